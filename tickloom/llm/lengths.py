"""Exact length histogram of encoded documents, with suffix sums.

Documents are aggregated by their number of tokens; every later answer comes from that histogram, which has
a row for each length that occurs, and never from the documents again. For each length the suffix sums give
how many documents and tokens are at least as long, and so the total that is left if every document is cut
at that length. The suffix sums are taken in two levels: within ranges of `RANGE` lengths, each in a window
of its own, and over the ranges' totals, of which there are at most the longest length / `RANGE`.

Defined results: null and empty texts have length 0; an empty table gives an empty histogram, and totals and
quantiles of nothing are null; repeated rows count as often as they stand there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import counted, rank_file
from .common import checkpointed, table

#: Lengths in a range.
RANGE = 1024


def histogram(lengths: DataFrame, col: str = "n_tokens") -> DataFrame:
    """length, n_docs: written to the shared folder, as it is read more than once and is small."""
    return checkpointed(lengths.groupBy(F.col(col).cast("long").alias("length")).agg(F.count("*").alias("n_docs")))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """The histogram with n_tokens, docs_at_least, tokens_at_least, docs_at_most, truncated_tokens, total_docs, total_tokens.

    docs_at_least and tokens_at_least are over documents of this length or more. truncated_tokens is the total
    if each document is cut after `length` tokens. A quantile q is the least length whose docs_at_most is q or
    more of total_docs.
    """
    h = hist.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("_range", F.floor(F.col("length") / RANGE))
    totals = h.groupBy("_range").agg(F.sum("n_docs").alias("_d"), F.sum("n_tokens").alias("_t"))
    above = W.orderBy(F.col("_range").desc()).rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = F.lit(0).cast("long")
    totals = totals.select("_range", F.coalesce(F.sum("_d").over(above), zero).alias("_docs_above"), F.coalesce(F.sum("_t").over(above), zero).alias("_tokens_above"), F.sum("_d").over(every).alias("total_docs"), F.sum("_t").over(every).alias("total_tokens"))
    within = W.partitionBy("_range").orderBy(F.col("length").desc())
    out = h.withColumn("_d", F.sum("n_docs").over(within)).withColumn("_t", F.sum("n_tokens").over(within)).join(totals, "_range")
    docs, tokens = F.col("_d") + F.col("_docs_above"), F.col("_t") + F.col("_tokens_above")
    return out.select(
        "length", "n_docs", "n_tokens", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"),
        (F.col("total_docs") - docs + F.col("n_docs")).alias("docs_at_most"),
        (F.col("total_tokens") - tokens + F.col("length") * docs).alias("truncated_tokens"), "total_docs", "total_tokens",
    )


def truncated_total(sums: DataFrame, limit: int) -> int | None:
    """Tokens left if every document is cut after `limit` tokens; null if there are no documents."""
    row = sums.filter(F.col("length") > limit).agg(F.max("docs_at_least").alias("d"), F.max("tokens_at_least").alias("t")).first()
    total = sums.agg(F.max("total_tokens").alias("n")).first()["n"]
    return total if row["d"] is None else total - row["t"] + limit * row["d"]


def quantile(sums: DataFrame, q: float) -> int | None:
    """The least length that a share q of the documents doesn't exceed; null if there are no documents."""
    return sums.filter(F.col("docs_at_most") >= F.lit(q) * F.col("total_docs")).agg(F.min("length").alias("n")).first()["n"]


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(histogram(counted(table(spark, sf_dir, "documents"), *rank_file())))
