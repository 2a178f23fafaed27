"""Offsets as sets of intervals, which are merged block by block.

A topic partition's offsets are cut into blocks of `BLOCK`. Of each block its runs of present offsets are kept, so that days of
archive are put together by merging the blocks they have in common, without reading what was archived before; no task
holds a topic partition, only its blocks. Merging is associative, and what comes again is counted as it is merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 4096
KEY = ["topic", "partition", "block"]
RUNS = "array<struct<first:bigint,last:bigint>>"


def joined(runs: Column) -> Column:
    """Sorted runs with those put together that overlap or touch."""

    def add(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        put = F.struct(last["first"].alias("first"), F.greatest(last["last"], r["last"]).alias("last"))
        touches = (F.size(acc) > 0) & (r["first"] <= F.try_element_at(acc, F.lit(-1))["last"] + 1)
        return F.when(touches, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(put))).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(F.array_sort(runs), F.array().cast(RUNS), lambda acc, r: add(acc, r).cast(RUNS))


def size(runs: str | Column) -> Column:
    """How many offsets lie in the runs."""
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)


def blocks(records: DataFrame) -> DataFrame:
    """topic, partition, block, runs, duplicates of records with coordinates. A block gathers BLOCK different offsets at most."""
    each = records.groupBy("topic", "partition", "offset").agg(F.count("*").alias("n"))
    d = each.groupBy("topic", "partition", F.floor(F.col("offset") / BLOCK).alias("block"))
    d = d.agg(F.collect_list(F.struct(F.col("offset").alias("first"), F.col("offset").alias("last"))).alias("runs"), F.sum(F.col("n") - 1).alias("duplicates"))
    return d.select(*KEY, joined(F.col("runs")).alias("runs"), "duplicates")


def merged(one: DataFrame, two: DataFrame) -> DataFrame:
    """The blocks of both; an offset that both have counts as a duplicate. Blocks that only `one` has are left out."""
    had = one.select(*KEY, F.col("runs").alias("had"), F.col("duplicates").alias("had_duplicates"))
    d = two.join(had, KEY, "left").withColumn("both", joined(F.concat("runs", F.coalesce("had", F.array().cast(RUNS)))))
    again = size("runs") + F.coalesce(size("had"), F.lit(0)) - size("both")
    return d.select(*KEY, F.col("both").alias("runs"), (F.col("duplicates") + F.coalesce("had_duplicates", F.lit(0)) + again).alias("duplicates"))


def coverage(of: DataFrame) -> DataFrame:
    """As `archive.coverage`, from blocks."""
    first, last = F.element_at("runs", 1)["first"], F.element_at("runs", -1)["last"]
    d = of.groupBy("topic", "partition").agg(F.min(first).alias("expectedFirstOffset"), F.max(last).alias("expectedLastOffset"), F.sum(size("runs")).alias("archivedRecordCount"), F.sum("duplicates").alias("duplicateCount"))
    d = d.withColumn("missingCount", F.col("expectedLastOffset") - F.col("expectedFirstOffset") + 1 - F.col("archivedRecordCount"))
    return d.withColumn("status", F.when(F.col("missingCount") > 0, "FAIL").when(F.col("duplicateCount") > 0, "WARNING").otherwise("PASS"))


def missing_ranges(of: DataFrame) -> DataFrame:
    """First and last of each run of offsets that is missing. The window goes over blocks, of which there are few, not over records."""
    first, last = F.element_at("runs", 1)["first"], F.element_at("runs", -1)["last"]
    before = F.lag(last).over(W.partitionBy("topic", "partition").orderBy("block"))
    gap = lambda a, z: F.struct((a + 1).alias("firstMissing"), (z - 1).alias("lastMissing"))
    inside = F.transform(F.sequence(F.lit(1), F.size("runs") - 1), lambda k: gap(F.element_at("runs", k)["last"], F.element_at("runs", k + 1)["first"]))
    inside = F.when(F.size("runs") > 1, inside).otherwise(F.array().cast("array<struct<firstMissing:bigint,lastMissing:bigint>>"))
    d = of.withColumn("gaps", F.concat(F.array(gap(before, first)), inside))
    return d.select("topic", "partition", F.inline("gaps")).filter("firstMissing <= lastMissing")
