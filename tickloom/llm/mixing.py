"""Temperature mixing of sources to target weights, realised as budgeted block permutations.

A source's share of all tokens, to the power a, gives its weight: a = 1 keeps the shares, a = 0 makes all
sources equal. a is bisected: with a repetition limit it is the least a with which no source is seen more than
`max_epochs` times; with a target entropy it is the greatest a whose weights have that entropy. The budget is
the number of tokens to draw; by default it is the least with which every source is seen whole once, so that
mixing repeats small sources but drops nothing.

A source is then seen budget * weight / tokens times. Its whole passes hold every document once, each pass in
the order of its own hash; the part of a pass that is left holds the documents that come first by one more
hash, until the source's budget is spent: that cut is found from sums over `CELLS` hash ranges, and only the
range where the budget ends is put in order. `position` runs from 0 to 1 over a source's whole budget, and
`block` cuts all positions into equal parts, so each block holds every source by its weight.

There may be any number of sources. The driver only gets sums over them, for a few exponents at once; the table of
one row for each source is broadcast up to `BROADCAST` bytes and joined by source beyond, where Spark splits large
sources.

Defined results: tokens are counted by `tokens`, a Column, here runs of characters that aren't white space;
null texts have none; a source without tokens has weight 0 and is seen once; null is a source of its own;
repeated rows are drawn each for itself; an empty table gives an empty result; columns of the input that
clash with those added are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, packed, restored, table

#: Hash ranges of a source, whose sums are added up in two levels; rows of one range are put in order by one task.
CELLS, FINE = 65_536, 256
#: Bytes of the sources' plan that are broadcast at most, and what one source takes beside its name.
BROADCAST, PLAN_ROW = 16 << 20, 96


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(tokens: list[int], a: float) -> list[float]:
    """Weights of sources with so many tokens."""
    total = sum(tokens) or 1
    raw = [(t / total) ** a if t else 0.0 for t in tokens]
    return [x / (sum(raw) or 1) for x in raw]


def whole_budget(tokens: list[int], weights: list[float]) -> float:
    """Least budget with which every source is seen whole."""
    return max((t / w for t, w in zip(tokens, weights, strict=True) if w), default=0.0)


def entropy_of(powers: tuple[float, float], a: float) -> float:
    """Entropy of the weights of exponent a. powers: the sums of p ** a and of p ** a * ln p over all shares p."""
    return math.log(powers[0]) - a * powers[1] / powers[0]


def bisected(sums: Callable[[list[float]], list[tuple[float, float]]], total: int, least: int, most: int, max_epochs: float | None, target_entropy: float | None, budget: float | None) -> float:
    """The exponent, from sums over all sources with tokens alone. sums: `powers` of each of a few exponents.

    A source's tokens t have weight (t / total) ** a / powers[0], so for a up to 1 the smallest source is seen most
    often, and the largest needs the greatest budget. [0, 1] is halved four times for each call of `sums`.
    """

    def flat_enough(a: float, powers: tuple[float, float]) -> bool:
        if target_entropy is not None:
            return entropy_of(powers, a) >= target_entropy
        if budget is None:
            return (most / least) ** (1 - a) > max_epochs
        return budget * (least / total) ** a / powers[0] / least > max_epochs

    def flat(points: list[float]) -> list[bool]:
        unread = target_entropy is None and budget is None
        return [flat_enough(a, x) for a, x in zip(points, [(0.0, 0.0)] * len(points) if unread else sums(points), strict=True)]

    at_0, at_1 = flat([0.0, 1.0])
    if at_1 or not at_0:
        return 1.0 if at_1 else 0.0
    low, high = 0.0, 1.0
    for _ in range(15):
        points = [low + (high - low) * k / 16 for k in range(17)]
        known = flat(points[1:-1])
        x, y = 0, 16
        while y - x > 1:
            mid = (x + y) // 2
            x, y = (mid, y) if known[mid - 1] else (x, mid)
        low, high = points[x], points[y]
    return low if target_entropy is not None else high


def exponent(tokens: list[int], max_epochs: float | None = None, target_entropy: float | None = None, budget: float | None = None) -> float:
    """The exponent in [0, 1] that meets the repetition limit or the target entropy as closely as any can."""
    some = [t for t in tokens if t]
    if not some:
        return 1.0
    total = sum(some)

    def sums(points: list[float]) -> list[tuple[float, float]]:
        return [(sum((t / total) ** a for t in some), sum((t / total) ** a * math.log(t / total) for t in some)) for a in points]

    return bisected(sums, total, min(some), max(some), max_epochs, target_entropy, budget)


def epochs_of(sizes: DataFrame, max_epochs: float | None, target_entropy: float | None, budget: float | None) -> DataFrame:
    """sizes (source, t) with full (whole passes), rest (tokens of the last one) and epochs, whatever the number of sources."""
    some = sizes.filter("t > 0")
    facts = some.agg(F.sum("t").alias("total"), F.min("t").alias("least"), F.max("t").alias("most")).first()
    total, least, most = facts["total"], facts["least"], facts["most"]
    seen = F.lit(1.0)
    if total:
        share = F.col("t") / F.lit(float(total))

        def sums(points: list[float]) -> list[tuple[float, float]]:
            power = [F.pow(share, F.lit(a)) for a in points]
            row = some.agg(*[x for p in power for x in (F.sum(p), F.sum(p * F.log(share)))]).first()
            return list(zip(row[::2], row[1::2], strict=True))

        a = bisected(sums, total, least, most, max_epochs, target_entropy, budget)
        norm = sums([a])[0][0]
        whole = most / ((most / total) ** a / norm) if budget is None else budget
        seen = F.when(F.col("t") > 0, F.lit(whole) * (F.pow(share, F.lit(a)) / F.lit(norm)) / F.col("t")).otherwise(1.0)
    out = sizes.withColumn("epochs", seen).withColumn("full", F.floor(F.col("epochs") + 1e-9).cast("int"))
    rest = F.greatest(F.lit(0).cast("long"), F.rint((F.col("epochs") - F.col("full")) * F.col("t")).cast("long"))
    return out.withColumn("rest", rest).withColumn("epochs", F.greatest("epochs", F.lit(1e-12)))


def ending(parts: DataFrame, needs: DataFrame) -> DataFrame:
    """source, rest, at, had: the part in which a source's rest ends, and what comes before it. needs: source, rest, before."""
    upto = F.col("before") + F.sum("t").over(W.partitionBy("source").orderBy("at"))
    found = parts.join(needs, "source").withColumn("upto", upto).withColumn("had", F.col("upto") - F.col("t"))
    return found.filter("had < rest and upto >= rest").select("source", "rest", "at", "had")


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def drawn(docs: DataFrame, tokens: Column | None = None, source: str = "source", key: str = "doc_id", max_epochs: float | None = 2.0, target_entropy: float | None = None, budget: float | None = None, n_blocks: int = 64, seed: int = 0) -> DataFrame:
    """Each row of docs (caller_0 and so on) as often as it is drawn, with tokens, epoch, position (0 to 1) and block."""
    spark, callers = docs.sparkSession, [f"caller_{k}" for k in range(len(docs.columns))]
    unit = lambda *x: F.pmod(F.xxhash64(F.lit(seed), F.col("key"), *x), F.lit(1 << 52)) / F.lit(float(1 << 52))
    named = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    d = docs.select(*packed(docs), F.col(key).alias("key"), named.alias("source"), (tokens if tokens is not None else words()).alias("tokens"))
    d = d.withColumn("cut", unit(F.lit("cut"))).withColumn("cell", F.floor(F.col("cut") * CELLS).cast("int"))
    cells = checkpointed(d.groupBy("source", "cell").agg(F.sum("tokens").alias("t")))
    ends = checkpointed(epochs_of(cells.groupBy("source").agg(F.sum("t").alias("t")), max_epochs, target_entropy, budget).drop("t"))
    # The hash range of each source in which its last, partial pass ends, and what the ranges before it hold.
    coarse = ending(cells.groupBy("source", F.floor(F.col("cell") / FINE).alias("at")).agg(F.sum("t").alias("t")), ends.select("source", "rest", F.lit(0).cast("long").alias("before")))
    fine = cells.withColumn("coarse", F.floor(F.col("cell") / FINE)).join(coarse.select("source", F.col("at").alias("coarse")), ["source", "coarse"])
    cut = ending(fine.select("source", F.col("cell").alias("at"), "t"), coarse.select("source", "rest", F.col("had").alias("before")))
    cut = cut.select("source", F.col("at").alias("edge"), "had")
    plan = checkpointed(ends.join(cut, "source", "left").na.fill({"edge": -1, "had": 0}))
    size = plan.agg(F.sum(F.octet_length("source") + PLAN_ROW).alias("n")).first()["n"] or 0
    marked = d.join(F.broadcast(plan) if size <= BROADCAST else plan, "source")
    # Whole passes, and the partial pass where it is sure to hold the document.
    inner = marked.withColumn("n", F.col("full") + (F.col("cell") < F.col("edge")).cast("int")).filter("n > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    ahead = F.sum("tokens").over(W.partitionBy("source").orderBy("cut", "key", F.xxhash64(*callers)).rowsBetween(W.unboundedPreceding, -1))
    last = marked.filter("cell = edge").withColumn("ahead", F.coalesce(ahead, F.lit(0))).filter("had + ahead < rest").withColumn("epoch", F.col("full"))
    both = inner.drop("n").unionByName(last.drop("ahead"))
    # In the partial pass the documents by the cutting hash fill what is left of the budget evenly.
    share = F.when(F.col("epoch") < F.col("full"), F.col("epoch") + unit(F.col("epoch"))).otherwise(F.col("full") + unit(F.lit("last")) * (F.col("epochs") - F.col("full")))
    both = both.withColumn("position", F.least(share / F.col("epochs"), F.lit(1.0))).withColumn("block", F.least(F.floor(F.col("position") * n_blocks), F.lit(n_blocks - 1)).cast("int"))
    return both.select(*callers, "tokens", "epoch", "position", "block")


def mix(docs: DataFrame, *args, **kwargs) -> DataFrame:
    """docs, a row as often as it is drawn, with tokens, epoch, position (0 to 1) and block; arguments as of `drawn`."""
    return restored(drawn(docs, *args, **kwargs), docs.columns, "tokens", "epoch", "position", "block")


def repeated(docs: DataFrame, *args, **kwargs) -> DataFrame:
    """docs, a row as often as it is drawn, and nothing else."""
    return restored(drawn(docs, *args, **kwargs), docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "tokens", "epoch", "position", "block")
