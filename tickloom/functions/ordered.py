"""Running extremes in delivery order that don't need all rows of a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def even_span(df: DataFrame, order: str, rows: int = 2_000_000) -> int:
    """A span that cuts the rows into ranges of about so many, if they are spread evenly over their order."""
    r = df.agg(F.min(order).alias("a"), F.max(order).alias("z"), F.count("*").alias("n")).first()
    return max(1, -(-(r["z"] - r["a"] + 1) // max(1, -(-r["n"] // rows)))) if r["n"] else 1


def ranged(df: DataFrame, order: str, span: int | None) -> DataFrame:
    """df with `_part`, the range of `span` in which a row's order lies; None: one range for each key."""
    return df.withColumn("_part", F.lit(0).cast("long") if span is None else F.floor(F.col(order) / span).cast("long"))


def _carried(df: DataFrame, key: list[str], value: Column, name: str, forward: bool) -> DataFrame:
    """df with `name`: the maximum over the ranges of the key before (or after) a row's own."""
    sums = df.groupBy(*key, "_part").agg(F.max(value).alias("_top"))
    w = W.partitionBy(*key).orderBy(F.col("_part") if forward else F.col("_part").desc()).rowsBetween(W.unboundedPreceding, -1)
    return df.join(sums.select(*key, "_part", F.max("_top").over(w).alias(name)), [*key, "_part"], "left")


def max_before(df: DataFrame, key: list[str], order: str, value: Column, out: str, span: int | None = None) -> DataFrame:
    """df with `out`: the maximum of value over the key's earlier rows, null for none.

    With a span, a key's rows are cut into ranges of order. Each range has its own window, and the maxima of the
    ranges before it, of which there are few, are carried in; so a key with a third of all rows is spread out.
    """
    within = F.max(value).over(W.partitionBy(*key, "_part").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    if span is None:
        return df.withColumn(out, F.max(value).over(W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)))
    d = _carried(ranged(df, order, span), key, value, "_carried", True)
    return d.withColumn(out, F.greatest(within, F.col("_carried"))).drop("_part", "_carried")


def max_from(df: DataFrame, key: list[str], order: str, value: Column, out: str, span: int | None = None) -> DataFrame:
    """df with `out`: the maximum of value over the row itself and the key's later rows.

    `order` must be unique within a key. The rows are gone through from the last on, so that frames only grow and the cost
    is linear; a frame that ends at the last row would be added up anew for each row.
    """
    back = lambda *by: W.partitionBy(*by).orderBy(F.col(order).desc()).rowsBetween(W.unboundedPreceding, 0)
    if span is None:
        return df.withColumn(out, F.max(value).over(back(*key)))
    within = F.max(value).over(back(*key, "_part"))
    d = _carried(ranged(df, order, span), key, value, "_carried", False)
    return d.withColumn(out, F.greatest(within, F.col("_carried"))).drop("_part", "_carried")


def numbered(df: DataFrame, key: list[str], order: str, out: str, span: int | None = None) -> DataFrame:
    """df with `out`: the row's number within its key from 0 on, in an order that is unique there.

    With a span, rows are numbered within ranges of order, and the counts of the ranges before, of which there are few, are added.
    """
    d = ranged(df, order, span)
    within = F.row_number().over(W.partitionBy(*key, "_part").orderBy(order)) - 1
    before = F.sum("_n").over(W.partitionBy(*key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    counts = d.groupBy(*key, "_part").agg(F.count("*").alias("_n")).select(*key, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return d.withColumn("_within", within).join(counts, [*key, "_part"]).withColumn(out, F.col("_within") + F.col("_before")).drop("_part", "_within", "_before")
