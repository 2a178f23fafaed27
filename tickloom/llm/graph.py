"""Connected components of a graph of any size, by rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(pairs: DataFrame, own: bool) -> DataFrame:
    """Link what surrounds each `u` to the least of it. own: link u as well (small-star)."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = pairs.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if own:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node of it) of every node that has a link. links: a, b (long).

    A node with very many links is never gathered: its least neighbour is an aggregate that starts on the map
    side, and its links are joined to that, a join whose large partitions Spark splits.
    """
    keep, turn, before = Scratch(links.sparkSession), 0, None
    edges = keep(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges-0")
    while True:  # large-star and small-star settle in O(log^2) rounds
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        turn += 1
        edges = keep(_star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), True), f"edges-{turn}")
        keep.drop_but(f"edges-{turn}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
