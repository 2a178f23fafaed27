"""Accounts that belong together, and opposing trades between them.

The rule is ours: traders and accounts are related if a trade names both, and so are all that can be reached that way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .enrichment import small


def _stored(df: DataFrame, at: str) -> DataFrame:
    """Write df and go on from there, so that a lost executor costs no round before."""
    to = f"{at}/{uuid.uuid4().hex}"
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def groups(links: DataFrame, at: str) -> DataFrame:
    """node, grp (the least node that can be reached) of every node. links: a, b; at: a shared folder for the rounds.

    Each round hands every node the least group around it and then follows groups to their own group, so that long chains
    halve. Both are aggregates and joins; a node with very many links is summed up before the shuffle.
    """
    both = _stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), at)
    now = _stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("grp")), at)
    while True:
        of = lambda c, d=now: d.select(F.col("node").alias(c), F.col("grp").alias(f"{c}_grp"))
        near = both.join(of("b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("b_grp").alias("near"))
        step = now.join(near, "node").select("node", F.col("grp").alias("old"), F.least("grp", "near").alias("grp"))
        # A group's own node may have found a lesser one: follow it.
        jump = step.select(F.col("node").alias("grp"), F.col("grp").alias("far"))
        found = step.join(jump, "grp").select("node", "old", F.least("grp", "far").alias("grp"))
        # What a member has found holds for its whole old group.
        lesser = found.groupBy("old").agg(F.min("grp").alias("best"))
        after = _stored(found.join(lesser, "old").select("node", "old", F.least("grp", "best").alias("grp")), at)
        if not after.filter("grp <> old").limit(1).count():
            return after.select("node", "grp")
        now = after.select("node", "grp")


def related_wash_trades(trades: DataFrame, window_ms: int, at: str) -> DataFrame:
    """Buys with a sell of the same ticker by a related trader or account within window_ms: the nearest, the earlier of two as near.

    Time is cut into ranges of the window's length, and a sell stands in its own range and both beside it, so that a group
    with a third of all trades is spread out by time. Within a range both frames only grow. A trade's trader and account are in one
    group, so its account tells it; accounts are few where traders are many. Of a sell only time and id are handed out.
    """
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c))
    found = groups(trades.select(node("trader", "traderId").alias("a"), node("account", "accountId").alias("b")).distinct(), at)
    of_account = found.filter(F.startswith("node", F.lit("account:"))).select(F.substring("node", len("account:") + 1, 1 << 30).alias("accountId"), "grp")
    d = trades.join(small(of_account), "accountId").select(*trades.columns, "grp")
    part = F.floor(F.col("event_ms") / window_ms)
    buys = d.filter("side = 'BUY'").withColumn("_part", part)
    told = ("ticker", "event_ms", "tradeId", "side", "grp")
    sells = d.filter("side = 'SELL'").select(*[c if c in told else F.lit(None).cast(d.schema[c].dataType).alias(c) for c in d.columns])
    sells = sells.withColumn("_part", F.explode(F.array(part - 1, part, part + 1)))
    own = W.partitionBy("grp", "ticker", "_part")
    there = own.orderBy("event_ms", "tradeId").rowsBetween(W.unboundedPreceding, -1)
    back = own.orderBy(F.col("event_ms").desc(), F.col("tradeId").desc()).rowsBetween(W.unboundedPreceding, -1)
    sell = F.when(F.col("side") == "SELL", F.struct(F.col("event_ms").alias("ms"), F.col("tradeId").alias("id")))
    both = buys.unionByName(sells).withColumns({"_b": F.last(sell, ignorenulls=True).over(there), "_a": F.last(sell, ignorenulls=True).over(back)})
    before, after = F.col("event_ms") - F.col("_b.ms"), F.col("_a.ms") - F.col("event_ms")
    hit = both.filter("side = 'BUY'").withColumn("gapMs", F.least(before, after)).filter(F.col("gapMs") <= window_ms)
    return hit.withColumn("sellTradeId", F.when(after.isNull() | (before <= after), F.col("_b.id")).otherwise(F.col("_a.id"))).drop("_b", "_a", "_part")
