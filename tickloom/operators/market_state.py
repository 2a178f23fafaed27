"""Market state: monotone latest tick, offset-guarded rolling volume-weighted average price.

Two guards are independent: a tick that is too old for the latest state still adds its volume, and a redelivered
offset adds nothing even if its event time is new. Both are running maxima per ticker in delivery order (`seq`).

The window keeps the buckets of `retain` seconds before the newest accepted bucket. Pruning is done by each
accepted tick, so a bucket survives if no accepted tick at or after it, in delivery order, is ahead by more.
Bucket and retention are parameters; the defaults hold 31 buckets in a dense feed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordered import max_before, max_from
from ..functions.scalars import event_bucket, turnover

BUCKET_S, RETAIN_S = 10, 300


def outcomes(ticks: DataFrame, span: int | None = None) -> DataFrame:
    """ticks with `outcome`: APPLIED if newer than all before it for the ticker, DUPLICATE if as new, else OLDER."""
    d = max_before(ticks, ["ticker"], "seq", F.col("event_ms"), "_prev", span)
    new = F.col("_prev").isNull() | (F.col("event_ms") > F.col("_prev"))
    return d.withColumn("outcome", F.when(new, "APPLIED").when(F.col("event_ms") == F.col("_prev"), "DUPLICATE").otherwise("OLDER")).drop("_prev")


def latest(ticks: DataFrame) -> DataFrame:
    """The tick of each ticker with the greatest event time, the first delivered of equals: an aggregate, no window."""
    cols = ["bid", "ask", "last", "volume", "event_ms", "offset", *[c for c in ("produced_ms", "correlationId") if c in ticks.columns]]
    best = F.max_by(F.struct(*cols), F.struct("event_ms", -F.col("seq"))).alias("t")
    return ticks.groupBy("ticker").agg(best).select("ticker", *[f"t.{c}" for c in cols])


def accepted(ticks: DataFrame, span: int | None = None) -> DataFrame:
    """ticks with `accepted`: the offset is above all offsets before it for the ticker."""
    d = max_before(ticks, ["ticker"], "seq", F.col("offset"), "_top", span)
    return d.withColumn("accepted", F.col("_top").isNull() | (F.col("offset") > F.col("_top"))).drop("_top")


def surviving(ticks: DataFrame, bucket_s: int = BUCKET_S, retain_s: int = RETAIN_S, span: int | None = None) -> DataFrame:
    """Accepted ticks whose bucket has not been pruned by the end of the input, with `bucket` (seconds)."""
    d = accepted(ticks, span).filter("accepted").drop("accepted").withColumn("bucket", event_bucket(F.col("event_ms"), bucket_s))
    d = max_from(d, ["ticker"], "seq", F.col("bucket"), "_ahead", span)
    return d.filter(F.col("bucket") >= F.col("_ahead") - retain_s).drop("_ahead")


def window_buckets(ticks: DataFrame, bucket_s: int = BUCKET_S, retain_s: int = RETAIN_S, span: int | None = None) -> DataFrame:
    """ticker, bucket, pv (decimal: an exact sum), v of the buckets that are left."""
    return surviving(ticks, bucket_s, retain_s, span).groupBy("ticker", "bucket").agg(F.sum(turnover(F.col("last"), F.col("volume"))).alias("pv"), F.sum(F.col("volume").cast("double")).alias("v"))


def vwap(buckets: DataFrame, horizon_s: int = RETAIN_S) -> DataFrame:
    """ticker, vwap, n_buckets over the buckets in the reader's horizon; null at volume 0 (the rule is ours)."""
    # A ticker has few buckets, so its newest is found in a window over them and nothing is computed twice.
    live = buckets.withColumn("_newest", F.max("bucket").over(W.partitionBy("ticker"))).filter(F.col("bucket") > F.col("_newest") - horizon_s)
    return live.groupBy("ticker").agg((F.sum("pv").cast("double") / F.nullif(F.sum("v"), F.lit(0.0))).alias("vwap"), F.count("*").alias("n_buckets"))


def rebuilt(log: DataFrame, bucket_s: int = BUCKET_S, retain_s: int = RETAIN_S, horizon_s: int = RETAIN_S, span: int | None = None) -> DataFrame:
    """Both outputs from the whole log, from its first offset on: each ticker's latest tick, with vwap and n_buckets.

    A log that has been replayed gives what it gave at first: a replayed tick is older or a duplicate for the
    latest state, and its offset adds nothing to the window.
    """
    return latest(log).join(vwap(window_buckets(log, bucket_s, retain_s, span), horizon_s), "ticker", "left")


def outcome_counts(ticks: DataFrame, span: int | None = None) -> DataFrame:
    """Counters: stale writes by reason, and ticks whose volume the offset guard skipped."""
    d = accepted(outcomes(ticks, span), span)
    n = lambda c: F.count_if(c)
    return d.agg(n(F.col("outcome") == "APPLIED").alias("applied"), n(F.col("outcome") == "DUPLICATE").alias("stale_duplicate"), n(F.col("outcome") == "OLDER").alias("stale_older"), n(~F.col("accepted")).alias("window_skipped"))


def freshness(ticks: DataFrame, now_ms: Column) -> DataFrame:
    """ticker, age_seconds of the latest state: gauges that only applied ticks move."""
    return latest(ticks).select("ticker", ((now_ms - F.col("event_ms")) / F.lit(1000.0)).alias("age_seconds"))
