"""Trades enriched with the market as it was at their execution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import market_cap, mid_price, price_deviation, spread, turnover

MISS = "REFERENCE_DATA_UNAVAILABLE"
#: A dimension is broadcast up to this size by the plan's statistics, or up to so many rows.
BROADCAST_BYTES, BROADCAST_ROWS = 32 << 20, 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if its size is checked to be within bounds; else the join is left to Spark. Nothing is kept.

    Statistics don't know that an aggregate has few rows, so what is large by them is counted: cheaper than to exchange the other side.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= BROADCAST_BYTES:
        return F.broadcast(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Ranges over which trades are dealt that come after all ticks.
AFTER = 4


def as_of(trades: DataFrame, ticks: DataFrame, horizon_ms: int = 300_000, span_ms: int | None = None) -> DataFrame:
    """trades with bid, ask, tick_ms and vwap of the last tick at or before them; null where there is none.

    Ticks are summed by ticker and millisecond; they and the trades are one stream in event order, in which each
    trade takes the last tick before it, and the horizon's sums as the difference of two running sums: one exchange,
    one sort, and frames that only grow, so the cost is linear in the rows. A tick of the trade's own millisecond
    counts. vwap is over the ticks of the horizon, up to the trade; its sums are exact.

    With a span (longer than the horizon) each ticker is cut into ranges of time, so a hot ticker is spread out: a range also
    holds the ticks that trades at its beginning look back to, and the last tick before it, which goes on to each range up to
    the ticker's next tick. So trades are read once; the ticks that are carried are tickers x ranges at most. Trades more than a
    range after the last of all ticks have nothing in their horizon; they need that tick alone and share `AFTER` ranges a ticker.
    """
    if span_ms is not None and span_ms <= horizon_ms:
        raise ValueError("a range of time must be longer than the horizon")
    part = lambda ms: F.lit(0).cast("long") if span_ms is None else F.floor(ms / span_ms).cast("long")
    own = part(F.col("event_ms"))
    # Ticks of one millisecond apply first come, first kept.
    first = [F.min_by(c, "seq").alias(f"_{c}") for c in ("bid", "ask")]
    each = ticks.groupBy("ticker", "event_ms").agg(*first, F.sum(turnover(F.col("last"), F.col("volume"))).alias("_pv"), F.sum("volume").alias("_v"))
    each = each.select("ticker", "event_ms", F.struct(F.col("_bid").alias("bid"), F.col("_ask").alias("ask"), F.col("event_ms").alias("tick_ms")).alias("_tick"), "_pv", "_v")
    cols = [c for c in trades.columns if c not in ("ticker", "event_ms")]
    kind = trades.select(F.struct(*cols)).schema[0].dataType
    none = lambda c: F.lit(None).cast(each.schema[c].dataType).alias(c)
    one = each.select("ticker", "event_ms", own.alias("_part"), "_tick", "_pv", "_v", F.lit(None).cast(kind).alias("_trade"))
    of = own
    if span_ms is not None:
        newest = ticks.agg(F.max("event_ms")).first()[0] or 0
        after = newest // span_ms + 2
        of = F.when(own < after, own).otherwise(F.lit(after) + F.pmod(own, F.lit(AFTER)))
        by_part = W.partitionBy("ticker").orderBy("_part")
        tops = each.groupBy("ticker", own.alias("_part")).agg(F.max_by("_tick", "event_ms").alias("_tick")).withColumn("_until", F.coalesce(F.lead("_part").over(by_part), F.lit(after + AFTER - 1)))
        tops = tops.withColumn("_part", F.explode(F.sequence(F.col("_part") + 1, "_until")))
        carried = tops.select("ticker", F.col("_tick.tick_ms").alias("event_ms"), "_part", "_tick", none("_pv"), none("_v"), F.lit(None).cast(kind).alias("_trade"))
        ahead = part(F.col("event_ms") + horizon_ms)
        one = one.unionByName(one.filter(ahead > F.col("_part")).withColumn("_part", F.col("_part") + 1)).unionByName(carried)
    two = trades.select("ticker", "event_ms", of.cast("long").alias("_part"), *[none(c) for c in ("_tick", "_pv", "_v")], F.struct(*cols).alias("_trade"))
    by_time = W.partitionBy("ticker", "_part").orderBy("event_ms")
    now, before = by_time.rangeBetween(W.unboundedPreceding, 0), by_time.rangeBetween(W.unboundedPreceding, -horizon_ms - 1)
    within = lambda c: F.sum(c).over(now) - F.coalesce(F.sum(c).over(before), F.lit(0))
    d = one.unionByName(two).withColumns({"_tick": F.last("_tick", ignorenulls=True).over(now), "_spv": within("_pv"), "_sv": within("_v")}).filter("_trade is not null")
    d = d.withColumn("vwap", F.col("_spv").cast("double") / F.nullif(F.col("_sv").cast("double"), F.lit(0.0)))
    return d.select("ticker", "event_ms", "_trade.*", "_tick.*", "vwap")


def at_latest(trades: DataFrame, latest: DataFrame) -> DataFrame:
    """trades with the market state as it is now (the live rule)."""
    state = latest.select("ticker", "bid", "ask", F.col("event_ms").alias("tick_ms"), *[c for c in ("vwap",) if c in latest.columns])
    return trades.join(small(state), "ticker", "left")


def enriched(quoted: DataFrame, instruments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(enriched trades, misses with `failure`). A trade without a tick or an instrument isn't passed on with nulls.

    A ticker may carry several instruments; the one with the least instrumentId stands for it.
    """
    one = instruments.groupBy("ticker").agg(F.min_by("sharesOutstanding", "instrumentId").alias("sharesOutstanding"))
    d = quoted.join(small(one), "ticker", "left")
    mid = mid_price("bid", "ask")
    good = d.filter("tick_ms is not null and sharesOutstanding is not null")
    bad = d.filter("tick_ms is null or sharesOutstanding is null").withColumn("failure", F.lit(MISS))
    return good.withColumns({"mid": mid, "spread": spread("bid", "ask"), "marketCap": market_cap(F.col("sharesOutstanding"), F.col("price")), "deviation": price_deviation(F.col("price"), mid), "dataAgeMs": F.col("event_ms") - F.col("tick_ms")}), bad
