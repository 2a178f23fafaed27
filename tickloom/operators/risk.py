"""Risk rules by version in force, and the four alerts. Thresholds and windows are ours; the contract names none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordered import numbered
from .enrichment import small


def rule_ranges(events: DataFrame) -> DataFrame:
    """ruleId, version, threshold, from_ms, to_ms (exclusive, null: open) of the versions that were in force.

    Maker and checker must differ. A version begins with its ACTIVE event and ends when the next ACTIVE, RETIRED or
    REJECTED event of the rule takes effect.
    """
    fit = events.filter(F.col("state").isin("ACTIVE", "RETIRED", "REJECTED") & ((F.col("state") != "ACTIVE") | ~F.col("checkerSubject").eqNullSafe(F.col("makerSubject"))))
    w = W.partitionBy("ruleId").orderBy("effective_ms", "version")
    d = fit.withColumn("to_ms", F.lead("effective_ms").over(w))
    return d.filter(F.col("state") == "ACTIVE").select("ruleId", "ruleType", "version", "threshold", F.col("effective_ms").alias("from_ms"), "to_ms")


#: A tree of time: cells of an hour, each level's 16 times as long as the one's below; and the end of open ranges.
HOUR, FAN, LEVELS, END_MS = 3_600_000, 16, 6, 253_402_300_800_000


def cells_of(ranges: DataFrame) -> DataFrame:
    """ranges, once for each cell of the fewest that cover them: level and cell. At most 30 a level, but for the last."""
    end = F.coalesce("to_ms", F.lit(END_MS))
    low = [F.floor(F.col("from_ms") / HOUR)] + [F.ceil(F.col("from_ms") / (HOUR * FAN**k)) for k in range(1, LEVELS)]
    high = [F.ceil(end / HOUR)] + [F.floor(end / (HOUR * FAN**k)) for k in range(1, LEVELS)]
    lists = []
    for k in range(LEVELS):
        every = lambda a, z, k=k: F.when(z > a, F.transform(F.sequence(a, z - 1), lambda c: F.struct(F.lit(k).alias("level"), c.alias("cell")))).otherwise(F.array())
        if k + 1 < LEVELS:
            covered = low[k + 1] < high[k + 1]
            lists += [every(low[k], F.when(covered, low[k + 1] * FAN).otherwise(high[k])), F.when(covered, every(high[k + 1] * FAN, high[k])).otherwise(F.array())]
        else:
            lists.append(every(low[k], high[k]))
    return ranges.withColumn("_at", F.explode(F.concat(*lists))).select(*ranges.columns, "_at.level", "_at.cell")


def in_force(rows: DataFrame, ranges: DataFrame, rule_type: str, at: str = "event_ms", few: int = 32) -> DataFrame:
    """rows, once for each rule of the type that was in force at their time.

    Up to `few` ranges are broadcast and each row looks at all of them; more are joined on equal cells of time, of which each row
    looks at one for each level that the ranges have; the cells are broadcast as far as they are small.
    """
    mine = ranges.filter(F.col("ruleType") == rule_type)
    inside = (F.col(at) >= F.col("from_ms")) & (F.col("to_ms").isNull() | (F.col(at) < F.col("to_ms")))
    if mine.limit(few + 1).count() <= few:
        return rows.join(F.broadcast(mine), inside)
    cells = cells_of(mine)
    found = sorted(r["level"] for r in cells.select("level").distinct().collect())
    levels = F.array(*[F.struct(F.lit(k).alias("_level"), F.floor(F.col(at) / (HOUR * FAN**k)).alias("_cell")) for k in found or [0]])
    seen = rows.withColumn("_in", F.explode(levels))
    both = seen.join(small(cells), (F.col("_in._level") == F.col("level")) & (F.col("_in._cell") == F.col("cell")) & inside)
    return both.drop("_in", "level", "cell")


def price_deviation_alerts(enriched: DataFrame, ranges: DataFrame) -> DataFrame:
    return in_force(enriched, ranges, "PRICE_DEVIATION").filter(F.abs("deviation") > F.col("threshold"))


def position_limit_alerts(positions: DataFrame, ranges: DataFrame) -> DataFrame:
    return in_force(positions, ranges, "POSITION_LIMIT_BREACH", "asOfMs").filter(F.abs("netQuantity") > F.col("threshold"))


def unusual_volume_alerts(ticks: DataFrame, ranges: DataFrame, back: int = 20, span: int | None = None, block: int = 65_536) -> DataFrame:
    """Ticks whose volume is more than the threshold times the mean of the `back` ticks before them.

    A ticker's ticks are numbered and cut into blocks, each of which also holds the last `back` ticks before it; so a hot ticker is
    spread out, however its ticks lie in time.
    """
    if block < back:
        raise ValueError("a block must hold what its first ticks look back to")
    n = F.col("_at")
    d = numbered(ticks, ["ticker"], "seq", "_at", span).withColumn("_block", F.floor(n / block))
    ahead = d.filter(n % block >= block - back).withColumn("_block", F.col("_block") + 1)
    w = W.partitionBy("ticker", "_block").orderBy("_at").rowsBetween(-back, -1)
    d = d.withColumn("_own", F.lit(True)).unionByName(ahead.withColumn("_own", F.lit(False)))
    d = d.withColumns({"meanVolume": F.avg("volume").over(w), "_n": F.count("*").over(w)}).filter(F.col("_own") & (F.col("_n") == back))
    return in_force(d, ranges, "UNUSUAL_VOLUME").filter(F.col("volume") > F.col("threshold") * F.col("meanVolume")).drop("_n", "_at", "_block", "_own")


def wash_trades(trades: DataFrame, window_ms: int) -> DataFrame:
    """Buys with a sell of the same trader and ticker within window_ms: the nearest, before or after.

    One pass in event order and one against it find the last sell before and the first after each buy, so no pairs are
    made. Both frames only grow, so the cost is linear; tradeId is unique, so nothing is equal in this order.
    """
    own = W.partitionBy("traderId", "ticker")
    there = own.orderBy("event_ms", "tradeId").rowsBetween(W.unboundedPreceding, -1)
    back = own.orderBy(F.col("event_ms").desc(), F.col("tradeId").desc()).rowsBetween(W.unboundedPreceding, -1)
    sell = F.when(F.col("side") == "SELL", F.struct(F.col("event_ms").alias("ms"), F.col("tradeId").alias("id")))
    d = trades.withColumns({"_b": F.last(sell, ignorenulls=True).over(there), "_a": F.last(sell, ignorenulls=True).over(back)})
    before, after = F.col("event_ms") - F.col("_b.ms"), F.col("_a.ms") - F.col("event_ms")
    gap = F.least(before, after)
    d = d.filter("side = 'BUY'").withColumn("gapMs", gap).filter(F.col("gapMs") <= window_ms)
    return d.withColumn("sellTradeId", F.when(after.isNull() | (before <= after), F.col("_b.id")).otherwise(F.col("_a.id"))).drop("_b", "_a")
