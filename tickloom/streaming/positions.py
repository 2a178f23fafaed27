"""Positions as a stream, idempotent by trade."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .versions import Added, Versions

KEY = ["accountId", "traderId", "ticker"]
SUMS = ["grossBuyQuantity", "grossSellQuantity"]
TABLES = {"position": Added(KEY, SUMS)}


def added(trades: DataFrame) -> DataFrame:
    """What each trade adds to its position. They are summed when they are read or compacted, so a batch isn't exchanged by position."""
    of = lambda side: F.when(F.col("side") == side, F.col("quantity")).otherwise(0)
    return trades.select(*KEY, of("BUY").alias(SUMS[0]), of("SELL").alias(SUMS[1]), F.struct("event_ms", "seq", "tradeId", "price").alias("last"))


def update(tables: Versions) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: adds a batch's trades to the positions, however often it is run; only what it adds is written."""

    def run(batch: DataFrame, batch_id: int) -> None:
        tables.publish(batch_id, {"position": added(batch)})

    return run


def position_stream(trades: DataFrame, tables: Versions, checkpoint: str, within: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Start it. trades: tradeId, the position's key, side, quantity, price, event_ms, seq.

    A trade that comes again, in whichever batch, changes nothing: trade ids are kept as state, spread by id. within: keep
    them only so long (a trade's `timestamp` is its event time then), which bounds the state.
    """
    once = trades.withWatermark("timestamp", within).dropDuplicatesWithinWatermark(["tradeId"]) if within else trades.dropDuplicates(["tradeId"])
    return once.writeStream.foreachBatch(update(tables)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def snapshots(tables: Versions) -> DataFrame | None:
    """The positions of the last version."""
    d = tables.read("position", tables.current())
    if d is None:
        return None
    net = F.col(SUMS[0]) - F.col(SUMS[1])
    return d.select(*KEY, net.alias("netQuantity"), *SUMS, (net * F.col("last.price")).alias("marketValue"), F.col("last.event_ms").alias("asOfMs"), F.col("last.tradeId").alias("lastProcessedTradeId"))
