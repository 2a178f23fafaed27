"""Live enrichment: trades as a stream, joined to the market state as it is when they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.enrichment import at_latest, enriched
from .failures import attempted, given_up


def enrich_batch(state: Callable[[], DataFrame | None], instruments: Callable[[], DataFrame], out: str, misses: str, attempts_at: str | None = None, attempts: int = 3, first_s: float = 0.1) -> Callable[[DataFrame, int], None]:
    """foreachBatch function. A batch that is run again overwrites its own folders, so each trade stands there once.

    state and instruments are asked anew for each batch and nothing of them is kept; without a state all trades are misses.
    With a column vwap in the state trades get it as vwap5Min. enrichmentLatencyMs is the time from production to now.

    attempts_at: trades that miss something are tried again, up to `attempts` times in all, with the state as it is then, while
    the others go on; what is kept there outlives a restart. The misses then tell retryCount, firstFailureMs and lastFailureMs.
    """

    def once(trades: DataFrame) -> tuple[DataFrame, DataFrame]:
        now_known = state()
        if now_known is None:
            now_known = trades.sparkSession.createDataFrame([], "ticker string, bid double, ask double, event_ms long, vwap double")
        good, bad = enriched(at_latest(trades, now_known), instruments())
        if "vwap" in good.columns:
            good, bad = good.withColumnRenamed("vwap", "vwap5Min"), bad.withColumnRenamed("vwap", "vwap5Min")
        return good, bad

    def attempt(trades: DataFrame, number: int) -> DataFrame:
        good, bad = once(trades)
        done = good.withColumns({"failure": F.lit(None).cast("string"), "again": F.lit(False)})
        return done.unionByName(bad.withColumn("again", F.lit(True)), allowMissingColumns=True)

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if attempts_at:
                rounds = attempted(batch, f"{attempts_at}/batch={batch_id}", ["tradeId"], attempt, attempts, first_s)
                good = rounds.filter("failure is null").drop("failure", "again", "attempt", "attempted_ms")
                bad = batch.join(given_up(rounds, ["tradeId"]), "tradeId")
            else:
                good, bad = once(batch)
            now = F.unix_millis(F.current_timestamp())
            good.withColumns({"enrichedAtMs": now, "enrichmentLatencyMs": now - F.col("produced_ms")}).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            bad.write.mode("overwrite").parquet(f"{misses}/batch={batch_id}")
        finally:
            batch.unpersist()

    return run


def enrichment_stream(trades: DataFrame, state: Callable[[], DataFrame | None], instruments: Callable[[], DataFrame], out: str, misses: str, checkpoint: str, attempts_at: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Start it. trades: ticker, price, event_ms, produced_ms and any more; state: as `market.market_now` gives it."""
    return trades.writeStream.foreachBatch(enrich_batch(state, instruments, out, misses, attempts_at)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
