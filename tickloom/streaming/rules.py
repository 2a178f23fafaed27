"""Rules that change while trades flow: each trade meets the versions in force at its event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.risk import rule_ranges
from .versions import GONE, Files, Versions

RULE_TABLES = {"event": ["ruleId", "version", "state", "effective_ms"], "progress": ["log"]}
HELD_TABLES = {"trade": ["tradeId"]}


def rule_tables(spark: SparkSession, path: str) -> Versions:
    """Keeps many versions, as batches of trades go back to the one that they began with."""
    return Versions(spark, path, RULE_TABLES, keep=100)


def keep_rules(tables: Versions) -> Callable[[DataFrame, int], None]:
    """foreachBatch function over the rules' log. A row without a ruleId only says how far in time the log has come."""

    def run(batch: DataFrame, batch_id: int) -> None:
        before = tables.read("progress", tables.current(before=batch_id))
        came = batch.agg(F.max("effective_ms").alias("known_ms"))
        came = came if before is None else came.unionByName(before.select("known_ms")).agg(F.max("known_ms").alias("known_ms"))
        events = batch.filter("ruleId is not null").dropDuplicates(RULE_TABLES["event"])
        tables.publish(batch_id, {"event": events, "progress": came.select(F.lit("rules").alias("log"), "known_ms")})

    return run


def alert_batch(rules: Versions, held: Versions, out: str, decide: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """foreachBatch function over trades (tradeId, event_ms and more): decide(trades, rule ranges) gives what is written.

    Trades that are ahead of the rules' log are held back and come again with a later batch. A batch that is run again meets the
    version of the rules that it met at first, so no trade is decided twice or not at all.
    """
    files = Files(rules.spark, held.path)

    def run(batch: DataFrame, batch_id: int) -> None:
        mark = f"{held.path}/met/{batch_id:012d}"
        if not files.exists(mark):
            now = rules.current()
            files.appear(mark, str(-1 if now is None else now["number"]))
        number = int(files.read(mark))
        version = rules.numbered(number) if number >= 0 else None
        waiting = held.read("trade", held.current(before=batch_id))
        new = batch.withColumn("_new", F.lit(True))
        trades = new if waiting is None else new.unionByName(waiting.withColumn("_new", F.lit(False)))
        progress = rules.read("progress", version)
        known = progress.first()["known_ms"] if progress is not None else None
        is_known = F.lit(False) if known is None else F.col("event_ms") <= known
        trades = trades.persist()
        try:
            ready = trades.filter(is_known).drop("_new")
            if known is not None:
                decide(ready, rule_ranges(rules.read("event", version))).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            # New ones that must wait, and those that need wait no longer.
            changes = trades.filter(F.col("_new") != is_known).withColumn(GONE, ~F.col("_new")).drop("_new")
            held.publish(batch_id, {"trade": changes})
        finally:
            trades.unpersist()

    return run


def _started(rows: DataFrame, run, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def rule_stream(events: DataFrame, tables: Versions, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    return _started(events, keep_rules(tables), checkpoint, trigger)


def alert_stream(trades: DataFrame, rules: Versions, held: Versions, out: str, checkpoint: str, decide: Callable[[DataFrame, DataFrame], DataFrame], trigger: dict | None = None) -> StreamingQuery:
    return _started(trades, alert_batch(rules, held, out, decide), checkpoint, trigger)
