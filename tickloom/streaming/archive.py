"""The archive as a stream: decode, quarantine, let each record through once, write; offsets are committed after the write."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.scalars import CORRELATION_ID, correlation_id
from ..operators import manifests
from ..operators.archive import COORDINATES, classified, let_through, partition_columns, projected
from ..operators.dead_letters import dead_letters
from ..schemas import RECORD
from .failures import Attempt, Outage, attempted, chain, given_up, with_retry  # noqa: F401

#: Offsets of a topic partition whose state is one row: a bit each.
BLOCK = 4096
PASSED = "topic string, partition int, offset long, key string, value binary, timestamp timestamp, correlationId string, arrival long"


class RecentKeys(StatefulProcessor):
    """The last n offsets that a topic partition has let through, oldest first. There is no clock: late records pass too.

    The state is committed with the batch, so a key counts as archived only after the batch has been written.
    """

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", "offsets binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["arrival", "offset"], kind="stable")
        held = self.ring.get()
        passes, ring = let_through(np.frombuffer(held[0], "<i8") if held else np.zeros(0, np.int64), frame["offset"].to_numpy(np.int64), self.n)
        self.ring.update((ring.astype("<i8").tobytes(),))
        yield frame[passes]

    def close(self) -> None:
        pass


class EveryKey(StatefulProcessor):
    """Which of a block's offsets have been let through, for ever: BLOCK bits, however often and however late they come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bits = handle.getValueState("bits", "bits binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        held = self.bits.get()
        seen = np.unpackbits(np.frombuffer(held[0], np.uint8)).astype(bool) if held else np.zeros(BLOCK, bool)
        at = frame["offset"].to_numpy(np.int64) % BLOCK
        passes = np.zeros(len(at), bool)
        passes[np.unique(at, return_index=True)[1]] = True
        passes &= ~seen[at]
        if passes.any():
            seen[at] = True
            self.bits.update((np.packbits(seen).tobytes(),))
        yield frame[passes].drop(columns="block")

    def close(self) -> None:
        pass


def once(records: DataFrame, window: int | None = None, arrival: str | None = None) -> DataFrame:
    """The records that their topic partition hasn't let through before; headers but the correlation id go.

    A bit for each offset is kept, in blocks that are spread over the tasks. window: only the last so many keys of a topic partition
    are remembered, by one task each, and what comes again after them is let through again.

    arrival: a column with the order in which they came; without one they count as having come by offset within a batch.
    """
    order = F.lit(0).cast("long") if arrival is None else F.col(arrival).cast("long")
    rows = records.select(*COORDINATES, "key", "value", "timestamp", correlation_id("headers").alias("correlationId"), order.alias("arrival"))
    state = {"outputStructType": PASSED, "outputMode": "Append", "timeMode": "None"}
    if window is None:
        d = rows.withColumn("block", F.floor(F.col("offset") / BLOCK)).groupBy("topic", "partition", "block").transformWithStateInPandas(EveryKey(), **state)
    else:
        d = rows.groupBy("topic", "partition").transformWithStateInPandas(RecentKeys(window), **state)
    header = F.array(F.struct(F.lit(CORRELATION_ID).alias("key"), F.encode("correlationId", "UTF-8").alias("value")))
    return d.withColumn("headers", F.when(F.col("correlationId").isNotNull(), header)).select(*RECORD.names)


def archive_batch(schemas: DataFrame, archive: str, quarantine: str, group: str, instance: str, attempt: Attempt | None = None, attempts_at: str | None = None, attempts: int = 3, sign_with: bytes | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch function. A batch that is run again overwrites its own folders, so each row stands there once.

    attempt: also do this with each decoded record, and archive those with which it comes to an end; the others are
    quarantined with the number of their attempts, which are kept under attempts_at. Undecodable records aren't tried.
    sign_with: the key by which a manifest of the batch's files is signed and written beside them.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if sign_with is not None and manifests.written(batch.sparkSession, archive, batch_id):
            return  # all of it was there before the manifest
        batch = batch.persist()  # the stateful plan runs once for all that is written
        try:
            good, bad = classified(batch, schemas)
            now = F.unix_millis(F.current_timestamp())
            once = {"chain": F.array(F.struct(F.lit("DecodeError").alias("class"), F.col("failure").alias("message"))), "retryCount": F.lit(1).cast("long"), "firstFailureMs": now, "lastFailureMs": now}
            failed = bad.withColumns(once)
            if attempt:
                rounds = attempted(good, f"{attempts_at}/batch={batch_id}", COORDINATES, attempt, attempts)
                lost = given_up(rounds, COORDINATES)
                failed = failed.unionByName(good.join(lost, COORDINATES).withColumn("chain", chain()).select(*failed.columns))
                good = good.join(lost.select(*COORDINATES), COORDINATES, "left_anti")
            rows = partition_columns(projected(good))
            with_retry(lambda: rows.write.mode("overwrite").partitionBy("year", "month", "day", "event_type").parquet(f"{archive}/batch={batch_id}"))
            # The dead letters belong to the same batch: if they can't be written, its offsets aren't committed.
            letters = dead_letters(failed.withColumn("stack", F.lit("")), group, instance)
            with_retry(lambda: letters.write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}"))
            if sign_with is not None:
                manifests.write_manifest(batch.sparkSession, archive, batch_id, sign_with)
        finally:
            batch.unpersist()

    return run


def archive_stream(records: DataFrame, schemas: DataFrame, archive: str, quarantine: str, checkpoint: str, group: str = "audit", instance: str = "audit-0", window: int | None = None, arrival: str | None = None, attempt: Attempt | None = None, attempts: int = 3, sign_with: bytes | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Start the archive. The records' session must be one that `session.stateful` gave.

    Undecodable records are let through once too; both kinds are written once, however late they come.
    """
    write = archive_batch(schemas, archive, quarantine, group, instance, attempt, f"{quarantine}-attempts", attempts, sign_with)
    return once(records, window, arrival).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
