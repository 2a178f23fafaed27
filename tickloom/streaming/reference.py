"""Versioned reference data as a stream: a high-water mark for each instrument, and a compacted table.

Both are tables that change together. A batch is judged as a whole, by joins and a window over its own rows, so the cost is in its
rows and not in how many instruments there are; and as the marks are those of the batch before, a batch that is run again judges alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.validation import instrument_reasons
from .versions import GONE, Versions

TABLES = {"instrument": ["instrumentId"], "mark": ["instrumentId"]}
STALE = "VERSION_NOT_NEWER"


def guarded(instruments: DataFrame, marks: DataFrame | None) -> DataFrame:
    """instruments with `reasons` (comma-separated, '' if it may be published) and `mark`, the version it moves its instrument's mark to.

    instruments: instrumentId, ticker, sharesOutstanding, referenceVersion, seq, deleted (marks a tombstone) and any more. marks:
    instrumentId, mark: the highest version before. A row passes if it is above that, above all before it and above 0. Bad rows
    and tombstones have no say in versions.
    """
    judged = instruments.withColumn("reasons", F.when(F.col("deleted"), "").otherwise(F.array_join(instrument_reasons(), ",")))
    own = (F.col("reasons") == "") & ~F.col("deleted")
    judged = judged.withColumn("_version", F.when(own, F.coalesce("referenceVersion", F.lit(0))))
    top = F.max("_version").over(W.partitionBy("instrumentId").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    held = F.lit(0).cast("long")
    if marks is not None:
        judged, held = judged.join(marks.select("instrumentId", F.col("mark").alias("_held")), "instrumentId", "left"), F.col("_held")
    stale = F.col("_version") <= F.greatest(F.lit(0).cast("long"), held, F.col("_top"))
    d = judged.withColumn("_top", top).withColumn("reasons", F.when(stale, STALE).otherwise(F.col("reasons")))
    passed = F.when(F.col("_version").isNotNull() & (F.col("reasons") == ""), F.col("_version"))
    return d.withColumn("mark", passed).select(*instruments.columns, "reasons", "mark")


def publish_batch(tables: Versions, rejects: str, identity: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: rejects, and of each instrument the batch's last row that passes, or its tombstone, with its mark."""

    def run(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in ("instrumentId", "deleted")]
        batch = guarded(batch, tables.read("mark", tables.current(before=batch_id))).persist()
        try:
            batch.filter("reasons <> ''").drop("mark").write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
            good = batch.filter("reasons = ''")
            last = good.groupBy("instrumentId").agg(F.max_by(F.struct(*rest, "deleted"), "seq").alias("l"))
            rows = last.select("instrumentId", *[f"l.{c}" for c in rest], F.lit(identity).alias("producerIdentity"), F.col("l.deleted").alias(GONE))
            marks = good.filter("mark is not null").groupBy("instrumentId").agg(F.max("mark").alias("mark"))
            tables.publish(batch_id, {"instrument": rows, "mark": marks})
        finally:
            batch.unpersist()

    return run


def reference_stream(instruments: DataFrame, tables: Versions, rejects: str, checkpoint: str, identity: str, trigger: dict | None = None) -> StreamingQuery:
    """Start it."""
    return instruments.writeStream.foreachBatch(publish_batch(tables, rejects, identity)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
