"""The archive of delivered records: projection, idempotence by coordinates, coverage, manifest."""

from __future__ import annotations

import itertools
from collections import OrderedDict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import idempotency_key, schema_id
from .enrichment import small

COORDINATES = ["topic", "partition", "offset"]
#: Missing offsets that are spelled out at once.
STEP = 65_536


def event_type(value: str = "value") -> Column:
    """Tombstone for a null value, else null: the schema's name is joined in by `classified`."""
    return F.when(F.col(value).isNull(), F.lit("Tombstone"))


def classified(records: DataFrame, schemas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with eventType, undecodable records with `failure`). schemas: id, name; one row a schema."""
    marked = records.withColumn("_id", schema_id("value")).join(small(schemas.select(F.col("id").alias("_sid"), F.col("name").alias("_name"))), F.col("_id") == F.col("_sid"), "left")
    named = marked.withColumn("eventType", F.coalesce(event_type(), F.col("_name"))).drop("_id", "_sid", "_name")
    bad = named.filter(F.col("eventType").isNull()).drop("eventType").withColumn("failure", F.lit("no schema for the payload"))
    return named.filter(F.col("eventType").isNotNull()), bad


def projected(records: DataFrame) -> DataFrame:
    """Archive rows: the delivered bytes (empty for a tombstone), with an idempotency key."""
    return records.select(*COORDINATES, "key", "eventType", F.coalesce("value", F.unhex(F.lit(""))).alias("payload"), "timestamp", idempotency_key().alias("idempotencyKey"))


def deduplicated(rows: DataFrame) -> DataFrame:
    """One row for each record coordinate."""
    return rows.dropDuplicates(COORDINATES)


class BoundedWindow:
    """Exact idempotence within the last n archived keys, oldest out first; a hit doesn't renew a key.

    For a single writer only: unlike `deduplicated` it lets a key through again once n others came between.
    """

    def __init__(self, n: int):
        if n <= 0:
            raise ValueError("the window must be positive")
        self.n, self.keys = n, OrderedDict()

    def write(self, key: str, sink) -> bool:
        """Call sink unless key is known; the key counts as archived only after sink has returned."""
        if key in self.keys:
            return False
        sink(key)
        self.keys[key] = None
        if len(self.keys) > self.n:
            self.keys.popitem(last=False)
        return True


def let_through(ring: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(which of the offsets pass, one after the other; the last n that have passed, oldest first, ring being those before).

    As `BoundedWindow` would have it. Where nothing can fall out of the window, all are judged at once.
    """
    if n <= 0:
        raise ValueError("the window must be positive")
    passes = np.zeros(len(offsets), bool)
    if len(ring) + len(offsets) <= n:
        passes[np.unique(offsets, return_index=True)[1]] = True
        passes &= ~np.isin(offsets, ring)
    else:
        held, line = set(ring.tolist()), deque(ring.tolist())
        for k, o in enumerate(offsets.tolist()):
            if o not in held:
                passes[k] = True
                held.add(o)
                line.append(o)
                if len(line) > n:
                    held.discard(line.popleft())
    return passes, np.concatenate([ring, offsets[passes]])[-n:]


def bounded_once(records: DataFrame, n: int, order: str) -> DataFrame:
    """records as `BoundedWindow` lets them through, for each topic and partition in the order in which they came.

    A partition's records pass one writer in a row, as they do there, and only the window is held. What is to be kept up over
    several batches goes through `streaming.archive.once`.
    """

    def run(batches):
        ring, of = np.zeros(0, np.int64), None
        for b in batches:
            topics, partitions = (b.column(c).to_numpy(zero_copy_only=False) for c in COORDINATES[:2])
            offsets = b.column("offset").to_numpy()
            cuts = np.flatnonzero((topics[1:] != topics[:-1]) | (partitions[1:] != partitions[:-1])) + 1
            kept = []
            for x, y in itertools.pairwise([0, *cuts.tolist(), b.num_rows]) if b.num_rows else ():
                if (topics[x], partitions[x]) != of:
                    ring, of = np.zeros(0, np.int64), (topics[x], partitions[x])
                passes, ring = let_through(ring, offsets[x:y], n)
                kept.append(passes)
            yield b.filter(pa.array(np.concatenate(kept))) if kept else b

    return records.repartition("topic", "partition").sortWithinPartitions("topic", "partition", order).mapInArrow(run, records.schema)


def coverage(records: DataFrame) -> DataFrame:
    """Archived, duplicate and missing records of each topic and partition; missing fails, duplicates only warn.

    Counted by arithmetic over an aggregate of offsets, so no range of expected offsets is made.
    """
    each = records.groupBy(*COORDINATES).agg(F.count("*").alias("_n"))
    d = each.groupBy("topic", "partition").agg(F.min("offset").alias("expectedFirstOffset"), F.max("offset").alias("expectedLastOffset"), F.count("*").alias("archivedRecordCount"), F.sum(F.col("_n") - 1).alias("duplicateCount"))
    d = d.withColumn("missingCount", F.col("expectedLastOffset") - F.col("expectedFirstOffset") + 1 - F.col("archivedRecordCount"))
    return d.withColumn("status", F.when(F.col("missingCount") > 0, "FAIL").when(F.col("duplicateCount") > 0, "WARNING").otherwise("PASS"))


def missing_ranges(records: DataFrame) -> DataFrame:
    """First and last of each run of offsets that is missing between two archived ones."""
    from pyspark.sql import Window as W

    d = records.select(*COORDINATES).distinct().withColumn("_next", F.lead("offset").over(W.partitionBy("topic", "partition").orderBy("offset")))
    return d.filter(F.col("_next") > F.col("offset") + 1).select("topic", "partition", (F.col("offset") + 1).alias("firstMissing"), (F.col("_next") - 1).alias("lastMissing"))


def missing_offsets(records: DataFrame) -> DataFrame:
    """Every missing offset: only the gaps are spelled out, long ones in steps, so that no list gets long."""
    steps = missing_ranges(records).withColumn("_from", F.explode(F.sequence("firstMissing", "lastMissing", F.lit(STEP).cast("long"))))
    return steps.select("topic", "partition", F.explode(F.sequence("_from", F.least("lastMissing", F.col("_from") + STEP - 1))).alias("offset"))


def partition_columns(rows: DataFrame) -> DataFrame:
    """rows with the columns of the archive's folders."""
    t = F.col("timestamp")
    return rows.withColumns({"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "event_type": F.col("eventType")})


def manifest(rows: DataFrame) -> DataFrame:
    """For each folder, topic and partition: records, offsets, and a digest over the records' digests.

    The digest adds the records' digests up, so it is an aggregate that doesn't depend on their order.
    """
    d = partition_columns(rows).withColumn("_d", F.conv(F.substring(F.sha2(F.concat(F.encode(idempotency_key(), "UTF-8"), F.col("payload")), 256), 1, 15), 16, 10).cast("decimal(38,0)"))
    return d.groupBy("year", "month", "day", "event_type", "topic", "partition").agg(F.count("*").alias("records"), F.min("offset").alias("firstOffset"), F.max("offset").alias("lastOffset"), F.sum("_d").cast("string").alias("digest"))
