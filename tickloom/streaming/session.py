"""Sessions for streams with state."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Where transformWithState keeps its state, and no batches for timers alone: without data there is nothing to wait for.
STATEFUL = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
#: What the caller may have set in their session and streams should have too.
CARRIED = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.files.maxPartitionBytes")
#: For streams of few large batches: what a batch has shuffled, and the copies of the state that its tasks worked on, go with it.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.streaming.stateStore.unloadOnCommit": "true", "spark.sql.parquet.compression.codec": "zstd", "spark.sql.streaming.stateStore.rocksdb.compression": "zstd"}


def stateful(spark: SparkSession, lean: bool = False) -> SparkSession:
    """A session of its own for streams with state, so that the caller's settings stay as they are.

    lean: leave as little on disk as can be; a batch then loads its state from the checkpoint.
    """
    own = spark.newSession()
    for k, v in (STATEFUL | (LEAN if lean else {})).items():
        own.conf.set(k, v)
    for k in CARRIED:
        own.conf.set(k, spark.conf.get(k))
    return own
