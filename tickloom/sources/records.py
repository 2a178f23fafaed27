"""Record sources and sinks: files with a record log's columns, or Kafka where its connector is installed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RECORD


@dataclass(frozen=True)
class Subscription:
    """What to read. `path` is a folder of record files; without it `servers` names a Kafka cluster."""

    topics: tuple[str, ...]
    group: str
    path: str | None = None
    servers: str | None = None
    max_files: int | None = None
    max_offsets: int | None = None
    window: int = 10_000

    def __post_init__(self):
        if not self.topics or not all(t.strip() for t in self.topics):
            raise ValueError("at least one topic is needed, and none may be blank")
        if self.window <= 0:
            raise ValueError("the deduplication window must be positive")
        if (self.path is None) == (self.servers is None):
            raise ValueError("either a path or servers")


def _of_kafka(df: DataFrame) -> DataFrame:
    return df.select("topic", "partition", "offset", F.col("key").cast("string").alias("key"), "value", "timestamp", "headers")


def read(spark: SparkSession, s: Subscription) -> DataFrame:
    """All records so far, in batch. Several topics are a bag union."""
    if s.path:
        return spark.read.schema(RECORD).parquet(s.path).filter(F.col("topic").isin(*s.topics))
    return _of_kafka(spark.read.format("kafka").options(**kafka_options(s)).load())


def stream(spark: SparkSession, s: Subscription) -> DataFrame:
    """Records as they come, from the earliest; how much a batch takes is bounded if asked."""
    if s.path:
        r = spark.readStream.schema(RECORD)
        r = r.option("maxFilesPerTrigger", s.max_files) if s.max_files else r
        return r.parquet(s.path).filter(F.col("topic").isin(*s.topics))
    r = spark.readStream.format("kafka").options(**kafka_options(s))
    return _of_kafka((r.option("maxOffsetsPerTrigger", s.max_offsets) if s.max_offsets else r).load())


def kafka_options(s: Subscription) -> dict[str, str]:
    return {"kafka.bootstrap.servers": s.servers or "", "subscribe": ",".join(s.topics), "startingOffsets": "earliest", "kafka.group.id": s.group, "includeHeaders": "true", "failOnDataLoss": "true"}


def sasl_options(name: str, secret: str) -> dict[str, str]:
    """Kafka options of a workload's own identity."""
    quoted = secret.replace("\\", "\\\\").replace('"', '\\"')
    return {"kafka.security.protocol": "SASL_SSL", "kafka.sasl.mechanism": "SCRAM-SHA-512", "kafka.sasl.jaas.config": f'org.apache.kafka.common.security.scram.ScramLoginModule required username="{name}" password="{quoted}";'}


# The durability profile of producers.
DURABLE = {"kafka.acks": "all", "kafka.enable.idempotence": "true", "kafka.max.in.flight.requests.per.connection": "5", "kafka.compression.type": "lz4", "kafka.batch.size": "65536", "kafka.linger.ms": "5", "kafka.buffer.memory": "67108864"}


def keyed(df: DataFrame, topic: str, key: str, value: str, headers: str | None = None) -> DataFrame:
    """Rows as records to publish: topic, key, value, headers. Rows of one key stay in order within a partition."""
    h = F.col(headers) if headers else F.lit(None).cast(RECORD["headers"].dataType)
    return df.select(F.lit(topic).alias("topic"), F.col(key).cast("string").alias("key"), F.col(value).alias("value"), h.alias("headers"))


def publish(records: DataFrame, path: str | None = None, servers: str | None = None) -> None:
    """Write records to a folder, by topic, or to Kafka with the durability profile. A failed write raises."""
    if path:
        records.write.mode("append").partitionBy("topic").parquet(path)
    else:
        records.write.format("kafka").option("kafka.bootstrap.servers", servers).options(**DURABLE).save()


def schemas_of(spark: SparkSession, ids: dict[int, str]) -> DataFrame:
    """id, name of registered schemas."""
    return spark.createDataFrame(list(ids.items()), "id long, name string")
