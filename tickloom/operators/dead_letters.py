"""Dead letters: per-record quarantine with full provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cause_chain, correlation_id, dlq_topic, root_class, root_message, stack_summary


def attempts(failures: DataFrame) -> DataFrame:
    """Attempts, first and last failure of each record. failures: topic, partition, offset, failed_ms."""
    return failures.groupBy("topic", "partition", "offset").agg(F.count("*").alias("retryCount"), F.min("failed_ms").alias("firstFailureMs"), F.max("failed_ms").alias("lastFailureMs"))


def with_attempts(records: DataFrame, tracked: DataFrame, now_ms: Column) -> DataFrame:
    """records with their attempts; a record that was never tracked counts one attempt, now."""
    d = records.join(tracked, ["topic", "partition", "offset"], "left")
    return d.withColumns({"retryCount": F.coalesce("retryCount", F.lit(1).cast("long")), "firstFailureMs": F.coalesce("firstFailureMs", now_ms), "lastFailureMs": F.coalesce("lastFailureMs", now_ms)})


def dead_letters(records: DataFrame, group: str, instance: str) -> DataFrame:
    """Rows for the record's dead-letter topic, keyed as the record was.

    records: topic, partition, offset, key, value, headers, chain (array of class and message, outermost first),
    stack, retryCount, firstFailureMs, lastFailureMs. The delivered bytes are kept on every row, those that failed
    validation too, so that each can be replayed.
    """
    return records.select(
        dlq_topic().alias("topic"), "key",
        F.col("topic").alias("originalTopic"), F.col("partition").alias("originalPartition"), F.col("offset").alias("originalOffset"),
        F.coalesce("value", F.unhex(F.lit(""))).alias("originalPayload"),
        cause_chain("chain").alias("failureReason"), root_class("chain").alias("exceptionClass"), root_message("chain").alias("exceptionMessage"),
        stack_summary(F.coalesce("stack", F.lit(""))).alias("stackTraceSummary"),
        F.col("retryCount").cast("int").alias("retryCount"), F.timestamp_millis("firstFailureMs").alias("firstFailureAt"), F.timestamp_millis("lastFailureMs").alias("lastFailureAt"),
        F.lit(group).alias("consumerGroup"), F.lit(instance).alias("consumerInstance"), correlation_id("headers").alias("correlationId"),
    )
