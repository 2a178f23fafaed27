"""Versioned instrument reference data as a compacted table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.validation import instrument_reasons, split, version_guard


def publishable(instruments: DataFrame, identity: str) -> tuple[DataFrame, DataFrame]:
    """(rows to publish, rejected rows with `reasons`): valid, newer than all before, stamped with our identity."""
    valid, bad = split(instruments, instrument_reasons())
    guarded = version_guard(valid)
    good = guarded.filter("accepted").drop("accepted").withColumn("producerIdentity", F.lit(identity))
    stale = guarded.filter("not accepted").drop("accepted").withColumn("reasons", F.array(F.lit("VERSION_NOT_NEWER")))
    return good, bad.unionByName(stale)


def compacted(log: DataFrame, key: str = "key", value: str = "value", offset: str = "offset") -> DataFrame:
    """The row of each key with the greatest offset, unless its value is null: an aggregate, no window."""
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), offset).alias("_last"))
    return last.select(key, *[F.col(f"_last.{c}").alias(c) for c in rest]).filter(F.col(value).isNotNull())


def latest_instruments(instruments: DataFrame) -> DataFrame:
    """The highest version of each instrument."""
    return compacted(instruments, "instrumentId", "ticker", "referenceVersion")
