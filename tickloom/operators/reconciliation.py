"""Reconciliation of internal against external records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def observations(internal: DataFrame, external: DataFrame, rounding: float = 1.0, now_ms: int | None = None, settle_ms: int = 0) -> DataFrame:
    """Mismatches by reference. internal, external: referenceId, amount, state, and with now_ms also seen_ms.

    Each side is summed up by reference before the join, so a reference that is repeated makes one row. A missing
    side comes first, then a repeated reference, a difference of amounts (small ones may be rounding or a fee) and
    of states; references that agree make no row. The order is ours.

    now_ms: only what has been seen by then is known. A reference with one side is then expected to settle until
    settle_ms after that side was first seen, and its side may still be in flight: TIMING_UNCERTAINTY, not a proven mismatch.
    Later it is MISSING_PARTICIPANT. So the same records give an expected observation first and an unknown one later.
    """
    if now_ms is not None:
        internal, external = internal.filter(F.col("seen_ms") <= now_ms), external.filter(F.col("seen_ms") <= now_ms)
    seen = lambda df: F.min("seen_ms") if "seen_ms" in df.columns else F.lit(None).cast("long")
    side = lambda df, p: df.groupBy("referenceId").agg(F.count("*").alias(f"{p}_n"), F.min("amount").alias(f"{p}Amount"), F.min("state").alias(f"{p}_state"), seen(df).alias(f"{p}_seen"))
    d = side(internal, "internal").join(side(external, "external"), "referenceId", "full_outer")
    gap = F.abs(F.col("internalAmount") - F.col("externalAmount"))
    alone = F.col("internal_n").isNull() | F.col("external_n").isNull()
    in_flight = F.lit(False) if now_ms is None else alone & (F.coalesce("internal_seen", "external_seen") + settle_ms >= now_ms)
    kind = (
        F.when(in_flight, "TIMING_UNCERTAINTY")
        .when(alone, "MISSING_PARTICIPANT")
        .when((F.col("internal_n") > 1) | (F.col("external_n") > 1), "DUPLICATE_REFERENCE")
        .when((gap > 0) & (gap <= rounding), "ROUNDING_OR_FEE_CANDIDATE")
        .when(gap > rounding, "AMOUNT_MISMATCH")
        .when(F.col("internal_state") != F.col("external_state"), "CONFLICTING_STATE")
    )
    n = F.when(F.col("internal_n").isNotNull(), 1).otherwise(0) + F.when(F.col("external_n").isNotNull(), 1).otherwise(0)
    return d.withColumn("observationType", kind).filter("observationType is not null").select("referenceId", "observationType", "internalAmount", "externalAmount", F.lit(2).alias("expectedParticipants"), n.alias("participantsObserved"), F.when(n == 2, "COMPLETE").when(in_flight, "INCOMPLETE_EXPECTED").otherwise("INCOMPLETE_UNKNOWN").alias("completeness"))
