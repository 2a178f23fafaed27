"""Corporate actions: validate before publishing, and context for alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.validation import corporate_action_reasons, missing_attributes, split


def validated(actions: DataFrame) -> DataFrame:
    """actions with `valid`, `reason` (the first, or null) and `missing` (attributes, comma-separated)."""
    d = actions.withColumn("_r", corporate_action_reasons())
    return d.withColumns({"valid": F.size("_r") == 0, "reason": F.try_element_at("_r", F.lit(1)), "missing": F.array_join(missing_attributes(), ",")}).drop("_r")


def publishable(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid actions, rejected ones with `reasons`)."""
    return split(actions, corporate_action_reasons())


def unexplained(alerts: DataFrame, actions: DataFrame, window_ms: int) -> DataFrame:
    """Alerts without a corporate action of the ticker that takes effect within window_ms of them.

    Actions are cut into cells of window_ms and each alert looks at three, so the join is on equal keys.
    """
    a = actions.select(F.col("ticker").alias("_t"), F.col("effective_ms").alias("_e"), F.floor(F.col("effective_ms") / window_ms).alias("_c"))
    d = alerts.withColumn("_c", F.explode(F.array(*[F.floor(F.col("alert_ms") / window_ms) + k for k in (-1, 0, 1)])))
    hit = d.join(a, (d["ticker"] == a["_t"]) & (d["_c"] == a["_c"]) & (F.abs(F.col("alert_ms") - F.col("_e")) <= window_ms), "left_semi").select("alertId").distinct()
    return alerts.join(hit, "alertId", "left_anti")
