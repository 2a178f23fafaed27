"""Stream metrics that can't fail the data."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

LOG = logging.getLogger(__name__)


def observed(updates: DataFrame, name: str = "market") -> DataFrame:
    """updates of the market state with counters of stale writes and skipped windows attached to each batch."""
    n = lambda c: F.count_if(c)
    return updates.observe(name, n(F.col("outcome") == "APPLIED").alias("applied"), n(F.col("outcome") == "DUPLICATE").alias("stale_duplicate"), n(F.col("outcome") == "OLDER").alias("stale_older"), n(~F.col("windowApplied")).alias("window_skipped"), F.max(F.when(F.col("outcome") == "APPLIED", F.col("event_ms"))).alias("newest_ms"))


class Metrics(StreamingQueryListener):
    """Passes each batch's observed values on to `tell`; what tell raises is logged and goes no further."""

    def __init__(self, tell: Callable[[str, dict], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            try:
                self.tell(name, row.asDict())
            except Exception:  # noqa: BLE001
                LOG.exception("metrics of %s", name)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
