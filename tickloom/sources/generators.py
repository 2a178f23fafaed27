"""Synthetic ticks and trades, seeds, and the pacing of load."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import isfinite

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import ask, batch_size, bid, log_step, pareto


@dataclass(frozen=True)
class TickModel:
    """Parameters of the price walk; refused if they make no sense."""

    prices: dict[str, float] = field(default_factory=lambda: {"RELIANCE": 2847.5, "TCS": 3890.0, "INFY": 1560.0, "WIPRO": 480.0})
    mu: float = 0.08
    sigma: float = 0.25
    step_seconds: float = 1.0
    spread_bps: float = 5.0
    volume_scale: float = 100.0
    volume_alpha: float = 1.5

    def __post_init__(self):
        good = self.prices and all(isfinite(p) and p > 0 for p in self.prices.values()) and isfinite(self.mu) and self.sigma >= 0 and self.step_seconds > 0 and self.spread_bps >= 0 and self.volume_scale > 0 and self.volume_alpha > 0
        if not good:
            raise ValueError(f"bad model: {self}")


@dataclass(frozen=True)
class Pace:
    """Events for each wake; wakes that were missed are not made up for."""

    rate: float
    interval_seconds: float

    def __post_init__(self):
        if self.rate <= 0 or self.interval_seconds <= 0:
            raise ValueError("rate and interval must be positive")

    @property
    def batch(self) -> int:
        return batch_size(self.rate, self.interval_seconds)

    def stream(self, spark: SparkSession) -> DataFrame:
        """A stream that makes a batch for each trigger, however late: value, timestamp."""
        return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", self.batch).option("advanceMillisPerBatch", round(self.interval_seconds * 1000)).load()


def walked(rows: DataFrame, model: TickModel) -> DataFrame:
    """Ticks from given shocks: each ticker's price is a geometric Brownian walk from its start, in order of seq.

    rows: ticker, seq, event_ms, shock, u (of the volume, 0 to 1), start. Log steps are summed as decimals, so that the walk
    depends on no order of addition: one window, no loop.
    """
    m = model
    step = log_step(m.mu, m.sigma, m.step_seconds, F.col("shock")).cast("decimal(30,15)")
    walk = F.sum(step).over(W.partitionBy("ticker").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)).cast("double")
    d = rows.withColumn("last", F.col("start") * F.exp(walk))
    return d.select("ticker", bid("last", m.spread_bps).alias("bid"), ask("last", m.spread_bps).alias("ask"), "last", pareto(F.col("u"), m.volume_scale, m.volume_alpha).alias("volume"), "event_ms", F.col("seq").alias("offset"), "seq")


def trades_at(walk: DataFrame, traders: int = 10) -> DataFrame:
    """A trade for each tick, buys at the ask and sells at the bid, by the tick's number."""
    n, side = F.col("seq"), F.when(F.col("seq") % 2 == 0, "BUY").otherwise("SELL")
    of = lambda kind, k: F.concat(F.lit(f"{kind}-"), (F.floor(n / k) % traders).cast("string"))
    return walk.select(F.concat(F.lit("trade-"), F.sha2(n.cast("string"), 256)).alias("tradeId"), "ticker", (n % 500 + 1).alias("quantity"), F.when(n % 2 == 0, F.col("ask")).otherwise(F.col("bid")).alias("price"), side.alias("side"), of("trader", 1).alias("traderId"), of("account", 10).alias("accountId"), "event_ms", "seq")


def ticks(spark: SparkSession, n: int, model: TickModel | None = None, seed: int = 0, start_ms: int = 1_740_000_000_000, enabled: bool = True) -> DataFrame:
    """n ticks, round robin over the tickers, each ticker's price a geometric Brownian walk.

    The shocks are random; `walked` makes prices of them.
    """
    m = model or TickModel()
    names = sorted(m.prices)
    d = spark.range(n if enabled else 0).withColumns({"seq": F.col("id"), "_i": F.pmod("id", F.lit(len(names))).cast("int"), "_z": F.randn(seed), "_u": F.rand(seed + 1)})
    at = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.col("_i") + 1)
    event_ms = (F.lit(start_ms) + F.col("seq") * round(m.step_seconds * 1000)).cast("long")
    return walked(d.select(at(names).alias("ticker"), "seq", event_ms.alias("event_ms"), F.col("_z").alias("shock"), F.col("_u").alias("u"), at([m.prices[x] for x in names]).alias("start")), m)


def trades(spark: SparkSession, n: int, tickers: list[str] | None = None, seed: int = 0, start_ms: int = 1_740_000_000_000, enabled: bool = True) -> DataFrame:
    """n trades with independent uniform fields."""
    names = tickers or ["AAPL", "MSFT", "GOOGL", "AMZN"]
    r = lambda k: F.rand(seed * 100 + k)
    whole = lambda k, top: F.floor(r(k) * top)
    d = spark.range(n if enabled else 0)
    return d.select(
        F.concat(F.lit("trade-"), F.sha2(F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string")), 256)).alias("tradeId"),
        F.element_at(F.array(*map(F.lit, names)), (whole(1, len(names)) + 1).cast("int")).alias("ticker"), (whole(2, 500) + 1).alias("quantity"), (F.lit(1000.0) + (r(3) - 0.5) * 100).alias("price"),
        F.when(r(4) < 0.5, "BUY").otherwise("SELL").alias("side"), F.concat(F.lit("trader-"), whole(5, 10).cast("string")).alias("traderId"), F.concat(F.lit("account-"), whole(6, 10).cast("string")).alias("accountId"),
        (F.lit(start_ms) + F.col("id")).alias("event_ms"), F.col("id").alias("seq"),
    )


def _seeds(spark: SparkSession, rows: list[tuple] | DataFrame, enabled: bool, ddl: str) -> DataFrame:
    """Seeds from a list or a table; none if they are switched off."""
    d = rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows, ddl)
    return d if enabled else d.limit(0)


def seed_corporate_actions(spark: SparkSession, rows: list[tuple] | DataFrame, now: Column | None = None, enabled: bool = True) -> DataFrame:
    """Seeded actions that take effect effective_in_seconds after now. rows: id, ticker, type, attributes, seconds."""
    d = _seeds(spark, rows, enabled, "corporateActionId string, ticker string, actionType string, attributes map<string,string>, effective_in_seconds long")
    at = F.current_timestamp() if now is None else now
    return d.withColumn("announcedAt", at).withColumn("effectiveAt", F.timestamp_seconds(F.unix_seconds("announcedAt") + F.col("effective_in_seconds"))).drop("effective_in_seconds")


def seed_instruments(spark: SparkSession, rows: list[tuple] | DataFrame, enabled: bool = True) -> DataFrame:
    """The instrument master, every instrument at version 1. rows: id, ticker, shares outstanding."""
    d = _seeds(spark, rows, enabled, "instrumentId string, ticker string, sharesOutstanding long")
    return d.withColumn("referenceVersion", F.lit(1).cast("long")).withColumn("seq", F.monotonically_increasing_id())
