"""Scalar rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of trading in a year.
TRADING_YEAR = 252 * 6.5 * 3600


def idempotency_key(topic="topic", partition="partition", offset="offset") -> Column:
    return F.concat_ws("-", topic, F.col(partition).cast("string"), F.col(offset).cast("string"))


def cache_key(ticker: str, what: str) -> Column:
    """market:{T}:tick or market:{T}:window, with the braces."""
    return F.format_string(f"market:{{%s}}:{what}", F.col(ticker))


def dlq_topic(topic="topic") -> Column:
    return F.concat(F.col(topic), F.lit(".dlq"))


def cause_chain(chain: str) -> Column:
    """e1 <- e2 <- …, outermost first. chain: array of (class, message)."""
    return F.array_join(F.transform(chain, lambda e: F.concat(e["class"], F.lit(": "), F.coalesce(e["message"], F.lit("null")))), " <- ")


def root_class(chain: str) -> Column:
    return F.try_element_at(chain, F.lit(-1))["class"]


def root_message(chain: str) -> Column:
    return F.coalesce(F.try_element_at(chain, F.lit(-1))["message"], F.lit("null"))


# Fixed value: the header's name.
CORRELATION_ID = "correlationId"


def correlation_id(headers: str) -> Column:
    """The last correlationId header, or null."""
    return F.decode(F.try_element_at(F.filter(headers, lambda h: h["key"] == CORRELATION_ID), F.lit(-1))["value"], "UTF-8")


def headers(correlation: str | None, trace: str) -> Column:
    """correlationId (unless None), then traceparent and tracestate if the trace map has them; a null map has none."""
    one = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(name).alias("key"), F.encode(value, "UTF-8").alias("value")))
    traced = [one(x, F.col(trace)[x]) for x in ("traceparent", "tracestate")]
    return F.array_compact(F.array(*([one(CORRELATION_ID, F.col(correlation))] if correlation else []), *traced))


def schema_id(value: str) -> Column:
    """The schema id of a record in the registry's wire format (a zero byte, four bytes, the body), or null."""
    framed = (F.octet_length(value) >= 5) & (F.hex(F.substring(value, 1, 1)) == "00")
    return F.when(framed, F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("long"))


def payload_body(value: str) -> Column:
    return F.substring(F.col(value), F.lit(6), F.octet_length(value))


def blank(c: Column) -> Column:
    """Null, or nothing but white space of any kind."""
    return c.isNull() | c.rlike(r"^[\s\p{Z}]*$")


def bid(mid: str, bps: float) -> Column:
    return F.col(mid) * (1 - bps / 20000)


def ask(mid: str, bps: float) -> Column:
    return F.col(mid) * (1 + bps / 20000)


def log_step(mu: float, sigma: float, step_seconds: float, shock: Column) -> Column:
    """Logarithm of a price step of geometric Brownian motion."""
    dt = step_seconds / TRADING_YEAR
    return F.lit((mu - sigma * sigma / 2) * dt) + F.lit(sigma * dt**0.5) * shock


def pareto(u: Column, scale: float, alpha: float) -> Column:
    """scale / u^(1 / alpha), cut to a long; u = 0 counts as the least normal double."""
    most = F.lit(9.223372036854775e18)
    raw = F.try_divide(F.lit(float(scale)), F.pow(F.greatest(u, F.lit(2.2250738585072014e-308)), F.lit(1 / alpha)))
    return F.least(F.coalesce(raw, most), most).cast("long")  # a power that comes to 0 means no bound


def age_seconds(now_ms: Column, event_ms: Column) -> Column:
    return (now_ms - event_ms) / F.lit(1000.0)


def batch_size(rate: float, interval_seconds: float) -> int:
    """Events in a wake: at least 1, halves rounded up."""
    return max(1, int(rate * interval_seconds + 0.5))


def mid_price(bid_: str, ask_: str) -> Column:
    return (F.col(bid_) + F.col(ask_)) / 2


def spread(bid_: str, ask_: str) -> Column:
    return F.col(ask_) - F.col(bid_)


def price_deviation(price: Column, mid: Column) -> Column:
    """Signed, in percent of the mid price; null at a mid price of 0. The contract leaves the sign open; this is ours."""
    return (price - mid) / F.nullif(mid, F.lit(0.0)) * 100


def market_cap(shares: Column, price: Column) -> Column:
    """In crores."""
    return shares * price / F.lit(1e7)


def money(price: Column) -> Column:
    """A price as a decimal of four digits, so that sums are exact in any order."""
    return price.cast("decimal(18,4)")


def turnover(price: Column, volume: Column) -> Column:
    """Price times volume, exact."""
    return (money(price) * volume.cast("decimal(19,0)")).cast("decimal(38,4)")


def half_up(x: Column, digits: int) -> Column:
    """x to so many digits by the same two floating-point steps on every engine; halves go up."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def event_bucket(event_ms: Column, seconds: int) -> Column:
    """Start of the bucket in seconds; rounds down, below zero too."""
    return (F.floor(event_ms / (seconds * 1000)) * seconds).cast("long")


def stack_summary(c: Column) -> Column:
    return F.substring(c, 1, 500)


def flag(name: Column) -> Column:
    """An operation or resource type as a command line flag."""
    return F.replace(F.lower(name), F.lit("_"), F.lit("-"))


def or_empty(c: Column) -> Column:
    """A null map as the empty map."""
    return F.coalesce(c, F.create_map().cast("map<string,string>"))
