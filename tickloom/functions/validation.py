"""Validation rules: each returns an array of the reasons against a row, empty for a valid one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import ENUMS, fields
from .scalars import blank

MAX_SKEW_MS = 3_600_000

# What each action type must state.
REQUIRED = {
    "DIVIDEND_DECLARATION": ["dividendPerShare"],
    "STOCK_SPLIT": ["splitRatio"],
    "RIGHTS_ISSUE": ["ratio", "subscriptionPrice"],
    "EARNINGS_ANNOUNCEMENT": [],
}


def reasons(*rules: tuple[str, Column]) -> Column:
    """Names of the rules whose condition holds; a null condition doesn't hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))


def first_reason(rules: Column) -> Column:
    return F.try_element_at(rules, F.lit(1))


def finite(c: Column) -> Column:
    """False for null, NaN and both infinities: NaN sorts above everything."""
    return F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))


def tick_reasons(now_ms: Column | None = None, bid="bid", ask="ask", last="last", volume="volume", event_ms="event_ms") -> Column:
    """Prices must be finite, volume not negative, and the event at most an hour ahead of now."""
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms
    return reasons(
        ("PRICE_NOT_FINITE", ~(finite(F.col(bid)) & finite(F.col(ask)) & finite(F.col(last)))),
        ("NEGATIVE_VOLUME", F.col(volume) < 0),
        ("FUTURE_EVENT", F.col(event_ms) > now + MAX_SKEW_MS),
    )


def missing_attributes(action="actionType", attributes="attributes") -> Column:
    """Required attributes that are absent or blank, in order; empty for an unknown action type."""
    known = reduce(lambda acc, x: acc.when(F.col(action) == x[0], F.array(*map(F.lit, x[1])).cast("array<string>")), REQUIRED.items(), F.when(F.lit(False), F.array().cast("array<string>")))
    needed = F.coalesce(known, F.array().cast("array<string>"))
    return F.array_sort(F.filter(needed, lambda k: blank(F.col(attributes)[k])))


def corporate_action_reasons() -> Column:
    """The date rule comes first. A null map is a fault of another kind, so it has a reason of its own."""
    return reasons(
        ("EFFECTIVE_BEFORE_ANNOUNCED", F.col("effectiveAt") < F.col("announcedAt")),
        ("NULL_ATTRIBUTES", F.col("attributes").isNull()),
        ("MISSING_ATTRIBUTES", F.col("attributes").isNotNull() & (F.size(missing_attributes()) > 0)),
    )


def instrument_reasons() -> Column:
    """A row whose every field is null would be a tombstone."""
    return reasons(
        ("NULL_INSTRUMENT", F.col("instrumentId").isNull() & F.col("ticker").isNull() & F.col("sharesOutstanding").isNull()),
        ("BLANK_INSTRUMENT_ID", blank(F.col("instrumentId"))),
        ("BLANK_TICKER", blank(F.col("ticker"))),
        ("SHARES_NOT_POSITIVE", ~F.coalesce(F.col("sharesOutstanding") > 0, F.lit(False))),
    )


def mandatory_reasons(name: str) -> Column:
    """Mandatory fields of an event that are null."""
    return reasons(*[(f"NULL_{f}", F.col(f).isNull()) for f, _, must in fields(name) if must])


def enum_reasons(name: str) -> Column:
    """Enum fields of an event whose value is outside their domain."""
    return reasons(*[(f"BAD_{f}", ~F.col(f).isin(ENUMS[t])) for f, t, _ in fields(name) if t in ENUMS])


def version_guard(df: DataFrame, key="instrumentId", version="referenceVersion", order="seq") -> DataFrame:
    """df with `accepted`: the version is positive and above all accepted before it for the key, in delivery order.

    A refused version is never above the highest accepted one (or isn't positive), so the running maximum over all
    earlier positive versions is the high-water mark.
    """
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("accepted", F.coalesce(F.col(version) > F.greatest(F.lit(0), F.max(version).over(before)), F.lit(False)))


def split(df: DataFrame, rules: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with `reasons`); nothing is thrown and nothing is lost."""
    marked = df.withColumn("reasons", rules)
    return marked.filter(F.size("reasons") == 0).drop("reasons"), marked.filter(F.size("reasons") > 0)
