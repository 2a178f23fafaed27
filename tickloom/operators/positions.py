"""Positions from trades, idempotent by trade."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_delivered(trades: DataFrame, *same: str) -> DataFrame:
    """trades without redelivered copies: of each tradeId the row with the least seq, picked before and after the exchange.

    same: columns that all copies of a trade have in common; rows that are dealt by them already are not exchanged again.
    """
    by_seq = W.partitionBy(*same, "tradeId").orderBy("seq")
    return trades.withColumn("_n", F.row_number().over(by_seq)).filter("_n = 1").drop("_n")


def positions(trades: DataFrame) -> DataFrame:
    """`positions_of` trades that may have been delivered again: the copy delivered first counts."""
    return positions_of(first_delivered(trades))


def positions_of(once: DataFrame) -> DataFrame:
    """Net and gross quantities of each account, trader and ticker; market value at the last trade's price.

    once: tradeId, each once, accountId, traderId, ticker, side,
    quantity, price, event_ms, seq.
    """
    buy = F.sum(F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(0))
    sell = F.sum(F.when(F.col("side") == "SELL", F.col("quantity")).otherwise(0))
    last = F.max(F.struct("event_ms", "seq", "tradeId", "price"))
    d = once.groupBy("accountId", "traderId", "ticker").agg(buy.alias("grossBuyQuantity"), sell.alias("grossSellQuantity"), last.alias("_last"))
    net = F.col("grossBuyQuantity") - F.col("grossSellQuantity")
    return d.select("accountId", "traderId", "ticker", net.alias("netQuantity"), "grossBuyQuantity", "grossSellQuantity", (net * F.col("_last.price")).alias("marketValue"), F.col("_last.event_ms").alias("asOfMs"), F.col("_last.tradeId").alias("lastProcessedTradeId"))
