"""Change capture of a legacy trade table as canonical trades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = "struct<id:string,ticker:string,quantity:bigint,price:double,side:string,trader:string,account:string,ts_ms:bigint>"
CHANGE = f"before {ROW}, after {ROW}, op string, source struct<table:string,lsn:string,ts_ms:bigint>"


def canonical_trades(changes: DataFrame, system: str, batch: str | None = None, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(trades with provenance, undecodable changes). Creates, snapshots and updates make trades; deletes make none.

    The trade's identity is a digest of system, key and change position, so a change that comes again is the same
    trade and is dropped here.
    """
    d = changes.withColumn("_c", F.from_json(F.col(value).cast("string"), CHANGE, {"mode": "PERMISSIVE"}))
    good = F.coalesce(F.col("_c.op").isNotNull() & ((F.col("_c.op") == "d") | F.col("_c.after.id").isNotNull()), F.lit(False))
    bad = d.filter(~good).drop("_c")
    a = F.col("_c.after")
    t = d.filter(good & F.col("_c.op").isin("c", "r", "u")).select(
        F.sha2(F.concat_ws("|", F.lit(system), a["id"], F.col("_c.source.lsn")), 256).alias("tradeId"),
        a["ticker"].alias("ticker"), a["quantity"].alias("quantity"), a["price"].alias("price"), F.upper(a["side"]).alias("side"), a["trader"].alias("traderId"), a["account"].alias("accountId"), a["ts_ms"].alias("event_ms"),
        F.lit(system).alias("sourceSystem"), a["id"].alias("sourceRecordKey"), F.col("_c.source.lsn").alias("sourceChangePosition"), F.lit(batch).cast("string").alias("migrationBatchId"),
    )
    return t.dropDuplicates(["tradeId"]), bad
