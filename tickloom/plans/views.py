"""Domain views derived from the test tables, each as DataFrame code and as SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.positions import first_delivered

BUCKET_S, RETAIN_S, HORIZON_S = 3600, 259_200, 259_200
START_MS = 1_704_067_200_000
SIX_HOURS_MS = 21_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(col: str):
    """Milliseconds of a timestamp as it is written, in any session time zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast({col} as timestamp_ntz))")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: shuffled delivery makes older ones, event times cut to six hours make duplicates, and a tenth is delivered twice."""
    e = table(spark, sf_dir, "events")
    at = (F.col("event_id") + F.col("event_id") * 7919 % 1000) * 1_000_000 + F.col("event_id")
    d = e.select(
        F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("ticker"), (F.col("value") - 0.5).alias("bid"), (F.col("value") + 0.5).alias("ask"), F.col("value").alias("last"),
        F.get_json_object("props", "$.k").cast("long").alias("volume"), (F.floor(epoch_ms("ts") / SIX_HOURS_MS) * SIX_HOURS_MS).cast("long").alias("event_ms"), at.alias("offset"), at.alias("seq"),
    )
    d = d.withColumns({"produced_ms": F.col("event_ms") + F.col("offset") % 1000, "correlationId": F.concat(F.lit("corr-"), F.col("offset").cast("string"))})
    return d.unionByName(d.filter("offset % 10 = 0").withColumn("seq", F.col("seq") + 500_000_000))


TICKS = f"""t0 AS (
  SELECT 'T' || CAST(user_id AS VARCHAR) AS ticker, value - 0.5 AS bid, value + 0.5 AS ask, value AS last,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume,
         CAST(floor((epoch_us(ts) // 1000) / {SIX_HOURS_MS}.0) AS BIGINT) * {SIX_HOURS_MS} AS event_ms,
         (event_id + event_id * 7919 % 1000) * 1000000 + event_id AS "offset",
         (event_id + event_id * 7919 % 1000) * 1000000 + event_id AS seq FROM events),
t1 AS (SELECT *, event_ms + "offset" % 1000 AS produced_ms, 'corr-' || "offset" AS "correlationId" FROM t0),
ticks AS (SELECT * FROM t1 UNION ALL SELECT * REPLACE (seq + 500000000 AS seq) FROM t1 WHERE "offset" % 10 = 0)"""


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`trades` with the order that each belongs to. What is delivered twice is spelled out row by row, so the join runs once."""
    d = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    k, n, p = F.col("l_orderkey"), F.col("l_linenumber").cast("long"), F.col("l_partkey")
    d = d.select(
        k.alias("orderKey"),
        F.concat_ws("-", k.cast("string"), n.cast("string"), p.cast("string"), F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("long").cast("string"), F.col("l_returnflag")).alias("tradeId"), F.concat(F.lit("T"), (p % 200).cast("string")).alias("ticker"),
        F.col("l_quantity").cast("long").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        F.concat(F.lit("trader-"), F.col("o_custkey").cast("string")).alias("traderId"), F.concat(F.lit("account-"), (F.col("o_custkey") % 50).cast("string")).alias("accountId"),
        (F.lit(START_MS) + (k * 7919 + n * 104729 + p * 31) % 43200 * 60_000).alias("event_ms"), (((k * 10 + n) * 10_000_000 + p) * 200 + F.col("l_quantity").cast("long") * 2).alias("seq"),
    )
    times = F.when(F.expr("(seq div 2000000000) % 20 = 0"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.withColumn("_again", F.explode(times)).withColumn("seq", F.col("seq") + F.col("_again")).drop("_again")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as trades within the month of the ticks; a twentieth is delivered twice."""
    return _trades(spark, sf_dir).drop("orderKey")


def trades_once(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Those columns (or all) of `trades` as delivered first. A trade's copies are of one order, by which the join has dealt them."""
    d = _trades(spark, sf_dir)
    d = d.select(*dict.fromkeys(["orderKey", "tradeId", "seq", *cols])) if cols else d
    d = first_delivered(d, "orderKey").drop("orderKey")
    return d.select(*cols) if cols else d


TRADES = f"""r0 AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS BIGINT) || '-' || l_returnflag AS "tradeId", 'T' || CAST(l_partkey % 200 AS VARCHAR) AS ticker,
         CAST(l_quantity AS BIGINT) AS quantity, l_extendedprice / l_quantity AS price,
         CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
         'trader-' || o_custkey AS "traderId", 'account-' || (o_custkey % 50) AS "accountId",
         {START_MS} + (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 43200 * 60000 AS event_ms,
         ((l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey) * 200 + CAST(l_quantity AS BIGINT) * 2 AS seq FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
trades AS (SELECT * FROM r0 UNION ALL SELECT * REPLACE (seq + 1 AS seq) FROM r0 WHERE (seq // 2000000000) % 20 = 0)"""


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as an instrument, delivered in three versions, some of them 0 or not newer, a few without a ticker."""
    p = table(spark, sf_dir, "part").withColumn("k", F.explode(F.expr("array(0L, 1L, 2L)")))
    key = F.col("p_partkey")
    return p.select(
        F.concat(F.lit("I"), key.cast("string")).alias("instrumentId"), F.when(key % 61 == 0, F.lit("  ")).otherwise(F.concat(F.lit("T"), (key % 190).cast("string"))).alias("ticker"),
        (F.col("p_size").cast("long") * 1_000_000).alias("sharesOutstanding"), (key * (F.col("k") + 1) % 4).alias("referenceVersion"), F.col("k").alias("seq"),
    )


INSTRUMENTS = """instruments AS (
  SELECT 'I' || p_partkey AS "instrumentId", CASE WHEN p_partkey % 61 = 0 THEN '  ' ELSE 'T' || (p_partkey % 190) END AS ticker,
         CAST(p_size AS BIGINT) * 1000000 AS "sharesOutstanding", p_partkey * (k + 1) % 4 AS "referenceVersion", k AS seq
  FROM part, (SELECT unnest([0, 1, 2]) AS k)),
guarded AS (
  SELECT *, "referenceVersion" > greatest(0, coalesce(max("referenceVersion") OVER (PARTITION BY "instrumentId" ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS accepted
  FROM instruments WHERE trim(ticker) <> '' AND "sharesOutstanding" > 0),
latest AS (SELECT "instrumentId", arg_max(ticker, "referenceVersion") AS ticker, arg_max("sharesOutstanding", "referenceVersion") AS "sharesOutstanding", max("referenceVersion") AS "referenceVersion"
           FROM guarded WHERE accepted GROUP BY ALL)"""


def corporate_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as corporate actions; some take effect too early, some lack attributes or have blank ones."""
    key = F.col("p_partkey")
    kinds = F.array(*map(F.lit, ["DIVIDEND_DECLARATION", "STOCK_SPLIT", "RIGHTS_ISSUE", "EARNINGS_ANNOUNCEMENT"]))
    value = F.when(key % 7 == 0, F.lit(" \t")).otherwise(F.lit("1"))
    full = F.create_map(F.lit("dividendPerShare"), value, F.lit("splitRatio"), value, F.lit("ratio"), F.lit("1:15"), F.lit("subscriptionPrice"), value)
    announced = F.lit(START_MS) + key * 1000
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("CA"), key.cast("string")).alias("corporateActionId"), F.concat(F.lit("T"), (key % 190).cast("string")).alias("ticker"), F.element_at(kinds, (key % 4 + 1).cast("int")).alias("actionType"),
        F.when(key % 17 == 0, F.lit(None)).when(key % 5 == 0, F.create_map().cast("map<string,string>")).otherwise(full).alias("attributes"),
        F.timestamp_millis(announced).alias("announcedAt"), F.timestamp_millis(announced + (key % 11 - 1) * 86_400_000).alias("effectiveAt"), (announced + (key % 11 - 1) * 86_400_000).alias("effective_ms"),
    )


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as delivered records: a gap at each 97th, each 50th delivered twice, each 29th a tombstone."""
    e = table(spark, sf_dir, "events").filter("event_id % 97 <> 0")
    i = F.col("event_id")
    header = lambda v: F.struct(F.lit("correlationId").alias("key"), F.encode(v, "UTF-8").alias("value"))
    d = e.select(
        F.concat(F.lit("topic-"), (i % 4).cast("string")).alias("topic"), (F.floor(i / 4) % 12).cast("int").alias("partition"), F.floor(i / 48).alias("offset"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("key"),
        F.when(i % 29 == 0, F.lit(None)).otherwise(F.encode(F.col("props"), "UTF-8")).alias("value"), F.timestamp_millis(epoch_ms("ts")).alias("timestamp"),
        F.when(i % 3 == 0, F.array().cast("array<struct<key:string,value:binary>>")).otherwise(F.array(header(F.lit("first")), header(F.concat(F.lit("corr-"), i.cast("string"))))).alias("headers"), "event_id", "event_type",
    )
    return d.unionByName(d.filter("event_id % 50 = 0"))


ARCHIVE = """a0 AS (
  SELECT 'topic-' || (event_id % 4) AS topic, CAST((event_id // 4) % 12 AS INTEGER) AS "partition", event_id // 48 AS "offset", 'U' || user_id AS key,
         CASE WHEN event_id % 29 = 0 THEN NULL ELSE props END AS value, (epoch_us(ts) // 1000) AS ts_ms,
         CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'corr-' || event_id END AS corr, event_id, event_type FROM events WHERE event_id % 97 <> 0),
archive AS (SELECT * FROM a0 UNION ALL SELECT * FROM a0 WHERE event_id % 50 = 0)"""

# Rule events: ruleId, ruleType, version, state, maker, checker, threshold, effective_ms.
RULE_EVENTS = [
    ("R-DEV", "PRICE_DEVIATION", 1, "ACTIVE", "ann", "bob", 900.0, START_MS),
    ("R-DEV", "PRICE_DEVIATION", 2, "ACTIVE", "ann", "cat", 500.0, START_MS + 864_000_000),
    ("R-DEV", "PRICE_DEVIATION", 3, "ACTIVE", "ann", "ann", 1.0, START_MS + 1_296_000_000),
    ("R-DEV", "PRICE_DEVIATION", 2, "RETIRED", "ann", "cat", 500.0, START_MS + 1_728_000_000),
    ("R-POS", "POSITION_LIMIT_BREACH", 1, "DRAFT", "dan", None, 60.0, START_MS),
    ("R-POS", "POSITION_LIMIT_BREACH", 1, "ACTIVE", "dan", "eve", 60.0, START_MS),
    ("R-VOL", "UNUSUAL_VOLUME", 1, "ACTIVE", "fay", "gus", 1.8, START_MS),
]


def rule_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(RULE_EVENTS, "ruleId string, ruleType string, version long, state string, makerSubject string, checkerSubject string, threshold double, effective_ms long")


_quoted = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
RULES = f"""rule_events("ruleId", "ruleType", version, state, maker, checker, threshold, effective_ms) AS (
  SELECT * FROM (VALUES {", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in RULE_EVENTS)}) v),
ranges AS (
  SELECT "ruleId", "ruleType", CAST(version AS BIGINT) AS version, CAST(threshold AS DOUBLE) AS threshold, effective_ms AS from_ms, to_ms FROM (
    SELECT *, lead(effective_ms) OVER (PARTITION BY "ruleId" ORDER BY effective_ms, version) AS to_ms FROM rule_events
    WHERE state IN ('ACTIVE', 'RETIRED', 'REJECTED') AND (state <> 'ACTIVE' OR checker IS DISTINCT FROM maker)) WHERE state = 'ACTIVE')"""


def case_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    states = F.array(*map(F.lit, ["OPEN", "ACKNOWLEDGED", "INVESTIGATING", "CLOSED", "FALSE_POSITIVE"]))
    step = F.col("event_id") % 5
    return e.select(F.concat(F.lit("C"), F.floor(F.col("event_id") / 7).cast("string")).alias("caseId"), F.element_at(states, (F.when(F.col("event_id") % 7 == 0, 0).otherwise(step) + 1).cast("int")).alias("state"), epoch_ms("ts").alias("event_ms"), F.col("event_id").alias("seq"))


CASES = """cases AS (
  SELECT 'C' || (event_id // 7) AS "caseId", ['OPEN', 'ACKNOWLEDGED', 'INVESTIGATING', 'CLOSED', 'FALSE_POSITIVE'][CASE WHEN event_id % 7 = 0 THEN 1 ELSE event_id % 5 + 1 END] AS state,
         (epoch_us(ts) // 1000) AS event_ms, event_id AS seq FROM events)"""


def ledger_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as internal records, and as external ones that lack some, repeat some and differ in some."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    inner = o.filter("o_orderkey % 59 <> 0").select(k.alias("referenceId"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("state"))
    outer = o.filter("o_orderkey % 53 <> 0").select(k.alias("referenceId"), (F.col("o_totalprice") + F.when(k % 31 == 0, 0.5).when(k % 37 == 0, 10.0).otherwise(0.0)).alias("amount"), F.when(k % 41 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("state"))
    return inner, outer.unionByName(outer.filter("referenceId % 43 = 0"))


LEDGERS = """internal AS (SELECT o_orderkey AS "referenceId", count(*) AS n, min(o_totalprice) AS amount, min(o_orderstatus) AS state FROM orders WHERE o_orderkey % 59 <> 0 GROUP BY 1),
e0 AS (SELECT o_orderkey AS "referenceId", o_totalprice + CASE WHEN o_orderkey % 31 = 0 THEN 0.5 WHEN o_orderkey % 37 = 0 THEN 10.0 ELSE 0.0 END AS amount,
              CASE WHEN o_orderkey % 41 = 0 THEN 'X' ELSE o_orderstatus END AS state FROM orders WHERE o_orderkey % 53 <> 0),
e1 AS (SELECT * FROM e0 UNION ALL SELECT * FROM e0 WHERE "referenceId" % 43 = 0),
external AS (SELECT "referenceId", count(*) AS n, min(amount) AS amount, min(state) AS state FROM e1 GROUP BY 1)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    names = F.array(*map(F.lit, ["LOW", "MEDIUM", "HIGH", "CRITICAL"]))
    return e.select(F.concat(F.lit("K"), F.col("event_id").cast("string")).alias("candidateId"), F.element_at(names, (F.col("user_id") % 4 + 1).cast("int")).alias("priority"), epoch_ms("ts").alias("created_ms"), F.col("event_id").alias("n"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on two thirds of the candidates; some have a failed tool."""
    c = candidates(spark, sf_dir).filter("n % 3 <> 0")
    n = F.col("n")
    return c.select(
        F.concat(F.lit("D"), n.cast("string")).alias("decisionId"), "candidateId", F.when(n % 2 == 0, "NO_FLAG").otherwise("FLAG").alias("outcome"), F.concat(F.lit("model-"), (n % 3).cast("string")).alias("modelId"),
        F.create_map(F.lit("search"), F.when(n % 5 == 0, "failed").otherwise("ok"), F.lit("graph"), F.lit("ok")).alias("toolStatus"), (n % 1000).alias("inputTokens"), (n % 100).alias("outputTokens"), ((n % 1000) / 4).alias("estimatedCostUsd"), "n",
    )


DECISIONS = """candidates AS (SELECT 'K' || event_id AS "candidateId", ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][user_id % 4 + 1] AS priority, user_id % 4 AS p, (epoch_us(ts) // 1000) AS created_ms, event_id AS n FROM events WHERE event_type = 'error'),
decisions AS (SELECT 'D' || n AS "decisionId", "candidateId", CASE WHEN n % 2 = 0 THEN 'NO_FLAG' ELSE 'FLAG' END AS outcome, 'model-' || (n % 3) AS "modelId",
                     n % 5 = 0 AS failed, n % 1000 AS "inputTokens", n % 100 AS "outputTokens", (n % 1000) / 4.0 AS "estimatedCostUsd", n FROM candidates WHERE n % 3 <> 0)"""
