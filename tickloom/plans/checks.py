"""More registered queries: sources and sinks, wire format, rules of single events, scalars, governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import validation, wire
from ..functions.ordered import even_span
from ..operators import archive, governance, market_state
from ..schemas import RECORD, TOPICS
from ..sources import cdc, generators, records
from . import views as V
from .registry import SQL, folder, query


@query(f"""WITH {V.ARCHIVE} SELECT topic, "partition", "offset", key, value AS payload, corr AS "correlationId" FROM archive WHERE topic IN ('topic-1', 'topic-3')""")
def records_read(spark, sf_dir):
    """Records published by topic, read again by a subscription to two topics."""
    at = folder(spark)
    records.publish(V.archive(spark, sf_dir).select(*RECORD.names), path=at)
    d = records.read(spark, records.Subscription(("topic-1", "topic-3"), "audit", path=at))
    return d.select("topic", "partition", "offset", "key", F.decode("value", "UTF-8").alias("payload"), S.correlation_id("headers").alias("correlationId"))


@query(f"""WITH {V.TICKS} SELECT 'market-data.ticks' AS topic, ticker AS key, 7 AS schema_id, ticker, bid, ask, last, volume, event_ms, 'corr-' || seq AS "correlationId", 'vendor=' || volume AS trace, CAST(NULL AS VARCHAR) AS error FROM ticks""")
def avro_round_trip(spark, sf_dir):
    """Ticks as keyed records with framed Avro bodies, and what a consumer decodes from them."""
    t = V.ticks(spark, sf_dir)
    named = {"bidPrice": F.col("bid"), "askPrice": F.col("ask"), "lastTradedPrice": F.col("last"), "eventTimestamp": F.col("event_ms"), "producedAt": F.col("event_ms") + 1, "correlationId": F.concat(F.lit("corr-"), F.col("seq").cast("string"))}
    event = F.struct("ticker", *[named[c].alias(c) for c in list(named)[:3]], "volume", *[named[c].alias(c) for c in list(named)[3:]], F.create_map(F.lit("tracestate"), F.concat(F.lit("vendor="), F.col("volume").cast("string"))).alias("traceContext"))
    sent = records.keyed(t.withColumn("value", wire.encoded(event, "MarketDataTickEvent", 7)), "market-data.ticks", "ticker", "value")
    d = sent.withColumn("d", wire.decode(S.payload_body("value"), "MarketDataTickEvent"))
    e = F.col("d.event")
    return d.select("topic", "key", S.schema_id("value").cast("int").alias("schema_id"), e["ticker"].alias("ticker"), e["bidPrice"].alias("bid"), e["askPrice"].alias("ask"), e["lastTradedPrice"].alias("last"), e["volume"].alias("volume"), F.unix_millis(e["eventTimestamp"]).alias("event_ms"), e["correlationId"].alias("correlationId"), F.array_join(F.transform(F.map_entries(e["traceContext"]), lambda x: x["value"]), ",").alias("trace"), F.col("d.error").alias("error"))


_CHANGES = """changes AS (SELECT o_orderkey AS k, ['c', 'u', 'd', 'r', 'x'][o_orderkey % 5 + 1] AS op, o_custkey AS c, o_totalprice AS p FROM orders)"""


def _changes(spark, sf_dir):
    """Orders as changes of a legacy table: every kind, each 7th twice, some that aren't JSON."""
    o = V.table(spark, sf_dir, "orders")
    k, n = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    op = F.element_at(F.array(*map(F.lit, "cudrx")), (k % 5 + 1).cast("int"))
    after = F.struct(F.concat(F.lit("L"), n).alias("id"), F.concat(F.lit("T"), (k % 50).cast("string")).alias("ticker"), (k % 90 + 1).alias("quantity"), F.col("o_totalprice").alias("price"), F.when(k % 2 == 0, "buy").otherwise("sell").alias("side"), F.concat(F.lit("tr"), F.col("o_custkey").cast("string")).alias("trader"), F.lit("a1").alias("account"), (F.lit(V.START_MS) + k).alias("ts_ms"))
    body = F.to_json(F.struct(F.when(op != "d", after).alias("after"), op.alias("op"), F.struct(F.lit("trades").alias("table"), F.concat(F.lit("lsn-"), n).alias("lsn"), (F.lit(V.START_MS) + k).alias("ts_ms")).alias("source")))
    d = o.select(k.alias("k"), F.encode(F.when(k % 23 == 0, F.lit("{broken")).otherwise(body), "UTF-8").alias("value"))
    return d.unionByName(d.filter("k % 7 = 0"))


@query(f"""WITH {_CHANGES} SELECT sha256('legacy|L' || k || '|lsn-' || k) AS "tradeId", 'T' || (k % 50) AS ticker, k % 90 + 1 AS quantity, p AS price, CASE WHEN k % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
'tr' || c AS "traderId", {V.START_MS} + k AS event_ms, 'L' || k AS "sourceRecordKey", 'lsn-' || k AS "sourceChangePosition", 'batch-1' AS "migrationBatchId" FROM changes WHERE k % 23 <> 0 AND op IN ('c', 'u', 'r')""")
def cdc_trades(spark, sf_dir):
    good, _ = cdc.canonical_trades(_changes(spark, sf_dir), "legacy", "batch-1")
    return good.select("tradeId", "ticker", "quantity", "price", "side", "traderId", "event_ms", "sourceRecordKey", "sourceChangePosition", "migrationBatchId")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS times FROM orders WHERE o_orderkey % 23 = 0")
def cdc_rejects(spark, sf_dir):
    """Changes that can't be read, each as often as it came."""
    return cdc.canonical_trades(_changes(spark, sf_dir), "legacy")[1].groupBy("k").agg(F.count("*").alias("times"))


@query(f"""WITH {V.ARCHIVE}, r AS (SELECT topic, "partition", "offset", event_id * 2 AS seq FROM a0 UNION ALL
SELECT topic, "partition", "offset", event_id * 2 + CASE WHEN event_id % 100 = 0 THEN 1 ELSE 301 END FROM a0 WHERE event_id % 50 = 0),
l AS (SELECT *, lag("offset") OVER (PARTITION BY topic, "partition" ORDER BY seq) AS before FROM r) SELECT topic, "partition", "offset", seq FROM l WHERE before IS DISTINCT FROM "offset" """)
def bounded_idempotence(spark, sf_dir):
    """A window of one key: what comes again at once is dropped, what comes again later passes."""
    d = V.table(spark, sf_dir, "events").filter("event_id % 97 <> 0").select("event_id", F.concat(F.lit("topic-"), (F.col("event_id") % 4).cast("string")).alias("topic"), (F.floor(F.col("event_id") / 4) % 12).cast("int").alias("partition"), F.floor(F.col("event_id") / 48).alias("offset"))
    late = F.when(F.col("event_id") % 100 == 0, 1).otherwise(301)
    d = d.withColumn("seq", F.col("event_id") * 2).unionByName(d.filter("event_id % 50 = 0").withColumn("seq", F.col("event_id") * 2 + late))
    return archive.bounded_once(d.select("topic", "partition", "offset", "seq"), 1, "seq")


@query(f"WITH l AS ({SQL['market_latest']}), v AS ({SQL['vwap']}) SELECT l.ticker, bid, ask, last, volume, event_ms, \"offset\", produced_ms, \"correlationId\", v.vwap, v.n_buckets FROM l LEFT JOIN v ON l.ticker = v.ticker")
def market_rebuild(spark, sf_dir):
    """The log, replayed from its first offset, gives what it gave at first."""
    t = V.ticks(spark, sf_dir)
    replayed = t.unionByName(t.withColumn("seq", F.col("seq") + 1_000_000_000_000_000))
    d = market_state.rebuilt(replayed, V.BUCKET_S, V.RETAIN_S, V.HORIZON_S, even_span(t, "seq"))
    return d.withColumn("vwap", S.half_up(F.col("vwap"), 4))


@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 43 = 0 THEN 'NULL_INSTRUMENT,BLANK_INSTRUMENT_ID,BLANK_TICKER,SHARES_NOT_POSITIVE'
ELSE concat_ws(',', CASE WHEN p_partkey % 5 = 0 THEN 'BLANK_INSTRUMENT_ID' END, CASE WHEN p_partkey % 7 = 0 THEN 'BLANK_TICKER' END, CASE WHEN p_partkey % 11 < 2 THEN 'SHARES_NOT_POSITIVE' END) END AS reasons
FROM part WHERE p_partkey % 43 = 0 OR p_partkey % 5 = 0 OR p_partkey % 7 = 0 OR p_partkey % 11 < 2""")
def instrument_faults(spark, sf_dir):
    """Rows whose fields are null or blank in all ways."""
    k = F.col("p_partkey")
    some = lambda c: F.when(k % 43 != 0, c)
    d = V.table(spark, sf_dir, "part").select(k.alias("k"), some(F.when(k % 5 == 0, F.lit(" \t")).otherwise(F.concat(F.lit("I"), k.cast("string")))).alias("instrumentId"), some(F.when(k % 7 == 0, F.lit("")).otherwise("T")).alias("ticker"), some(F.when(k % 11 == 0, 0).when(k % 11 == 1, -1).otherwise(5)).cast("long").alias("sharesOutstanding"))
    return validation.split(d, validation.instrument_reasons())[1].select("k", F.array_join("reasons", ",").alias("reasons"))


def _cases(spark, sf_dir):
    i = F.col("event_id")
    state = F.element_at(F.array(*map(F.lit, ["OPEN", "CLOSED", "closed", "LOST"])), (i % 4 + 1).cast("int"))
    text = lambda c, m: F.when(i % m != 0, F.concat(F.lit(c), i.cast("string")))
    return V.table(spark, sf_dir, "events").select(i, text("C", 11).alias("caseId"), text("A", 13).alias("alertId"), F.when(i % 17 != 0, state).alias("state"), F.lit("s").alias("actorSubject"), F.lit("r").alias("actorRole"), F.lit("x").alias("reasonCode"), F.lit(None).cast("string").alias("comment"), F.timestamp_millis(V.epoch_ms("ts")).alias("eventTimestamp"), text("K", 19).alias("correlationId"))


@query("""SELECT event_id, concat_ws(',', CASE WHEN event_id % 11 = 0 THEN 'NULL_caseId' END, CASE WHEN event_id % 13 = 0 THEN 'NULL_alertId' END, CASE WHEN event_id % 17 = 0 THEN 'NULL_state' END, CASE WHEN event_id % 19 = 0 THEN 'NULL_correlationId' END) AS reasons
FROM events WHERE event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0 OR event_id % 19 = 0""")
def event_mandatory(spark, sf_dir):
    """Events that lack mandatory fields; a null optional one is no fault."""
    return validation.split(_cases(spark, sf_dir), validation.mandatory_reasons("AlertCaseEvent"))[1].select("event_id", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT event_id, 'BAD_state' AS reasons FROM events WHERE event_id % 17 <> 0 AND event_id % 4 >= 2")
def event_enums(spark, sf_dir):
    """Events with a symbol outside the field's domain, to the letter."""
    return validation.split(_cases(spark, sf_dir), validation.enum_reasons("AlertCaseEvent"))[1].select("event_id", F.array_join("reasons", ",").alias("reasons"))


@query("""SELECT event_id, concat_ws(';', 'correlationId=c' || event_id, CASE WHEN event_id % 3 = 1 OR event_id % 3 = 2 THEN 'traceparent=p' || event_id END, CASE WHEN event_id % 3 = 2 THEN 'tracestate=s' END) AS headers FROM events""")
def trace_headers(spark, sf_dir):
    """A correlation id and what the trace map has; a null map has nothing."""
    i = F.col("event_id")
    p = F.concat(F.lit("p"), i.cast("string"))
    trace = F.when(i % 3 == 1, F.create_map(F.lit("traceparent"), p)).when(i % 3 == 2, F.create_map(F.lit("tracestate"), F.lit("s"), F.lit("traceparent"), p, F.lit("other"), F.lit("x")))
    d = V.table(spark, sf_dir, "events").select(i, F.concat(F.lit("c"), i.cast("string")).alias("c"), trace.alias("t"))
    return d.select("event_id", F.array_join(F.transform(S.headers("c", "t"), lambda h: F.concat(h["key"], F.lit("="), F.decode(h["value"], "UTF-8"))), ";").alias("headers"))


_SIX = "floor({x} * 1000000 + 0.5) / 1000000"


@query(f"""SELECT event_id, {_SIX.format(x="(value * (1 - 5.0::DOUBLE / 20000))")} AS bid, {_SIX.format(x="(value * (1 + 5.0::DOUBLE / 20000))")} AS ask,
{_SIX.format(x="(((0.08::DOUBLE - 0.25::DOUBLE * 0.25::DOUBLE / 2) * (60.0::DOUBLE / (252 * 6.5::DOUBLE * 3600)) + 0.25::DOUBLE * power(60.0::DOUBLE / (252 * 6.5::DOUBLE * 3600), 0.5) * (value / 100)))")} AS step,
CAST(floor(100.0::DOUBLE / power((event_id % 997 + 1) / 1000.0::DOUBLE, 1.0::DOUBLE / 1.5)) AS BIGINT) AS volume, CAST(floor(event_id / 10.0) * 10 AS BIGINT) AS bucket FROM events""")
def price_scalars(spark, sf_dir):
    """Bid, ask, step of the price walk and Pareto volume, from given shocks in place of random ones."""
    e = V.table(spark, sf_dir, "events")
    u = (F.col("event_id") % 997 + 1) / 1000.0
    return e.select("event_id", S.half_up(S.bid("value", 5.0), 6).alias("bid"), S.half_up(S.ask("value", 5.0), 6).alias("ask"), S.half_up(S.log_step(0.08, 0.25, 60.0, F.col("value") / 100), 6).alias("step"), S.pareto(u, 100.0, 1.5).alias("volume"), S.event_bucket(F.col("event_id") * 1000, 10).alias("bucket"))


_TOPICS = ", ".join(f"('{t}', {p}, '{'cleanup.policy=compact' if d is None else f'retention.ms={d * 86_400_000}'}')" for t, (p, d, _) in TOPICS.items())


_NAMES = ", ".join(f"'{t}'" for t in TOPICS)


@query(f"""WITH c AS (SELECT * FROM (VALUES {_TOPICS}) v(name, partitions, config)), r AS (SELECT [{_NAMES}][event_id % {len(TOPICS) + 1} + 1] AS name, user_id % 16 AS p FROM events)
SELECT c.name, CAST(c.partitions AS INTEGER) AS partitions, c.config, count(r.name) AS records, count(*) FILTER (r.p >= c.partitions) AS misplaced FROM c LEFT JOIN r ON c.name = r.name GROUP BY ALL""")
def topic_catalogue(spark, sf_dir):
    """The catalogue's topics, with the records that came to each and those in a partition that it hasn't."""
    name = F.try_element_at(F.array(*map(F.lit, TOPICS)), (F.col("event_id") % (len(TOPICS) + 1) + 1).cast("int"))
    records = V.table(spark, sf_dir, "events").select(name.alias("name"), (F.col("user_id") % 16).alias("p"))
    return governance.topic_use(governance.topic_catalogue(spark), records)


_RULES = ", ".join(f"('{p}', '{t}', '{n}', '{o}')" for p, t, n, ops in governance.POLICIES for o in ops)
_WHO = sorted({p[0] for p in governance.POLICIES})
_WHAT = sorted({p[2] for p in governance.POLICIES})


@query(f"""WITH g AS (SELECT principal, "resourceType", name, operation, '--add --allow-principal User:' || principal || ' --operation ' || operation || ' --' || replace(lower("resourceType"), '_', '-') || ' ' || name AS arguments
  FROM (VALUES {_RULES}) v(principal, "resourceType", name, operation)), r AS (SELECT [{", ".join(f"'{w}'" for w in _WHO)}][user_id % {len(_WHO)} + 1] AS principal, [{", ".join(f"'{w}'" for w in _WHAT)}][event_id % {len(_WHAT)} + 1] AS name FROM events)
SELECT g.*, count(r.name) AS requests FROM g LEFT JOIN r ON r.principal = g.principal AND r.name = g.name GROUP BY ALL""")
def grant_arguments(spark, sf_dir):
    """The argument line of each grant, with the requests that it would answer."""
    pick = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (F.col(c) % len(xs) + 1).cast("int"))
    requests = V.table(spark, sf_dir, "events").select(pick(_WHO, "user_id").alias("principal"), pick(_WHAT, "event_id").alias("name"))
    return governance.grants_used(governance.grant_arguments(governance.policies(spark)), requests)


@query("SELECT n_name AS name, 'r' || n_regionkey AS namespace FROM nation WHERE n_nationkey % 4 = 0 OR n_nationkey % 7 = 1")
def schemas_dropped(spark, sf_dir):
    """Schemas that are gone, or that have moved to another namespace."""
    n = V.table(spark, sf_dir, "nation")
    k, space = F.col("n_nationkey"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    now = n.filter(k % 4 != 0).select(F.col("n_name").alias("name"), F.when(k % 7 == 1, "moved").otherwise(space).alias("namespace"))
    return governance.dropped_schemas(n.select(F.col("n_name").alias("name"), space.alias("namespace")), now)


@query("SELECT c_mktsegment AS name FROM customer WHERE c_custkey % 2 = 0 INTERSECT SELECT c_mktsegment FROM customer WHERE c_custkey % 3 = 0")
def settings_shared(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "name")
    return governance.shared_names(c.filter("c_custkey % 2 = 0"), c.filter("c_custkey % 3 = 0"))


@query("""SELECT s_suppkey AS name, concat_ws(',', CASE WHEN s_suppkey % 3 > 0 THEN 'application' END, CASE WHEN s_suppkey % 5 > 0 THEN 'module' END, CASE WHEN s_suppkey % 2 > 0 THEN 'principal' END) AS found
FROM supplier WHERE (s_suppkey % 3 = 0 OR s_suppkey % 5 = 0 OR s_suppkey % 2 = 0) AND (s_suppkey % 3 > 0 OR s_suppkey % 5 > 0 OR s_suppkey % 2 > 0)""")
def names_unchained(spark, sf_dir):
    s = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"))
    return governance.name_chain(s.filter("name % 5 > 0"), s.filter("name % 3 > 0"), s.filter("name % 2 > 0"))


@query("""SELECT DISTINCT l_partkey % 40 AS src, l_suppkey % 40 AS dst, 'p' || (l_partkey % 4) AS from_plane, 'p' || (l_suppkey % 4) AS to_plane FROM lineitem
WHERE l_partkey % 4 <> l_suppkey % 4 AND NOT (l_partkey % 4 = 0 AND l_suppkey % 4 = 1) AND NOT (l_partkey % 4 = 2 AND l_suppkey % 4 = 3)""")
def edges_crossing(spark, sf_dir):
    """Dependencies between planes, of which two ways are allowed."""
    edges = V.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 40).alias("src"), (F.col("l_suppkey") % 40).alias("dst")).distinct()
    planes = spark.range(40).select(F.col("id").alias("module"), F.concat(F.lit("p"), (F.col("id") % 4).cast("string")).alias("plane"))
    return governance.crossing_edges(edges, planes, [("p0", "p1"), ("p2", "p3")]).select("src", "dst", "from_plane", "to_plane")


@query("SELECT event_id, replace(lower(event_type), '_', '-') AS flag, 'topic-' || event_id % 4 || '.dlq' AS dlq, 'market:{T' || user_id || '}:window' AS cache_key FROM events")
def names_and_flags(spark, sf_dir):
    d = V.table(spark, sf_dir, "events").withColumns({"topic": F.concat(F.lit("topic-"), (F.col("event_id") % 4).cast("string")), "ticker": F.concat(F.lit("T"), F.col("user_id").cast("string"))})
    return d.select("event_id", S.flag(F.col("event_type")).alias("flag"), S.dlq_topic().alias("dlq"), S.cache_key("ticker", "window").alias("cache_key"))


@query(f"""WITH {V.TRADES}, once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "tradeId" ORDER BY seq) AS k FROM trades) WHERE k = 1), {V.TICKS}, {V.INSTRUMENTS},
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY event_ms DESC, seq) AS m FROM ticks) WHERE m = 1),
one AS (SELECT ticker, arg_min("sharesOutstanding", "instrumentId") AS shares FROM latest GROUP BY ticker)
SELECT "tradeId", o.ticker, floor((bid + ask) / 2 * 10000 + 0.5) / 10000 AS mid, floor(shares * price / 1e7 * 10000 + 0.5) / 10000 AS "marketCap", o.event_ms - l.event_ms AS "dataAgeMs", true AS timed
FROM once o JOIN l ON o.ticker = l.ticker JOIN one ON o.ticker = one.ticker""")
def stream_enrichment(spark, sf_dir):
    """Trades as a stream of several batches, enriched with the market as it is now."""
    from ..operators import reference_data
    from ..streaming.enrichment import enrichment_stream
    from ..streaming.versions import Files

    at = folder(spark)
    trades = V.trades_once(spark, sf_dir, "tradeId", "ticker", "price", "event_ms").withColumn("produced_ms", F.col("event_ms"))
    trades.write.parquet(f"{at}/in")
    market_state.latest(V.ticks(spark, sf_dir)).write.parquet(f"{at}/state")
    reference_data.latest_instruments(reference_data.publishable(V.instruments(spark, sf_dir), "reference-data")[0]).write.parquet(f"{at}/instruments")
    # Four batches or so, each with a quarter of the files: a batch of a fixed few would leave most cores idle.
    files = sum(n.endswith(".parquet") for n in Files(spark, at).names(f"{at}/in"))
    stream = spark.readStream.schema(trades.schema).option("maxFilesPerTrigger", max(4, -(-files // 4))).parquet(f"{at}/in")
    enrichment_stream(stream, lambda: spark.read.parquet(f"{at}/state"), lambda: spark.read.parquet(f"{at}/instruments"), f"{at}/out", f"{at}/misses", f"{at}/cp").awaitTermination()
    d = spark.read.parquet(f"{at}/out")
    return d.select("tradeId", "ticker", S.half_up(F.col("mid"), 4).alias("mid"), S.half_up(F.col("marketCap"), 4).alias("marketCap"), "dataAgeMs", (F.col("enrichmentLatencyMs") == F.col("enrichedAtMs") - F.col("produced_ms")).alias("timed"))


@query(f"""SELECT 'CA' || p_partkey AS "corporateActionId", 'T' || (p_partkey % 190) AS ticker, p_partkey % 4 = 1 AS split, {V.START_MS} AS announced_ms, {V.START_MS} + p_partkey % 1000 * 60000 AS effective_ms FROM part WHERE p_partkey % 3 = 0""")
def seeded_actions(spark, sf_dir):
    """Corporate actions seeded from a table, in force so many seconds after now."""
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 1, "STOCK_SPLIT").otherwise("EARNINGS_ANNOUNCEMENT")
    attributes = F.when(k % 4 == 1, F.create_map(F.lit("splitRatio"), F.lit("2:1"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = V.table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(F.concat(F.lit("CA"), k.cast("string")).alias("corporateActionId"), F.concat(F.lit("T"), (k % 190).cast("string")).alias("ticker"), kind.alias("actionType"), attributes.alias("attributes"), (k % 1000 * 60).alias("effective_in_seconds"))
    d = generators.seed_corporate_actions(spark, rows, F.timestamp_millis(F.lit(V.START_MS)))
    return d.select("corporateActionId", "ticker", (F.try_element_at("attributes", F.lit("splitRatio")) == "2:1").eqNullSafe(True).alias("split"), F.unix_millis("announcedAt").alias("announced_ms"), F.unix_millis("effectiveAt").alias("effective_ms"))


@query("""SELECT 'I' || p_partkey AS "instrumentId", 'T' || (p_partkey % 190) AS ticker, CAST(p_size AS BIGINT) * 1000000 AS "sharesOutstanding", CAST(1 AS BIGINT) AS "referenceVersion" FROM part""")
def seeded_instruments(spark, sf_dir):
    """The instrument master seeded from a table: each at version 1, all of which the version guard lets through."""
    k = F.col("p_partkey")
    rows = V.table(spark, sf_dir, "part").select(F.concat(F.lit("I"), k.cast("string")).alias("instrumentId"), F.concat(F.lit("T"), (k % 190).cast("string")).alias("ticker"), (F.col("p_size").cast("long") * 1_000_000).alias("sharesOutstanding"))
    good = validation.version_guard(generators.seed_instruments(spark, rows)).filter("accepted")
    return good.select("instrumentId", "ticker", "sharesOutstanding", "referenceVersion")


@query(f"""WITH {V.TRADES} SELECT 'trades.raw' AS topic, ticker AS key, "tradeId", quantity, price, side, "traderId", event_ms, 'corr-' || seq AS "correlationId", 'p' || seq AS trace FROM trades""")
def trades_published(spark, sf_dir):
    """Trades published by ticker with their trace headers, and what a consumer makes of the records."""
    at, t = folder(spark), V.trades(spark, sf_dir)
    n = F.col("seq").cast("string")
    body = F.struct("tradeId", "ticker", "quantity", "price", "side", "traderId", "event_ms")
    t = t.withColumns({"value": F.encode(F.to_json(body), "UTF-8"), "c": F.concat(F.lit("corr-"), n), "t": F.create_map(F.lit("traceparent"), F.concat(F.lit("p"), n))})
    records.publish(records.keyed(t.withColumn("h", S.headers("c", "t")), "trades.raw", "ticker", "value", "h"), path=at)
    d = spark.read.schema("key string, value binary, headers array<struct<key:string,value:binary>>, topic string").parquet(at)
    event = F.from_json(F.decode("value", "UTF-8"), "tradeId string, ticker string, quantity long, price double, side string, traderId string, event_ms long")
    trace = F.decode(F.element_at(F.filter("headers", lambda h: h["key"] == "traceparent"), 1)["value"], "UTF-8")
    return d.withColumn("e", event).select("topic", "key", "e.tradeId", "e.quantity", "e.price", "e.side", "e.traderId", "e.event_ms", S.correlation_id("headers").alias("correlationId"), trace.alias("trace"))
