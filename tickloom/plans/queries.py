"""The registered queries over the domain views, each beside the SQL that gives the same rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import even_span
from ..functions.scalars import cache_key, correlation_id, half_up, idempotency_key
from ..functions.validation import tick_reasons, version_guard
from ..operators import archive, cases, corporate_actions, dead_letters, enrichment, governance, market_state, positions, reconciliation, reference_data, risk
from ..sources import generators
from . import views as V
from .registry import QUERIES, SQL, folder, query  # noqa: F401

#: Delivery order of one of these queries' ranges, into many of which each ticker's rows are cut, and their span of time.
SPAN, SPAN_MS = 2_000_000_000, 518_400_000
WASH_MS = 3_600_000
_PREV = "max({v}) OVER (PARTITION BY ticker ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_OUTCOMES = f"""o AS (SELECT *, {_PREV.format(v="event_ms")} AS prev, {_PREV.format(v='"offset"')} AS top FROM ticks),
outcomes AS (SELECT *, CASE WHEN prev IS NULL OR event_ms > prev THEN 'APPLIED' WHEN event_ms = prev THEN 'DUPLICATE' ELSE 'OLDER' END AS outcome,
                    top IS NULL OR "offset" > top AS accepted FROM o)"""
_BUCKETS = f"""b AS (SELECT *, CAST(floor(event_ms / {V.BUCKET_S * 1000}.0) AS BIGINT) * {V.BUCKET_S} AS bucket FROM outcomes WHERE accepted),
c AS (SELECT *, max(bucket) OVER (PARTITION BY ticker ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM b),
buckets AS (SELECT ticker, bucket, sum(CAST(last AS DECIMAL(18,4)) * volume) AS pv, sum(CAST(volume AS DOUBLE)) AS v FROM c WHERE bucket >= ahead - {V.RETAIN_S} GROUP BY ALL)"""
_R = "floor({x} * 10000 + 0.5) / 10000"
_VWAP = f"""WITH {V.TICKS}, {_OUTCOMES}, {_BUCKETS}, n AS (SELECT *, max(bucket) OVER (PARTITION BY ticker) AS newest FROM buckets)
SELECT ticker, {_R.format(x="CAST(sum(pv) AS DOUBLE) / nullif(sum(v), 0)")} AS vwap, count(*) AS n_buckets FROM n WHERE bucket > newest - {V.HORIZON_S} GROUP BY ticker"""


@query(f"WITH {V.TICKS}, {_OUTCOMES} SELECT ticker, seq, event_ms, outcome FROM outcomes")
def market_outcomes(spark, sf_dir):
    return market_state.outcomes(V.ticks(spark, sf_dir), SPAN).select("ticker", "seq", "event_ms", "outcome")


@query(f"""WITH {V.TICKS}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY event_ms DESC, seq) AS k FROM ticks)
SELECT ticker, bid, ask, last, volume, event_ms, "offset", produced_ms, "correlationId", 'market:{{' || ticker || '}}:tick' AS cache_key FROM r WHERE k = 1""")
def market_latest(spark, sf_dir):
    return market_state.latest(V.ticks(spark, sf_dir)).withColumn("cache_key", cache_key("ticker", "tick"))


@query(f'WITH {V.TICKS}, {_OUTCOMES} SELECT ticker, seq, "offset", accepted FROM outcomes')
def window_accepts(spark, sf_dir):
    return market_state.accepted(V.ticks(spark, sf_dir), SPAN).select("ticker", "seq", "offset", "accepted")


@query(f"WITH {V.TICKS}, {_OUTCOMES}, {_BUCKETS} SELECT ticker, bucket, CAST(pv AS DOUBLE) AS pv, v FROM buckets")
def window_buckets(spark, sf_dir):
    return market_state.window_buckets(V.ticks(spark, sf_dir), V.BUCKET_S, V.RETAIN_S, SPAN).select("ticker", "bucket", F.col("pv").cast("double").alias("pv"), "v")


@query(_VWAP)
def vwap(spark, sf_dir):
    t = V.ticks(spark, sf_dir)
    b = market_state.window_buckets(t, V.BUCKET_S, V.RETAIN_S, even_span(t, "seq"))
    return market_state.vwap(b, V.HORIZON_S).select("ticker", half_up(F.col("vwap"), 4).alias("vwap"), "n_buckets")


@query(f"""WITH {V.TICKS}, {_OUTCOMES} SELECT count(*) FILTER (outcome = 'APPLIED') AS applied, count(*) FILTER (outcome = 'DUPLICATE') AS stale_duplicate,
count(*) FILTER (outcome = 'OLDER') AS stale_older, count(*) FILTER (NOT accepted) AS window_skipped FROM outcomes""")
def outcome_counts(spark, sf_dir):
    return market_state.outcome_counts(V.ticks(spark, sf_dir), SPAN)


_BAD = """CASE WHEN volume % 7 = 0 THEN -volume ELSE volume END AS volume, CASE WHEN volume % 11 = 0 THEN event_ms + 4000000 ELSE event_ms END AS event_ms"""
_NOW = V.START_MS + 2_592_000_000


@query(f"""WITH {V.TICKS}, x AS (SELECT ticker, seq, volume % 13 = 0 AS broken, {_BAD} FROM ticks)
SELECT ticker, seq, concat_ws(',', CASE WHEN broken THEN 'PRICE_NOT_FINITE' END, CASE WHEN volume < 0 THEN 'NEGATIVE_VOLUME' END, CASE WHEN event_ms > {V.START_MS + 1_296_000_000} + 3600000 THEN 'FUTURE_EVENT' END) AS reasons
FROM x WHERE broken OR volume < 0 OR event_ms > {V.START_MS + 1_296_000_000} + 3600000""")
def tick_rejects(spark, sf_dir):
    v = F.col("volume")
    t = V.ticks(spark, sf_dir).withColumns({"bid": F.when(v % 13 == 0, F.lit(float("nan"))).otherwise(F.col("bid")), "event_ms": F.when(v % 11 == 0, F.col("event_ms") + 4_000_000).otherwise(F.col("event_ms")), "volume": F.when(v % 7 == 0, -v).otherwise(v)})
    rules = tick_reasons(F.lit(V.START_MS + 1_296_000_000))
    return t.withColumn("reasons", F.array_join(rules, ",")).filter("reasons <> ''").select("ticker", "seq", "reasons")


@query(f"""SELECT 'CA' || p_partkey AS "corporateActionId", early OR k17 OR missing <> '' AS rejected,
CASE WHEN early THEN 'EFFECTIVE_BEFORE_ANNOUNCED' WHEN k17 THEN 'NULL_ATTRIBUTES' WHEN missing <> '' THEN 'MISSING_ATTRIBUTES' END AS reason, missing
FROM (SELECT *, p_partkey % 11 = 0 AS early, p_partkey % 17 = 0 AS k17,
  CASE WHEN p_partkey % 4 = 3 THEN '' WHEN p_partkey % 17 = 0 OR p_partkey % 5 = 0 THEN ['dividendPerShare', 'splitRatio', 'ratio,subscriptionPrice'][p_partkey % 4 + 1]
       WHEN p_partkey % 7 = 0 THEN ['dividendPerShare', 'splitRatio', 'subscriptionPrice'][p_partkey % 4 + 1] ELSE '' END AS missing FROM part)""")
def corp_action_validate(spark, sf_dir):
    d = corporate_actions.validated(V.corporate_actions(spark, sf_dir))
    return d.select("corporateActionId", (~F.col("valid")).alias("rejected"), "reason", "missing")


@query(f'WITH {V.INSTRUMENTS} SELECT "instrumentId", seq, "referenceVersion", accepted FROM guarded')
def version_guard_check(spark, sf_dir):
    d = V.instruments(spark, sf_dir).filter("trim(ticker) <> '' and sharesOutstanding > 0")
    return version_guard(d).select("instrumentId", "seq", "referenceVersion", "accepted")


@query(f"""WITH {V.INSTRUMENTS} SELECT "instrumentId", seq, 'VERSION_NOT_NEWER' AS reasons FROM guarded WHERE NOT accepted
UNION ALL SELECT "instrumentId", seq, concat_ws(',', CASE WHEN trim(ticker) = '' THEN 'BLANK_TICKER' END, CASE WHEN "sharesOutstanding" <= 0 THEN 'SHARES_NOT_POSITIVE' END)
FROM instruments WHERE trim(ticker) = '' OR "sharesOutstanding" <= 0""")
def instrument_rejects(spark, sf_dir):
    return reference_data.publishable(V.instruments(spark, sf_dir), "reference-data")[1].select("instrumentId", "seq", F.array_join("reasons", ",").alias("reasons"))


def _latest_instruments(spark, sf_dir):
    return reference_data.latest_instruments(reference_data.publishable(V.instruments(spark, sf_dir), "reference-data")[0])


@query(f"""WITH {V.INSTRUMENTS} SELECT "instrumentId", ticker, "sharesOutstanding", "referenceVersion", 'reference-data' AS "producerIdentity" FROM latest""")
def instruments_compacted(spark, sf_dir):
    return _latest_instruments(spark, sf_dir).select("instrumentId", "ticker", "sharesOutstanding", "referenceVersion", "producerIdentity")


def _archived(spark, sf_dir):
    d = V.archive(spark, sf_dir)
    kind = F.coalesce(archive.event_type(), F.col("event_type"))
    return archive.deduplicated(archive.projected(d.withColumn("eventType", kind)))


@query(f"""WITH {V.ARCHIVE} SELECT DISTINCT topic || '-' || "partition" || '-' || "offset" AS "idempotencyKey", key,
CASE WHEN value IS NULL THEN 'Tombstone' ELSE event_type END AS "eventType", coalesce(value, '') AS payload, ts_ms FROM archive""")
def archive_dedup(spark, sf_dir):
    return _archived(spark, sf_dir).select("idempotencyKey", "key", "eventType", F.decode("payload", "UTF-8").alias("payload"), F.unix_millis("timestamp").alias("ts_ms"))


@query(f"""WITH {V.ARCHIVE}, e AS (SELECT topic, "partition", "offset", count(*) AS n FROM archive GROUP BY ALL),
s AS (SELECT topic, "partition", min("offset") AS f, max("offset") AS l, count(*) AS c, CAST(sum(n - 1) AS BIGINT) AS d FROM e GROUP BY ALL)
SELECT topic, "partition", f AS "expectedFirstOffset", l AS "expectedLastOffset", c AS "archivedRecordCount", d AS "duplicateCount", l - f + 1 - c AS "missingCount",
CASE WHEN l - f + 1 - c > 0 THEN 'FAIL' WHEN d > 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM s""")
def archive_coverage(spark, sf_dir):
    return archive.coverage(V.archive(spark, sf_dir))


@query(f"""WITH {V.ARCHIVE}, r AS (SELECT topic, "partition", unnest(range(min("offset"), max("offset") + 1)) AS "offset" FROM archive GROUP BY topic, "partition")
SELECT * FROM r EXCEPT SELECT topic, "partition", "offset" FROM archive""")
def missing_offsets(spark, sf_dir):
    return archive.missing_offsets(V.archive(spark, sf_dir))


@query(f"""WITH {V.ARCHIVE}, m AS (SELECT DISTINCT topic, "partition", "offset", ts_ms, CASE WHEN value IS NULL THEN 'Tombstone' ELSE event_type END AS event_type,
  CAST('0x' || substr(sha256(topic || '-' || "partition" || '-' || "offset" || coalesce(value, '')), 1, 15) AS BIGINT) AS d FROM archive)
SELECT CAST(year(make_timestamp_ms(ts_ms)) AS INTEGER) AS year, CAST(month(make_timestamp_ms(ts_ms)) AS INTEGER) AS month, CAST(day(make_timestamp_ms(ts_ms)) AS INTEGER) AS day, event_type, topic, "partition",
count(*) AS records, min("offset") AS "firstOffset", max("offset") AS "lastOffset", CAST(sum(d) AS VARCHAR) AS digest FROM m GROUP BY ALL""")
def archive_manifest(spark, sf_dir):
    return archive.manifest(_archived(spark, sf_dir))


def _failures(spark, sf_dir):
    """None to three failures of every event's record."""
    d = V.table(spark, sf_dir, "events").withColumn("k", F.explode(F.expr("slice(array(0, 1, 2), 1, cast(event_id % 4 as int))")))
    i = F.col("event_id")
    return d.select(F.concat(F.lit("topic-"), (i % 4).cast("string")).alias("topic"), (F.floor(i / 4) % 12).cast("int").alias("partition"), F.floor(i / 48).alias("offset"), (V.epoch_ms("ts") + F.col("k") * 100).alias("failed_ms"))


_FAILED = """SELECT 'topic-' || (event_id % 4) AS topic, CAST((event_id // 4) % 12 AS INTEGER) AS "partition", event_id // 48 AS "offset", event_id % 4 AS "retryCount",
(epoch_us(ts) // 1000) AS "firstFailureMs", (epoch_us(ts) // 1000) + (event_id % 4 - 1) * 100 AS "lastFailureMs" FROM events WHERE event_id % 4 > 0"""


@query(_FAILED)
def failure_attempts(spark, sf_dir):
    return dead_letters.attempts(_failures(spark, sf_dir))


@query(f"""WITH {V.ARCHIVE}, f AS ({_FAILED}), d AS (SELECT DISTINCT * FROM archive)
SELECT d.topic || '.dlq' AS topic, d.key, d.topic AS "originalTopic", d."partition" AS "originalPartition", d."offset" AS "originalOffset", coalesce(d.value, '') AS payload,
'SinkError: sink rejected the batch <- IOError: ' || CASE WHEN event_id % 2 = 0 THEN 'connection reset' ELSE 'null' END AS "failureReason", 'IOError' AS "exceptionClass",
CASE WHEN event_id % 2 = 0 THEN 'connection reset' ELSE 'null' END AS "exceptionMessage", 500 AS stack_chars,
CAST(coalesce(f."retryCount", 1) AS INTEGER) AS "retryCount", coalesce(f."firstFailureMs", {_NOW}) AS first_ms, coalesce(f."lastFailureMs", {_NOW}) AS last_ms, corr AS "correlationId"
FROM d LEFT JOIN f ON d.topic = f.topic AND d."partition" = f."partition" AND d."offset" = f."offset" """)
def dead_letter_rows(spark, sf_dir):
    r = V.archive(spark, sf_dir).dropDuplicates(archive.COORDINATES)
    r = dead_letters.with_attempts(r, dead_letters.attempts(_failures(spark, sf_dir)), F.lit(_NOW))
    cause = F.struct(F.lit("IOError").alias("class"), F.when(F.col("event_id") % 2 == 0, "connection reset").alias("message"))
    r = r.withColumns({"chain": F.array(F.struct(F.lit("SinkError").alias("class"), F.lit("sink rejected the batch").alias("message")), cause), "stack": F.repeat(F.lit("at frame "), 100)})
    d = dead_letters.dead_letters(r, "audit-service", "audit-service-7")
    return d.select("topic", "key", "originalTopic", "originalPartition", "originalOffset", F.decode("originalPayload", "UTF-8").alias("payload"), "failureReason", "exceptionClass", "exceptionMessage", F.length("stackTraceSummary").alias("stack_chars"), "retryCount", F.unix_millis("firstFailureAt").alias("first_ms"), F.unix_millis("lastFailureAt").alias("last_ms"), "correlationId")


@query(f"""WITH {V.ARCHIVE} SELECT topic || '-' || "partition" || '-' || "offset" AS key, corr AS "correlationId", count(*) AS n FROM archive GROUP BY ALL""")
def headers(spark, sf_dir):
    return V.archive(spark, sf_dir).groupBy(idempotency_key().alias("key"), correlation_id("headers").alias("correlationId")).agg(F.count("*").alias("n"))


_ONCE = f"WITH {V.TRADES}, once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY \"tradeId\" ORDER BY seq) AS k FROM trades) WHERE k = 1)"
_HORIZON_MS = V.HORIZON_S * 1000
_QUOTED = f"""{_ONCE}, {V.TICKS}, {V.INSTRUMENTS}, firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, event_ms ORDER BY seq) AS f FROM ticks) WHERE f = 1),
sums AS (SELECT ticker, event_ms, sum(CAST(last AS DECIMAL(18,4)) * volume) AS pv, sum(CAST(volume AS DOUBLE)) AS v FROM ticks GROUP BY ALL),
j AS (SELECT o.*, t.bid, t.ask, t.event_ms AS tick_ms FROM once o ASOF LEFT JOIN firsts t ON o.ticker = t.ticker AND o.event_ms >= t.event_ms),
w AS (SELECT times.ticker, times.event_ms, CAST(sum(s.pv) AS DOUBLE) / nullif(sum(s.v), 0) AS vwap FROM (SELECT DISTINCT ticker, event_ms FROM once) times
      LEFT JOIN sums s ON s.ticker = times.ticker AND s.event_ms BETWEEN times.event_ms - {_HORIZON_MS} AND times.event_ms GROUP BY ALL),
quoted AS (SELECT j.*, w.vwap FROM j JOIN w ON j.ticker = w.ticker AND j.event_ms = w.event_ms),
one AS (SELECT ticker, arg_min("sharesOutstanding", "instrumentId") AS shares FROM latest GROUP BY ticker)"""


def _quoted(spark, sf_dir):
    return enrichment.as_of(V.trades_once(spark, sf_dir, "tradeId", "ticker", "price", "event_ms"), V.ticks(spark, sf_dir), _HORIZON_MS, SPAN_MS)


@query(_QUOTED + f' SELECT "tradeId", ticker, event_ms, tick_ms, bid, ask, {_R.format(x="vwap")} AS vwap FROM quoted')
def enrich_asof(spark, sf_dir):
    return _quoted(spark, sf_dir).select("tradeId", "ticker", "event_ms", "tick_ms", "bid", "ask", half_up(F.col("vwap"), 4).alias("vwap"))


@query(_QUOTED + f""" SELECT "tradeId", q.ticker, {_R.format(x="(bid + ask) / 2")} AS mid, {_R.format(x="(ask - bid)")} AS spread, {_R.format(x="vwap")} AS vwap, {_R.format(x="shares * price / 1e7")} AS "marketCap",
{_R.format(x="(price - (bid + ask) / 2) / nullif((bid + ask) / 2, 0) * 100")} AS deviation, q.event_ms - tick_ms AS "dataAgeMs" FROM quoted q JOIN one ON q.ticker = one.ticker WHERE tick_ms IS NOT NULL""")
def enrich_full(spark, sf_dir):
    good, _ = enrichment.enriched(_quoted(spark, sf_dir), _latest_instruments(spark, sf_dir))
    return good.select("tradeId", "ticker", *[half_up(F.col(c), 4).alias(c) for c in ("mid", "spread", "vwap", "marketCap", "deviation")], "dataAgeMs")


@query(_QUOTED + """ SELECT "tradeId", q.ticker, 'REFERENCE_DATA_UNAVAILABLE' AS failure FROM quoted q LEFT JOIN one ON q.ticker = one.ticker WHERE tick_ms IS NULL OR shares IS NULL""")
def enrich_misses(spark, sf_dir):
    return enrichment.enriched(_quoted(spark, sf_dir), _latest_instruments(spark, sf_dir))[1].select("tradeId", "ticker", "failure")


@query(f"""{_ONCE}, {V.TICKS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY event_ms DESC, seq) AS m FROM ticks) WHERE m = 1)
SELECT "tradeId", o.ticker, l.bid, l.ask, l.event_ms AS tick_ms FROM once o LEFT JOIN l ON o.ticker = l.ticker""")
def enrich_latest(spark, sf_dir):
    return enrichment.at_latest(V.trades_once(spark, sf_dir), market_state.latest(V.ticks(spark, sf_dir))).select("tradeId", "ticker", "bid", "ask", "tick_ms")


_POSITIONS = """p AS (SELECT "accountId", "traderId", ticker, CAST(sum(CASE WHEN side = 'BUY' THEN quantity ELSE 0 END) AS BIGINT) AS buy, CAST(sum(CASE WHEN side = 'SELL' THEN quantity ELSE 0 END) AS BIGINT) AS sell,
max(event_ms) AS as_of, arg_max(struct_pack(i := "tradeId", p := price), struct_pack(e := event_ms, s := seq)) AS l FROM once GROUP BY ALL)"""


@query(f"""{_ONCE}, {_POSITIONS} SELECT "accountId", "traderId", ticker, buy - sell AS "netQuantity", buy AS "grossBuyQuantity", sell AS "grossSellQuantity",
floor((buy - sell) * l.p * 100 + 0.5) / 100 AS "marketValue", as_of AS "asOfMs", l.i AS "lastProcessedTradeId" FROM p""")
def positions_snapshot(spark, sf_dir):
    return positions.positions_of(V.trades_once(spark, sf_dir)).withColumn("marketValue", half_up(F.col("marketValue"), 2))


_ALL_RULES = f"""re AS (SELECT 'R' || s_suppkey % 7 AS "ruleId", 'TYPE-' || s_suppkey % 3 AS "ruleType", CAST(s_suppkey AS BIGINT) AS version, ['ACTIVE', 'DRAFT', 'RETIRED', 'ACTIVE', 'REJECTED'][s_suppkey % 5 + 1] AS state,
  s_suppkey % 11 = 0 AS alone, CAST(s_suppkey % 13 AS DOUBLE) AS threshold, {V.START_MS} + s_suppkey * 7919 % 43200 * 60000 AS f FROM supplier),
rr AS (SELECT *, lead(f) OVER (PARTITION BY "ruleId" ORDER BY f, version) AS t FROM re WHERE state IN ('ACTIVE', 'RETIRED', 'REJECTED') AND (state <> 'ACTIVE' OR NOT alone))"""


@query(f"""WITH {_ALL_RULES} SELECT "ruleId", "ruleType", version, threshold, f AS from_ms, t AS to_ms FROM rr WHERE state = 'ACTIVE'""")
def rule_in_force(spark, sf_dir):
    """Suppliers as the life of rules: drafts, rules that were approved by their maker, versions that end others."""
    k = F.col("s_suppkey").cast("long")
    state = F.element_at(F.array(*map(F.lit, ["ACTIVE", "DRAFT", "RETIRED", "ACTIVE", "REJECTED"])), (k % 5 + 1).cast("int"))
    events = V.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("R"), (k % 7).cast("string")).alias("ruleId"), F.concat(F.lit("TYPE-"), (k % 3).cast("string")).alias("ruleType"), k.alias("version"), state.alias("state"),
        F.lit("ann").alias("makerSubject"), F.when(k % 11 == 0, "ann").otherwise("bob").alias("checkerSubject"), (k % 13).cast("double").alias("threshold"), (F.lit(V.START_MS) + k * 7919 % 43_200 * 60_000).alias("effective_ms"),
    )
    return risk.rule_ranges(events)


_FORCE = "r.from_ms <= {t} AND (r.to_ms IS NULL OR {t} < r.to_ms)"


@query(_QUOTED + f""", {V.RULES}, d AS (SELECT q.*, (price - (bid + ask) / 2) / nullif((bid + ask) / 2, 0) * 100 AS deviation FROM quoted q JOIN one ON q.ticker = one.ticker WHERE tick_ms IS NOT NULL)
SELECT "tradeId", "ruleId", r.version, {_R.format(x="deviation")} AS deviation, r.threshold FROM d JOIN ranges r ON r."ruleType" = 'PRICE_DEVIATION' AND {_FORCE.format(t="d.event_ms")} WHERE abs(deviation) > r.threshold""")
def price_deviation_alerts(spark, sf_dir):
    good, _ = enrichment.enriched(_quoted(spark, sf_dir), _latest_instruments(spark, sf_dir))
    return risk.price_deviation_alerts(good, risk.rule_ranges(V.rule_events(spark, sf_dir))).select("tradeId", "ruleId", "version", half_up(F.col("deviation"), 4).alias("deviation"), "threshold")


@query(f"""{_ONCE}, {_POSITIONS}, {V.RULES} SELECT "accountId", "traderId", ticker, buy - sell AS "netQuantity", "ruleId", r.version FROM p
JOIN ranges r ON r."ruleType" = 'POSITION_LIMIT_BREACH' AND {_FORCE.format(t="p.as_of")} WHERE abs(buy - sell) > r.threshold""")
def position_limit_alerts(spark, sf_dir):
    p = positions.positions_of(V.trades_once(spark, sf_dir))
    return risk.position_limit_alerts(p, risk.rule_ranges(V.rule_events(spark, sf_dir))).select("accountId", "traderId", "ticker", "netQuantity", "ruleId", "version")


@query(f"""WITH {V.TICKS}, {V.RULES}, m AS (SELECT *, avg(volume) OVER b AS mean, count(*) OVER b AS n FROM ticks WINDOW b AS (PARTITION BY ticker ORDER BY seq ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT ticker, seq, volume, round(mean, 4) AS "meanVolume", "ruleId" FROM m JOIN ranges r ON r."ruleType" = 'UNUSUAL_VOLUME' AND {_FORCE.format(t="m.event_ms")} WHERE n = 20 AND volume > r.threshold * mean""")
def unusual_volume_alerts(spark, sf_dir):
    return risk.unusual_volume_alerts(V.ticks(spark, sf_dir), risk.rule_ranges(V.rule_events(spark, sf_dir)), span=SPAN).select("ticker", "seq", "volume", F.round("meanVolume", 4).alias("meanVolume"), "ruleId")


_COARSE = "event_ms - event_ms % 3600000 AS event_ms"


@query(f"""{_ONCE}, k AS (SELECT * REPLACE ('t' || (seq // 2000000000 % 40) AS "traderId") FROM once),
buys AS (SELECT * FROM k WHERE side = 'BUY'), sells AS (SELECT * FROM k WHERE side = 'SELL'),
g AS (SELECT b."tradeId", b.ticker, b."traderId", min(abs(b.event_ms - s.event_ms)) AS "gapMs" FROM buys b JOIN sells s ON b.ticker = s.ticker AND b."traderId" = s."traderId" GROUP BY ALL)
SELECT * FROM g WHERE "gapMs" <= {WASH_MS}""")
def wash_trades(spark, sf_dir):
    t = V.trades_once(spark, sf_dir).withColumn("traderId", F.concat(F.lit("t"), F.expr("seq div 2000000000 % 40").cast("string")))
    return risk.wash_trades(t, WASH_MS).select("tradeId", "ticker", "traderId", "gapMs")


@query(f"""{_ONCE}, ca AS (SELECT 'T' || (p_partkey % 190) AS ticker, {V.START_MS} + p_partkey * 1000 + (p_partkey % 11 - 1) * 86400000 AS e FROM part)
SELECT "tradeId" AS "alertId", ticker FROM once o WHERE quantity > 45 AND NOT EXISTS (SELECT 1 FROM ca WHERE ca.ticker = o.ticker AND abs(o.event_ms - ca.e) <= 86400000)""")
def alerts_unexplained(spark, sf_dir):
    alerts = V.trades_once(spark, sf_dir).filter("quantity > 45").select(F.col("tradeId").alias("alertId"), "ticker", F.col("event_ms").alias("alert_ms"))
    return corporate_actions.unexplained(alerts, V.corporate_actions(spark, sf_dir), 86_400_000).select("alertId", "ticker")


@query(f"""WITH {V.LEDGERS}, f AS (SELECT coalesce(i."referenceId", e."referenceId") AS "referenceId", i.amount AS ia, e.amount AS ea, i.n AS i_n, e.n AS e_n, i.state AS si, e.state AS se
  FROM internal i FULL OUTER JOIN external e ON i."referenceId" = e."referenceId"),
k AS (SELECT *, CASE WHEN i_n IS NULL OR e_n IS NULL THEN 'MISSING_PARTICIPANT' WHEN i_n > 1 OR e_n > 1 THEN 'DUPLICATE_REFERENCE' WHEN abs(ia - ea) > 0 AND abs(ia - ea) <= 1 THEN 'ROUNDING_OR_FEE_CANDIDATE'
  WHEN abs(ia - ea) > 1 THEN 'AMOUNT_MISMATCH' WHEN si <> se THEN 'CONFLICTING_STATE' END AS "observationType" FROM f)
SELECT "referenceId", "observationType", ia AS "internalAmount", ea AS "externalAmount", 2 AS "expectedParticipants", CASE WHEN i_n IS NULL OR e_n IS NULL THEN 1 ELSE 2 END AS "participantsObserved",
CASE WHEN i_n IS NULL OR e_n IS NULL THEN 'INCOMPLETE_UNKNOWN' ELSE 'COMPLETE' END AS completeness FROM k WHERE "observationType" IS NOT NULL""")
def recon_observations(spark, sf_dir):
    return reconciliation.observations(*V.ledger_sides(spark, sf_dir))


@query(f"""WITH {V.CASES}, r AS (SELECT *, row_number() OVER (PARTITION BY "caseId" ORDER BY event_ms DESC, seq DESC) AS k, count(*) OVER (PARTITION BY "caseId") AS n_events FROM cases)
SELECT "caseId", state, event_ms, n_events FROM r WHERE k = 1""")
def case_latest(spark, sf_dir):
    return cases.case_latest(V.case_events(spark, sf_dir))


_LEGAL = ", ".join(f"'{x}'" for x in cases.LEGAL)


@query(f"""WITH {V.CASES}, s AS (SELECT *, lag(state) OVER (PARTITION BY "caseId" ORDER BY event_ms, seq) AS previous FROM cases)
SELECT "caseId", seq, previous, state FROM s WHERE CASE WHEN previous IS NULL THEN state <> 'OPEN' ELSE previous || '>' || state NOT IN ({_LEGAL}) END""")
def case_illegal(spark, sf_dir):
    return cases.illegal_transitions(V.case_events(spark, sf_dir)).select("caseId", "seq", "previous", "state")


@query(f"""WITH {V.DECISIONS} SELECT "candidateId", priority, created_ms FROM candidates ORDER BY p DESC, created_ms, "candidateId" LIMIT 25""")
def topk_candidates(spark, sf_dir):
    return cases.top_candidates(V.candidates(spark, sf_dir), 25).select("candidateId", "priority", "created_ms")


@query(f"""WITH {V.DECISIONS} SELECT c."candidateId", d."decisionId", CASE WHEN d.n IS NULL THEN NULL WHEN outcome = 'NO_FLAG' AND failed THEN 'ESCALATE' ELSE outcome END AS outcome,
CASE WHEN d.n % 4 = 1 THEN 'CONFIRM_FLAG' END AS verdict FROM candidates c LEFT JOIN decisions d ON c."candidateId" = d."candidateId" """)
def review_chain(spark, sf_dir):
    d = V.decisions(spark, sf_dir).withColumn("outcome", cases.safe_outcome())
    reviews = d.filter("n % 4 = 1").select("decisionId", F.lit("CONFIRM_FLAG").alias("verdict"))
    return cases.review_chain(V.candidates(spark, sf_dir).select("candidateId"), d, reviews).select("candidateId", "decisionId", "outcome", "verdict")


@query(f"""WITH {V.DECISIONS} SELECT "modelId", count(*) AS decisions, CAST(sum("inputTokens") AS BIGINT) AS "inputTokens", CAST(sum("outputTokens") AS BIGINT) AS "outputTokens", sum("estimatedCostUsd") AS "estimatedCostUsd" FROM decisions GROUP BY 1""")
def agent_costs(spark, sf_dir):
    return cases.agent_costs(V.decisions(spark, sf_dir))


_GRANTS = "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{t}', '{n}', '{o}')" for p, t, n, ops in governance.POLICIES for o in [*ops, "DESCRIBE"]) + ') v(principal, "resourceType", name, operation)'
_PRINCIPALS = "['trade-producer', 'audit-service', 'market-data-simulator', 'market-data-cache-projector', 'nobody']"
_NAMES = "['trades.raw', 'market-data.ticks', 'corporate-actions', 'trades.raw.dlq']"


@query(f"""WITH g AS (SELECT DISTINCT * FROM ({_GRANTS})), r AS (SELECT {_PRINCIPALS}[event_id % 5 + 1] AS principal, 'TOPIC' AS "resourceType", {_NAMES}[event_id % 4 + 1] AS name, ['READ', 'WRITE', 'DESCRIBE'][event_id % 3 + 1] AS operation FROM events)
SELECT r.principal, r.name, r.operation, CASE WHEN g.principal IS NULL THEN 'DENY' ELSE 'ALLOW' END AS decision, count(*) AS n FROM r
LEFT JOIN g ON r.principal = g.principal AND r."resourceType" = g."resourceType" AND r.name = g.name AND r.operation = g.operation GROUP BY ALL""")
def acl_decisions(spark, sf_dir):
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("event_id") % len(xs) + 1).cast("int"))
    r = V.table(spark, sf_dir, "events").select(pick(["trade-producer", "audit-service", "market-data-simulator", "market-data-cache-projector", "nobody"]).alias("principal"), F.lit("TOPIC").alias("resourceType"), pick(["trades.raw", "market-data.ticks", "corporate-actions", "trades.raw.dlq"]).alias("name"), pick(["READ", "WRITE", "DESCRIBE"]).alias("operation"))
    return governance.decide(r, governance.policies(spark)).groupBy("principal", "name", "operation", "decision").agg(F.count("*").alias("n"))


@query(f"""WITH {V.TRADES} SELECT "tradeId", seq, sha256('salt' || "traderId") AS "traderId", sha256('salt' || "accountId") AS "accountId" FROM trades""")
def restricted_masked(spark, sf_dir):
    return governance.masked(V.trades(spark, sf_dir), "salt").select("tradeId", "seq", "traderId", "accountId")


@query(f"""WITH {V.TICKS} SELECT ticker, ({_NOW} - max(event_ms)) / 1000.0 AS age_seconds FROM ticks GROUP BY ticker""")
def market_freshness(spark, sf_dir):
    return market_state.freshness(V.ticks(spark, sf_dir), F.lit(_NOW))


_DT = "(60.0::DOUBLE / (252 * 6.5::DOUBLE * 3600))"
_WALK = f"""st AS (SELECT 'T' || user_id AS ticker, event_id AS seq, epoch_us(ts) // 1000 AS event_ms, (event_id % 997 + 1) / 1000.0::DOUBLE AS u,
  CAST((0.08::DOUBLE - 0.25::DOUBLE * 0.25::DOUBLE / 2) * {_DT} + 0.25::DOUBLE * power({_DT}, 0.5) * (value / 100 - 0.5) AS DECIMAL(30,15)) AS step FROM events),
walk AS (SELECT *, 100 * exp(CAST(sum(step) OVER (PARTITION BY ticker ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)) AS last FROM st)"""
_MODEL = generators.TickModel(mu=0.08, sigma=0.25, step_seconds=60.0, spread_bps=5.0, volume_scale=100.0, volume_alpha=1.5)


def _walk(spark, sf_dir):
    """Events as shocks of their users' prices."""
    e, i = V.table(spark, sf_dir, "events"), F.col("event_id")
    rows = e.select(F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("ticker"), i.alias("seq"), V.epoch_ms("ts").alias("event_ms"), (F.col("value") / 100 - 0.5).alias("shock"), ((i % 997 + 1) / 1000.0).alias("u"), F.lit(100.0).alias("start"))
    return generators.walked(rows, _MODEL)


@query(f"""WITH {_WALK} SELECT ticker, seq, event_ms, {_R.format(x="last")} AS last, {_R.format(x="(last * (1 - 5.0::DOUBLE / 20000))")} AS bid, {_R.format(x="(last * (1 + 5.0::DOUBLE / 20000))")} AS ask,
CAST(floor(100.0::DOUBLE / power(u, 1.0::DOUBLE / 1.5)) AS BIGINT) AS volume FROM walk""")
def gbm_walk(spark, sf_dir):
    """The price walk of each user's events."""
    return _walk(spark, sf_dir).select("ticker", "seq", "event_ms", *[half_up(F.col(c), 4).alias(c) for c in ("last", "bid", "ask")], "volume")


@query(f"""WITH {_WALK} SELECT 'trade-' || sha256(CAST(seq AS VARCHAR)) AS "tradeId", ticker, seq % 500 + 1 AS quantity, {_R.format(x="(CASE WHEN seq % 2 = 0 THEN last * (1 + 5.0::DOUBLE / 20000) ELSE last * (1 - 5.0::DOUBLE / 20000) END)")} AS price,
CASE WHEN seq % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, 'trader-' || seq % 10 AS "traderId", 'account-' || seq // 10 % 10 AS "accountId", event_ms FROM walk""")
def trade_walk(spark, sf_dir):
    """A trade at each step of the walk."""
    d = generators.trades_at(_walk(spark, sf_dir))
    return d.select("tradeId", "ticker", "quantity", half_up(F.col("price"), 4).alias("price"), "side", "traderId", "accountId", "event_ms")


@query(f"""WITH {V.TICKS}, {_OUTCOMES}, {_BUCKETS}, k AS (SELECT ticker, seq, bucket FROM b),
h AS (SELECT o.ticker, o.seq, k.bucket, k.seq AS s FROM outcomes o JOIN k ON k.ticker = o.ticker AND k.seq <= o.seq),
g AS (SELECT h.ticker, h.seq, h.bucket, max(x.bucket) AS ahead FROM (SELECT ticker, seq, bucket, max(s) AS s FROM h GROUP BY ALL) h
      JOIN k x ON x.ticker = h.ticker AND x.seq BETWEEN h.s AND h.seq GROUP BY ALL),
n AS (SELECT ticker, seq, count(*) FILTER (bucket >= ahead - {V.RETAIN_S}) AS n FROM g GROUP BY ALL)
SELECT o.ticker, o.seq, o.event_ms, o.outcome, o.accepted AS "windowApplied", coalesce(n.n, 0) AS "windowBuckets" FROM outcomes o LEFT JOIN n ON n.ticker = o.ticker AND n.seq = o.seq""")
def stream_market_state(spark, sf_dir):
    """The stateful operator over the whole input in four deliveries; its outcomes are those of the batch query."""
    from ..streaming.market import market_stream, market_tables
    from ..streaming.session import stateful
    from .deliveries import Deliveries, evenly

    at, own, ticks = folder(spark), stateful(spark), V.ticks(spark, sf_dir)
    come, tables = Deliveries(spark, ticks, evenly(ticks, "seq", 4), f"{at}/ticks"), market_tables(own, f"{at}/state")
    for k in range(4):
        come.come(k)
        market_stream(come.stream(own), tables, f"{at}/cp", f"{at}/out", V.BUCKET_S, V.RETAIN_S, 86_400_000).awaitTermination()
    return spark.read.parquet(f"{at}/out").select("ticker", "seq", "event_ms", "outcome", "windowApplied", "windowBuckets")


def entry(spark: SparkSession) -> DataFrame:
    """The flagship: volume-weighted average price per ticker over the surviving window, of the tables in $TICKLOOM_SF_DIR."""
    return vwap(spark, os.environ.get("TICKLOOM_SF_DIR", "/root/testdata/sf0.001"))


from . import checks, streams  # noqa: E402, F401  register their queries
