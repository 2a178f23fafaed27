"""Registered queries that run streams over several deliveries, with restarts between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import half_up
from ..operators import cases, intervals, manifests, positions, reconciliation, reference_data, related, risk
from ..operators.archive import partition_columns
from ..schemas import RECORD
from ..streaming import archive, enrichment, failures, market, rebuild, reference, rules
from ..streaming import positions as positions_stream
from ..streaming.session import stateful
from ..streaming.versions import Versions
from . import views as V
from .deliveries import EVENLY, Deliveries, evenly
from .registry import SQL, folder, query
from .sinks import flaky

_R = "floor({x} * 10000 + 0.5) / 10000"
#: Longer than any run, so that no window expires on the way.
TTL_MS = 86_400_000

_HALF = EVENLY.format(order="seq", table="ticks", n=2)
# Ticks as they are known after either delivery, and both states made of them.
_KNOWN = f"""known AS (SELECT h, ticks.* FROM ticks, (SELECT unnest([0, 1]) AS h) WHERE {_HALF} <= h),
judged AS (SELECT *, max("offset") OVER (PARTITION BY h, ticker ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM known),
b AS (SELECT *, CAST(floor(event_ms / {V.BUCKET_S * 1000}.0) AS BIGINT) * {V.BUCKET_S} AS bucket FROM judged WHERE top IS NULL OR "offset" > top),
c AS (SELECT *, max(bucket) OVER (PARTITION BY h, ticker ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM b),
buckets AS (SELECT h, ticker, bucket, sum(CAST(last AS DECIMAL(18,4)) * volume) AS pv, sum(CAST(volume AS DOUBLE)) AS v FROM c WHERE bucket >= ahead - {V.RETAIN_S} GROUP BY ALL),
n AS (SELECT *, max(bucket) OVER (PARTITION BY h, ticker) AS newest FROM buckets),
w AS (SELECT h, ticker, {_R.format(x="CAST(sum(pv) AS DOUBLE) / nullif(sum(v), 0)")} AS vwap FROM n WHERE bucket > newest - {V.HORIZON_S} GROUP BY ALL),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h, ticker ORDER BY event_ms DESC, seq) AS m FROM known) WHERE m = 1)"""


@query(f"""WITH {V.TICKS}, {V.TRADES}, once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "tradeId" ORDER BY seq) AS k FROM trades) WHERE k = 1), {V.INSTRUMENTS}, {_KNOWN},
one AS (SELECT ticker, arg_min("sharesOutstanding", "instrumentId") AS shares FROM latest GROUP BY ticker)
SELECT "tradeId", o.ticker, seq_of AS delivery, {_R.format(x="(l.bid + l.ask) / 2")} AS mid, l.event_ms AS tick_ms, w.vwap AS "vwap5Min", shares IS NULL OR l.ticker IS NULL AS missed
FROM (SELECT *, quantity % 2 AS seq_of FROM once) o LEFT JOIN l ON l.h = o.seq_of AND l.ticker = o.ticker LEFT JOIN w ON w.h = o.seq_of AND w.ticker = o.ticker LEFT JOIN one ON one.ticker = o.ticker""")
def live_enrichment(spark, sf_dir):
    """Ticks and trades in turn: the first trades meet the market after half of the ticks, the others after all of them."""
    at, own = folder(spark), stateful(spark)
    ticks = V.ticks(spark, sf_dir)
    trades = V.trades_once(spark, sf_dir, "tradeId", "ticker", "quantity", "price", "event_ms").withColumn("produced_ms", F.col("event_ms"))
    ticks_in = Deliveries(spark, ticks, evenly(ticks, "seq", 2), f"{at}/ticks")
    trades_in = Deliveries(spark, trades, F.col("quantity") % 2, f"{at}/trades")
    known, _ = reference_data.publishable(V.instruments(spark, sf_dir), "reference-data")
    reference_data.latest_instruments(known).write.parquet(f"{at}/instruments")
    tables = market.market_tables(own, f"{at}/state")
    for k in (0, 1):
        ticks_in.come(k)
        market.market_stream(ticks_in.stream(own), tables, f"{at}/cp-ticks", None, V.BUCKET_S, V.RETAIN_S, TTL_MS).awaitTermination()
        trades_in.come(k)
        state = lambda: market.market_now(tables, V.HORIZON_S)
        enrichment.enrichment_stream(trades_in.stream(own), state, lambda: own.read.parquet(f"{at}/instruments"), f"{at}/out", f"{at}/misses", f"{at}/cp-trades").awaitTermination()
    cols = ["tradeId", "ticker", (F.col("quantity") % 2).alias("delivery"), half_up((F.col("bid") + F.col("ask")) / 2, 4).alias("mid"), "tick_ms", half_up(F.col("vwap5Min"), 4).alias("vwap5Min")]
    good = spark.read.parquet(f"{at}/out").select(*cols, F.lit(False).alias("missed"))
    return good.unionByName(spark.read.parquet(f"{at}/misses").select(*cols, F.lit(True).alias("missed")))


def _framed(spark, sf_dir, bad=None):
    """Events as records whose payloads name their schema; where bad holds they don't."""
    frame = F.concat(F.unhex(F.lit("0000000001")), F.col("value"))
    d = V.archive(spark, sf_dir).withColumn("value", frame if bad is None else F.when(bad, F.encode(F.lit("poison"), "UTF-8")).otherwise(frame))
    return d.withColumn("n", F.col("partition") + F.col("offset") * 12)


def _late(n):
    """In which of three deliveries a record comes: most by their time, a few long after the others, some in all three."""
    return F.when(n % 11 == 0, F.lit(2)).otherwise(n % 2)


@query(f"""WITH {V.ARCHIVE} SELECT DISTINCT topic || '-' || "partition" || '-' || "offset" AS "idempotencyKey", CASE WHEN value IS NULL THEN 'Tombstone' ELSE 'Event' END AS "eventType", coalesce(value, '') AS payload
FROM archive""")
def stream_archive(spark, sf_dir):
    """The archive stream over three deliveries with records that come late and records that come again, restarted between them."""
    at, own = folder(spark), stateful(spark)
    d = _framed(spark, sf_dir)
    again = d.filter("n % 7 = 0").withColumn("delivery", F.lit(1)).unionByName(d.filter("n % 5 = 0").withColumn("delivery", F.lit(2)))
    come = Deliveries(spark, d.withColumn("delivery", _late(F.col("n"))).unionByName(again).select(*RECORD.names, F.col("delivery").alias("of")), F.col("of"), f"{at}/in")
    schemas = own.createDataFrame([(1, "Event")], "id long, name string")
    for k in range(3):
        come.come(k)
        archive.archive_stream(come.stream(own), schemas, f"{at}/archive", f"{at}/dlq", f"{at}/cp").awaitTermination()
    rows = spark.read.parquet(f"{at}/archive")
    return rows.select("idempotencyKey", "eventType", F.decode(F.substring(F.col("payload"), F.lit(6), F.octet_length("payload")), "UTF-8").alias("payload"))


@query(f"""WITH {V.ARCHIVE}, d AS (SELECT DISTINCT topic, "partition", "offset", value, corr, "partition" + "offset" * 12 AS n FROM archive),
k AS (SELECT *, value IS NOT NULL AND n % 17 = 0 AS broken FROM d)
SELECT topic, "partition", "offset", CASE WHEN broken OR n % 19 = 0 OR n % 13 = 0 THEN 'given up' ELSE 'archived' END AS outcome,
CASE WHEN broken THEN 1 WHEN n % 19 = 0 THEN 1 WHEN n % 13 = 0 THEN 3 END AS "retryCount",
CASE WHEN broken THEN 'DecodeError' WHEN n % 19 = 0 THEN 'Poison' WHEN n % 13 = 0 THEN 'OSError' END AS "exceptionClass",
CASE WHEN broken THEN 'no schema for the payload' WHEN n % 19 = 0 THEN 'not for us' WHEN n % 13 = 0 THEN 'connection ' || n % 3 || ' reset' END AS "exceptionMessage",
CASE WHEN broken OR n % 19 = 0 OR n % 13 = 0 THEN corr END AS "correlationId" FROM k""")
def stream_failures(spark, sf_dir):
    """Records tried one by one in two deliveries: what fails three times, or can't be decoded, is given up, all others are archived."""
    at, own = folder(spark), stateful(spark)
    d = _framed(spark, sf_dir, F.col("value").isNotNull() & ((F.col("partition") + F.col("offset") * 12) % 17 == 0))
    come = Deliveries(spark, d.select(*RECORD.names), F.col("offset") % 2, f"{at}/in")
    schemas = own.createDataFrame([(1, "Event")], "id long, name string")
    sink = failures.by_record(flaky, ["topic", "partition", "offset"], ["topic", "partition", "offset"])
    for k in range(2):
        come.come(k)
        archive.archive_stream(come.stream(own), schemas, f"{at}/archive", f"{at}/dlq", f"{at}/cp", attempt=sink).awaitTermination()
    good = spark.read.parquet(f"{at}/archive").select("topic", "partition", "offset", F.lit("archived").alias("outcome"), *[F.lit(None).cast(t).alias(c) for c, t in (("retryCount", "int"), ("exceptionClass", "string"), ("exceptionMessage", "string"), ("correlationId", "string"))])
    bad = spark.read.parquet(f"{at}/dlq").select(F.col("originalTopic").alias("topic"), F.col("originalPartition").alias("partition"), F.col("originalOffset").alias("offset"), F.lit("given up").alias("outcome"), "retryCount", "exceptionClass", "exceptionMessage", "correlationId")
    return good.unionByName(bad)


@query(f"""WITH {V.INSTRUMENTS}, last AS (SELECT * FROM latest WHERE CAST(substr("instrumentId", 2) AS BIGINT) % 10 <> 0)
SELECT "instrumentId", 'row' AS kind, ticker, "sharesOutstanding", "referenceVersion", '' AS reasons FROM last
UNION ALL SELECT "instrumentId", 'reject', ticker, "sharesOutstanding", "referenceVersion", 'VERSION_NOT_NEWER' FROM guarded WHERE NOT accepted
UNION ALL SELECT "instrumentId", 'reject', ticker, "sharesOutstanding", "referenceVersion", concat_ws(',', CASE WHEN trim(ticker) = '' THEN 'BLANK_TICKER' END, CASE WHEN "sharesOutstanding" <= 0 THEN 'SHARES_NOT_POSITIVE' END)
FROM instruments WHERE trim(ticker) = '' OR "sharesOutstanding" <= 0""")
def stream_instruments(spark, sf_dir):
    """Versions of instruments in three deliveries with a restart before each, then tombstones of some in a fourth."""
    at, own = folder(spark), stateful(spark)
    d = V.instruments(spark, sf_dir).withColumn("deleted", F.lit(False))
    gone = d.filter("seq = 0 and cast(substr(instrumentId, 2) as long) % 10 = 0").withColumns({"deleted": F.lit(True), "seq": F.lit(3).cast("long")})
    come = Deliveries(spark, d.unionByName(gone), F.col("seq"), f"{at}/in")
    tables = Versions(own, f"{at}/tables", reference.TABLES)
    for k in range(4):
        come.come(k)
        reference.reference_stream(come.stream(own), tables, f"{at}/rejects", f"{at}/cp", "reference-data").awaitTermination()
    cols = ["ticker", "sharesOutstanding", "referenceVersion"]
    rows = tables.read("instrument", tables.current()).select("instrumentId", F.lit("row").alias("kind"), *cols, F.lit("").alias("reasons"))
    return rows.unionByName(spark.read.parquet(f"{at}/rejects").select("instrumentId", F.lit("reject").alias("kind"), *cols, "reasons"))


@query(SQL["positions_snapshot"])
def stream_positions(spark, sf_dir):
    """Trades in three deliveries; what is delivered twice comes again in a later one and changes nothing."""
    at, own = folder(spark), stateful(spark, lean=True)
    number = F.when(F.pmod("seq", F.lit(2)) == 1, 2).otherwise(F.coalesce(F.pmod("quantity", F.lit(2)), F.lit(0)))  # 0 to 2 for any quantity, or its trade would never come
    come = Deliveries(own, V.trades(own, sf_dir), number, f"{at}/in")
    tables = Versions(own, f"{at}/tables", positions_stream.TABLES)
    for k in range(3):
        come.come(k)
        positions_stream.position_stream(come.stream(own), tables, f"{at}/cp").awaitTermination()
        come.gone(k)
    return positions_stream.snapshots(Versions(spark, f"{at}/tables", positions_stream.TABLES)).withColumn("marketValue", half_up(F.col("marketValue"), 2))


@query(SQL["market_rebuild"])
def stream_rebuild(spark, sf_dir):
    """Market state of the first half of the log, then rebuilt from all of it under readers; what they see after the swap."""
    at, own = folder(spark), stateful(spark)
    ticks = V.ticks(spark, sf_dir)
    come, both = Deliveries(spark, ticks, evenly(ticks, "seq", 2), f"{at}/ticks"), rebuild.Generations(own, f"{at}/market", market.TABLES)
    for k in (0, 1):
        come.come(k)
        run = lambda tables, cp: market.market_stream(come.stream(own), tables, cp, None, V.BUCKET_S, V.RETAIN_S, TTL_MS).awaitTermination()
        both.rebuild(run)
    d = market.market_now(both.tables(), V.HORIZON_S).withColumn("vwap", half_up(F.col("vwap"), 4))
    return d.select("ticker", "bid", "ask", "last", "volume", "event_ms", "offset", "produced_ms", "correlationId", "vwap", "n_buckets")


@query(SQL["archive_coverage"])
def coverage_by_deliveries(spark, sf_dir):
    """Coverage kept up over three deliveries by merging blocks of intervals; what was archived before isn't read again."""
    at = folder(spark)
    d = V.archive(spark, sf_dir).withColumn("of", _late(F.col("partition") + F.col("offset") * 12))
    tables = Versions(spark, f"{at}/tables", {"blocks": intervals.KEY})
    for k in range(3):
        new, old = intervals.blocks(d.filter(F.col("of") == k)), tables.read("blocks", tables.current(before=k))
        tables.publish(k, {"blocks": new if old is None else intervals.merged(old, new)})
    return intervals.coverage(tables.read("blocks", tables.current()))


@query(f"""WITH {V.ARCHIVE}, o AS (SELECT DISTINCT topic, "partition", "offset" FROM archive), n AS (SELECT *, lead("offset") OVER (PARTITION BY topic, "partition" ORDER BY "offset") AS nxt FROM o)
SELECT topic, "partition", "offset" + 1 AS "firstMissing", nxt - 1 AS "lastMissing" FROM n WHERE nxt > "offset" + 1""")
def missing_ranges(spark, sf_dir):
    return intervals.missing_ranges(intervals.blocks(V.archive(spark, sf_dir)))


@query(f"""WITH {V.ARCHIVE}, d AS (SELECT DISTINCT topic, "partition", "offset", topic || '-' || "partition" || '-' || "offset" AS key, coalesce(value, '') AS payload, make_timestamp_ms(ts_ms) AS t FROM archive),
l AS (SELECT *, sha256(strlen(key) || ':' || key || strlen(payload) || ':' || payload) AS leaf FROM d),
b AS (SELECT year(t) AS y, month(t) AS m, day(t) AS d, topic, "partition", "offset" // {manifests.FAN} AS block, sha256(string_agg(leaf, '' ORDER BY "offset")) AS h FROM l GROUP BY ALL),
p AS (SELECT y, m, d, topic, "partition", sha256(string_agg(h, '' ORDER BY block)) AS h FROM b GROUP BY ALL)
SELECT CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month, CAST(d AS INTEGER) AS day, sha256(string_agg(h, '' ORDER BY topic, "partition")) AS root FROM p GROUP BY ALL""")
def archive_roots(spark, sf_dir):
    """The root of the tree of digests over each day's records."""
    d = V.archive(spark, sf_dir).dropDuplicates(["topic", "partition", "offset"]).withColumn("eventType", F.lit("Event"))
    rows = partition_columns(d.withColumnRenamed("value", "payload"))
    return manifests.roots(manifests.leaves(rows), ["year", "month", "day"])


_SETTLE_MS, _FIRST_MS, _LATER_MS = 3_600_000, V.START_MS + 10_000_000, V.START_MS + 40_000_000


@query(f"""WITH {V.LEDGERS}, i0 AS (SELECT o_orderkey AS k, {V.START_MS} + o_orderkey % 7200 * 1000 AS seen FROM orders WHERE o_orderkey % 59 <> 0),
x0 AS (SELECT "referenceId" AS k, {V.START_MS} + "referenceId" % 7200 * 1000 + CASE WHEN "referenceId" % 5 = 0 THEN 9000000 ELSE 1000 END AS seen FROM e1),
times AS (SELECT unnest([{_FIRST_MS}, {_LATER_MS}]) AS now_ms),
i AS (SELECT now_ms, k, count(*) AS n, min(seen) AS seen FROM i0, times WHERE seen <= now_ms GROUP BY ALL), x AS (SELECT now_ms, k, count(*) AS n, min(seen) AS seen FROM x0, times WHERE seen <= now_ms GROUP BY ALL),
f AS (SELECT coalesce(i.now_ms, x.now_ms) AS now_ms, coalesce(i.k, x.k) AS "referenceId", i.n AS i_n, x.n AS e_n, coalesce(i.seen, x.seen) AS seen FROM i FULL OUTER JOIN x ON i.now_ms = x.now_ms AND i.k = x.k),
v AS (SELECT f.*, a.amount AS ia, b.amount AS ea, a.state AS si, b.state AS se FROM f LEFT JOIN internal a ON a."referenceId" = f."referenceId" AND i_n IS NOT NULL LEFT JOIN external b ON b."referenceId" = f."referenceId" AND e_n IS NOT NULL),
g AS (SELECT *, i_n IS NULL OR e_n IS NULL AS alone FROM v),
k AS (SELECT *, CASE WHEN alone AND seen + {_SETTLE_MS} >= now_ms THEN 'TIMING_UNCERTAINTY' WHEN alone THEN 'MISSING_PARTICIPANT' WHEN i_n > 1 OR e_n > 1 THEN 'DUPLICATE_REFERENCE' WHEN abs(ia - ea) > 0 AND abs(ia - ea) <= 1 THEN 'ROUNDING_OR_FEE_CANDIDATE'
  WHEN abs(ia - ea) > 1 THEN 'AMOUNT_MISMATCH' WHEN si <> se THEN 'CONFLICTING_STATE' END AS "observationType" FROM g)
SELECT now_ms, "referenceId", "observationType", ia AS "internalAmount", ea AS "externalAmount", CASE WHEN alone THEN 1 ELSE 2 END AS "participantsObserved",
CASE WHEN NOT alone THEN 'COMPLETE' WHEN seen + {_SETTLE_MS} >= now_ms THEN 'INCOMPLETE_EXPECTED' ELSE 'INCOMPLETE_UNKNOWN' END AS completeness FROM k WHERE "observationType" IS NOT NULL""")
def recon_over_time(spark, sf_dir):
    """What is observed at two times: what is in flight is expected at first, and unknown or settled later."""
    inner, outer = V.ledger_sides(spark, sf_dir)
    k = F.col("referenceId")
    seen = F.lit(V.START_MS) + k % 7200 * 1000
    inner, outer = inner.withColumn("seen_ms", seen), outer.withColumn("seen_ms", seen + F.when(k % 5 == 0, 9_000_000).otherwise(1000))
    each = [reconciliation.observations(inner, outer, 1.0, now, _SETTLE_MS).drop("expectedParticipants").withColumn("now_ms", F.lit(now)) for now in (_FIRST_MS, _LATER_MS)]
    return each[0].unionByName(each[1])


_LEGAL = ", ".join(f"'{x}'" for x in cases.LEGAL)


@query(f"""WITH {V.CASES}, s AS (SELECT "caseId", count(*) AS n_events, list_reduce(list_prepend({{'s': '', 'bad': 0}}, list({{'s': state, 'bad': 0}} ORDER BY event_ms, seq)),
  lambda a, x: CASE WHEN CASE WHEN a.s = '' THEN x.s = 'OPEN' ELSE a.s || '>' || x.s IN ({_LEGAL}) END THEN {{'s': x.s, 'bad': a.bad}} ELSE {{'s': a.s, 'bad': a.bad + 1}} END) AS r FROM cases GROUP BY 1)
SELECT "caseId", r.s AS state, n_events, CAST(r.bad AS BIGINT) AS n_illegal FROM s""")
def case_states(spark, sf_dir):
    """The state that each case is really in, illegal events left out."""
    return cases.case_states(V.case_events(spark, sf_dir), 518_400_000, 4)


@query(f"""WITH {V.TRADES}, once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "tradeId" ORDER BY seq) AS k FROM trades) WHERE k = 1),
g AS (SELECT b."tradeId", b.ticker, b."accountId", min(abs(b.event_ms - s.event_ms)) AS "gapMs" FROM once b JOIN once s ON b.side = 'BUY' AND s.side = 'SELL' AND b.ticker = s.ticker AND b."accountId" = s."accountId" GROUP BY ALL)
SELECT * FROM g WHERE "gapMs" <= 3600000""")
def related_wash_trades(spark, sf_dir):
    """Opposing trades between related traders; here those of one account are, as each trader trades for one."""
    once = V.trades_once(spark, sf_dir, "tradeId", "ticker", "side", "traderId", "accountId", "event_ms")
    return related.related_wash_trades(once, 3_600_000, folder(spark)).select("tradeId", "ticker", "accountId", "gapMs")


_RULES = f"""re AS (SELECT s_suppkey AS version, 25 + s_suppkey % 20 AS threshold, {V.START_MS} + s_suppkey * 7919 % 43200 * 60000 AS f FROM supplier),
rr AS (SELECT *, lead(f) OVER (ORDER BY f, version) AS t FROM re)"""


def _over(trades, ranges):
    return risk.in_force(trades, ranges, "QUANTITY").filter("quantity > threshold").select("tradeId", "ruleId", "version", "threshold", "quantity")


@query(f"""WITH {V.TRADES}, once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "tradeId" ORDER BY seq) AS k FROM trades) WHERE k = 1), {_RULES}
SELECT "tradeId", 'R-QTY' AS "ruleId", version, CAST(threshold AS DOUBLE) AS threshold, quantity FROM once JOIN rr ON f <= event_ms AND (t IS NULL OR event_ms < t) WHERE quantity > threshold""")
def stream_rules(spark, sf_dir):
    """Versions of a rule and trades in turn; trades ahead of the rules wait for them, over a restart."""
    at, own = folder(spark), stateful(spark)
    s = F.col("s_suppkey").cast("long")
    events = V.table(spark, sf_dir, "supplier").select(F.lit("R-QTY").alias("ruleId"), F.lit("QUANTITY").alias("ruleType"), s.alias("version"), F.lit("ACTIVE").alias("state"), F.lit("ann").alias("makerSubject"), F.lit("bob").alias("checkerSubject"), (25 + s % 20).cast("double").alias("threshold"), (F.lit(V.START_MS) + s * 7919 % 43_200 * 60_000).alias("effective_ms"))
    end = events.limit(1).select(*[(F.lit(None).cast(f.dataType) if f.name != "effective_ms" else F.lit(V.START_MS * 2)).alias(f.name) for f in events.schema])
    late = F.when(F.col("effective_ms") < V.START_MS + 1_296_000_000, 0).otherwise(1)
    rules_in = Deliveries(spark, events.unionByName(end), late, f"{at}/rules")
    trades_in = Deliveries(spark, V.trades_once(spark, sf_dir, "tradeId", "event_ms", "quantity"), F.col("quantity") % 2, f"{at}/trades")
    known, held = rules.rule_tables(own, f"{at}/known"), Versions(own, f"{at}/held", rules.HELD_TABLES)
    for k in (0, 1):
        rules_in.come(k)
        rules.rule_stream(rules_in.stream(own), known, f"{at}/cp-rules").awaitTermination()
        trades_in.come(k)
        rules.alert_stream(trades_in.stream(own), known, held, f"{at}/out", f"{at}/cp-trades", _over).awaitTermination()
    return spark.read.parquet(f"{at}/out").select("tradeId", "ruleId", "version", "threshold", "quantity")
