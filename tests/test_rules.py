"""VAL-4..12, WIN-7/8/11/12, JN-1..10, AGG-7/8, PRD-1..4, GOV-1..8, SRC-4..8."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.functions import scalars as S
from tickloom.functions import validation as V
from tickloom.functions.ordered import max_from
from tickloom.operators import cases, corporate_actions, enrichment, governance, positions, reconciliation, reference_data, risk
from tickloom.sources import generators as G

MAP = "map<string,string>"


@pytest.mark.parametrize("kind,attributes,missing", [
    ("STOCK_SPLIT", {"splitRatio": "2:1"}, []), ("STOCK_SPLIT", {}, ["splitRatio"]), ("STOCK_SPLIT", {"splitRatio": "  "}, ["splitRatio"]),
    ("DIVIDEND_DECLARATION", {"exDate": "x"}, ["dividendPerShare"]), ("RIGHTS_ISSUE", {}, ["ratio", "subscriptionPrice"]), ("EARNINGS_ANNOUNCEMENT", {}, []),
])
def test_val6_required_attributes(spark, kind, attributes, missing):
    d = spark.createDataFrame([(kind, attributes)], f"actionType string, attributes {MAP}")
    assert d.select(V.missing_attributes().alias("m")).first()["m"] == missing


def test_val5_val7_dates_come_first_and_null_is_named(spark):
    d = spark.sql(f"""select id, 'STOCK_SPLIT' actionType, cast(if(id = 2, null, if(id = 3, map(), map('splitRatio', '2:1'))) as {MAP}) attributes,
    timestamp'2026-08-16 09:15:00' announcedAt, timestamp'2026-08-16 09:15:00' - make_interval(0,0,0,0,0,0, if(id in (1, 3), 1, 0)) effectiveAt from range(4)""")
    got = {r["id"]: r["reason"] for r in corporate_actions.validated(d).collect()}
    assert got == {0: None, 1: "EFFECTIVE_BEFORE_ANNOUNCED", 2: "NULL_ATTRIBUTES", 3: "EFFECTIVE_BEFORE_ANNOUNCED"}
    good, bad = corporate_actions.publishable(d)
    assert (good.count(), bad.count()) == (1, 3)


@pytest.mark.parametrize("versions,accepted", [([1, 2], [True, True]), ([5, 4], [True, False]), ([3, 3], [True, False]), ([0, 1], [False, True]), ([5, 9, 7, 9, 10], [True, True, False, False, True])])
def test_val4_version_guard(spark, versions, accepted):
    d = spark.createDataFrame([("I1", v, i) for i, v in enumerate(versions)] + [("I2", 1, 0)], "instrumentId string, referenceVersion long, seq long")
    assert [r["accepted"] for r in V.version_guard(d).filter("instrumentId = 'I1'").orderBy("seq").collect()] == accepted


def test_val8_val9_win8_publish_and_compact(spark):
    rows = [("I1", "A", 5, 1, 0), ("I1", "B", 5, 2, 1), ("I1", "C", 5, 1, 2), ("I2", " ", 5, 1, 0), (None, None, None, 1, 0), ("I3", "D", 0, 1, 0)]
    d = spark.createDataFrame(rows, "instrumentId string, ticker string, sharesOutstanding long, referenceVersion long, seq long")
    good, bad = reference_data.publishable(d, "me")
    assert {r["producerIdentity"] for r in good.collect()} == {"me"} and bad.count() == 4
    assert [(r["instrumentId"], r["ticker"]) for r in reference_data.latest_instruments(good).collect()] == [("I1", "B")]
    log = spark.createDataFrame([("k", "v", 1), ("k", None, 2), ("j", "w", 1)], "key string, value string, offset long")
    assert [tuple(r) for r in reference_data.compacted(log).select("key", "value").collect()] == [("j", "w")]


def test_val11_val12_prd4_schema_rules(spark):
    d = spark.createDataFrame([("t", "BUY", "x"), (None, "HOLD", "y")], "tradeId string, side string, traderId string")
    for f, t, _ in schemas.fields("TradeEvent"):
        if f not in d.columns:
            d = d.withColumn(f, F.lit(None).cast(schemas.TYPES.get(t, schemas.TYPES["string"])))
    r = d.select(V.mandatory_reasons("TradeEvent").alias("m"), V.enum_reasons("TradeEvent").alias("e")).collect()
    assert "NULL_tradeId" not in r[0]["m"] and "NULL_tradeId" in r[1]["m"] and list(r[1]["e"]) == ["BAD_side"]
    assert schemas.schema("TradeEvent")["traderId"].metadata == {"classification": "RESTRICTED"}
    assert len(schemas.FIELDS) == 16 and len(schemas.ENUMS) == 15 and len(schemas.TOPICS) == 22
    masked = governance.masked(d).collect()
    assert len(masked[0]["traderId"]) == 64 and masked[0]["accountId"] is None


def test_jn2_as_of_ties_and_misses(spark):
    ticks = spark.createDataFrame([("A", 1.0, 3.0, 2.0, 10, 100, 0), ("A", 5.0, 7.0, 6.0, 30, 200, 1), ("A", 50.0, 70.0, 60.0, 0, 200, 2)], "ticker string, bid double, ask double, last double, volume long, event_ms long, seq long")
    trades = spark.createDataFrame([("t0", "A", 99, 1.0), ("t1", "A", 100, 1.0), ("t2", "A", 200, 6.6), ("t3", "B", 200, 1.0)], "tradeId string, ticker string, event_ms long, price double")
    q = enrichment.as_of(trades, ticks, 1000)
    got = {r["tradeId"]: (r["bid"], r["vwap"]) for r in q.collect()}
    assert got == {"t0": (None, None), "t1": (1.0, 2.0), "t2": (5.0, 5.0), "t3": (None, None)}
    inst = spark.createDataFrame([("I2", "A", 5), ("I1", "A", 30_000_000)], "instrumentId string, ticker string, sharesOutstanding long")
    good, bad = enrichment.enriched(q, inst)
    r = good.filter("tradeId = 't2'").first()
    assert (r["mid"], r["spread"], round(r["deviation"], 6), round(r["marketCap"], 6), r["dataAgeMs"]) == (6.0, 2.0, 10.0, 19.8, 0)
    assert {x["failure"] for x in bad.collect()} == {"REFERENCE_DATA_UNAVAILABLE"} and bad.count() == 2


def test_agg7_positions_are_idempotent(spark):
    cols = "tradeId string, accountId string, traderId string, ticker string, side string, quantity long, price double, event_ms long, seq long"
    rows = [("1", "a", "t", "X", "BUY", 10, 5.0, 1, 0), ("1", "a", "t", "X", "BUY", 10, 5.0, 1, 3), ("2", "a", "t", "X", "SELL", 4, 6.0, 2, 1)]
    once = positions.positions(spark.createDataFrame(rows, cols)).first()
    assert (once["netQuantity"], once["grossBuyQuantity"], once["grossSellQuantity"], once["marketValue"], once["lastProcessedTradeId"]) == (6, 10, 4, 36.0, "2")


def test_win12_jn5_rule_in_force(spark):
    rows = [("R", "X", 1, "ACTIVE", "a", "b", 1.0, 10), ("R", "X", 2, "ACTIVE", "a", "a", 9.0, 15), ("R", "X", 2, "ACTIVE", "a", "c", 2.0, 20), ("R", "X", 2, "RETIRED", "a", "c", 2.0, 30)]
    ranges = risk.rule_ranges(spark.createDataFrame(rows, "ruleId string, ruleType string, version long, state string, makerSubject string, checkerSubject string, threshold double, effective_ms long"))
    at = spark.createDataFrame([(t,) for t in (9, 10, 19, 20, 29, 30)], "event_ms long")
    assert [(r["event_ms"], r["version"]) for r in risk.in_force(at, ranges, "X").orderBy("event_ms").collect()] == [(10, 1), (19, 1), (20, 2), (29, 2)]


def test_jn10_wash_trades(spark):
    rows = [("b1", "BUY", 100), ("s1", "SELL", 150), ("b2", "BUY", 400), ("b3", "BUY", 152)]
    d = spark.createDataFrame([(i, "t", "X", s, ms) for i, s, ms in rows], "tradeId string, traderId string, ticker string, side string, event_ms long")
    assert {r["tradeId"]: (r["sellTradeId"], r["gapMs"]) for r in risk.wash_trades(d, 60).collect()} == {"b1": ("s1", 50), "b3": ("s1", 2)}


def test_jn9_alerts_near_an_action_are_explained(spark):
    alerts = spark.createDataFrame([("1", "X", 1000), ("2", "X", 5000), ("3", "Y", 1000)], "alertId string, ticker string, alert_ms long")
    actions = spark.createDataFrame([("X", 1100)], "ticker string, effective_ms long")
    assert sorted(r["alertId"] for r in corporate_actions.unexplained(alerts, actions, 100).collect()) == ["2", "3"]


def test_jn6_observations(spark):
    cols = "referenceId long, amount double, state string"
    a = spark.createDataFrame([(1, 5.0, "F"), (2, 5.0, "F"), (3, 5.0, "F"), (4, 5.0, "F"), (5, 5.0, "F"), (6, 5.0, "F")], cols)
    b = spark.createDataFrame([(1, 5.0, "F"), (2, 5.5, "F"), (3, 50.0, "F"), (4, 5.0, "O"), (5, 5.0, "F"), (5, 5.0, "F"), (7, 5.0, "F")], cols)
    got = {r["referenceId"]: r["observationType"] for r in reconciliation.observations(a, b).collect()}
    assert got == {2: "ROUNDING_OR_FEE_CANDIDATE", 3: "AMOUNT_MISMATCH", 4: "CONFLICTING_STATE", 5: "DUPLICATE_REFERENCE", 6: "MISSING_PARTICIPANT", 7: "MISSING_PARTICIPANT"}


def test_win11_prd3_srt4_cases(spark):
    e = spark.createDataFrame([("c", "OPEN", 1, 0), ("c", "CLOSED", 2, 1), ("d", "CLOSED", 1, 2)], "caseId string, state string, event_ms long, seq long")
    assert {r["caseId"]: r["state"] for r in cases.case_latest(e).collect()} == {"c": "CLOSED", "d": "CLOSED"}
    assert sorted(r["seq"] for r in cases.illegal_transitions(e).collect()) == [1, 2]
    o = spark.createDataFrame([("NO_FLAG", {"t": "failed"}), ("NO_FLAG", {"t": "ok"}), ("FLAG", {"t": "failed"}), ("NO_FLAG", None)], f"outcome string, toolStatus {MAP}")
    assert [r["o"] for r in o.select(cases.safe_outcome().alias("o")).collect()] == ["ESCALATE", "NO_FLAG", "FLAG", "NO_FLAG"]
    k = spark.createDataFrame([("a", "LOW", 1), ("b", "CRITICAL", 5), ("c", "CRITICAL", 2)], "candidateId string, priority string, created_ms long")
    assert [r["candidateId"] for r in cases.top_candidates(k, 2).collect()] == ["c", "b"]


def test_prd1_gov6_access(spark):
    rules = governance.policies(spark)
    asked = spark.createDataFrame([("trade-producer", "TOPIC", "trades.raw", o) for o in ("WRITE", "READ", "DESCRIBE")] + [("trade-producer", "TOPIC", "market-data.ticks", "WRITE"), ("audit-service", "GROUP", "audit-service", "READ"), ("audit-service", "GROUP", "other", "READ")], "principal string, resourceType string, name string, operation string")
    got = {(r["name"], r["operation"]): r["decision"] for r in governance.decide(asked, rules).collect()}
    assert got == {("trades.raw", "WRITE"): "ALLOW", ("trades.raw", "READ"): "DENY", ("trades.raw", "DESCRIBE"): "ALLOW", ("market-data.ticks", "WRITE"): "DENY", ("audit-service", "READ"): "ALLOW", ("other", "READ"): "DENY"}
    assert rules.count() == 16
    assert governance.grant_arguments(rules).first()["arguments"] == "--add --allow-principal User:audit-service --operation READ --group audit-service"


def _changed(change):
    s = json.loads(governance.avro_schema("TradeEvent"))
    change(s["fields"])
    return json.dumps(s)


def test_gov1_full_compatibility():
    base = governance.avro_schema("TradeEvent")
    assert governance.incompatibilities(base, base) == []
    assert governance.incompatibilities(base, _changed(lambda f: f.append({"name": "note", "type": ["null", "string"], "default": None}))) == []
    for change in (lambda f: f.pop(0), lambda f: f[3].update(type="string"), lambda f: f.append({"name": "must", "type": "string"}), lambda f: f[5]["type"].update(symbols=["BUY"])):
        assert governance.incompatibilities(base, _changed(change))
    for name in schemas.FIELDS:
        assert governance.incompatibilities(governance.avro_schema(name), governance.avro_schema(name)) == []


def test_gov2_parse_order():
    docs = {"b": json.dumps({"type": "record", "name": "B", "fields": [{"name": "a", "type": "A"}]}), "a": json.dumps({"type": "record", "name": "A", "fields": []})}
    assert governance.parse_order(docs) == ["a", "b"]
    with pytest.raises(ValueError):
        governance.parse_order({"b": docs["b"]})


def test_gov3_gov4_gov5_gov7_gov8_catalogues(spark):
    names = lambda *x: spark.createDataFrame([(n, "ns") for n in x], "name string, namespace string")
    assert [r["name"] for r in governance.dropped_schemas(names("A", "B"), names("A")).collect()] == ["B"]
    assert governance.topic_catalogue(spark).filter("name = 'reference-data.instruments'").first()["config"] == "cleanup.policy=compact"
    assert governance.subject_catalogue(spark).filter("schemaName = 'EnrichedTradeEvent'").first()["reference"] == "trades.raw-value"
    assert governance.shared_names(names("A", "B"), names("B")).count() == 1
    assert [r["name"] for r in governance.name_chain(names("a", "b"), names("a", "b"), names("a")).collect()] == ["b"]
    edges = spark.createDataFrame([("x", "y"), ("y", "x")], "src string, dst string")
    planes = spark.createDataFrame([("x", "one"), ("y", "two")], "module string, plane string")
    assert [r["src"] for r in governance.crossing_edges(edges, planes, [("one", "two")]).collect()] == ["y"]


def test_src4_generated_ticks(spark):
    t = G.ticks(spark, 2000, seed=3).cache()
    assert t.filter("bid <= last and last <= ask").count() == 2000 and t.filter("last <= 0 or volume < 100").count() == 0
    assert t.select("ticker").distinct().count() == 4 and t.agg(F.max("volume")).first()[0] > 1000
    assert t.collect() == G.ticks(spark, 2000, seed=3).collect() != G.ticks(spark, 2000, seed=4).collect()
    r = t.first()
    assert abs((r["ask"] - r["bid"]) - r["last"] * 5e-4) < 1e-9
    assert G.ticks(spark, 100, enabled=False).count() == 0
    wild = G.ticks(spark, 20_000, G.TickModel(sigma=5, step_seconds=60))
    assert wild.filter("last <= 0").count() == 0


@pytest.mark.parametrize("bad", [{"sigma": -1}, {"prices": {"A": float("nan")}}, {"prices": {}}, {"step_seconds": 0}, {"volume_alpha": 0}, {"spread_bps": -1}])
def test_val10_model_parameters(bad):
    with pytest.raises(ValueError):
        G.TickModel(**bad)


def test_src5_src6_src7_src8(spark):
    t = G.trades(spark, 500, seed=1)
    assert t.filter("quantity between 1 and 500 and price between 950 and 1050 and side in ('BUY', 'SELL')").count() == 500 and t.select("tradeId").distinct().count() == 500
    assert [G.Pace(r, i).batch for r, i in ((50_000, 0.01), (1000, 0.01), (10, 0.01), (100, 0.05), (250, 0.01))] == [500, 10, 1, 5, 3]
    with pytest.raises(ValueError):
        G.Pace(0, 1)
    a = G.seed_corporate_actions(spark, [("c", "X", "STOCK_SPLIT", {"splitRatio": "2:1"}, 60)], F.timestamp_seconds(F.lit(0)))
    assert a.select(F.unix_seconds("effectiveAt")).first()[0] == 60
    assert G.seed_instruments(spark, [("I", "X", 5)]).first()["referenceVersion"] == 1


def test_fn14_pareto_edges(spark):
    r = spark.range(1).select(S.pareto(F.lit(0.0), 100, 0.5).alias("a"), S.pareto(F.lit(1.0), 100, 1.5).alias("b"), S.pareto(F.lit(0.5), 100, 1.0).alias("c")).first()
    assert r["a"] > 9.2e18 and (r["b"], r["c"]) == (100, 200)


@pytest.mark.parametrize("span", [None, 60_001, 150_000])
def test_as_of_equals_brute_force_in_any_ranges(spark, span):
    r = random.Random(3)
    rows = [("T" if r.random() < 0.8 else "U", r.randrange(-300_000, 600_000) // 50 * 50, round(r.uniform(1, 9), 4), r.randrange(0, 5), k) for k in range(800)]
    rows = [x for x in rows if not 100_000 < x[1] < 420_000]  # a stretch without ticks, longer than a range
    ticks = spark.createDataFrame([(t, ms, p - 0.5, p + 0.5, p, v, k) for t, ms, p, v, k in rows], "ticker string, event_ms long, bid double, ask double, last double, volume long, seq long")
    asked = [(f"t{k}", r.choice("TUX"), r.randrange(-400_000, 700_000) // 50 * 50) for k in range(300)]
    trades = spark.createDataFrame(asked, "tradeId string, ticker string, event_ms long")
    got = {x["tradeId"]: (x["tick_ms"], x["bid"], x["vwap"]) for x in enrichment.as_of(trades, ticks, 60_000, span).collect()}
    for i, t, ms in asked:
        mine = [x for x in rows if x[0] == t and x[1] <= ms]
        near = [x for x in mine if x[1] >= ms - 60_000]
        last = min((x for x in mine if x[1] == max(y[1] for y in mine)), key=lambda x: x[4], default=None)
        pv, v = sum(round(x[2] * 10_000) * x[3] for x in near), sum(x[3] for x in near)
        assert got[i] == (last and last[1], last and last[2] - 0.5, pv / 10_000 / v if v else None)


@pytest.mark.parametrize("few", [10_000, 0])
def test_rules_in_force_by_cells(spark, few):
    """Broadcast or joined by cells of time, each row meets the same ranges, open, short and very long ones."""
    r = random.Random(5)
    spans = [(0, None), (5, 6), (10, 3_600_000 * 16**5 * 3), (-10**9, 10**9), *((a := r.randrange(10**11), a + r.randrange(1, 10**10)) for _ in range(40))]
    ranges = spark.createDataFrame([(f"R{k}", "X", 1, 1.0, a, z) for k, (a, z) in enumerate(spans)], "ruleId string, ruleType string, version long, threshold double, from_ms long, to_ms long")
    times = [0, 4, 5, 6, 3_600_000, *(r.randrange(2 * 10**11) for _ in range(100))]
    got = risk.in_force(spark.createDataFrame([(t,) for t in times], "event_ms long"), ranges, "X", few=few)
    assert sorted((x["event_ms"], x["ruleId"]) for x in got.collect()) == sorted((t, f"R{k}") for t in times for k, (a, z) in enumerate(spans) if a <= t and (z is None or t < z))
    assert risk.cells_of(ranges).count() < len(spans) * 200


@pytest.mark.parametrize("block,span", [(3, None), (5, 7), (65_536, 40)])
def test_agg8_volume_in_blocks(spark, block, span):
    r = random.Random(block)
    rows = [("H" if r.random() < 0.7 else f"T{k % 4}", k * 3 % 400, r.randrange(1, 20)) for k in range(400)]
    rows = list({(t, s): (t, s, v) for t, s, v in rows}.values())
    d = spark.createDataFrame([(t, s, v, 10) for t, s, v in rows], "ticker string, seq long, volume long, event_ms long")
    ranges = spark.createDataFrame([("R", "UNUSUAL_VOLUME", 1, 1.5, 0, None)], "ruleId string, ruleType string, version long, threshold double, from_ms long, to_ms long")
    want = set()
    for t in {x[0] for x in rows}:
        mine = sorted(x[1:] for x in rows if x[0] == t)
        for k in range(3, len(mine)):
            mean = sum(v for _, v in mine[k - 3 : k]) / 3
            if mine[k][1] > 1.5 * mean:
                want.add((t, mine[k][0], round(mean, 6)))
    got = risk.unusual_volume_alerts(d, ranges, 3, span, block)
    assert {(x["ticker"], x["seq"], round(x["meanVolume"], 6)) for x in got.collect()} == want and want


def test_frames_of_one_hot_key_grow_only(spark):
    """40,000 rows of one key; a frame that ended at the last row took most of a minute."""
    n = 40_000
    d = spark.range(n).selectExpr("'k' as ticker", "id as seq", "(id * 7919) % 10007 as x").cache()
    assert d.count() == n
    began = time.perf_counter()
    got = np.array([r["m"] for r in max_from(d, ["ticker"], "seq", F.col("x"), "m").orderBy("seq").select("m").collect()])
    x = np.arange(n) * 7919 % 10007
    assert (got == np.maximum.accumulate(x[::-1])[::-1]).all()
    t = d.selectExpr("ticker", "'t' as traderId", "cast(seq as string) as tradeId", "seq * 10 as event_ms", "if(x % 50 = 0, 'SELL', 'BUY') as side")
    hits = risk.wash_trades(t, 100)
    assert hits.count() == sum(1 for k in range(n) if x[k] % 50 and (x[max(0, k - 10) : k + 11] % 50 == 0).any())
    assert time.perf_counter() - began < 25
