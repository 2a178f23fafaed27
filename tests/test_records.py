"""PRJ-1, WIN-6, AGG-4/6/9, JN-7, SNK-8, FN-1..11, SRC-3/10."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.functions import wire
from tickloom.operators import archive as A
from tickloom.operators import dead_letters as D
from tickloom.sources.cdc import canonical_trades
from tickloom.sources.records import Subscription, keyed, read

REC = "topic string, partition int, offset long, key string, value binary, timestamp timestamp"
FRAME = bytes([0, 0, 0, 0, 1, 42])


def records(spark, coords, value=FRAME):
    return spark.createDataFrame([("trades.raw", p, o, "RELIANCE", value) for p, o in coords], REC.rsplit(",", 1)[0]).withColumn("timestamp", F.timestamp_millis(F.lit(1_786_000_000_000)))


def archived(spark, coords, value=FRAME):
    schemas = spark.createDataFrame([(1, "TradeEvent")], "id long, name string")
    good, bad = A.classified(records(spark, coords, value), schemas)
    return A.deduplicated(A.projected(good)), bad


def test_win6_one_row_per_coordinate(spark):
    rows, _ = archived(spark, [(0, 17), (0, 17), (1, 17)])
    assert sorted(r["idempotencyKey"] for r in rows.collect()) == ["trades.raw-0-17", "trades.raw-1-17"]
    assert rows.first()["payload"] == FRAME and rows.first()["eventType"] == "TradeEvent"


def test_fn9_tombstones_and_undecodable(spark):
    rows, bad = archived(spark, [(2, 99)], None)
    assert (rows.first()["eventType"], bytes(rows.first()["payload"]), bad.count()) == ("Tombstone", b"", 0)
    rows, bad = archived(spark, [(2, 99)], b"not an avro payload")
    assert (rows.count(), bytes(bad.first()["value"])) == (0, b"not an avro payload")


def test_win6_bounded_window_marks_after_the_write():
    out = []
    w = A.BoundedWindow(1)
    assert [w.write(k, out.append) for k in ("1", "2", "1")] == [True, True, True]
    w = A.BoundedWindow(10)

    def fails(_):
        raise OSError

    with pytest.raises(OSError):
        w.write("k", fails)
    assert w.write("k", out.append) and not w.write("k", out.append)
    with pytest.raises(ValueError):
        A.BoundedWindow(0)


def test_agg6_jn7_coverage_and_gaps(spark):
    d = records(spark, [(0, 1), (0, 2), (0, 2), (0, 5), (1, 7), (2, 3), (2, 3)])
    got = {r["partition"]: (r["archivedRecordCount"], r["duplicateCount"], r["missingCount"], r["status"]) for r in A.coverage(d).collect()}
    assert got == {0: (3, 1, 2, "FAIL"), 1: (1, 0, 0, "PASS"), 2: (1, 1, 0, "WARNING")}
    assert sorted(r["offset"] for r in A.missing_offsets(d).collect()) == [3, 4]


def test_agg9_manifest_does_not_depend_on_order(spark):
    a, _ = archived(spark, [(0, 1), (0, 2), (0, 3)])
    b, _ = archived(spark, [(0, 3), (0, 1), (0, 2)])
    assert A.manifest(a).collect() == A.manifest(b.repartition(3)).collect()


def test_snk8_agg4_dead_letter(spark):
    d = records(spark, [(3, 4242)], b"\0\0\0\0\x07\x2a")
    head = lambda v: F.struct(F.lit("correlationId").alias("key"), F.encode(F.lit(v), "UTF-8").alias("value"))
    tracked = D.attempts(spark.createDataFrame([("trades.raw", 3, 4242, t) for t in (0, 2000, 4000)], "topic string, partition int, offset long, failed_ms long"))
    d = D.with_attempts(d, tracked, F.lit(9))
    cause = F.array(F.struct(F.lit("IllegalState").alias("class"), F.lit("sink rejected the batch").alias("message")), F.struct(F.lit("IOException").alias("class"), F.lit("connection reset").alias("message")))
    d = d.withColumns({"chain": cause, "stack": F.repeat(F.lit("x"), 900), "headers": F.array(head("corr-1"), head("corr-9"))})
    r = D.dead_letters(d, "audit-service", "audit-service-7").first()
    assert (r["topic"], r["key"], bytes(r["originalPayload"])) == ("trades.raw.dlq", "RELIANCE", b"\0\0\0\0\x07\x2a")
    assert (r["retryCount"], r["exceptionClass"], r["exceptionMessage"], r["correlationId"]) == (3, "IOException", "connection reset", "corr-9")
    assert "sink rejected the batch" in r["failureReason"] and len(r["stackTraceSummary"]) == 500
    assert (r["lastFailureAt"] - r["firstFailureAt"]).seconds == 4


def test_fn5_fn6_absent_values(spark):
    kind = "array<struct<key:string,value:binary>>"
    chain = F.array(F.struct(F.lit("E").alias("class"), F.lit(None).cast("string").alias("message")))
    r = spark.range(1).withColumns({"h": F.array().cast(kind), "c": chain}).select(S.correlation_id("h").alias("a"), S.root_message("c").alias("b")).first()
    assert tuple(r) == (None, "null")


def test_fn2_fn7_keys_and_headers(spark):
    d = spark.createDataFrame([("TCS", "c1", {"traceparent": "p"}), ("TCS", "c2", None)], "t string, c string, m map<string,string>")
    got = d.select(S.cache_key("t", "window").alias("k"), F.transform(S.headers("c", "m"), lambda h: h["key"]).alias("h")).collect()
    assert got[0]["k"] == "market:{TCS}:window"
    assert [r["h"] for r in got] == [["correlationId", "traceparent"], ["correlationId"]]


def test_fn10_fn11_wire_format(spark):
    row = {f: "x" for f, t, _ in wire.fields("TradeEvent")} | {"quantity": 1500, "price": 2847.55, "side": "SELL", "eventTimestamp": 1_786_000_000_000, "producedAt": -1, "traceContext": {"a": "b"}, "sourceSystem": None, "sourceRecordKey": None, "sourceChangePosition": None, "migrationBatchId": "m"}
    good = wire.framed(300, wire.encode("TradeEvent", row))
    d = spark.createDataFrame([(good,), (good[:-3],), (good + b"z",), (b"\0\0",)], "v binary")
    got = d.select(S.schema_id("v").alias("id"), wire.decode(S.payload_body("v"), "TradeEvent").alias("d")).collect()
    assert [r["id"] for r in got] == [300, 300, 300, None]
    e = got[0]["d"]["event"]
    assert (e["quantity"], e["price"], e["side"], e["traceContext"], e["sourceSystem"], e["migrationBatchId"]) == (1500, 2847.55, "SELL", {"a": "b"}, None, "m")
    assert all(r["d"]["error"] and r["d"]["event"] is None for r in got[1:])


@settings(max_examples=60, deadline=None)
@given(st.integers(-(2**62), 2**62), st.text(), st.dictionaries(st.text(max_size=5), st.text(max_size=5), max_size=4))
def test_fn11_round_trip(n, s, m):
    row = {"ticker": s, "bidPrice": 1.5, "askPrice": float(n), "lastTradedPrice": 0.0, "volume": n, "eventTimestamp": 0, "producedAt": 0, "correlationId": s, "traceContext": m}
    back = wire.Reader(wire.encode("MarketDataTickEvent", row)).record("MarketDataTickEvent")
    assert (back["volume"], back["ticker"], back["traceContext"]) == (n, s, m)


@pytest.mark.parametrize("bad", [{"topics": ()}, {"topics": (" ",)}, {"window": 0}, {"servers": "x:1"}])
def test_src3_settings_are_checked(bad):
    with pytest.raises(ValueError):
        Subscription(**{"topics": ("a",), "group": "g", "path": "/x"} | bad)


def test_src1_src2_files_with_record_columns(spark, tmp_path):
    d = records(spark, [(0, 1), (0, 2)]).withColumn("headers", F.lit(None).cast("array<struct<key:string,value:binary>>"))
    d.unionByName(d.withColumn("topic", F.lit("other"))).write.parquet(str(tmp_path / "r"))
    assert read(spark, Subscription(("trades.raw",), "g", str(tmp_path / "r"))).count() == 2
    assert keyed(d, "t", "key", "value").columns == ["topic", "key", "value", "headers"]


def test_src10_change_capture(spark):
    row = '{"id":"9","ticker":"TCS","quantity":5,"price":1.5,"side":"buy","trader":"t","account":"a","ts_ms":7}'
    change = lambda op, lsn: '{"before":null,"after":%s,"op":"%s","source":{"table":"trades","lsn":"%s","ts_ms":1}}' % (row if op != "d" else "null", op, lsn)
    d = spark.createDataFrame([(change("c", "1"),), (change("c", "1"),), (change("u", "2"),), (change("d", "3"),), ("{broken",)], "value string")
    good, bad = canonical_trades(d, "legacy", "m1")
    got = good.orderBy("sourceChangePosition").collect()
    assert [r["sourceChangePosition"] for r in got] == ["1", "2"] and bad.count() == 1
    assert (got[0]["side"], got[0]["sourceSystem"], got[0]["sourceRecordKey"], got[0]["migrationBatchId"]) == ("BUY", "legacy", "9", "m1")


def test_bounded_once_equals_the_window(spark):
    """In Spark as one by one, for windows shorter and longer than the distance of repeats."""
    r = random.Random(1)
    rows = [(f"t{r.randrange(2)}", r.randrange(2), r.randrange(12), seq) for seq in range(400)]
    d = spark.createDataFrame(rows, "topic string, partition int, offset long, seq long").repartition(5)
    for n in (1, 3, 50):
        windows, want = {}, []
        for t, p, o, s in rows:
            if windows.setdefault((t, p), A.BoundedWindow(n)).write(o, lambda _: None):
                want.append((t, p, o, s))
        assert sorted(tuple(x) for x in A.bounded_once(d, n, "seq").collect()) == sorted(want)
