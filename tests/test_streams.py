"""STR-1..11: batch and stream agree, replay gives the same state, poison is set aside, retries are bounded."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_market_state import DDL, simulate, ticks
from tickloom.schemas import RECORD
from tickloom.operators.archive import BoundedWindow, let_through
from tickloom.streaming.archive import Outage, archive_stream, with_retry
from tickloom.streaming.failures import Poison, by_record
from tickloom.streaming.market import ROCKSDB, market_updates
from tickloom.streaming.metrics import Metrics
from tickloom.streaming.session import stateful


@pytest.fixture
def rocksdb(spark):
    keys = ROCKSDB | {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def test_str2_str3_str11_stream_equals_simulation(spark, tmp_path, rocksdb):
    r = random.Random(5)
    rows = [(r.randrange(0, 900_000), float(r.randrange(1, 50)), r.randrange(5), r.randrange(60)) for _ in range(80)]
    t = ticks(spark, rows)
    for k, part in enumerate((t.filter("seq < 40"), t.filter("seq >= 40"))):  # in two batches
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(DDL).parquet(str(tmp_path / "in"))
        q = market_updates(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    assert [(x["outcome"], x["windowApplied"], x["windowBuckets"]) for x in got] == simulate(rows)[0]


SCHEMAS = [(1, "TradeEvent")]
GOOD = bytes([0, 0, 0, 0, 1, 9])


def come(spark, path, rows):
    """Records as (partition, offset, value, day), in this order."""
    d = spark.createDataFrame([("t", p, o, "K", v, day, k) for k, (p, o, v, day) in enumerate(rows)], "topic string, partition int, offset long, key string, value binary, day long, arrival long")
    d = d.withColumns({"timestamp": F.timestamp_millis(1_786_000_000_000 + F.col("day") * 86_400_000), "headers": F.lit(None).cast(RECORD["headers"].dataType)})
    d.select(*RECORD.names, "arrival").coalesce(1).write.mode("append").parquet(str(path))


def archived(spark, at, **more):
    own = stateful(spark)
    s = own.readStream.schema(spark.read.parquet(str(at / "in")).schema).parquet(str(at / "in"))
    archive_stream(s, own.createDataFrame(SCHEMAS, "id long, name string"), str(at / "archive"), str(at / "dlq"), str(at / "cp"), arrival="arrival", **more).awaitTermination()
    rows = sorted((r["partition"], r["offset"], r["eventType"]) for r in spark.read.parquet(str(at / "archive")).collect())
    return rows, sorted((r["originalOffset"], r["retryCount"], bytes(r["originalPayload"]), r["exceptionClass"]) for r in spark.read.parquet(str(at / "dlq")).collect())


def test_str6_str7_snk6_snk7_archive(spark, tmp_path):
    come(spark, tmp_path / "in", [(0, 1, GOOD, 0), (0, 1, GOOD, 0), (0, 2, None, 0), (0, 3, b"poison", 0)])
    want = [(0, 1, "TradeEvent"), (0, 2, "Tombstone")], [(3, 1, b"poison", "DecodeError")]
    assert archived(spark, tmp_path) == archived(spark, tmp_path) == want


def test_str1_late_records_are_kept(spark, tmp_path):
    for rows in ([(0, 1, GOOD, 30)], [(0, 2, GOOD, 0), (0, 3, GOOD, 31), (0, 1, GOOD, 30)], [(0, 2, GOOD, 0), (0, 4, b"late poison", -40)]):
        come(spark, tmp_path / "in", rows)
        got = archived(spark, tmp_path)
    assert got == ([(0, o, "TradeEvent") for o in (1, 2, 3)], [(4, 1, b"late poison", "DecodeError")])


@pytest.mark.parametrize("n", [1, 4, 1000])
def test_win6_srt2_stream_equals_the_window(spark, tmp_path, n):
    r, windows, want = random.Random(n), {}, []
    for _ in range(3):  # late and replayed records over three batches
        rows = [(r.randrange(2), r.randrange(12), GOOD, r.randrange(40)) for _ in range(15)]
        come(spark, tmp_path / "in", rows)
        for p, o, *_ in rows:
            if windows.setdefault(p, BoundedWindow(n)).write(o, lambda _: None):
                want.append((p, o, "TradeEvent"))
        got, _ = archived(spark, tmp_path, window=n)
        assert got == sorted(want)


def test_let_through():
    r = random.Random(3)
    for _ in range(300):
        n, rows = r.randrange(1, 12), [r.randrange(9) for _ in range(r.randrange(30))]
        w, cut = BoundedWindow(n), r.randrange(31)
        want = [w.write(o, lambda _: None) for o in rows]
        one, ring = let_through(np.zeros(0, np.int64), np.array(rows[:cut], np.int64), n)
        two, ring = let_through(ring, np.array(rows[cut:], np.int64), n)
        assert [*one.tolist(), *two.tolist()] == want and ring.tolist() == list(w.keys)


def test_str7_str8_agg4_attempts_outlive_a_restart(spark, tmp_path):
    """Offset 5 is never taken, 6 at the third attempt; while 7 is at its second the dependency goes down."""
    marks = str(tmp_path / "marks")
    os.makedirs(marks)

    def sink(record, attempt):
        o = record["offset"]
        if o == 7 and attempt == 2 and not os.path.exists(f"{marks}/down"):
            open(f"{marks}/down", "w").close()
            raise Outage("no route")
        open(f"{marks}/{o}-{attempt}-{time.time_ns()}", "w").close()
        if o == 5 or (o == 6 and attempt < 3) or (o == 7 and attempt < 2):
            raise OSError("reset")
        if o == 8:
            raise Poison("never")

    attempt = by_record(sink, ["topic", "partition", "offset"], ["topic", "partition", "offset"])
    come(spark, tmp_path / "in", [(0, o, GOOD, 0) for o in range(1, 10)])
    with pytest.raises(Exception, match="no route"):
        archived(spark, tmp_path, attempt=attempt)
    assert not os.path.exists(tmp_path / "archive")
    before = int(time.time() * 1000)
    rows, letters = archived(spark, tmp_path, attempt=attempt)
    assert [o for _, o, _ in rows] == [1, 2, 3, 4, 6, 7, 9] and letters == [(5, 3, GOOD, "OSError"), (8, 1, GOOD, "Poison")]
    (d,) = spark.read.parquet(str(tmp_path / "dlq")).filter("originalOffset = 5").collect()
    assert d["firstFailureAt"].timestamp() * 1000 < before < d["lastFailureAt"].timestamp() * 1000
    assert len([x for x in os.listdir(marks) if x.startswith("1-1-")]) == 1  # what was done before the outage isn't done again


def test_str8_str9_retries():
    waits, calls = [], []

    def fails():
        calls.append(1)
        raise OSError

    with pytest.raises(OSError):
        with_retry(fails, sleep=waits.append)
    assert (len(calls), waits) == (3, [0.1, 0.2])
    left = [OSError(), None]

    def once():
        if e := left.pop(0):
            raise e

    assert with_retry(once, sleep=waits.append) == 2

    def out():
        calls.append(2)
        raise Outage

    with pytest.raises(Outage):
        with_retry(out, sleep=waits.append)
    assert calls.count(2) == 1


def test_str10_metrics_do_not_fail_the_data():
    class Event:
        class progress:
            observedMetrics = {"m": type("R", (), {"asDict": lambda self: {"a": 1}})()}

    Metrics(lambda *_: 1 / 0).onQueryProgress(Event)
