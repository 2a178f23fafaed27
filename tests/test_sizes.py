"""What the findings of round 3 said about larger tables, at sizes that a test can meet."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import enrichment, related, risk
from tickloom.plans import queries, checks, registry, streams  # noqa: F401, I001
from tickloom.plans import views as V
from tickloom.schemas import RECORD
from tickloom.streaming import market, positions, reference
from tickloom.streaming.archive import archive_stream
from tickloom.streaming.session import stateful
from tickloom.streaming.versions import Files, Versions

SF = "/root/testdata/sf0.001"


def test_f1_versions_are_judged_by_batch(spark, tmp_path):
    """No state by instrument: a batch is judged as a whole against the marks before it, and alike when it is run again."""
    ddl = "instrumentId string, ticker string, sharesOutstanding long, referenceVersion long, seq long, deleted boolean"
    tables = Versions(spark, str(tmp_path / "t"), reference.TABLES)
    run = reference.publish_batch(tables, str(tmp_path / "rejects"), "us")
    run(spark.createDataFrame([("A", "T", 5, 2, 1, False), ("A", "T", 5, 1, 2, False), ("B", "T", 5, 3, 3, False)], ddl), 0)
    for _ in range(2):
        run(spark.createDataFrame([("A", "T", 5, 2, 4, False), ("A", "T", 6, 4, 5, False), ("B", "T", 5, None, 6, True), ("C", "T", 5, None, 7, False)], ddl), 1)
        assert [(r["instrumentId"], r["sharesOutstanding"], r["referenceVersion"]) for r in tables.read("instrument", tables.current()).collect()] == [("A", 6, 4)]
        assert sorted((r["seq"], r["reasons"]) for r in spark.read.parquet(str(tmp_path / "rejects")).collect()) == [(2, reference.STALE), (4, reference.STALE), (7, reference.STALE)]
    run(spark.createDataFrame([("B", "T", 5, 3, 8, False)], ddl), 2)  # a tombstone leaves the mark
    assert tables.read("instrument", tables.current()).filter("instrumentId = 'B'").count() == 0


def test_f2_a_record_that_comes_after_very_many_others_is_known(spark, tmp_path):
    own, n = stateful(spark), 120_000
    every = spark.range(n, numPartitions=1).select(F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"), F.lit("k").alias("key"), F.lit(None).cast("binary").alias("value"), F.timestamp_millis(F.lit(0)).alias("timestamp"), F.lit(None).cast(RECORD["headers"].dataType).alias("headers"))
    for rows in (every, every.filter("offset < 10")):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        s = own.readStream.schema(every.schema).parquet(str(tmp_path / "in"))
        archive_stream(s, own.createDataFrame([(1, "E")], "id long, name string"), str(tmp_path / "archive"), str(tmp_path / "dlq"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "archive")).count() == n


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_f14_f3_trades_are_exchanged_for_their_order_alone(spark, no_broadcast):
    """Both sides of the join, no more: copies lie where the join has put them, and are spelled out there."""
    assert exchanges(V.trades_once(spark, SF)) == exchanges(V.trades(spark, SF)) == 2


def test_f9_f8_f10_f12_trades_are_read_once(spark, tmp_path):
    """With ranges too, and trades long after all ticks or before them get what they get without ranges."""
    ddl = "ticker string, bid double, ask double, last double, volume long, event_ms long, seq long"
    ticks = spark.createDataFrame([(t, ms / 7, ms / 5, ms / 6, ms % 9 + 1, ms, ms) for t in "AB" for ms in (5, 95, 96, 350, 351, 790)], ddl)
    rows = [(f"{t}{ms}", t, ms) for t in "ABC" for ms in [*range(0, 1400, 13), 100_000, 123_456]]
    spark.createDataFrame(rows, "tradeId string, ticker string, event_ms long").write.parquet(str(tmp_path / "trades"))
    trades = spark.read.parquet(str(tmp_path / "trades"))
    got = enrichment.as_of(trades, ticks, 60, 100)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [tradeId") == 1
    assert sorted(map(str, got.collect())) == sorted(map(str, enrichment.as_of(trades, ticks, 60).collect()))


def test_f3_positions_write_what_a_batch_adds(spark, tmp_path):
    ddl = "tradeId string, accountId string, traderId string, ticker string, side string, quantity long, price double, event_ms long, seq long"
    tables = Versions(spark, str(tmp_path / "t"), positions.TABLES, compact_after=2)
    for b in range(4):  # with a compaction on the way
        batch = spark.createDataFrame([(f"{b}", "a", "t", "X", "BUY", 10, 2.0, 100 - b, b)], ddl)
        positions.update(tables)(batch, b)
        if b == 1:
            assert [r["grossBuyQuantity"] for p in tables.current()["parts"]["position"] for r in spark.read.parquet(p).collect()] == [10, 10]
        (r,) = positions.snapshots(tables).collect()
        assert (r["netQuantity"], r["lastProcessedTradeId"], r["asOfMs"]) == (10 * (b + 1), "0", 100)


def test_round4_f1_a_trade_of_any_quantity_is_delivered(spark, tmp_path):
    """Returns are negative, a quantity may be missing, and keys below 0 make seq negative; some trades come twice."""
    part = F.col("l_partkey") % 5
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_quantity", F.when(part == 0, -F.col("l_quantity")).when(part > 1, F.col("l_quantity")))
    lines.withColumns({"l_orderkey": F.col("l_orderkey") - 700, "l_linenumber": F.col("l_linenumber") + 3}).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.read.parquet(f"{SF}/orders.parquet").withColumn("o_orderkey", F.col("o_orderkey") - 700).write.parquet(str(tmp_path / "orders.parquet"))
    got, want = (registry.QUERIES[q](spark, str(tmp_path)) for q in ("stream_positions", "positions_snapshot"))
    assert V.trades(spark, str(tmp_path)).filter("pmod(seq, 2) = 1").count() > 0
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_round4_f2_positions_leave_their_tables_and_trade_ids_alone(spark, monkeypatch):
    """What the batches have shuffled and worked off is gone before the result is read."""
    shuffled = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    at, before = [], shuffled()
    monkeypatch.setattr(streams, "folder", lambda s: at.append(registry.folder(s)) or at[0])
    got = streams.stream_positions(spark, SF)
    files, until = Files(spark, at[0]), time.time() + 20
    while (left := shuffled() - before) and time.time() < until:  # they are taken away beside the work
        time.sleep(0.2)
    assert not left and files.names(f"{at[0]}/in/come") == [] and len(files.names(f"{at[0]}/tables/position")) == 2
    assert sorted(map(str, got.collect())) == sorted(map(str, queries.positions_snapshot(spark, SF).select(got.columns).collect()))


def test_f7_trades_meet_their_group_by_account(spark, tmp_path, no_broadcast):
    ddl = "tradeId string, ticker string, side string, traderId string, accountId string, event_ms long"
    trades = spark.createDataFrame([("1", "X", "BUY", "a", "p", 10), ("2", "X", "SELL", "b", "q", 15), ("3", "X", "BUY", "a", "q", 900), ("4", "X", "SELL", "c", "r", 11)], ddl)
    d = related.related_wash_trades(trades, 20, str(tmp_path))
    assert exchanges(d) == 1 and [(r["tradeId"], r["gapMs"], r["sellTradeId"], r["accountId"]) for r in d.collect()] == [("1", 5, "2", "p")]


def test_f6_batches_dont_grow_in_number(spark, monkeypatch):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(old, ("24", "false", "-1"), strict=True):
        spark.conf.set(k, v)
    at = []
    monkeypatch.setattr(checks, "folder", lambda s: at.append(registry.folder(s)) or at[0])
    try:
        checks.stream_enrichment(spark, SF)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len([n for n in Files(spark, at[0]).names(f"{at[0]}/out") if n.startswith("batch=")]) == 4


def test_f13_many_versions_are_not_looked_at_one_by_one(spark):
    rows = spark.range(0, 4000).select(F.col("id").alias("tradeId"), (F.col("id") * 997_001).alias("event_ms"))
    ranges = spark.range(0, 500).select(F.lit("R").alias("ruleId"), F.lit("Q").alias("ruleType"), F.col("id").alias("version"), (F.col("id") * 7_000_000).alias("from_ms"), F.when(F.col("id") < 499, (F.col("id") + 1) * 7_000_000).alias("to_ms"))
    d = risk.in_force(rows, ranges, "Q")
    assert "BroadcastNestedLoopJoin" not in d._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["tradeId"], r["version"]) for r in d.collect()) == [(k, min(499, k * 997_001 // 7_000_000)) for k in range(4000)]


def test_f4_f5_f11_state_is_read_and_written_as_a_whole():
    """However many buckets a ticker holds."""
    calls = []

    class Value:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    class Handle:
        def getValueState(self, *_):
            return Value()

    state = market.MarketState(1, 1000)
    state.init(Handle())
    for k, n in ((0, 50), (50, 51)):
        frame = pd.DataFrame({"seq": range(k, n), "event_ms": [i * 1000 for i in range(k, n)], "offset": range(k, n), "bid": 1.0, "ask": 3.0, "last": 2.0, "volume": 4, "produced_ms": None, "correlationId": None})
        (out,) = state.handleInputRows(("A",), iter([frame]), None)
    assert out["windowBuckets"].tolist() == [51] and len(calls) == 8
