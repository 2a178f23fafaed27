"""SNK-5, JN-1, JN-3, SNK-4, WIN-8, AGG-7, STR-4, STR-12: tables that streams keep, over batches and restarts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tickloom.operators import positions as P
from tickloom.streaming import enrichment, market, positions, rebuild, reference
from tickloom.streaming.session import stateful
from tickloom.streaming.versions import GONE, Versions

TICK_DDL = "ticker string, bid double, ask double, last double, volume long, event_ms long, offset long, seq long"


def test_versions_appear_whole_and_once(spark, tmp_path):
    t = Versions(spark, str(tmp_path / "v"), {"a": ["k"], "b": ["k"]}, compact_after=3, keep=2)
    rows = lambda xs: spark.createDataFrame(xs, f"k string, n int, {GONE} boolean")
    assert t.current() is None and t.read("a", t.current()) is None
    want, r = {}, random.Random(1)
    for batch in range(9):
        change = {f"k{k}": (batch, r.random() < 0.3) for k in r.sample(range(6), 3)}
        before = t.current()
        assert t.publish(batch, {"a": rows([(k, n, g) for k, (n, g) in change.items()]), "b": rows([("all", batch, False)])})
        assert not t.publish(batch, {"a": rows([("k0", -1, False)]), "b": rows([])})  # run again
        for k, (n, g) in change.items():
            want.pop(k, None)
            if not g:
                want[k] = n
        now = t.current()
        assert dict(map(tuple, t.read("a", now).collect())) == want and [x["n"] for x in t.read("b", now).collect()] == [batch]
        if before:  # who has begun to read the version before goes on with it
            assert [x["n"] for x in t.read("b", before).collect()] == [batch - 1]
        assert len(now["parts"]["a"]) <= 3 and t.current(before=batch) == before
    assert len(t.files.names(str(tmp_path / "v/versions"))) == 2
    assert len(t.files.names(str(tmp_path / "v/a"))) <= 5


def feed(spark, at, rows, ddl):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(at))
    return stateful(spark).readStream.schema(ddl).parquet(str(at))


def test_snk5_jn1_jn3_trades_meet_the_market_of_their_batch(spark, tmp_path):
    tables = market.market_tables(stateful(spark), str(tmp_path / "state"))
    instruments = spark.createDataFrame([("I1", "A", 100), ("I2", "B", 100)], "instrumentId string, ticker string, sharesOutstanding long")
    got = []
    trade = lambda i, ticker: (i, ticker, 10.0, 5_000, 5_000)
    run = lambda rows: enrichment.enrichment_stream(feed(spark, tmp_path / "trades", rows, "tradeId string, ticker string, price double, event_ms long, produced_ms long"), lambda: market.market_now(tables), lambda: instruments, str(tmp_path / "out"), str(tmp_path / "misses"), str(tmp_path / "cp-trades")).awaitTermination()
    ticks = lambda rows, **kw: market.market_stream(feed(spark, tmp_path / "ticks", rows, TICK_DDL), tables, str(tmp_path / "cp-ticks"), **kw).awaitTermination()
    run([trade("before", "A")])
    ticks([("A", 1.0, 3.0, 2.0, 10, 1_000, 1, 1), ("A", 2.0, 4.0, 3.0, 30, 2_000, 2, 2)])
    run([trade("first", "A"), trade("unknown", "C")])
    ticks([("A", 5.0, 7.0, 6.0, 40, 301_000, 3, 3), ("A", 9.0, 9.0, 9.0, 20, 500, 4, 4), ("B", 1.0, 1.0, 1.0, 0, 500, 5, 5)])
    run([trade("second", "A"), trade("no volume", "B")])
    got = {r["tradeId"]: (r["mid"], r["tick_ms"], r["vwap5Min"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # By then the second state has 40 at 6.0 in its horizon; the older buckets are outside of it.
    assert got == {"first": (3.0, 2_000, 2.75), "second": (6.0, 301_000, 6.0), "no volume": (1.0, 500, None)}
    assert sorted(r["tradeId"] for r in spark.read.parquet(str(tmp_path / "misses")).collect()) == ["before", "unknown"]
    assert not spark.sparkContext._jsc.getPersistentRDDs() and spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_str4_window_expires_alone(spark, tmp_path):
    tables = market.market_tables(stateful(spark), str(tmp_path / "state"))
    run = lambda rows: market.market_stream(feed(spark, tmp_path / "ticks", rows, TICK_DDL), tables, str(tmp_path / "cp"), str(tmp_path / "out"), ttl_ms=1500).awaitTermination()
    run([("A", 1.0, 3.0, 2.0, 10, 1_000, 7, 1)])
    assert market.market_now(tables, now_ms=0).first()["vwap"] == 2.0
    time.sleep(2)
    assert market.market_now(tables).first()["vwap"] is None and market.market_now(tables).first()["bid"] == 1.0
    run([("A", 1.0, 3.0, 4.0, 10, 1_000, 7, 2)])  # the offset guard has gone with the window, the latest tick hasn't
    (r,) = spark.read.parquet(str(tmp_path / "out")).filter("seq = 2").collect()
    assert (r["outcome"], r["windowApplied"], r["windowBuckets"]) == ("DUPLICATE", True, 1)
    now = market.market_now(tables, now_ms=0).first()
    assert (now["vwap"], now["last"]) == (4.0, 2.0)


def test_snk4_version_guard_over_restarts(spark, tmp_path):
    r, own = random.Random(4), stateful(spark)
    ddl = "instrumentId string, ticker string, sharesOutstanding long, referenceVersion long, seq long, deleted boolean"
    tables, high, want, stale, seq = Versions(own, str(tmp_path / "t"), reference.TABLES), {}, {}, [], 0
    for _ in range(3):
        rows = []
        for _ in range(12):
            i, v, seq = f"I{r.randrange(3)}", r.randrange(-1, 9), seq + 1
            gone, bad = r.random() < 0.15, r.random() < 0.15
            rows.append((i, " " if bad else "T", 5, None if gone else v, seq, gone))
            if gone:
                want.pop(i, None)
            elif bad:
                stale.append((seq, "BLANK_TICKER"))
            elif v <= max(0, high.get(i, 0)):
                stale.append((seq, reference.STALE))
            else:
                high[i] = want[i] = v
        reference.reference_stream(feed(spark, tmp_path / "in", rows, ddl), tables, str(tmp_path / "rejects"), str(tmp_path / "cp"), "us").awaitTermination()
        assert {x["instrumentId"]: (x["referenceVersion"], x["producerIdentity"]) for x in tables.read("instrument", tables.current()).collect()} == {i: (v, "us") for i, v in want.items()}
    assert sorted((x["seq"], x["reasons"]) for x in spark.read.parquet(str(tmp_path / "rejects")).collect()) == stale


def test_agg7_redelivery_changes_nothing(spark, tmp_path):
    r, every, tables = random.Random(7), [], Versions(stateful(spark), str(tmp_path / "t"), positions.TABLES, compact_after=2)
    ddl = "tradeId string, accountId string, traderId string, ticker string, side string, quantity long, price double, event_ms long, seq long"
    for b in range(4):
        rows = [(f"{b}-{k}", "a", f"t{k % 2}", "X", r.choice(["BUY", "SELL"]), r.randrange(9), 2.5, r.randrange(50), b * 100 + k) for k in range(10)]
        rows += [(*x[:-1], x[-1] + 1000) for x in r.sample(every, min(5, len(every)))]
        every += rows
        positions.position_stream(feed(spark, tmp_path / "in", rows, ddl), tables, str(tmp_path / "cp")).awaitTermination()
        want = P.positions(spark.createDataFrame(every, ddl))
        got = positions.snapshots(tables)
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    positions.update(tables)(spark.createDataFrame(every, ddl), 3)  # a batch that is run again
    assert sorted(map(tuple, positions.snapshots(tables).collect())) == sorted(map(tuple, want.collect()))


def test_str12_readers_see_one_generation(spark, tmp_path):
    g = rebuild.Generations(spark, str(tmp_path / "g"), {"a": ["k"]})
    fill = lambda n: lambda tables, cp: tables.publish(0, {"a": spark.range(1).select(F.lit("k").alias("k"), F.lit(n).alias("n"))})
    assert g.number() == -1 and g.rebuild(fill(1)) == 0

    def fails(tables, cp):
        fill(2)(tables, cp)
        assert g.tables().read("a", g.tables().current()).first()["n"] == 1  # while it is being rebuilt
        raise OSError

    with pytest.raises(OSError):
        g.rebuild(fails)
    assert g.number() == 0 and g.rebuild(lambda tables, cp: None) == 1  # taken up where it stopped
    assert g.tables().read("a", g.tables().current()).first()["n"] == 2 and g.checkpoint(0) != g.checkpoint(1)
    g.drop_before(1)
    assert g.files.names(str(tmp_path / "g")) == ["finished", "generation-1"]


def test_str7_bad_ticks_never_reach_the_state(spark, tmp_path):
    tables, nan = market.market_tables(stateful(spark), str(tmp_path / "state")), float("nan")
    for rows in ([("A", 1.0, 3.0, 2.0, 10, 1_000, 1, 1), ("A", nan, 3.0, 2.0, 10, 2_000, 2, 2)], [("A", 1.0, 3.0, 9.0, -5, 3_000, 3, 3), ("A", 2.0, 2.0, 2.0, 10, 3_500, 4, 4), ("B", 1.0, 1.0, 1.0, 1, 9_000_000, 5, 5)]):
        good, bad = market.valid(feed(spark, tmp_path / "in", rows, TICK_DDL), F.lit(4_000))
        market.market_stream(good, tables, str(tmp_path / "cp")).awaitTermination()
        market.quarantine_stream(bad, str(tmp_path / "bad"), str(tmp_path / "cp-bad")).awaitTermination()
    assert [(r["ticker"], r["event_ms"], r["vwap"]) for r in market.market_now(tables).collect()] == [("A", 3_500, 2.0)]
    assert sorted((r["seq"], *r["reasons"]) for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == [(2, "PRICE_NOT_FINITE"), (3, "NEGATIVE_VOLUME"), (5, "FUTURE_EVENT")]


def test_str8_jn1_misses_are_tried_again(spark, tmp_path):
    """B is known from the second attempt on, C never; A isn't tried again."""
    asked = []

    def state():
        asked.append(1)
        known = [("A", 1.0, 3.0, len(asked))] + [("B", 2.0, 4.0, len(asked))] * (len(asked) > 1)
        return spark.createDataFrame(known, "ticker string, bid double, ask double, event_ms long")

    instruments = spark.createDataFrame([(f"I{t}", t, 100) for t in "ABC"], "instrumentId string, ticker string, sharesOutstanding long")
    trades = spark.createDataFrame([(t, t, 10.0, 5_000, 5_000) for t in "ABC"], "tradeId string, ticker string, price double, event_ms long, produced_ms long")
    run = enrichment.enrich_batch(state, lambda: instruments, str(tmp_path / "out"), str(tmp_path / "misses"), str(tmp_path / "attempts"), first_s=0.01)
    for _ in range(2):  # a batch that is run again asks for nothing
        run(trades, 0)
        assert len(asked) == 3
        assert sorted((r["tradeId"], r["mid"], r["tick_ms"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("A", 2.0, 1), ("B", 3.0, 2)]
        assert [(r["tradeId"], r["failure"], r["retryCount"]) for r in spark.read.parquet(str(tmp_path / "misses")).collect()] == [("C", "REFERENCE_DATA_UNAVAILABLE", 3)]
