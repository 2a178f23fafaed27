"""WIN-1..5, AGG-1..3, VAL-1..3, STR-11: goldens and a sequential simulation."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions.validation import split, tick_reasons
from tickloom.operators import market_state as M

B = 1_740_000_000_000
DDL = "ticker string, bid double, ask double, last double, volume long, event_ms long, offset long, seq long"


def ticks(spark, rows, ticker="RELIANCE"):
    return spark.createDataFrame([(ticker, p - 0.5, p + 0.5, p, v, ts, o, i) for i, (ts, p, v, o) in enumerate(rows)], DDL)


def simulate(rows, bucket_s=10, retain_s=300):
    """The rules one tick at a time."""
    newest = top = None
    buckets, out = {}, []
    for ts, p, v, o in rows:
        outcome = "APPLIED" if newest is None or ts > newest else "DUPLICATE" if ts == newest else "OLDER"
        newest = ts if outcome == "APPLIED" else newest
        added = top is None or o > top
        if added:
            top = o
            b = ts // (bucket_s * 1000) * bucket_s
            pv, w = buckets.get(b, (0.0, 0.0))
            buckets[b] = (pv + p * v, w + v)
            for x in [x for x in buckets if x < b - retain_s]:
                del buckets[x]
        out.append((outcome, added, len(buckets)))
    return out, buckets


GOLDEN = [
    ([(B, 101.5, 10, 1)], ["APPLIED"], 101.5),
    ([(B, 101.5, 10, 1), (B + 1000, 102.5, 10, 2)], ["APPLIED", "APPLIED"], 102.5),
    ([(B, 101.5, 10, 1), (B, 999.0, 10, 2)], ["APPLIED", "DUPLICATE"], 101.5),
    ([(B + 1000, 102.5, 10, 1), (B, 101.5, 10, 2)], ["APPLIED", "OLDER"], 102.5),
]


@pytest.mark.parametrize("rows,outcomes,last", GOLDEN)
def test_win1_win2_outcomes_and_latest(spark, rows, outcomes, last):
    t = ticks(spark, rows)
    assert [r.outcome for r in M.outcomes(t).orderBy("seq").collect()] == outcomes
    assert M.latest(t).first()["last"] == last


def test_win3_win4_volume_is_guarded_by_offset_alone(spark):
    same = [(B, 100.0, 3, 7), (B, 100.0, 3, 7)]
    assert M.window_buckets(ticks(spark, same)).collect()[0]["v"] == 3
    late = [(B, 100.0, 3, 1), (B, 100.0, 4, 2)]
    row = M.window_buckets(ticks(spark, late)).first()
    assert (row["bucket"], row["v"]) == (1740000000, 7)


def test_win5_old_buckets_go(spark):
    rows = M.window_buckets(ticks(spark, [(B, 100.0, 3, 1), (B + 360_000, 110.0, 2, 2)])).collect()
    assert [r["bucket"] for r in rows] == [1740000360]
    dense = [(B + i * 1000, 1.0, 1, i) for i in range(2000)]
    assert M.window_buckets(ticks(spark, dense)).count() == 31
    assert M.vwap(M.window_buckets(ticks(spark, dense))).first()["n_buckets"] == 30


def test_win4_negative_times_round_down(spark):
    assert M.window_buckets(ticks(spark, [(-1, 1.0, 1, 1)])).first()["bucket"] == -10


def test_agg3_no_volume_gives_null(spark):
    assert M.vwap(M.window_buckets(ticks(spark, [(B, 5.0, 0, 1)]))).first()["vwap"] is None


@pytest.mark.parametrize("span", [None, 7])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_closed_form_equals_simulation(spark, seed, span):
    r = random.Random(seed)
    rows = [(r.randrange(-400_000, 900_000), float(r.randrange(1, 50)), r.randrange(5), r.randrange(120)) for _ in range(150)]
    want, buckets = simulate(rows)
    t = ticks(spark, rows)
    got = M.accepted(M.outcomes(t, span), span).orderBy("seq").collect()
    assert [(x["outcome"], x["accepted"]) for x in got] == [(a, b) for a, b, _ in want]
    assert {x["bucket"]: (x["pv"], x["v"]) for x in M.window_buckets(t, span=span).collect()} == buckets


def test_val1_val2_val3_reasons(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1.0, 1, 0), (nan, 1, 0), (inf, 1, 0), (-inf, 1, 0), (1.0, -1, 0), (1.0, 0, 0), (1.0, 1, 3_600_000), (1.0, 1, 3_600_001)]
    d = spark.createDataFrame([(p, p, p, v, ms) for p, v, ms in rows], "bid double, ask double, last double, volume long, event_ms long")
    got = [list(r["r"]) for r in d.select(tick_reasons(F.lit(0)).alias("r")).collect()]
    assert got == [[], ["PRICE_NOT_FINITE"], ["PRICE_NOT_FINITE"], ["PRICE_NOT_FINITE"], ["NEGATIVE_VOLUME"], [], [], ["FUTURE_EVENT"]]
    good, bad = split(d, tick_reasons(F.lit(0)))
    assert (good.count(), bad.count()) == (3, 5)


def test_agg5_counters(spark):
    t = ticks(spark, [(5000, 1.0, 1, 1), (5000, 1.0, 1, 2), (4000, 1.0, 1, 3), (3000, 1.0, 1, 3)])
    assert tuple(M.outcome_counts(t).first()) == (1, 1, 2, 1)
    assert M.freshness(t, F.lit(7000)).first()["age_seconds"] == 2.0
