"""op12: against a plain version, with hot clients in pieces, odd rows, repeated rows, and no shuffle before the cells."""

import datetime as dt
import math
import random
import zlib

import pytest

from tickloom.llm import cohorts as C

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
CLIENTS = "client_id long, segment string"
EPOCH = dt.datetime(1970, 1, 1)


def us(t):
    return (t - EPOCH) // dt.timedelta(microseconds=1)


def crc(x):
    return zlib.crc32(str(x).encode())


def brute(clicks, clients):
    rows = {tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in clicks if r[1] is not None and r[3] is not None}
    seg = {}
    for c, s in clients:
        if s is not None:
            seg[c] = min(s, seg.get(c, s))
    cut, day = us(dt.datetime(2024, 2, 15)), 86_400_000_000
    known = {0: [], 1: []}
    for r in rows:
        late = crc(r[0]) % 100 * day if r[0] is not None and crc(r[0]) % 3 == 0 else 0
        known[1].append(r)
        if r[2] is not None and us(r[2]) + late < cut:
            known[0].append(r)
    start = {s: {} for s in known}
    for s, rs in known.items():
        for r in rs:
            if r[4] == "signup":
                start[s][r[3]] = min(us(r[1]), start[s].get(r[3], us(r[1])))
    cells = {}
    for s, rs in known.items():
        for r in rs:
            c = r[3]
            if c in start[s] and us(r[1]) >= start[s][c]:
                cell = cells.setdefault((s, seg.get(c, ""), start[s][c] // day, (us(r[1]) - start[s][c]) // day), [set(), 0])
                cell[0].add(c)
                v = r[5]
                cell[1] += 0 if v is None or v == "nan" or math.isinf(v) or abs(100 * v) > 9.2e18 else math.floor(100 * v + 0.5)
    moved = {c for c in start[0] if start[0][c] // day != start[1][c] // day}
    return sorted((*k, len(cs), sum(map(crc, cs)), len(cs & moved), cents) for k, (cs, cents) in cells.items())


def run(spark, clicks, clients, least=C.LEAST, extra=False):
    d = spark.createDataFrame(clicks, CLICKS).repartition(3)
    if extra:
        d = d.selectExpr("*", "1 as piece", "'x' as split", "rand() as segment")
    out = C.retention(d, spark.createDataFrame(clients, CLIENTS), least=least)
    assert out.columns == ["state", "segment", "cohort", "period", "users", "users_crc32", "moved", "cents"]
    return sorted(map(tuple, out.collect()))


def invented(seed, n=600):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        t = dt.datetime(2024, 2, r.randrange(8, 20), r.randrange(24), r.randrange(60), 1, r.choice([0, 1, 999_999]))
        c = 7 if r.random() < 0.35 else r.randrange(25)
        rows.append((i, t, t + dt.timedelta(seconds=r.randrange(90)), c, r.choice(["signup", "view", "view", None]), r.choice([None, 1.005, 2.5, -0.0, 0.0, 12.345, -3.7]), r.choice([None, "", "{}"])))
    rows += r.choices(rows, k=60)
    return rows


@pytest.mark.parametrize("seed,least", [(0, 1000), (1, 20), (2, 1)])
def test_equals_brute_force(spark, seed, least):
    clicks = invented(seed)
    assert run(spark, clicks, [(c, ["a", "b", None][c % 3]) for c in range(20)], least) == brute(clicks, [(c, ["a", "b", None][c % 3]) for c in range(20)])


def test_odd_rows(spark):
    t = dt.datetime(2024, 2, 1)
    row = lambda i, ts=t, at=t, c=1, k="view", v=1.0, p="x": (i, ts, at, c, k, v, p)
    clicks = [row(1, k="signup"), row(1, k="signup"), row(1, k="signup", p=None), row(1, k="signup", p=""), row(2, v=float("nan")), row(2, v=float("nan")), row(3, v=float("inf")), row(4, v=1e300), row(5, v=None), row(5, v=0.0), row(5, v=-0.0),
              row(None), row(6, at=None), row(7, ts=None), row(8, c=None), row(9, ts=dt.datetime(1960, 1, 1, 3), c=2, k="signup"), row(10, c=3), row(11, ts=t - dt.timedelta(microseconds=1)), row(12, ts=t + dt.timedelta(days=1)), row(13, p="y" * 300_000)]
    clicks += [row(100, c=4, k="signup")] * 50  # one row makes a client hot
    clients = [(1, "b"), (1, "a"), (1, None), (2, None), (None, "z"), (5, "q")]
    for least in (1000, 2):
        assert run(spark, clicks, clients, least, extra=True) == brute(clicks, clients)


def test_empty(spark):
    assert run(spark, [], []) == [] and run(spark, [], [(1, "a")]) == []
    assert [r[:5] for r in run(spark, [(1, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1), 1, "signup", None, None)], [])] == [(0, "", 19723, 0, 1), (1, "", 19723, 0, 1)] or crc(1) % 3 == 0


def test_joins_need_no_shuffle_and_tables_go(spark):
    used = C.usable(spark.createDataFrame(invented(3), CLICKS))
    split = C.split_clients(used, 4, 20)
    assert 0 < split.count() <= 16
    tables = C.Tables(spark, 4)
    one = lambda d: C.in_pieces(d, split)
    clicked = tables(one(used).selectExpr("client_id", "piece", "true as split", "us", "early", "cents"), "clicks")
    started, segments = tables(one(C.starts(used)), "starts"), tables(one(used.selectExpr("client_id", "'a' as segment").distinct()), "clients")
    plan = C.partial_cells(clicked, started, segments)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan and "HashAggregate" in plan
    tables.drop()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("cohorts_")]
