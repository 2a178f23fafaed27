"""AGG-6, JN-7, SNK-7, AGG-9, JN-6, WIN-11, JN-10, JN-5: controls over the archive, cases, related accounts, rules while they change."""

import glob
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tests.test_streams import GOOD, archived, come
from tickloom.operators import archive, cases, intervals, manifests, reconciliation, related
from tickloom.streaming import rules
from tickloom.streaming.versions import Versions


@pytest.mark.parametrize("block", [4, 4096])
def test_agg6_jn7_blocks_of_intervals(spark, monkeypatch, block):
    monkeypatch.setattr(intervals, "BLOCK", block)
    r = random.Random(block)
    days = [[("t", p, r.randrange(60)) for p in (0, 1) for _ in range(14)] for _ in range(3)] + [[("t", 0, 200), ("t", 0, -3)]]
    frame = lambda rows: spark.createDataFrame(rows, "topic string, partition int, offset long")
    tables = {}
    for rows in days:
        new = intervals.blocks(frame(rows))
        old = frame([]).selectExpr("topic", "partition", "offset as block", f"cast(array() as {intervals.RUNS}) as runs", "0L as duplicates") if not tables else spark.createDataFrame(list(tables.values()), new.schema)
        tables |= {(x["topic"], x["partition"], x["block"]): x for x in intervals.merged(old, new).collect()}
    of, every = spark.createDataFrame(list(tables.values()), new.schema), frame([x for d in days for x in d])
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    assert same(intervals.coverage(of), archive.coverage(every)) and same(intervals.missing_ranges(of), archive.missing_ranges(every))
    assert same(intervals.coverage(intervals.blocks(every)), archive.coverage(every))


def test_snk7_agg9_signed_manifests(spark, tmp_path):
    key, at = b"secret", str(tmp_path / "archive")
    for k in range(3):
        come(spark, tmp_path / "in", [(p, 10 * k + o, GOOD + bytes([o]), 0) for p in (0, 1) for o in range(4)])
        archived(spark, tmp_path, sign_with=key)
    faults = lambda k=key: sorted((r["batch"], r["fault"]) for r in manifests.verified(spark, at, k).collect())
    assert faults() == [] and faults(b"other") == [(0, "MANIFEST"), (1, "MANIFEST"), (2, "MANIFEST")]
    assert manifests.write_manifest(spark, at, 1, key) == manifests.write_manifest(spark, at, 1, b"another")  # stands once

    files = sorted(glob.glob(f"{at}/batch=1/**/*.parquet", recursive=True))
    held = str(tmp_path / "held")
    shutil.copytree(at, held)
    rows = spark.read.parquet(files[0])
    rows.withColumn("payload", F.when(F.col("offset") == F.lit(rows.agg(F.max("offset")).first()[0]), F.unhex(F.lit("00"))).otherwise(F.col("payload"))).coalesce(1).write.parquet(str(tmp_path / "bad"))
    shutil.copy(glob.glob(str(tmp_path / "bad/*.parquet"))[0], files[0])
    for crc in glob.glob(f"{os.path.dirname(files[0])}/.*.crc"):
        os.remove(crc)
    (fault,) = manifests.verified(spark, at, key).collect()
    assert (fault["batch"], fault["file"], fault["fault"]) == (1, os.path.basename(files[0]), "CHANGED")
    os.remove(files[0])
    shutil.copy(glob.glob(str(tmp_path / "bad/*.parquet"))[0], f"{os.path.dirname(files[0])}/more.parquet")
    spark.catalog.clearCache()
    assert faults() == [(1, "MISSING"), (1, "UNKNOWN")]
    shutil.rmtree(at)
    shutil.copytree(held, at)
    os.remove(f"{at}-manifests/{1:012d}.json")  # a batch whose manifest is left out breaks what comes after
    assert faults() == [(2, "MANIFEST")]


def test_jn6_in_flight_then_missing(spark):
    side = lambda rows: spark.createDataFrame(rows, "referenceId string, amount double, state string, seen_ms long")
    one, two = side([("a", 1.0, "S", 100), ("b", 1.0, "S", 100), ("c", 1.0, "S", 400)]), side([("b", 1.0, "S", 250), ("d", 2.0, "S", 100)])
    at = lambda now: {r["referenceId"]: (r["observationType"], r["completeness"], r["participantsObserved"]) for r in reconciliation.observations(one, two, 1.0, now, 100).collect()}
    flying, gone = ("TIMING_UNCERTAINTY", "INCOMPLETE_EXPECTED", 1), ("MISSING_PARTICIPANT", "INCOMPLETE_UNKNOWN", 1)
    assert at(99) == {} and at(200) == {"a": flying, "b": flying, "d": flying} and at(201) == {"a": gone, "b": gone, "d": gone}
    assert at(450) == {"a": gone, "d": gone, "c": flying} and at(1000) == {"a": gone, "d": gone, "c": gone}


@pytest.mark.parametrize("span,rows", [(1, 1), (40, 3), (10**9, 1024)])
def test_win11_states_as_a_fold(spark, span, rows):
    r = random.Random(rows)
    events = [(f"C{r.randrange(4)}", r.choice([*cases.STATES[1:], "OPEN"]), r.randrange(100), k) for k in range(160)] + [("N", "CLOSED", 1, 500)]
    want = {}
    for c, s, *_ in sorted(events, key=lambda e: (e[2], e[3])):
        now, n, bad = want.get(c, ("", 0, 0))
        legal = s == "OPEN" if not now else f"{now}>{s}" in cases.LEGAL
        want[c] = (s if legal else now, n + 1, bad + (not legal))
    got = cases.case_states(spark.createDataFrame(events, "caseId string, state string, event_ms long, seq long"), span, rows)
    assert {x["caseId"]: (x["state"], x["n_events"], x["n_illegal"]) for x in got.collect()} == want and want["N"] == ("", 1, 1)


def test_jn10_related_accounts(spark, tmp_path):
    r = random.Random(2)
    links = [(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(28)] + [(f"c{k:02d}", f"c{k + 1:02d}") for k in range(60)]  # a long chain
    r.shuffle(links)
    least = {n: n for x in links for n in x}
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    got = related.groups(spark.createDataFrame(links, "a string, b string"), str(tmp_path / "rounds"))
    assert {x["node"]: x["grp"] for x in got.collect()} == least
    trades = [(f"x{k:03d}", f"t{r.randrange(6)}", f"a{r.randrange(9)}", r.choice("XY"), r.choice(["BUY", "SELL"]), r.randrange(300)) for k in range(90)]
    trades += [("far", "t0", "a0", "X", "BUY", -50), ("edge", "t7", "own", "Z", "SELL", 0), ("hit", "t8", "own", "Z", "BUY", 20), ("miss", "t8", "own", "Z", "BUY", 21), ("tie", "t8", "own", "Z", "BUY", -20)]
    grp, of = {}, lambda t: [f"trader:{t[1]}", f"account:{t[2]}"]
    for _ in range(20):
        for t in trades:
            g = min(grp.get(n, n) for n in of(t))
            grp |= dict.fromkeys(of(t), g)
    want = {}
    for b in [t for t in trades if t[4] == "BUY"]:
        near = sorted((abs(s[5] - b[5]), s[5] > b[5] or (s[5] == b[5] and s[0] > b[0]), s[0]) for s in trades if s[4] == "SELL" and s[3] == b[3] and grp[of(s)[0]] == grp[of(b)[0]])
        if near and near[0][0] <= 20:
            want[b[0]] = near[0][0]
    d = spark.createDataFrame(trades, "tradeId string, traderId string, accountId string, ticker string, side string, event_ms long")
    assert {x["tradeId"]: x["gapMs"] for x in related.related_wash_trades(d, 20, str(tmp_path / "more")).collect()} == want
    assert "hit" in want and "tie" in want and "miss" not in want


def test_jn5_trades_ahead_of_the_rules_wait(spark, tmp_path):
    ddl = "ruleId string, ruleType string, version long, state string, makerSubject string, checkerSubject string, threshold double, effective_ms long"
    rule = lambda v, at, threshold, rid="R": (rid, "Q", v, "ACTIVE", "m", "c", threshold, at)
    known, held = rules.rule_tables(spark, str(tmp_path / "rules")), Versions(spark, str(tmp_path / "held"), rules.HELD_TABLES)
    decide = lambda t, ranges: t.join(F.broadcast(ranges), (F.col("event_ms") >= F.col("from_ms")) & (F.col("to_ms").isNull() | (F.col("event_ms") < F.col("to_ms")))).filter("quantity > threshold").select("tradeId", "version")
    run, learn = rules.alert_batch(known, held, str(tmp_path / "out"), decide), rules.keep_rules(known)
    trades = lambda rows: spark.createDataFrame(rows, "tradeId string, event_ms long, quantity long")
    alerts = lambda: sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("tradeId", "version").collect()))
    run(trades([("early", 10, 9)]), 0)  # no rules yet
    learn(spark.createDataFrame([rule(1, 0, 5.0), rule(2, 100, 8.0)], ddl), 0)
    run(trades([("a", 50, 6), ("b", 100, 6), ("c", 150, 9)]), 1)
    assert alerts() == [("a", 1), ("early", 1)]
    learn(spark.createDataFrame([rule(3, 120, 10.0), rule(None, 200, None, None)], ddl), 1)
    run(trades([("a", 50, 6), ("b", 100, 6), ("c", 150, 9)]), 1)  # run again: it meets the rules of its first run
    assert alerts() == [("a", 1), ("early", 1)]
    run(trades([("d", 110, 9), ("e", 150, 11), ("f", 500, 99)]), 2)  # c meets version 3 now, f waits
    assert alerts() == [("a", 1), ("d", 2), ("e", 3), ("early", 1)]
    assert [x["tradeId"] for x in held.read("trade", held.current()).collect()] == ["f"]
