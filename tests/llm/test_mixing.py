"""op10: the exponent, budgets kept, passes whole, blocks by weight, odd rows."""

import math
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tickloom.llm import mixing as M

DDL = "doc_id long, text string, source string, epoch string"


def corpus(spark):
    rows = [(i, "w " * (1 + i % 9), "big", "x") for i in range(600)] + [(1000 + i, "w " * 5, "mid", "x") for i in range(100)] + [(2000 + i, "w " * 7, "small", "x") for i in range(30)]
    return spark.createDataFrame(rows, DDL).repartition(4)


def test_exponent():
    t = [1000, 100, 10]
    a = M.exponent(t, max_epochs=3)
    w = M.tempered(t, a)
    b = M.whole_budget(t, w)
    assert abs(max(b * x / y for x, y in zip(w, t)) - 3) < 1e-6 and abs(min(b * x / y for x, y in zip(w, t)) - 1) < 1e-9
    a = M.exponent(t, target_entropy=0.9)
    assert abs(M.entropy(M.tempered(t, a)) - 0.9) < 1e-6
    assert M.exponent(t, target_entropy=0.0) == 1.0 and M.exponent(t, target_entropy=math.log(3) + 1) == 0.0 and M.exponent([5, 5], max_epochs=1) in (0.0, 1.0) and M.exponent([], max_epochs=2) in (0.0, 1.0)


@pytest.mark.parametrize("budget", [None, 1000.0])
def test_draws(spark, budget):
    d = corpus(spark)
    got = M.mix(d, budget=budget, n_blocks=4).collect()
    size = {r["source"]: r["n"] for r in d.groupBy("source").agg(F.sum(M.words()).alias("n")).collect()}
    names = sorted(size)
    w = dict(zip(names, M.tempered([size[s] for s in names], M.exponent([size[s] for s in names], 2.0, None, budget))))
    total = budget or M.whole_budget([size[s] for s in names], [w[s] for s in names])
    drawn = Counter()
    for r in got:
        drawn[r["source"]] += r["tokens"]
    for s in names:
        assert abs(drawn[s] - total * w[s]) <= 10
    seen = defaultdict(list)
    for r in got:
        seen[r["doc_id"]].append(r["epoch"])
        assert 0 <= r["position"] <= 1 and 0 <= r["block"] < 4
    assert all(sorted(v) == list(range(len(v))) for v in seen.values()) and max(map(len, seen.values())) <= 2 + (budget is not None)
    if budget is None:
        assert len(seen) == 730
        for k in range(4):
            share = sum(r["tokens"] for r in got if r["block"] == k and r["source"] == "big") / drawn["big"]
            assert 0.15 < share < 0.35
    assert sorted(map(str, got)) == sorted(map(str, M.mix(d.repartition(2), budget=budget, n_blocks=4).collect()))


def test_odd_rows(spark):
    d = spark.createDataFrame([(1, None, "a", "x"), (2, "", "a", "x"), (3, "w w", None, "x"), (3, "w w", None, "x"), (None, "w", "b", "x"), (4, "w " * 50_000, "b", "x")], DDL)
    got = M.mix(d)
    assert Counter(r["doc_id"] for r in got.collect() if r["epoch"] == 0) == {1: 1, 2: 1, 3: 2, None: 1, 4: 1}
    assert M.mix(d.limit(0)).collect() == []


def unit(key, *more):
    """The hash of a row as the engine takes it: each value is hashed with the last hash as its seed."""
    h = xxhash.xxh64_intdigest((0).to_bytes(4, "little"), 42)
    for x in (key, *more):
        raw = x.encode() if isinstance(x, str) else x.to_bytes(8, "little")
        h = xxhash.xxh64_intdigest(raw, h)
    return (h & ((1 << 52) - 1)) / (1 << 52)


@pytest.mark.parametrize("budget", [None, 1000.0, 6000.0])
def test_draws_equal_a_plain_simulation(spark, budget):
    d = corpus(spark)
    docs = [(r["doc_id"], r["source"], len((r["text"] or "").split())) for r in d.collect()]
    names = sorted({s for _, s, _ in docs})
    size = [sum(n for _, s, n in docs if s == name) for name in names]
    w = M.tempered(size, M.exponent(size, 2.0, None, budget))
    total = M.whole_budget(size, w) if budget is None else budget
    want = set()
    for name, t, x in zip(names, size, w):
        own = sorted((unit(i, "cut"), i, n) for i, s, n in docs if s == name)
        epochs = total * x / t
        full = math.floor(epochs + 1e-9)
        want |= {(i, e) for _, i, _ in own for e in range(full)}
        left = round((epochs - full) * t)
        for _, i, n in own:
            if left > 0:
                want.add((i, full))
            left -= n
    got = [(r["doc_id"], r["epoch"]) for r in M.mix(d, budget=budget).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("args", [{"max_epochs": 2.0}, {"max_epochs": 2.0, "budget": 3000.0}, {"target_entropy": 1.0, "max_epochs": None}])
def test_plan_joined_or_broadcast(spark, args, monkeypatch):
    d = corpus(spark)
    want = sorted(map(str, M.mix(d, **args).collect()))
    monkeypatch.setattr(M, "BROADCAST", 0)
    assert sorted(map(str, M.mix(d, **args).collect())) == want


def test_any_number_of_sources(spark):
    n = 120_000
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), F.when(F.col("id") % 3 == 0, "w w").otherwise("")).alias("text"), F.col("id").cast("string").alias("source"))
    got = M.mix(d, max_epochs=3.0).groupBy("tokens").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")).collect()
    assert {r["tokens"]: (r["n"], r["docs"]) for r in got} == {3: (n // 3, n // 3), 1: (3 * (n - n // 3), n - n // 3)}
