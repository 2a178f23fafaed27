"""op2: against brute force, with ties, odd vectors and large values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import topk as T

DDL = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, u in {(i, tuple(v)) for i, v in good if i % 50 == 0}:
        s = sorted((-sum(a * b for a, b in zip(u, v)), i) for i, v in good if i != q and len(v) == len(u))[:k]
        out[q] = [(i, -x) for x, i in s]
    return out


def run(spark, rows, k=5):
    d = spark.createDataFrame([(i, v, 0) for i, v in rows], DDL).repartition(3)
    out: dict = {}
    for r in T.top_k(T.scaled(d), F.col("id") % 50 == 0, k).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("seed,leaf", [(0, 128), (1, 4), (2, 16)])
def test_equals_brute_force(spark, seed, leaf, monkeypatch):
    monkeypatch.setattr(T, "LEAF", leaf)
    g = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.float32(g.normal(size=6) * (0.1 + (i % 7)))]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(120)]  # one very common vector
    assert run(spark, rows) == {q: s for q, s in brute(rows).items()}


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0]), (1, None), (2, []), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, [-0.001, 0.5]), (6, [-0.001, 0.5]), (None, [1.0, 1.0]), (0, [1.0, 2.0]), (7, [1e15, -1e15])]
    got = run(spark, rows)
    assert got == {0: [(6, 65280), (6, 65280), (7, -(1 << 63))]} and 50 not in got


def test_branches_are_cut():
    g = np.random.default_rng(0)
    x = np.floor(g.normal(size=(4096, 3)) * 256)
    search = T.Search(np.arange(4096, 4100), x[:4].copy(), 5)
    search.run(T.BallTree(np.arange(4096), x, 64))
    assert search.leaves < 4096 / 64 * 4 / 3


def test_empty(spark):
    assert run(spark, []) == {}
