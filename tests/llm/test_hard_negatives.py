"""op11: against brute force, with ties, repeated and odd rows, large values; rows are discarded early."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import hard_negatives as H
from tickloom.llm.topk import scaled

LONG = (1 << 63) - 1


def brute(rows, every=20, k=5):
    good = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    asks = {}
    for i, lab, v in good:
        if i % every == 0:
            asks[i] = min(asks.get(i, (lab, v)), (lab, v))
    out = []
    for a, (lab, u) in asks.items():
        s = sorted((-max(-LONG, min(LONG, sum(x * y for x, y in zip(u, v)))), i, other) for i, other, v in good if i != a and len(v) == len(u))
        for ps, p, _ in [x for x in s if x[2] == lab][:k]:
            hits = [x for x in s if x[2] != lab and 80 * -ps <= 100 * -x[0] <= 100 * -ps][:k]
            out += [(a, p, r, n, -ps, -ns) for r, (ns, n, _) in enumerate(hits, 1)]
    return sorted(out)


def run(spark, rows, every=20, extra=False):
    d = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    d = d.withColumns({"id": F.lit("x"), "v": F.lit(1), "positive": F.lit(2)}) if extra else d
    got = H.hard_negatives(scaled(d.filter("label is not null"), also=("label",)), F.col("id") % every == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("seed,dim", [(0, 16), (1, 3), (2, 1)])
def test_equals_brute_force(spark, seed, dim, monkeypatch):
    monkeypatch.setattr(H, "ROWS", 50)
    monkeypatch.setattr(H, "PAIRS", 70)
    g = np.random.default_rng(seed)
    centres = g.normal(size=(6, dim))
    rows = [(i, int(g.integers(3)), [float(x) for x in np.float32(centres[i % 6] + g.normal(size=dim) * 0.4)]) for i in range(300)]
    rows += [(1000 + i, i % 2, rows[3][2]) for i in range(120)]  # one very common vector
    got = run(spark, rows)
    assert got == brute(rows) and got


def test_odd_rows(spark):
    one = [1.0, 2.0]
    rows = [(0, 1, one), (1, 1, one), (1, 1, one), (2, 2, [0.9, 1.9]), (2, 2, [0.9, 1.9]), (3, 2, [1.0, 1.9]), (4, None, one), (None, 1, one), (5, 1, None), (6, 1, []), (7, 1, [float("nan"), 1.0]), (8, 1, [None, 1.0]), (9, 1, [float("inf"), 0.0]),
            (20, 1, [1.0]), (20, 0, [1.0]), (21, 0, [1.0]), (22, 1, [1.0]), (40, 7, one), (60, 3, [-1.0, 0.0]), (61, 3, [1.0, 0.0]), (80, 4, [0.0, 0.0]), (81, 4, [0.0, 0.0]), (82, 5, [0.0, 0.0])]
    got = run(spark, rows, extra=True)
    want = brute(rows)
    assert got == want and any(r[0] == 80 for r in got) and got.count(got[0]) == 2


def test_large_values(spark):
    rows = [(0, 1, [1e9, -1e9]), (1, 1, [1e9, 1.0]), (2, 2, [9e8, 3.0]), (3, 2, [1e9, 2.0]), (4, 2, [-1e9, 2.0]), (20, 1, [1e16, 1e16]), (21, 2, [1e16, 1e16])]
    assert run(spark, rows) == brute(rows) != []


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, 1, [1.0])]) == [] and run(spark, [(0, 1, [1.0]), (1, 2, [1.0])]) == []


def test_rows_are_discarded_early(spark):
    g = np.random.default_rng(0)
    x = np.floor(g.normal(size=(4000, 32)) * np.r_[[300.0] * 4, [20.0] * 28] @ np.linalg.qr(g.normal(size=(32, 32)))[0])
    d = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "id long, v array<double>")
    axes = H.rotation(d, 32)
    assert np.allclose(axes.T @ axes, np.eye(32)) and ((x @ axes)[:, :4] ** 2).sum() > 0.9 * (x**2).sum()
    labels = np.arange(4000) % 2
    s = H.Search(labels[:40], np.arange(40), x[:40], 5, axes)
    s.run(labels, np.arange(4000), x)
    assert s.verified < 40 * 2000 / 3
    for a in range(40):
        true = sorted((-int(v), i) for i, v in enumerate(x[a] @ x.T) if i != a and i % 2 == a % 2)[:5]
        assert list(zip((-s.best.score[a]).tolist(), s.best.id[a].tolist())) == true
