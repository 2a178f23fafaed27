"""op7: held-out accuracy, what is learned from, odd rows."""

import random
import zlib

import numpy as np

from pyspark.sql import functions as F

from tickloom.llm import toxicity as T

BAD = ["vilex", "grotz", "plonk"]


def corpus(spark, n=1500):
    r = random.Random(1)
    word = lambda: "".join(r.choice("aeioutnrs") for _ in range(r.randrange(2, 7)))
    docs, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        words = [word() for _ in range(r.randrange(5, 80))]
        if toxic:
            words[r.randrange(len(words))] = r.choice(BAD)
        docs.append((i, " ".join(words), "en"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    model = T.learn(docs, labels)
    assert len(model[0]) < 2000
    got = T.score(docs.drop("score"), model).join(labels, "doc_id").withColumn("h", T.held_out()).collect()
    held = [r for r in got if r["h"]]
    assert {r["doc_id"] for r in held} == {i for i in range(1500) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum((r["score"] >= T.THRESHOLD) == (r["toxic"] == 1) for r in held) / len(held) > 0.95
    kept = T.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id % 6 <> 0").count() > 1230 and kept.filter("doc_id % 6 = 0").count() < 20


def test_held_out_labels_are_never_read(spark):
    docs, labels = corpus(spark, 400)
    turned = labels.withColumn("toxic", F.when(T.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = T.learn(docs, labels), T.learn(docs, turned)
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist() and a[2] == b[2]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (1, "x " * 30_000), (1, "x " * 30_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = T.learn(docs, labels)
    rows = T.score(docs, model).collect()
    assert len(rows) == 5 and all(r["score"] == 0.0 for r in rows)
    labelled = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    assert all(0 <= r["score"] <= 1 for r in T.score(docs, T.learn(docs, labelled)).collect())
    assert T.reject_toxic(docs.limit(0), labels).collect() == []


def plain_fit(rows, labels, passes):
    """FTRL-proximal one coordinate at a time."""
    z, n, bias = {}, {}, T.DIMS

    def weight(i):
        s, l1 = z.get(i, 0.0), 0.0 if i == bias else T.L1
        return 0.0 if abs(s) <= l1 else ((1 if s > 0 else -1) * l1 - s) / ((T.BETA + n.get(i, 0.0) ** 0.5) / T.ALPHA + T.L2)

    for _ in range(passes):
        for x, y in zip(rows, labels):
            w = {i: weight(i) for i in [*x, bias]}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in w:
                rate = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / T.ALPHA
                z[i] = z.get(i, 0.0) + g - rate * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if i != bias and weight(i)}, weight(bias)


def test_fit_equals_one_coordinate_at_a_time():
    r = random.Random(2)
    rows = [sorted(r.sample(range(40), r.randrange(0, 12))) for _ in range(300)]
    labels = np.array([int(3 in x or (5 in x and r.random() < 0.9)) for x in rows])
    w, b = T.fit([np.array(x, np.int64) for x in rows], labels, 6)
    want, bias = plain_fit(rows, labels.tolist(), 6)
    assert set(np.flatnonzero(w).tolist()) == set(want) and want and abs(b - bias) < 1e-9
    assert all(abs(w[i] - v) < 1e-9 for i, v in want.items())


def test_copies_of_a_labelled_row_change_nothing(spark):
    """A doc_id is learned from once, however many rows it has."""
    docs, labels = corpus(spark, 200)
    many = docs.unionByName(docs.filter("doc_id < 6").crossJoin(spark.range(50)).drop("id"))
    a, b = T.learn(docs, labels), T.learn(many, labels)
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist() and a[2] == b[2]
