"""Every operator that keeps the caller's columns, with columns of its internal names, dotted ones and others."""

import pytest
from pyspark.sql import functions as F

from tickloom.llm import bpe, chunk_dedup, exact_dedup, mixing, near_dedup, sharding, suffix_dedup, toxicity

NAMES = [
    "_digest", "_kept", "_keep_id", "_found", "_n", "_ties", "digest", "id", "found", "keep_id", "group_size", "ties", "kept", "at", "first", "a.b", "x`y", "tokens", "cut", "cell", "key", "_source", "epochs", "edge",
    "had", "rest", "full", "block", "epoch", "position", "_t", "_text", "_spans", "spans", "t", "n", "th", "score", "shard", "slot", "c", "a", "b", "s", "o", "end", "times", "low", "high", "off", "rank", "row", "node", "ids", "round_trip", "_near",
]


def docs(spark):
    texts = ["one two three four five six", "one two three four five six", "another text of five words and more", None, ""]
    rows = [(i, t, "s", *(f"{i}/{k}" for k in range(len(NAMES)))) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join("`" + n.replace("`", "``") + "` string" for n in NAMES))


def check(d, out, added=(), texts=True):
    """The caller's columns come back with their values, but for those that are replaced."""
    assert out.columns == [c for c in d.columns if c not in added] + list(added)
    here = [F.col("`" + c.replace("`", "``") + "`") for c in d.columns if c not in added and (texts or c != "text")]
    had = {r["doc_id"]: r for r in d.select(here).collect()}
    got = out.select(here).collect()
    assert got and all(r == had[r["doc_id"]] for r in got)
    return len({r["doc_id"] for r in got})


def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, toxic int")


CASES = {
    "exact_dedup": lambda d: (exact_dedup.exact_dedup(d), (), 3),
    "near_dedup": lambda d: (near_dedup.near_dedup(d), (), 4),
    "mix": lambda d: (mixing.mix(d), ("tokens", "epoch", "position", "block"), 5),
    "suffix_dedup": lambda d: (suffix_dedup.suffix_dedup(d), ("kept",), 5),
    "substring_dedup": lambda d: (chunk_dedup.substring_dedup(d), (), 5),
    "score": lambda d: (toxicity.score(d, toxicity.learn(d, labels(d.sparkSession))), ("score",), 5),
    "place": lambda d: (sharding.place(d, [F.col("doc_id")], 3, 5), ("shard", "slot"), 5),
    "encoded": lambda d: (bpe.encoded(d, *bpe.rank_file(), check=True), ("ids", "round_trip"), 5),
}


@pytest.mark.parametrize("name", CASES)
def test_columns_come_back(spark, name):
    d = docs(spark)
    out, added, n = CASES[name](d)
    assert check(d, out, added) == n


def test_reject_toxic(spark):
    d = docs(spark)
    assert toxicity.reject_toxic(d, labels(spark).limit(0)).columns == d.columns
