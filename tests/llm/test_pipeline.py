"""The pipeline's stages against brute force on a small table, and its contract."""

import pytest

import corpus_pipeline as P
from tickloom.llm import near_dedup, toxicity
from tickloom.llm.common import table

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    from tests.llm.test_exact_dedup import brute

    assert [n for n, _ in P.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "byte-level BPE"]
    docs = table(spark, SF, "documents")
    at = {}
    for k, (name, f) in enumerate(P.STAGES):
        f(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        at[name] = (before, docs)
        if k < 4:
            assert docs.columns == before.columns == COLUMNS
    ids = lambda d: sorted(r["doc_id"] for r in d.select("doc_id").collect())
    a, b = at["toxicity"]
    s = toxicity.score(a, toxicity.learn(a, table(spark, SF, "labels")))
    assert ids(b) == ids(s.filter(f"score < {toxicity.THRESHOLD}"))
    a, b = at["exact dedup"]
    _, least, _ = brute([(r["doc_id"], r["text"]) for r in a.collect()])
    assert ids(b) == sorted(least.values())
    a, b = at["near dedup"]
    classes = {r["class_id"] for r in near_dedup.near_classes(a).collect()}
    assert ids(b) == sorted(classes)
    a, b = at["mixing"]
    assert set(ids(b)) == set(ids(a)) and 0 < b.count() <= 2 * a.count()
    a, b = at["byte-level BPE"]
    assert b.count() == a.count() and b.filter("not round_trip").count() == 0


def test_run(spark):
    assert P.run(spark, SF).filter("round_trip").count() > 0 and P.ORACLE_SQL is None


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, tmp_path, empty):
    """Nulls in any column, empty and very long texts, ties, repeated rows, extra columns, and no rows at all."""
    long = "word " * 60_000
    rows = [(1, "one two three four five six", "en", "a"), (1, "one two three four five six", "en", "a"), (2, "one  two three four\tfive six", None, None), (3, None, "en", "a"), (4, "", None, "b"), (None, None, None, None), (None, "a text without a number of its own", "en", "a"), (5, long, "en", "a"), (6, long, "en", "b"), (7, long + "more", "en", None)]
    names = ["tokens", "kept", "_near", "a.b", "score"]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([] if empty else [(*r, None, *names) for r in rows], ddl)
    spark.createDataFrame([(1, 1, 0), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for k, (name, stage) in enumerate(P.STAGES):
        had = docs.count()
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage-{k}"))
        read = spark.read.parquet(str(tmp_path / f"stage-{k}"))
        if name != "byte-level BPE":
            assert read.columns == docs.columns and all(tuple(r)[5:] == tuple(names) for r in read.collect())
        want = {"toxicity": 10, "exact dedup": 5, "near dedup": 4}  # null and empty texts are one, and so are the long ones
        assert empty and read.count() == 0 or read.count() == want.get(name, read.count()) and (name != "byte-level BPE" or read.count() == had)
        docs = read
    if not empty:
        assert all(r["round_trip"] for r in docs.collect())
