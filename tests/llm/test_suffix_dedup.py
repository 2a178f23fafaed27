"""op3: against brute force over all windows, through every way of settling them; the transform itself."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import suffix_dedup as S

DDL = "doc_id long, text string, kept string"


def brute(texts, length=400):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    prose = lambda n: "".join(r.choice("abcdeé \n") for _ in range(n))
    shared, long = prose(520), prose(1500)
    edited = lambda: (lambda c: c[: (k := r.randrange(len(c)))] + "X" + c[k + 1 :])(long)
    texts = [None, "", "short", "a" * 399, "a" * 400, "a" * 1000, ("xyz" * 300)[:801], prose(900)]
    texts += [prose(r.randrange(0, 700)) + shared[r.randrange(60) : 520 - r.randrange(60)] + prose(r.randrange(0, 300)) for _ in range(25)]
    texts += [edited() for _ in range(12)] + [long, long, long + long]
    return texts


def run(spark, texts, shared=False):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DDL).repartition(3)
    found = S.removed(d)
    both = S.named(d).join(found, ["t", "n"], "left").select("doc_id", "text", "spans", F.coalesce("shared", F.lit(0)).cast("long").alias("n_shared"))
    rows = both.mapInArrow(S._kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long").collect()
    return [tuple(r)[1 : 5 + shared] for r in sorted(rows)]


@pytest.mark.parametrize("seed,hot,part", [(1, 64, S.PART), (2, 3, S.PART), (3, 1, 1200)])
def test_equals_brute_force(spark, seed, hot, part, monkeypatch):
    monkeypatch.setattr(S, "HOT", hot)
    texts = corpus(seed)
    if part != S.PART:  # workers import the module anew, so parts are tried without them
        raw = (texts[-1] or "").encode()
        monkeypatch.setattr(S, "PART", part)
        pieces = list(S._parts(raw))
        assert [a for a, _ in pieces] == list(range(0, len(raw) - 399, part)) and all(raw[a : a + len(x)] == x for a, x in pieces)
    assert run(spark, texts) == brute(texts)


def test_keeps_other_columns_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "ab" * 300, "mine"), (None, None, "b")], DDL).drop("kept")
    assert {r["doc_id"]: bytes(r["kept"]) for r in S.suffix_dedup(d).collect()} == {1: b"", None: b""}
    assert run(spark, []) == []


def test_construction_equals_sorting():
    r = random.Random(4)
    rows = [[r.randrange(1, 4) for _ in range(r.randrange(0, 9))] for _ in range(30)]
    size = np.array([len(x) for x in rows])
    strings = np.zeros((30, 8), np.uint16)
    for i, x in enumerate(rows):
        strings[i, : len(x)] = x[::-1]
    bwt, lcp, who, long = S.construct(strings, size)
    suffixes = sorted((tuple(x[k:]), i) for i, x in enumerate(rows) for k in range(len(x) + 1))
    assert [(tuple(rows[w][len(rows[w]) - n :]), w) for w, n in zip(who.tolist(), long.tolist())] == [(s, i) for s, i in suffixes] or sorted(map(str, suffixes)) == sorted(str((tuple(rows[w][len(rows[w]) - n :]), w)) for w, n in zip(who.tolist(), long.tolist()))
    got = [tuple(rows[w][len(rows[w]) - n :]) for w, n in zip(who.tolist(), long.tolist())]
    assert got == sorted(got)
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert lcp.tolist()[1:] == [common(a, b) for a, b in zip(got, got[1:])]
    assert [rows[w][len(rows[w]) - n - 1] if n < len(rows[w]) else 0 for w, n in zip(who.tolist(), long.tolist())] == bwt.tolist()


def test_range_min():
    g = np.random.default_rng(0)
    x = g.integers(0, 200, 1000).astype(np.uint8)
    low = g.integers(0, 1000, 300)
    high = np.minimum(999, low + g.integers(0, 900, 300))
    assert S.range_min(x, low, high).tolist() == [x[a : b + 1].min() for a, b in zip(low, high)]


def test_shared_bytes(spark):
    """Passages of SHORT + WINNOW - 1 bytes in two documents are found, whatever stands around them; nothing else is."""
    r = random.Random(9)
    prose = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    size = S.SHORT + S.WINNOW - 1
    passages = [prose(size + k) for k in range(40)]
    texts = [prose(r.randrange(900)) + p + prose(r.randrange(900)) for p in passages for _ in range(2)]
    texts += [prose(1500) for _ in range(20)] + ["z" * 3000, "abc" * 1000, prose(100) + (own := prose(300)) + prose(50) + own, None, "", "short"]
    got = [x[-1] for x in run(spark, texts, True)]
    for n, p in zip(got[:80], [p for p in passages for _ in range(2)]):
        assert S.SHORT <= n <= len(p) + 6
    assert got[80:] == [0] * 20 + [3000, 3000, 0, 0, 0, 0]  # what is removed counts; a short passage twice in one document doesn't


def test_copies_do_not_multiply_the_work(spark, monkeypatch):
    """Blocks of texts with copies beside variants: as many for 40 copies as for 5."""
    r = random.Random(10)
    base = "".join(r.choice("abcdefgh ") for _ in range(3000))
    variants = [base[: 700 * k] + "X" + base[700 * k + 1 :] for k in (1, 2, 3)]
    rows = {}
    keep = S.Scratch.__call__

    def kept(self, df, name):
        out = keep(self, df, name)
        if name == "blocks":
            rows[n] = out.count()
        return out

    monkeypatch.setattr(S.Scratch, "__call__", kept)
    for n in (5, 40):
        texts = variants + [base] * n
        assert run(spark, texts) == brute(texts)
    assert rows[5] == rows[40] > 0
