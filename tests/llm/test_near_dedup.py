"""op9: the estimate and the exact similarity, classes against brute force, odd rows."""

import random
from collections import Counter

import numpy as np
import pytest
import regex

from tickloom.llm import near_dedup as N
from tickloom.llm.graph import components

DDL = "doc_id long, text string, sig int"


def bag(text):
    w = regex.findall(r"[\p{L}\p{M}\p{N}\p{Pc}]+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def plain(a, b):
    """Probability Jaccard by its definition."""
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in set(a) | set(b)) for i in set(a) & set(b))


def prose(r, n, words=3000):
    return [f"w{r.randrange(words)}" for _ in range(n)]


def edited(r, words, k):
    out = list(words)
    for _ in range(k):
        out[r.randrange(len(out))] = f"e{r.randrange(10**6)}"
    return out


def corpus():
    r = random.Random(2)
    texts = {}
    bases = [prose(r, r.randrange(60, 260)) for _ in range(12)]
    for i, b in enumerate(bases):
        texts[10 * i] = " ".join(b)
        for k in range(1, 6):
            texts[10 * i + k] = " ".join(edited(r, b, k))
    for k in range(60):  # a large group of near copies
        texts[1000 + k] = " ".join(edited(r, bases[0], 1))
    texts |= {2000: "Same, text here twice over!", 2001: "same text HERE twice over", 2002: "a b", 2003: "A  b", 2004: "a c", 2005: "", 2006: "!!!", 2007: None, 2008: "rep " * 500, 2009: "rep " * 499}
    return texts


def classes_of(texts):
    bags = {i: bag(t) for i, t in texts.items()}
    at = {i: i for i in texts}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if bags[i] and bags[j] and root(i) != root(j) and plain(bags[i], bags[j]) >= N.SIMILARITY:
                a, b = sorted((root(i), root(j)))
                at[b] = a
    return {i: root(i) for i in ids}


def test_similarity_and_estimate():
    r = random.Random(0)
    a = prose(r, 300)
    texts = [" ".join(a), " ".join(edited(r, a, 12)), "x y z " * 40, "x y z " * 20 + " ".join(a[:50]), "one"]
    text, shingle, times = N.weighted_shingles(texts)
    sig = N.signatures(text, shingle, times, len(texts), 2000)
    for i in range(5):
        for j in range(5):
            p, q = text == i, text == j
            exact = N.probability_jaccard(shingle[p], times[p], shingle[q], times[q])
            assert abs(exact - plain(bag(texts[i]), bag(texts[j]))) < 1e-9
            assert abs((sig[i] == sig[j]).mean() - exact) < 0.06
    assert Counter(np.unique(text, return_counts=True)[1].tolist()) == Counter(len(bag(t)) for t in texts)


@pytest.mark.parametrize("leaders", [N.LEADERS, 3])
def test_classes_equal_brute_force(spark, leaders, monkeypatch):
    monkeypatch.setattr(N, "LEADERS", leaders)
    monkeypatch.setattr(N, "PAIRS", leaders)
    texts = corpus()
    d = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], DDL).repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in N.near_classes(d).collect()}
    assert got == classes_of(texts)
    kept = N.near_dedup(d)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


def test_odd_rows(spark):
    long = " ".join(prose(random.Random(1), 20_000, 10**6))
    d = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, long), (4, long + " end"), (None, None)], "doc_id long, text string")
    rows = N.near_classes(d).collect()
    assert len(rows) == 7 and Counter(r["class_id"] for r in rows) == {1: 3, None: 2, 3: 2}
    assert N.near_classes(d.limit(0)).collect() == [] and N.near_dedup(d).count() == 5


def test_components(spark):
    r = random.Random(5)
    links = [(r.randrange(80), r.randrange(80)) for _ in range(55)] + [(200, 200 + k) for k in range(1, 40)] + [(300 + k, 301 + k) for k in range(30)]
    at = {}

    def root(i):
        at.setdefault(i, i)
        while at[i] != i:
            i = at[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        at[y] = x
    want = {i: root(i) for a, b in links if a != b for i in (a, b)}
    assert {r_["node"]: r_["component"] for r_ in components(spark.createDataFrame(links, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_less_similar_pairs_are_found_if_asked_for(spark):
    r = random.Random(6)
    rows = []
    for i in range(40):
        words = prose(r, 100, 10**6)
        other = [f"e{i}x{k}" if k in (10, 30, 50, 70, 97) else w for k, w in enumerate(words)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    assert 0.61 < plain(bag(rows[0][1]), bag(rows[1][1])) < 0.62
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"]: x["class_id"] for x in N.near_classes(d, 0.6).collect()} == {i: i // 2 * 2 for i in range(80)}


def test_banding():
    assert N.banding(N.SIMILARITY) == (N.BANDS, N.ROWS) and N.banding(0.6) == (41, 3) and abs(N.screen(0.8) - 0.5853) < 1e-3
    for wrong in (0.0, 0.05, 1.1):
        with pytest.raises(ValueError):
            N.banding(wrong)


def test_a_large_group_just_under_the_similarity(spark, monkeypatch):
    """2,200 texts of one base of 120 words, most of them 0.7 to 0.9 from it and less from each other."""
    made = []
    spread = N.Scratch.__call__
    monkeypatch.setattr(N.Scratch, "__call__", lambda self, df, name: (lambda out: made.append((name, out.count() if name.startswith("pairs") else 0)) or out)(spread(self, df, name)))
    r = random.Random(8)
    base = prose(r, 120, 10**6)
    texts = [" ".join(base), *(" ".join(edited(r, base, r.choice((1, 2, 3, 4, 4, 5)))) for _ in range(2200))]
    texts += [" ".join(edited(r, texts[7].split(), 1)) for _ in range(20)]  # near copies of one of them
    bags = [frozenset(bag(t)) for t in texts]
    shingles = {x: k for k, x in enumerate({x for b in bags for x in b})}
    has = np.zeros((len(texts), len(shingles)), np.float32)
    for i, b in enumerate(bags):
        has[i, [shingles[x] for x in b]] = 1
    common, size = has @ has.T, has.sum(axis=1)
    near = common / (size[:, None] + size - common) >= N.SIMILARITY - 1e-6
    want = np.arange(len(texts))
    while True:
        now = np.array([want[row].min() for row in near])
        if (now == want).all():
            break
        want = now
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {x["doc_id"]: x["class_id"] for x in N.near_classes(d).collect()} == dict(enumerate(want.tolist()))
    assert len(set(want.tolist())) > 300 and sum(n for _, n in made) < 2 * len(texts)


def test_a_large_group_with_words_put_in_left_out_and_changed(spark, monkeypatch):
    """What differs from the lead differs in number too, so counts alone let most pairs pass."""
    made = []
    spread = N.Scratch.__call__
    monkeypatch.setattr(N.Scratch, "__call__", lambda self, df, name: (lambda out: made.append(out.count() if name.startswith("pairs") else 0) or out)(spread(self, df, name)))
    r = random.Random(5)
    base = prose(r, 150)
    texts = []
    for _ in range(800):
        words = list(base)
        for _ in range(r.choice((1, 2, 3, 4, 5, 6))):
            i, word, how = r.randrange(len(words)), f"w{r.randrange(3000)}", r.randrange(3)
            words[i : i + (how != 1)] = [word] if how else []
        texts.append(" ".join(words))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x["class_id"] for x in N.near_classes(d).collect()}
    bags = [bag(t) for t in texts]
    assert all(n == 1 for b in bags for n in b.values())  # so shares of common shingles are the similarity
    at = {x: k for k, x in enumerate({x for b in bags for x in b})}
    has = np.zeros((len(texts), len(at)), np.float32)
    for i, b in enumerate(bags):
        has[i, [at[x] for x in b]] = 1
    common, size = has @ has.T, has.sum(axis=1)
    near = common / (size[:, None] + size - common) >= N.SIMILARITY - 1e-6
    want = np.arange(len(texts))
    while (want != (now := np.array([want[row].min() for row in near]))).any():
        want = now
    assert got == dict(enumerate(want.tolist()))
    assert sum(made) < 2 * len(texts)


def test_differences_hold():
    """Bits that only one of two nodes has are no more than the shingles that only one of them has, for short and long leads."""
    g = np.random.default_rng(7)
    for size in (1, 63, 64, 65, 900):
        for _ in range(20):
            lead = np.unique(g.integers(0, 1 << N.SHINGLE_BITS, size, np.uint64))
            pool = g.integers(0, 1 << N.SHINGLE_BITS, 2 * size, np.uint64)
            made = [(np.unique(g.choice(pool, g.integers(0, size + 1))), g.random(len(lead)) < g.choice([0.1, 0.6, 1.0])) for _ in range(2)]
            (fx, ax), (fy, ay) = made
            (mx, bx), (my, by) = (N.differences(f, a) for f, a in made)
            both = int(np.unpackbits((mx & my).view(np.uint8)).sum())
            assert bx + ay.sum() - both <= len(np.setdiff1d(fx, fy)) + (ay & ~ax).sum()
            assert by + ax.sum() - both <= len(np.setdiff1d(fy, fx)) + (ax & ~ay).sum()


def test_bound_holds():
    """The similarity of two weighted sets is at most what the facts about each and a third tell."""
    g = np.random.default_rng(3)
    for _ in range(400):
        w = g.integers(0, 4, (3, 30)) * (g.random((3, 30)) < g.choice([0.3, 0.9, 0.97]))
        x, y, c = w
        if not (x.any() and y.any() and c.any()):
            continue
        facts = []
        for a, b in ((x, y), (y, x)):
            facts.append((int(a[(c == 0) & (b == 0)].sum()), int(((c > 0) & (a == 0)).sum()), int(a.sum())))
        (ux, ax, wx), (uy, ay, wy) = facts
        p, q = 1 - (ux + max(0, ay - ax)) / wx, 1 - (uy + max(0, ax - ay)) / wy
        i, j = np.flatnonzero(x).astype(np.uint64), np.flatnonzero(y).astype(np.uint64)
        exact = N.probability_jaccard(i, x[x > 0], j, y[y > 0])
        assert exact <= (1 / (1 / p + 1 / q - 1) if p > 0 and q > 0 else 0) + 1e-9


def test_rows_that_share_a_doc_id(spark):
    r = random.Random(4)
    x, y, z = (prose(r, 80, 10**6) for _ in range(3))
    rows = [(1, x), (1, y), (2, edited(r, x, 1)), (3, edited(r, y, 1)), (4, z), (5, z), (5, x)]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    out = N.near_classes(d).collect()
    assert Counter(r_["class_id"] for r_ in out) == {1: 7}  # document 5 has a text of 4 and one of 1
    kept = sorted((r_["doc_id"], r_["text"]) for r_ in N.near_dedup(d).collect())
    assert kept == sorted([(1, " ".join(x)), (1, " ".join(y)), (4, " ".join(z))])


def test_any_column_names(spark):
    names = ["near_id", "_near_id", "NEAR_TEXT", "node", "component", "kept", "th", "a.b", "x`y"]
    d = spark.createDataFrame([(i, "a b c d e f", *range(9)) for i in range(3)], ["doc_id", "text", *names])
    out = N.near_dedup(d)
    assert out.columns == d.columns and out.collect() == d.filter("doc_id = 0").collect()
