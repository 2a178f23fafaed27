"""op4, op5: against the tiktoken library, round trips, odd texts, invented rank files; the histogram by brute force."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import bpe, lengths, words

PATH, PATTERN = bpe.rank_file()
RANKS = bpe.read_ranks(PATH)
CODEC = bpe.Codec(RANKS, PATTERN)
TRUE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["", " ", "  \n\n x", "it's 'sound 'LL we'll'd ''s 's's", "a" * 3000, "ab" * 2000, "été  x　", "\x1c\x1d\x85 q", "1234 ٣٤ Ⅷ²", "日本語テキスト👍🏽", "<|endoftext|>", "éa‍", " \t'", "\n \n", "x  ", "' s"]


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    (got,) = CODEC.encode([text])
    assert ids(got) == TRUE.encode_ordinary(text) and CODEC.decode(got) == text.encode()


TEXT = st.one_of(st.text(), st.text("ab' \nsreéltv1? ", max_size=40), st.lists(st.sampled_from(["the", " un", "tion", "'s", "  ", "é", "zz", "\n"]), max_size=30).map("".join))


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_equals_library(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert [ids(x) for x in CODEC.encode(texts)] == [TRUE.encode_ordinary(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_splitter_equals_pattern(texts):
    every = "".join(texts)
    chars, starts, upto = CODEC.pieces(texts, every)
    got = [[every[a:b] for a, b in zip(starts[x:y], [*starts[x + 1 : y], sum(map(len, texts[: k + 1]))])] for k, (x, y) in enumerate(zip(upto[:-1], upto[1:]))]
    assert got == [regex.findall(PATTERN, t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=2, max_size=5), max_size=12, unique=True), st.text("abc", max_size=60), st.randoms())
def test_any_rank_file(tokens, text, r):
    tokens = [bytes(b"abc"[x % 3] for x in t) for t in tokens]
    order = [bytes([b]) for b in range(256)] + sorted(set(tokens))
    r.shuffle(order)  # merges may make pairs of lower ranks
    ranks = {t: i for i, t in enumerate(order)}
    true = tiktoken.Encoding("x", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    few, bpe.FEW = bpe.FEW, 1
    try:
        assert [ids(x) for x in bpe.Codec(ranks, r"\w+").encode([text, text + "b"])] == [true.encode_ordinary(text), true.encode_ordinary(text + "b")]
    finally:
        bpe.FEW = few


def test_forgetting_keeps_results():
    c = bpe.Codec(RANKS, PATTERN)
    texts = [f"word{i} and the rest of it {i * 7}" for i in range(50)]
    want = list(c.encode(texts))
    c.forget(2)
    assert 0 < len(c.number) == len(c.hash) and list(c.encode(texts)) == want


def thue_morse(n, a="a", b="b"):
    return "".join(a if bin(k).count("1") % 2 == 0 else b for k in range(n))


@pytest.mark.parametrize("n", [16, 64, 65, 1024, 2048, 4096])
def test_regular_strings_are_told_apart(n, monkeypatch):
    one, two = thue_morse(n), thue_morse(n, "b", "a")
    c = bpe.Codec(RANKS, PATTERN)
    for texts in ([one, two, one], [two], [one + " " + two]):  # also from one slice to the next
        assert [ids(x) for x in c.encode(texts)] == [TRUE.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(bpe, "hashes", lambda chars, starts, ends: (ends - starts, chars[starts].astype(np.uint64)))  # clashes
    c = bpe.Codec(RANKS, PATTERN)
    assert [ids(x) for t in (one, two, "xy yx xx") for x in c.encode([t, "ab " + t])] == [TRUE.encode_ordinary(x) for t in (one, two, "xy yx xx") for x in (t, "ab " + t)]
    h, _ = words.hashed_words([one, two, "ab ba"])
    assert len(set(h.tolist())) == 4


def test_queries_on_rows(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(None, None, "x", 1), (3, "the the", "x", 1), (3, "the the", "x", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)
    for r, (i, t, *_) in zip(sorted(bpe.digests(d, PATH, PATTERN).collect(), key=str), sorted(((i, t) for i, t, *_ in rows), key=lambda x: str(x))):
        assert r["doc_id"] in {x[0] for x in rows}
    got = sorted(tuple(map(str, r)) for r in bpe.digests(d, PATH, PATTERN).collect())
    want = []
    for i, t, *_ in rows:
        x = TRUE.encode_ordinary(t or "")
        want.append(tuple(map(str, (i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))))
    assert got == sorted(want)
    back = bpe.decoded(bpe.encoded(d, PATH, PATTERN), PATH, PATTERN)
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in back.collect()) and back.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    assert bpe.digests(d.limit(0), PATH, PATTERN).collect() == []


def test_op5_histogram(spark):
    texts = [None, "", "a", "b c", "b c d", "b c d", "one two three four " * 700]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sums = lengths.suffix_sums(lengths.histogram(bpe.counted(d, PATH, PATTERN)))
    n = sorted(len(TRUE.encode_ordinary(t or "")) for t in texts)
    rows = {r["length"]: r for r in sums.collect()}
    assert set(rows) == set(n)
    for x, r in rows.items():
        assert (r["n_docs"], r["docs_at_least"], r["tokens_at_least"], r["docs_at_most"]) == (n.count(x), sum(y >= x for y in n), sum(y for y in n if y >= x), sum(y <= x for y in n))
        assert (r["truncated_tokens"], r["total_docs"], r["total_tokens"]) == (sum(min(x, y) for y in n), len(n), sum(n))
    for limit in (0, 1, 2, 100, 10**6):
        assert lengths.truncated_total(sums, limit) == sum(min(y, limit) for y in n)
    assert lengths.quantile(sums, 0.5) == n[3] and lengths.quantile(sums, 1.0) == n[-1]
    none = lengths.suffix_sums(lengths.histogram(bpe.counted(d.limit(0), PATH, PATTERN)))
    assert none.collect() == [] and lengths.quantile(none, 0.5) is None and lengths.truncated_total(none, 5) is None


def test_vocabulary_is_only_read():
    assert public_tokenizers.path("byte_bpe_multi_50k.tiktoken") == PATH
