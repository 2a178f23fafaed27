"""op13: against the tokenizers library, with lexicons of any words; the automaton against a dictionary, and that it is minimal."""

import hashlib
import json

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tickloom.llm import transducer as X

PATH = public_tokenizers.path("byte_bpe_50k.json")
TRUE = Tokenizer.from_file(PATH)
V = X.Vocabulary(PATH)
KIND = X.character_classes(PATH)
ODD = ["", " ", "  \n\n x", "it's 'sound 'LL we'll'd ''s 's's", "a" * 3000, "ab" * 2000, "été  x　", "\x1c\x1d\x85 q", "1234 ٣٤ Ⅷ²", "日本語テキスト👍🏽", "<|endoftext|>", " <|endoftext|><|endoftext|>  x<|endoftext", "a <|endoftext|>\n", "éa‍", " \t'", "\n \n", "x  ", "' s", "ՠࡰ a\U00031350 \U00011de0 1"]


def coder(words, path=None):
    b = X.Builder()
    for w in sorted(set(words)):
        b.add(w, tuple(V.merged(w)))
    arrays = b.arrays() | {"kind": KIND}
    if path is not None:
        path.write_bytes(X.as_file(arrays))
        arrays = X.mapped(str(path))
    return X.Coder(V, arrays)


FULL = coder([b" the", b"the", b" then", b" them", b" other", b"a", b" ", b"  ", b"\n", " é".encode(), b" word", b"words", b"x", b"'s", b"ab" * 20])
NONE = coder([])


def true(t):
    return TRUE.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    for c in (FULL, NONE):
        (got,) = c.encode([text])
        assert got.tolist() == true(text) and c.decode(got) == TRUE.decode(got.tolist(), skip_special_tokens=False) == text
    assert [x.tolist() for x in FULL.encode(ODD)] == list(map(true, ODD))


TEXT = st.one_of(st.text(), st.text("ab' \nsreéltv1? <|>", max_size=40), st.lists(st.sampled_from(["the", " then", " the", "'s", "  ", "é", "zz", "\n", "<|endoftext|>", " word", "words"]), max_size=30).map("".join))


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=6), st.integers(0, 2))
def test_equals_library(texts, some):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    c = [FULL, NONE, coder([b" the", b"words", b"zz"])][some]
    got = list(c.encode(texts))
    assert [x.tolist() for x in got] == list(map(true, texts)) and list(map(c.decode, got)) == texts


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.binary(max_size=7).map(lambda b: bytes(x % 3 + 97 for x in b)), st.lists(st.integers(0, 3), max_size=4).map(tuple), max_size=25), st.lists(st.binary(max_size=8).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=8))
def test_automaton_equals_dictionary_and_is_minimal(words, others):
    b = X.Builder()
    for w in sorted(words):
        b.add(w, words[w])
    c = X.Coder(V, b.arrays() | {"kind": KIND})
    asked = [*words, *others]
    data = np.frombuffer(b"".join(asked), np.uint8)
    ends = np.cumsum([len(w) for w in asked], dtype=np.int64) if asked else np.zeros(0, np.int64)
    good, n, ids = c.lookup(data, ends - [len(w) for w in asked], ends)
    assert good.tolist() == [w in words for w in asked]
    assert [tuple(x) for x in np.split(ids, np.cumsum(n))[:-1]] == [words.get(w, ()) for w in asked]
    rest = {}  # states that are left: what can still be read from each, and with what ids, is unlike that of any other

    def says(s):
        if s not in rest:
            rest[s] = frozenset([(b"", b.final[s])] * (b.final[s] is not None)) | {(bytes([a]) + w, tuple(o) + tuple(x)) for a, t, o in b.arcs[s] for w, x in says(t)}
        return rest[s]

    assert len({says(s) for s in range(len(b.arcs))}) == len(b.arcs)


def test_suffixes_are_shared():
    b = X.Builder()
    for w in sorted(p + m + b"nation" for p in (b"a", b"b", b"c") for m in (b"x", b"y")):
        b.add(w, (w[0], 7))
    b.arrays()
    assert len(b.arcs) == 1 + 1 + 1 + 6  # root, after a or b or c, after x or y, and "nation"
    with pytest.raises(ValueError):
        b.add(b"a", (1,))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abetho nir", min_size=1, max_size=30), min_size=1, max_size=5))
def test_both_ways_of_merging_agree(words):
    raw = [w.encode() for w in words]
    assert NONE.replay.merged(raw) == list(map(V.merged, raw))


def test_file_is_mapped(tmp_path):
    c = coder([b" the", b"x"], tmp_path / "lexicon")
    assert not c.lex["key"].flags.owndata and [x.tolist() for x in c.encode(["x the x then"])] == [true("x the x then")]


def test_other_files_are_refused(tmp_path):
    whole = json.load(open(PATH))
    whole["added_tokens"][0]["lstrip"] = True
    (tmp_path / "a.json").write_text(json.dumps(whole))
    with pytest.raises(ValueError):
        X.Vocabulary(str(tmp_path / "a.json"))


def test_rows(spark, monkeypatch):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(None, None, "x", 1), (3, "the the", "x", 1), (3, "the the", "x", 1), (50, "the long " * 60_000, "x", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)
    want = []
    for i, t, *_ in rows:
        x = true(t or "")
        want.append(tuple(map(str, (i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))))
    assert sorted(tuple(map(str, r)) for r in X.digests(d, PATH).collect()) == sorted(want)
    name = X.compiled(d, PATH, 5)
    e = X.encoded(d, PATH, name)
    back = X.decoded(e, PATH, name)
    assert e.columns == ["doc_id", "text", "n_tokens", "ids"] and all(r["decoded"] == (r["text"] or "") for r in back.collect())
    assert X.digests(d.limit(0), PATH).collect() == [] and X.encoded(d.limit(0), PATH).collect() == []


def test_counts(spark):
    d = spark.createDataFrame([(1, "the cat the"), (2, None), (3, "x<|endoftext|> the"), (3, "z" * 100)], "doc_id long, text string")
    assert {bytes(r["word"]): r["n"] for r in X.word_counts(d, PATH, KIND).collect()} == {b"the": 1, b" cat": 1, b" the": 2, b"x": 1}


def test_frequent_words_by_marks(spark):
    d = spark.createDataFrame([(f"w{k}".encode(), n) for k, n in enumerate([1, 1, 1, 5, 5, 6, 100, 1000])], "word binary, n long")
    for most, want in ((0, []), (1, [7]), (2, [6, 7]), (3, [5, 6, 7]), (4, [5, 6, 7]), (5, [3, 4, 5, 6, 7]), (7, [3, 4, 5, 6, 7]), (8, list(range(8)))):
        assert sorted(int(bytes(r["word"])[1:]) for r in X.frequent(d, most).collect()) == want
