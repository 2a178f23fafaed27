"""BPE encoding and decoding with a minimal acyclic transducer as the lexicon of frequent words.

Words are counted over the whole corpus; the most frequent, at most `WORDS_KEPT`, are merged once and compiled into a transducer: an
automaton over their bytes in which equal suffixes share their states, and whose arcs and final states carry the token ids.
Ids stand as early as all words that share an arc agree on them, so that what is left to the suffixes is more often equal.
The automaton is a file of flat arrays. Executors fetch it once each, and all their Python workers map it into memory.

Encoding runs all words of a slice through the automaton at once, a byte at a time. It compares bytes, not hashes, so a
word is accepted only if it is in the lexicon; all others are merged pair by pair in the order of the vocabulary's merges.
Which words are frequent has an effect on speed only.

Texts are cut into words by the classes of characters that the tokenizers library's own pre-tokenizer shows, as other
libraries know characters of other Unicode versions. Added tokens are found first, leftmost and longest, and what
stands between them is encoded for itself. Decoding gives each id's bytes; what is no UTF-8 then becomes U+FFFD.

Defined results: a null text counts as empty and has no tokens; a text of any length is encoded whole, in slices that
never cut a text; words of more than `LONGEST` bytes are merged like other unseen words, in n log n steps; repeated rows give
repeated results; words of about one count are kept all or none, and words that stand once are not; an empty table gives an empty result and an
empty lexicon; columns of the caller stay, but for those that have a result's name.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import os
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import OTHER, SPACE, Codec, Splitter, hashes, ragged
from .common import Scratch, by_batches, packed, restored, shared_folder, table

#: Words in the lexicon, and the most bytes of one.
WORDS_KEPT, LONGEST = 65_536, 48
#: Characters of text in a slice, words that a task counts before it hands them on, unseen words a worker remembers.
SLICE, COUNTED, REMEMBERED = 1_000_000, 200_000, 50_000
#: Marks between a count and its double, at one of which the lexicon ends.
MARKS = 32


class Vocabulary:
    """Tokens, merges and added tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, before = whole["model"], whole["pre_tokenizer"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        if not plain or whole["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or whole["decoder"]["type"] != "ByteLevel":
            raise ValueError("only byte-level BPE without a normalizer is known")
        added = whole["added_tokens"]
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take what stands beside them aren't known")
        # Bytes that print stand for themselves, the others for characters from 256 on, in order.
        prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = (b for b in range(256) if b not in prints)
        self.byte = {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(rest)}
        self.added = {t["content"]: t["id"] for t in added}
        vocab = model["vocab"]
        self.byte_id = [vocab[c] for c, _ in sorted(self.byte.items(), key=lambda x: x[1])]
        self.joins: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.joins.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.token = {i: self.raw(t) for t, i in (vocab | self.added).items()}

    def raw(self, token: str) -> bytes:
        return bytes(self.byte[c] for c in token) if all(c in self.byte for c in token) else token.encode()

    def merged(self, word: bytes) -> list[int]:
        """The word's ids: of all pairs that can be joined the one of the least rank goes first, the leftmost of equals."""
        ids, n, joins = [self.byte_id[b] for b in word], len(word), self.joins
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        todo = [(j[0], i, j[1]) for i, pair in enumerate(itertools.pairwise(ids)) if (j := joins.get(pair))]
        heapq.heapify(todo)
        at = {i: new for _, i, new in todo}  # what the pair that begins at a place would become
        while todo:
            _, i, new = heapq.heappop(todo)
            if at.get(i) != new:
                continue
            k = nxt[i]
            ids[i], ids[k] = new, -1
            at.pop(k, None)
            right = nxt[i] = nxt[k]
            at.pop(i)
            if right < n:
                prv[right] = i
                if j := joins.get((new, ids[right])):
                    at[i] = j[1]
                    heapq.heappush(todo, (j[0], i, j[1]))
            left = prv[i]
            if left >= 0:
                at.pop(left, None)
                if j := joins.get((ids[left], new)):
                    at[left] = j[1]
                    heapq.heappush(todo, (j[0], left, j[1]))
        return [x for x in ids if x >= 0]


class Replay(Codec):
    """Merges many words at once. Tokens go by numbers: bytes first, then what the merges make, in their order."""

    def __init__(self, v: Vocabulary):
        made = [new for _, new in v.joins.values()]
        number = {i: 256 + rank for rank, i in v.joins.values()} | {i: b for b, i in enumerate(v.byte_id)}
        #: A token that several merges make, or a byte does too, has no number of its own; such words are merged one by one.
        self.known = len(set(made)) == len(made) and not set(made) & set(v.byte_id)
        splits = sorted((number[a] << 32 | number[b], 256 + rank) for (a, b), (rank, _) in v.joins.items())
        self.joined = dict(splits)
        self.pair, self.pair_rank = np.array([x for x, _ in splits] or [0], np.int64), np.array([x for _, x in splits] or [-1], np.int64)
        self.falling = {x for p, r in splits for x in (p >> 32, p & 0xFFFFFFFF) if x > r}
        self.byte_id = np.arange(256)
        self.first = np.array([self.joined.get((b >> 8) << 32 | b & 255, -1) for b in range(65536)], np.int64)
        self.id_of = np.zeros(max(number.values()) + 1, np.uint32)
        self.id_of[list(number.values())] = list(number)
        self.v = v

    def merged(self, words: list[bytes]) -> list[list[int]]:
        if not words or not self.known:
            return [self.v.merged(w) for w in words]
        numbers, ends = self.replay(words)
        ids, ends = self.id_of[numbers].tolist(), ends.tolist()
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


@functools.cache
def character_classes(path: str) -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE for every code point, as the tokenizers library's pre-tokenizer shows them."""
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    kind = np.full(0x110000, OTHER, np.uint8)
    for a in range(0, 0x110000, 4096):
        some = [c for c in range(a, a + 4096) if not 0xD800 <= c < 0xE000 and c != 39]
        # A character between a letter and a number goes with the one of its class, or stands alone.
        at = np.zeros(3 * len(some) + 1, bool)
        for _, (x, _) in cut("".join(f"a{chr(c)}1" for c in some)):
            at[x] = True
        begins = at[:-1].reshape(-1, 3)
        kind[some] = np.where(~begins[:, 1], 0, np.where(~begins[:, 2] & (np.array(some) != 32), 1, OTHER))
    spaces = [c for c in range(0x110000) if kind[c] == OTHER and chr(c).isspace() and len(cut(f"!{chr(c)}")) == 2]
    kind[spaces] = SPACE
    return kind


class Builder:
    """The minimal transducer of words that come in order, each with its ids."""

    def __init__(self):
        #: State: its arcs as (label, target, ids), and its final ids or None. Frozen states are found by what they are.
        self.arcs: list[tuple] = []
        self.final: list[tuple | None] = []
        self.known: dict[tuple, int] = {}
        self.last = b""
        self.path: list[list] = [[[], None]]  # [arcs, final ids] of the states along the last word

    def _freeze(self, upto: int) -> None:
        """States beyond so many bytes of the last word won't change any more."""
        while len(self.path) > upto + 1:
            arcs, final = self.path.pop()
            self.path[-1][0][-1][1] = self._state(arcs, final)

    def _state(self, arcs: list, final: tuple | None) -> int:
        key = (tuple(map(tuple, arcs)), final)
        if key not in self.known:
            self.known[key] = len(self.arcs)
            self.arcs.append(key[0])
            self.final.append(final)
        return self.known[key]

    def add(self, word: bytes, ids: tuple[int, ...]) -> None:
        if self.path[0][0] and word <= self.last:
            raise ValueError("words must come in order, each once")
        same = len(os.path.commonprefix([word, self.last]))
        self._freeze(same)
        for k in range(same):  # of what an arc says only the part that holds for this word too stays there
            arc, (arcs, final) = self.path[k][0][-1], self.path[k + 1]
            said = os.path.commonprefix([arc[2], ids])
            if rest := arc[2][len(said) :]:
                arc[2] = said
                for a in arcs:
                    a[2] = rest + a[2]
                if final is not None:
                    self.path[k + 1][1] = rest + final
            ids = ids[len(said) :]
        for b in word[same:]:
            self.path[-1][0].append([b, -1, ids])
            self.path.append([[], None])
            ids = ()
        self.path[-1][1] = ids
        self.last = word

    def arrays(self) -> dict[str, np.ndarray]:
        """Flat arrays: arcs in order of state and label; where the ids of arcs and of final states stand in `ids`."""
        self._freeze(0)
        root = self._state(*self.path[0])
        key = [s << 8 | a[0] for s, arcs in enumerate(self.arcs) for a in arcs]
        target = [a[1] for arcs in self.arcs for a in arcs]
        said = [a[2] for arcs in self.arcs for a in arcs] + [f or () for f in self.final]
        ids = list(itertools.chain.from_iterable(said))
        ends = np.r_[0, np.cumsum([len(x) for x in said])]
        return {"root": np.array([root]), "key": np.array(key, np.int64), "target": np.array(target, np.int32), "ends": ends.astype(np.int32), "ids": np.array(ids, np.uint32), "final": np.array([f is not None for f in self.final], np.uint8)}


def as_file(arrays: dict[str, np.ndarray]) -> bytes:
    """The arrays one after the other, each at a multiple of eight bytes, after a line that says where."""
    at, places, parts = 0, {}, []
    for name, x in arrays.items():
        raw = x.tobytes()
        places[name] = (str(x.dtype), at, len(x))
        parts.append(raw + b"\0" * (-len(raw) % 8))
        at += len(parts[-1])
    head = json.dumps(places).encode() + b"\n"
    return head + b" " * (-len(head) % 8) + b"".join(parts)


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file that `as_file` made, without reading it."""
    whole = np.asarray(np.memmap(path, np.uint8, "r"))
    with open(path, "rb") as f:
        head = f.readline()
    first = len(head) + -len(head) % 8
    return {name: whole[first + at : first + at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, at, n) in json.loads(head).items()}


class Coder:
    """Encodes and decodes by a vocabulary and the lexicon of its frequent words."""

    def __init__(self, vocabulary: Vocabulary, lexicon: dict[str, np.ndarray]):
        import regex

        self.v, self.lex, self.root = vocabulary, lexicon, int(lexicon["root"][0])
        self.splitter = Splitter.__new__(Splitter)
        self.splitter.kind = lexicon["kind"]
        self.find = regex.compile("|".join(map(regex.escape, sorted(vocabulary.added, key=len, reverse=True)))) if vocabulary.added else None
        self.replay = Replay(vocabulary)
        self.remembered: dict[bytes, list[int]] = {}
        self.unseen = 0
        top = max(vocabulary.token)
        self.token_at = np.r_[0, np.cumsum([len(vocabulary.token.get(k, b"")) for k in range(top + 1)])]
        self.token_bytes = np.frombuffer(b"".join(vocabulary.token.get(k, b"") for k in range(top + 1)), np.uint8)

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether a word is in the lexicon, its ids' number, all ids end to end) for words that lie in data."""
        lex = self.lex
        key, n_arcs = lex["key"], len(lex["key"])
        words, state, at = np.flatnonzero(ends - starts <= LONGEST), None, None
        state = np.full(len(words), self.root, np.int64)
        at, stop = starts[words], ends[words]
        who, said = [], []
        good = np.zeros(len(starts), bool)
        while len(words):
            done = at == stop
            if done.any():
                over = np.flatnonzero(done)
                over = over[lex["final"][state[over]] > 0]
                good[words[over]] = True
                who.append(words[over])
                said.append(n_arcs + state[over])
                go = ~done
                words, state, at, stop = words[go], state[go], at[go], stop[go]
            want = state << 8 | data[at]
            arc = np.minimum(np.searchsorted(key, want), n_arcs - 1) if n_arcs else np.zeros(len(want), np.int64)
            hit = key[arc] == want if n_arcs else np.zeros(len(want), bool)
            words, at, stop, arc = words[hit], at[hit] + 1, stop[hit], arc[hit]
            state = lex["target"][arc].astype(np.int64)
            says = lex["ends"][arc + 1] > lex["ends"][arc]
            who.append(words[says])
            said.append(arc[says])
        who, said = np.concatenate([np.zeros(0, np.int64), *who]), np.concatenate([np.zeros(0, np.int64), *said])
        kept = good[who]
        who, said = who[kept], said[kept]
        order = np.argsort(who, kind="stable")  # what a word says stays in the order of its bytes
        who, said = who[order], said[order]
        ids, _ = ragged(lex["ids"], lex["ends"][said].astype(np.int64), lex["ends"][said + 1].astype(np.int64))
        return good, np.bincount(who, lex["ends"][said + 1] - lex["ends"][said], len(starts)).astype(np.int64), ids

    def words(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all parts, where words begin and end in them, how many words end with each part after a 0)."""
        every = "".join(parts)
        chars = np.frombuffer(every.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        upto = np.r_[0, np.cumsum(size)]
        starts = self.splitter.starts(chars, upto[:-1][size > 0]) if len(chars) else np.zeros(0, np.int64)
        data = np.frombuffer(every.encode("utf-8", "replace"), np.uint8)
        width = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
        width[(chars >= 0xD800) & (chars < 0xE000)] = 1  # half of a pair, encoded as a question mark
        place = np.r_[0, np.cumsum(width)]
        begin = place[starts]
        return data, begin, np.r_[begin[1:], len(data)] if len(begin) else begin, np.searchsorted(starts, upto)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        a = 0
        while a < len(texts):
            b, n = a, 0
            while b < len(texts) and (b == a or n + len(texts[b]) <= SLICE):
                n += len(texts[b])
                b += 1
            yield from self._slice(texts[a:b])
            a = b

    def _slice(self, texts: list[str]) -> Iterator[np.ndarray]:
        parts, after, of = [], [], []  # what is encoded for itself, the added token that follows or -1, and the text
        for k, t in enumerate(texts):
            x = 0
            for m in self.find.finditer(t) if self.find else ():
                parts.append(t[x : m.start()])
                after.append(self.v.added[m.group()])
                of.append(k)
                x = m.end()
            parts.append(t[x:])
            after.append(-1)
            of.append(k)
        data, starts, ends, upto = self.words(parts)
        good, size, flat = self.lookup(data, starts, ends)
        rest = np.flatnonzero(~good)
        self.unseen += len(rest)
        if len(self.remembered) > REMEMBERED:
            self.remembered.clear()
        raw = data.tobytes()
        others = [raw[x:y] for x, y in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
        new = [w for w in dict.fromkeys(others) if w not in self.remembered]
        fresh = dict(zip(new, self.replay.merged(new), strict=True))
        own = [fresh[w] if w in fresh else self.remembered[w] for w in others]
        self.remembered.update((w, ids) for w, ids in fresh.items() if len(w) <= LONGEST)
        # The lexicon's ids lie in order of their words, then come those of the other words, then the added tokens.
        begin = np.cumsum(size) - size
        n = np.fromiter(map(len, own), np.int64, len(own))
        begin[rest], size[rest] = len(flat) + np.cumsum(n) - n, n
        added = np.array(after, np.int64)
        flat = np.concatenate([flat, np.fromiter(itertools.chain.from_iterable(own), np.uint32, int(n.sum())), added[added >= 0].astype(np.uint32)])
        first = len(flat) - int((added >= 0).sum())
        begin = np.insert(begin, upto[1:][added >= 0], first + np.arange(len(flat) - first))
        size = np.insert(size, upto[1:][added >= 0], 1)
        words = upto[1:] + np.cumsum(added >= 0)
        last = np.r_[np.flatnonzero(np.diff(of)), len(of) - 1]
        out, to = ragged(flat, begin, begin + size)
        cuts = [0, *to[words[last]].tolist()]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            yield out[x:y]

    def decode(self, ids: np.ndarray) -> str:
        x = ids.astype(np.int64)
        return ragged(self.token_bytes, self.token_at[x], self.token_at[x + 1])[0].tobytes().decode("utf-8", "replace")


_coders: dict[str, Coder] = {}


def coder(vocabulary: str, name: str) -> Coder:
    """The worker's coder; the lexicon is mapped from where Spark has put it on this machine."""
    if name not in _coders:
        _coders.clear()
        _coders[name] = Coder(Vocabulary(vocabulary), mapped(SparkFiles.get(name)))
    return _coders[name]


def _without(kind: np.ndarray) -> dict[str, np.ndarray]:
    """A lexicon of no words."""
    return Builder().arrays() | {"kind": kind}


def word_counts(docs: DataFrame, vocabulary: str, kind: np.ndarray) -> DataFrame:
    """word, n over all documents. Tasks add up what they meet before it is shuffled; words of over LONGEST bytes aren't counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, held = Coder(Vocabulary(vocabulary), _without(kind)), Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return b

        for b in batches:
            for at in range(0, b.num_rows, 64):
                texts = [t or "" for t in b.column("text").slice(at, 64).to_pylist()]
                data, starts, ends, _ = c.words([x for t in texts for x in (c.find.split(t) if c.find else [t])])
                fit = ends - starts <= LONGEST
                starts, ends = starts[fit], ends[fit]
                if len(starts):
                    flat, to = ragged(data, starts, ends)
                    _, first, n = np.unique(hashes(flat, to[:-1], to[1:])[0], return_index=True, return_counts=True)
                    raw = flat.tobytes()
                    for x, y, m in zip(to[first].tolist(), to[first + 1].tolist(), n.tolist(), strict=True):
                        held[raw[x:y]] += m
                if len(held) > COUNTED:
                    yield out()
        yield out()

    return by_batches(docs.select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, n_words: int) -> DataFrame:
    """The words of the highest counts, n_words at most: all whose count lies above a mark. counts: word, n.

    The mark is found in a histogram of at most `64 * MARKS` rows, so no task has to hand its best words to the driver.
    """
    mark = F.floor(F.log2("n") * MARKS).cast("int")
    sizes = counts.groupBy(mark.alias("mark")).agg(F.count("*").alias("words")).orderBy(F.col("mark").desc()).collect()
    total, least = 0, None
    for r in sizes:
        total += r["words"]
        if total > n_words:
            break
        least = r["mark"]
    return counts.filter(mark >= least) if least is not None else counts.limit(0)


def compiled(docs: DataFrame, vocabulary: str, n_words: int = WORDS_KEPT) -> str:
    """Compile the lexicon of docs' most frequent words; the name under which executors find it. At most n_words reach the driver."""
    spark, v, kind, keep = docs.sparkSession, Vocabulary(vocabulary), character_classes(vocabulary), Scratch(docs.sparkSession)
    counts = keep(word_counts(docs, vocabulary, kind).filter("n > 1"), "counts")
    build = Builder()
    for word in sorted(bytes(r["word"]) for r in frequent(counts, n_words).select("word").collect()):
        build.add(word, tuple(v.merged(word)))
    keep.drop_but()
    return shipped(spark, as_file(build.arrays() | {"kind": kind}))


def shipped(spark: SparkSession, content: bytes) -> str:
    """Write a file to the shared folder, from where Spark brings it to every executor, also to those that start later."""
    name = f"lexicon-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    stream.write(bytearray(content))
    stream.close()
    spark.sparkContext.addFile(path.toString())
    return name


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, name: str):
    """(coder, some rows, their texts' ids), few rows at once."""
    c = coder(vocabulary, name)
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            yield c, part, list(c.encode([t or "" for t in part.column("text").to_pylist()]))


def encoded(docs: DataFrame, vocabulary: str, name: str | None = None) -> DataFrame:
    """docs with `ids` (array of int). name: of a lexicon that `compiled` gave; else one of docs' own words is compiled."""
    name = name or compiled(docs, vocabulary)
    callers = [f"caller_{k}" for k in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, ids in _encoded(batches, vocabulary, name):
            offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in callers), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32)))], [*callers, "ids"])

    rows = docs.select(*packed(docs), F.col("text").alias("text"))
    schema = T.StructType([*rows.select(*callers).schema, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return restored(by_batches(rows, run, schema), docs.columns, "ids")


def decoded(docs: DataFrame, vocabulary: str, name: str) -> DataFrame:
    """docs with `decoded`: the text that the tokens in `ids` stand for; null ids give an empty one."""
    callers = [f"caller_{k}" for k in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary, name)
        for b in batches:
            texts = [c.decode(np.array(x or [], np.int64)) for x in b.column("given").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in callers), pa.array(texts, pa.string())], [*callers, "decoded"])

    rows = docs.select(*packed(docs), F.col("ids").alias("given"))
    schema = T.StructType([*rows.select(*callers).schema, T.StructField("decoded", T.StringType())])
    return restored(by_batches(rows, run, schema), docs.columns, "decoded")


def digests(docs: DataFrame, vocabulary: str, name: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded in one pass, ids and texts not kept."""
    name = name or compiled(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for c, part, ids in _encoded(batches, vocabulary, name):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(",".join(map(str, x.tolist()))) for x in ids], pa.string()), pa.array([sha(c.decode(x)) for x in ids], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return by_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
