"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pieces of a slice of the corpus are laid end to end as one array of byte tokens with links to
both neighbours. An inverted index maps every token pair that a merge can join (by the merge's rank) to its
positions. Merges are then replayed in rank order: all positions of the least rank, from left to right, are
joined, and only the pairs with the two touched neighbours are looked up again. If a join makes a pair of a
lower rank than the one at hand, that rank is taken up first, so any rank file gives what merging each piece
alone would give. A piece that is itself in the rank file is one token without any merge.

A piece's tokens depend on the piece alone, so slices need no exchange: each task replays the pieces of its
own slice and remembers them, up to `REMEMBERED` pieces, for its worker's next slices.

Defined results: a null text counts as empty and has no tokens; a text of any length is encoded whole;
repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_batches, packed, restored, table
from .words import mixed

#: Pieces whose tokens a Python worker keeps between slices; the most frequent half survives an overflow.
REMEMBERED = 300_000
#: Characters of text in a slice.
SLICE = 250_000
#: A merge at fewer places than this is replayed place by place.
FEW = 12


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


#: The pattern that `Splitter` knows; any other is left to the regex library.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTER, NUMBER, OTHER, SPACE = range(4)


class Splitter:
    """Cuts texts as WORDS does, all texts of a slice at once."""

    def __init__(self):
        import regex

        self.kind = np.full(0x110000, OTHER, np.uint8)
        for a in range(0, 0x110000, 1 << 16):
            some = "".join(map(chr, range(a, a + (1 << 16))))
            for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
                for m in regex.finditer(name, some):
                    self.kind[a + m.start() : a + m.end()] = kind

    def starts(self, chars: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Where pieces begin. chars: code points of all texts; heads: where the texts that aren't empty begin."""
        n = len(chars)
        kind = self.kind[chars]
        head = np.zeros(n + 1, bool)
        head[heads] = True
        head[n] = True
        start = np.empty(n + 1, bool)
        start[1:n] = kind[1:] != kind[:-1]
        start[0] = start[n] = True
        start |= head
        space = kind == SPACE
        # The last white space before something else stands alone, or leads it if it is a blank.
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~head[1:n])
        start[last] = True
        start[last[chars[last] == 32] + 1] = False
        quote = np.flatnonzero((chars == 39) & start[:n])
        quote = quote[quote + 1 < n]
        quote = quote[~head[quote + 1]]
        one = chars[quote + 1]
        short = quote[np.isin(one, [ord(c) for c in "stmd"])]
        long = quote[np.isin(one, [ord(c) for c in "rvl"]) & (quote + 2 < n)]
        two = chars[long + 2]
        long = long[~head[long + 2] & np.where(chars[long + 1] == ord("l"), two == ord("l"), two == ord("e"))]
        start[short + 1] = start[long + 1] = False
        start[short + 2] = start[long + 3] = True
        return np.flatnonzero(start[:n])


def hashes(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each piece's code points, each the sum of a random number for every character at every place."""
    size = ends - starts
    within = np.arange(len(chars), dtype=np.int32) - np.repeat(starts.astype(np.int32), size)
    key = chars.astype(np.uint64) << np.uint64(32) | within.astype(np.uint64)
    one = mixed(key + np.uint64(0x9E3779B97F4A7C15))
    return np.add.reduceat(one, starts), np.add.reduceat(mixed(one ^ np.uint64(0xC2B2AE3D27D4EB4F)), starts)


def ragged(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of flat, end to end, and where each ends, after a 0."""
    size = ends - starts
    to = np.r_[0, np.cumsum(size)]
    return flat[np.arange(to[-1]) + np.repeat(starts - to[:-1], size)], to


class Codec:
    """Encodes pieces and texts by one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.splitter = Splitter() if pattern == WORDS else None
        self.find = regex.compile(pattern).findall
        self.token = {v: k for k, v in ranks.items()}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.first = np.array([ranks.get(bytes([b >> 8, b & 255]), -1) for b in range(65536)], np.int64)
        splits = sorted((ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        self.joined = dict(splits)
        self.pair = np.array([x[0] for x in splits] or [0], np.int64)
        self.pair_rank = np.array([x[1] for x in splits] or [-1], np.int64)
        #: Merges after which a pair of a lower rank can arise; only these can't be joined at all places at once.
        self.falling = {x for p, r in splits for x in (p >> 32, p & 0xFFFFFFFF) if x > r}
        self.token_at = np.zeros(max(self.token) + 2, np.int64)
        for k, t in self.token.items():
            self.token_at[k + 1] = len(t)
        self.token_at = np.cumsum(self.token_at)
        self.token_bytes = np.frombuffer(b"".join(self.token[k] for k in sorted(self.token)), np.uint8)
        self.forget()

    def forget(self, least: int | None = None) -> None:
        """Start anew, or with the pieces that have been used so often."""
        if least is None:
            #: Hashes of the remembered pieces, in order, and the pieces' numbers.
            self.hash, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            self.second = np.zeros(0, np.uint64)
            self.tokens, self.ends, self.uses = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, np.int64)
            return
        kept = np.flatnonzero(self.uses >= least)
        new = np.full(len(self.uses), -1, np.int64)
        new[kept] = np.arange(len(kept))
        stays = new[self.number] >= 0
        self.hash, self.number = self.hash[stays], new[self.number[stays]]
        self.tokens, self.ends = ragged(self.tokens, self.ends[:-1][kept], self.ends[1:][kept])
        self.second, self.uses = self.second[kept], self.uses[kept] // 2

    def ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.pair_rank[at], -1)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words, and where each word's end, after a 0; none of the words is empty."""
        joined = self.joined
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        start = np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]
        now = np.full(len(flat), -1, np.int64)  # rank of the pair that begins at a place; -1: none, -2: joined to the left
        now[:-1] = self.first[flat[:-1] << 8 | flat[1:]]
        now[start[1:] - 1] = -1
        tok = self.byte_id[flat]
        word = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(start))
        nxt, prv = np.arange(1, len(flat) + 1), np.arange(-1, len(flat) - 1)
        nxt[start[1:] - 1] = -1
        prv[start[:-1]] = -1
        where = np.flatnonzero(now >= 0)
        where = where[np.argsort(now[where], kind="stable")]
        of = now[where]
        cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else np.zeros(1, np.int64)
        index = {int(of[a]): where[a:b].tolist() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)}
        todo = list(index)
        heapq.heapify(todo)

        def note(q: int, i: int) -> None:
            if q in index:
                index[q].append(i)
            else:
                index[q] = [i]
                heapq.heappush(todo, q)

        while todo:
            r = heapq.heappop(todo)
            places = index.pop(r)
            if len(places) >= FEW:
                i = np.array(places, np.int64)
                i.sort()
                i = i[(now[i] == r) & np.r_[True, i[1:] != i[:-1]]]
                if not len(i):
                    continue
                if r in self.falling:  # one place of each word, as what it makes may go before the others
                    leads = np.r_[True, word[i[1:]] != word[i[:-1]]]
                    if not leads.all():
                        index[r] = i[~leads].tolist()
                        heapq.heappush(todo, r)
                        i = i[leads]
                j = nxt[i]
                if (now[j] == r).any():  # overlapping places: the left one goes first
                    free, last = [], -1
                    for a, b in zip(i.tolist(), j.tolist(), strict=True):
                        if a != last:
                            free.append(a)
                            last = b
                    i = np.array(free, np.int64)
                    j = nxt[i]
                n = nxt[j]
                tok[i] = r
                now[j] = -2
                now[i] = -1
                nxt[i] = n
                right = n >= 0
                i_right, n = i[right], n[right]
                prv[n] = i_right
                p = prv[i]
                p = p[p >= 0]
                at = np.concatenate((i_right, p))
                q = self.ranked(tok[at], tok[nxt[at]])
                now[at] = q
                good = q >= 0
                for q_, i_ in zip(q[good].tolist(), at[good].tolist(), strict=True):
                    if q_ in index:
                        index[q_].append(i_)
                    else:
                        index[q_] = [i_]
                        heapq.heappush(todo, q_)
                continue
            places.sort()
            for k, i in enumerate(places):
                if now[i] != r:
                    continue
                j = int(nxt[i])
                n, p = int(nxt[j]), int(prv[i])
                tok[i] = r
                now[j] = -2
                now[i] = -1
                nxt[i] = n
                lower = False
                if n >= 0:
                    prv[n] = i
                    q = joined.get(r << 32 | int(tok[n]), -1)
                    if q >= 0:
                        now[i] = q
                        note(q, i)
                        lower = q < r
                if p >= 0:
                    q = now[p] = joined.get(int(tok[p]) << 32 | r, -1)
                    if q >= 0:
                        note(q, p)
                        lower = lower or q < r
                if lower and k + 1 < len(places):
                    for x in places[k + 1 :]:
                        note(r, x)
                    break
        alive = now != -2
        ends = np.r_[0, np.cumsum(alive)][start]
        return tok[alive].astype("<u4"), ends

    def tokenized(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of these pieces, and where each piece's end, after a 0."""
        raw = [p.encode("utf-8", "replace") for p in new]
        one = np.array([self.ranks.get(w, -1) for w in raw], np.int64)
        rest = one < 0
        size = np.ones(len(new), np.int64)
        flat, ends = self.replay([w for w, k in zip(raw, one.tolist(), strict=True) if k < 0]) if rest.any() else (np.zeros(0, "<u4"), np.zeros(1, np.int64))
        size[rest] = np.diff(ends)
        to = np.r_[0, np.cumsum(size)]
        out = np.empty(to[-1], "<u4")
        out[to[:-1][~rest]] = one[~rest]
        replayed = np.ones(len(out), bool)
        replayed[to[:-1][~rest]] = False
        out[replayed] = flat
        return out, to

    def learn(self, new: list[str]) -> None:
        """Append the tokens of the pieces that have just been numbered."""
        if not new:
            return
        out, to = self.tokenized(new)
        self.tokens = np.concatenate([self.tokens, out])
        self.ends = np.r_[self.ends, self.ends[-1] + to[1:]]
        self.uses = np.r_[self.uses, np.zeros(len(new), np.int64)]

    def pieces(self, texts: list[str], every: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all texts, where pieces begin, and how many pieces end with each text, after a 0."""
        chars = np.frombuffer(every.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.r_[0, np.cumsum(size)]
        if self.splitter:
            starts = self.splitter.starts(chars, ends[:-1][size > 0])
        else:
            cut = [(e, [len(p) for p in self.find(t)]) for e, t in zip(ends.tolist(), texts, strict=False)]
            starts = np.concatenate([e + np.r_[0, np.cumsum(x[:-1])] for e, x in cut if x]).astype(np.int64)
        return chars, starts, np.searchsorted(starts, ends)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Token numbers of each text as little-endian unsigned 32-bit integers."""
        a = 0
        while a < len(texts):
            b, n = a, 0
            while b < len(texts) and (b == a or n + len(texts[b]) <= SLICE):
                n += len(texts[b])
                b += 1
            yield from self._slice(texts[a:b]) if n else [b""] * (b - a)
            a = b

    def _slice(self, texts: list[str]) -> list[bytes]:
        if len(self.second) > REMEMBERED:
            self.forget(max(2, int(np.median(self.uses)) + 1))
        every = "".join(texts)
        chars, starts, upto = self.pieces(texts, every)
        ends = np.r_[starts[1:], len(chars)]
        one, two = hashes(chars, starts, ends)
        del chars
        distinct, first, which = np.unique(one, return_index=True, return_inverse=True)
        if (two[first][which] != two).any():
            return self._apart(every, starts, ends, upto)
        at, numbers = np.searchsorted(self.hash, distinct), np.full(len(distinct), -1, np.int64)
        had = np.flatnonzero(at < len(self.hash))
        had = had[self.hash[at[had]] == distinct[had]]
        numbers[had] = self.number[at[had]]
        if (self.second[numbers[had]] != two[first[had]]).any():
            return self._apart(every, starts, ends, upto)
        new = np.flatnonzero(numbers < 0)
        numbers[new] = len(self.second) + np.arange(len(new))
        self.hash, self.number = np.insert(self.hash, at[new], distinct[new]), np.insert(self.number, at[new], numbers[new])
        self.second = np.r_[self.second, two[first[new]]]
        self.learn([every[x:y] for x, y in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        self.uses[numbers] += np.bincount(which, minlength=len(distinct))
        which = numbers[which]
        tokens, to = ragged(self.tokens, self.ends[which], self.ends[which + 1])
        return self._cut(tokens, to[upto])

    def _apart(self, every: str, starts: np.ndarray, ends: np.ndarray, upto: np.ndarray) -> list[bytes]:
        """A slice in which two pieces share a first hash but not the second: by the pieces themselves, nothing remembered."""
        pieces = [every[x:y] for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
        new = {p: k for k, p in enumerate(dict.fromkeys(pieces))}
        flat, to = self.tokenized(list(new))
        which = np.fromiter(map(new.__getitem__, pieces), np.int64, len(pieces))
        tokens, to = ragged(flat, to[which], to[which + 1])
        return self._cut(tokens, to[upto])

    @staticmethod
    def _cut(tokens: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        return [tokens[x:y].tobytes() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def decode(self, ids: bytes) -> bytes:
        x = np.frombuffer(ids, "<u4").astype(np.int64)
        return ragged(self.token_bytes, self.token_at[x], self.token_at[x + 1])[0].tobytes()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file; the file has to be at the same path on every machine."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def _texts(batches: Iterator[pa.RecordBatch], path: str, pattern: str):
    """(rows of a batch, their texts' tokens) for small runs of rows, so that few texts are held at once."""
    c = codec(path, pattern)
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            yield c, part, c.encode([t or "" for t in part.column("text").to_pylist()])


def _rows(docs: DataFrame, new: list[str], kinds: list[T.DataType], run, text: Column) -> DataFrame:
    """The columns of docs and those that run makes of `text`, in place of columns of their names."""
    callers = [f"caller_{k}" for k in range(len(docs.columns))]
    rows = docs.select(*packed(docs), text.alias("text"))
    schema = T.StructType([*rows.select(*callers).schema, *(T.StructField(n, k) for n, k in zip(new, kinds, strict=True))])
    return restored(by_batches(rows, run(callers), schema), docs.columns, *new)


def encoded(docs: DataFrame, path: str, pattern: str, check: bool = False) -> DataFrame:
    """docs with `ids` (array of int): the tokens of `text`. check: also `round_trip`, whether they decode to it again."""
    new = ["ids", *["round_trip"] * check]

    def run(callers: list[str]):
        def encode(batches):
            for c, part, tokens in _texts(batches, path, pattern):
                raw = list(tokens)
                ids = [np.frombuffer(x, "<i4") for x in raw]
                offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32))
                column = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))
                same = [pa.array([c.decode(x) == (t or "").encode("utf-8", "replace") for x, t in zip(raw, part.column("text").to_pylist(), strict=True)], pa.bool_())] * check
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in callers), column, *same], [*callers, *new])

        return encode

    return _rows(docs, new, [T.ArrayType(T.IntegerType()), T.BooleanType()][: len(new)], run, F.col("text"))


def decoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with `decoded` (binary): the bytes that the tokens in `ids` stand for; null ids give no bytes."""

    def run(callers: list[str]):
        def decode(batches):
            c = codec(path, pattern)
            for b in batches:
                raw = [c.decode(np.array(x or [], "<u4").tobytes()) for x in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in callers), pa.array(raw, pa.binary())], [*callers, "decoded"])

        return decode

    return _rows(docs, ["decoded"], [T.BinaryType()], run, F.col("ids"))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded in one pass, ids and texts not kept."""

    def run(batches):
        for c, part, tokens in _texts(batches, path, pattern):
            rows = [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(c.decode(x)).hexdigest()) for x in tokens]
            n, ids, raw = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return by_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def counted(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens of every document."""

    def run(batches):
        for _, part, tokens in _texts(batches, path, pattern):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in tokens], pa.int64())], ["doc_id", "n_tokens"])

    return by_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long")


def rank_file() -> tuple[str, str]:
    """Path and pattern of the public vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *rank_file())
