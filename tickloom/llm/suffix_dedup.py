"""Suffix-array deduplication: every byte covered by a string of `LENGTH` bytes that starts elsewhere too.

1. Anchors. In every window of LENGTH bytes the place of the least hash of `GRAM` bytes is the window's anchor;
   equal windows have equal anchors. Neighbouring windows with one anchor make a segment. Segments are counted
   by anchor hash and digest: an anchor that stands once settles its windows as unique, and a segment that
   stands twice settles all its windows as repeated. Only places and hashes are exchanged for this.
2. Blocks. What is left are segments that share an anchor but differ, mostly at the ends of repeated passages.
   Their windows are cut into blocks of up to 64 by where the anchor stands in them. The windows of a block
   share a core of bytes, and two can be equal only if their cores are; blocks are counted by core and by what
   stands around it, with the same two ways to be settled.
3. Collections. Blocks that share a core but differ around it are strings of at most 127 symbols (the core
   counts as one symbol that no other core shares), in which windows are the substrings of 64 symbols. A
   collection of such strings goes through column-wise construction of its Burrows-Wheeler transform: each
   round inserts one symbol for each string, from the right end on, and updates the transform and the common
   prefixes of neighbouring suffixes, which are read from and written to sequential files; those of up to
   `BUFFER` bytes, as all of collections of at most COLLECTION + HOT - 1 strings are, stay in memory. Suffixes
   whose common prefix with a neighbour is 64 symbols or more are repeated windows.

A core with more than `HOT` different surroundings is not collected in one task: its blocks are cut into blocks
of 8 windows, which have longer cores, and if one of those is still as hot, into single windows, which only
have to be counted. Repeated windows are joined to ranges, and the texts meet their ranges by digest. However
many copies a text has, it is cut into blocks once.

Beside that law, which passages of under LENGTH bytes never meet, `shared` counts the bytes that are removed or
that stand in shorter passages of other documents: of every `WINNOW` strings of `SHORT` bytes in a row the one
with the least hash is a fingerprint, so a common passage of SHORT + WINNOW - 1 bytes has one in common, and the
bytes under fingerprints that stand in two documents are counted. These are counts of hashes, not of the
construction, and nothing is removed by them.

The digests are of 64 or 128 bits and stand for equality. Texts are named by a 64-bit digest and their length.

Defined results: a null text counts as empty; texts shorter than LENGTH keep all bytes; repeated rows and equal
texts remove each other wholly if they are long enough; doc_id is carried only and may be null; an empty table
gives an empty result; extra columns may have any name.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, by_batches, packed, restored, table
from .words import PRIME, mixed, slices

LENGTH, GRAM = 400, 32
#: Bytes of a fingerprint, and how many places in a row have one at least.
SHORT, WINNOW = 128, 128
#: Different surroundings of a core that one task takes.
HOT = 64
#: Strings in a collection, unless one core has more.
COLLECTION = 4096
#: Bytes of a construction's file that are buffered before it goes to disk.
BUFFER = 32 << 20
#: Bytes of a text that are anchored at once; places within have 24 bits.
PART = 8_000_000
WIDTHS = (64, 8, 1)
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * PRIME)


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of the `size` bytes (a power of two) from each place on; the last size - 1 mean nothing."""
    h, width, factor = BYTES[data], 1, int(PRIME) | 1
    while width < size:
        ahead = h[width:]
        h = h * np.uint64(factor)
        h[:-width] += ahead
        width, factor = 2 * width, factor * factor % 2**64
    return mixed(h)


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the least hash among the `width` from each place on, the first of equal ones; 40 bits are compared."""
    n, place = len(h), np.uint64((1 << 24) - 1)
    v = np.full(-(-n // width) * width + width, ~np.uint64(0))
    v[:n] = (h & ~place) | np.arange(n, dtype=np.uint64)
    # Sliding minimum: the rest of one stretch of `width` places and the beginning of the next.
    v = v.reshape(-1, width)
    least = np.minimum(np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()[:n], np.minimum.accumulate(v, axis=1).ravel()[width - 1 : width - 1 + n])
    return (least & place).astype(np.int64)


def within(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Of each of n places whether the `size` bytes from it on lie in one text."""
    edge, long = np.zeros(n + 1, np.int32), np.diff(starts) >= size
    edge[starts[:-1][long]] += 1
    edge[starts[1:][long] - size + 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def fingerprints(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the fingerprints of all texts; where one stands again and again, few of them."""
    whole = within(starts, len(data), SHORT + WINNOW - 1)
    if not whole.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data, SHORT)
    at = np.unique(least_places(h, WINNOW)[whole])
    h = h[at]
    again = np.r_[False, (h[1:] == h[:-1]) & (np.diff(at) < SHORT // 2)]
    head = np.flatnonzero(~again)
    step = (at - np.repeat(at[head], np.diff(np.r_[head, len(at)]))) // (SHORT // 2)
    kept = ~again | np.r_[True, step[1:] != step[:-1]]
    return at[kept], h[kept]


def segments(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(anchor hash, first window, last window, anchor) of each segment. starts: where texts begin, and the end."""
    whole = within(starts, len(data), length)
    if not whole.any():
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    h = gram_hashes(data)
    anchor = least_places(h, length - GRAM + 1)
    change = np.r_[True, (anchor[1:] != anchor[:-1])]
    change[starts[:-1][np.diff(starts) >= length]] = True
    first = np.flatnonzero(whole & (change | np.r_[True, ~whole[:-1]]))
    last = np.flatnonzero(whole & np.r_[change[1:] | ~whole[1:], True])
    return h[anchor[first]], first, last, anchor[first]


def _parts(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """A long text in overlapping parts; each window lies in exactly one."""
    for a in range(0, max(1, len(raw) - LENGTH + 1), PART):
        yield a, raw[a : a + PART + LENGTH - 1]


def _segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each segment: anchor hash, digest, text (digest, bytes), place (first window, further ones, anchor).

    And one for each fingerprint: its hash, 0, text, and as place -1 - 2 * place, less 1 if the text has had it before.
    """
    for b in batches:
        for part, texts in slices(b):
            raws = [t.encode("utf-8", "replace") for t in texts]
            names = part.column("t").to_pylist()
            pieces = [(t, len(raw), k, a, x) for k, (t, raw) in enumerate(zip(names, raws, strict=True)) for a, x in _parts(raw)]
            at, before, had = 0, -1, np.zeros(0, np.uint64)
            while at < len(pieces):
                to, size = at, 0
                while to < len(pieces) and (to == at or size + len(pieces[to][-1]) <= PART):
                    size += len(pieces[to][-1])
                    to += 1
                some = pieces[at:to]
                at = to
                raw = b"".join(x for *_, x in some)
                starts = np.r_[0, np.cumsum([len(x) for *_, x in some])]
                data, owner = np.frombuffer(raw, np.uint8), np.array([k for _, _, k, *_ in some])
                h, first, last, anchor = segments(data, starts)
                text = np.searchsorted(starts, first, side="right") - 1
                digest = np.fromiter((xxhash.xxh3_64_intdigest(raw[x:y], z) for x, y, z in zip(first.tolist(), (last + LENGTH).tolist(), (anchor - first).tolist(), strict=True)), np.uint64, len(first))
                name, n_bytes, begin = (np.array([x[c] for x in some], np.int64) for c in (0, 1, 3))
                place = first - starts[text] + begin[text] << 20 | (last - first) << 10 | (anchor - first)
                spot, print_ = fingerprints(data, starts)
                of = np.searchsorted(starts, spot, side="right") - 1
                own = (spot - starts[of] < PART) | (of + 1 == len(some))  # what a further part of a text holds too is its
                spot, print_, of = spot[own], print_[own], of[own]
                order = np.lexsort((spot, print_, owner[of]))
                again = np.zeros(len(spot), bool)
                again[order[1:]] = (np.diff(print_[order]) == 0) & (np.diff(owner[of][order]) == 0)
                again |= (owner[of] == before) & np.isin(print_, had)
                had = np.r_[had[: len(had) * (owner[-1] == before)], print_[owner[of] == owner[-1]]] if len(raw) >= PART else had[:0]
                before = owner[-1]
                mark = -1 - (2 * (spot - starts[of] + begin[of]) + again)
                cols = ((h.view(np.int64), print_.view(np.int64)), (digest.view(np.int64), np.zeros(len(spot), np.int64)), (name[text], name[of]), (n_bytes[text], n_bytes[of]), (place, mark))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in cols], ["h", "g", "t", "n", "place"])


def block_rows(raw: bytes, first: int, more: int, off: int, h: int) -> Iterator[tuple]:
    """(core digest, window range, left, right) of each block of a segment, at the first width."""
    anchor, width = first + off, WIDTHS[0]
    low, high = off - more, off  # how far windows begin before the anchor
    for j in range(low // width, high // width + 1):
        top, bottom = min(width * (j + 1) - 1, high), max(width * j, low)
        core_at, core_end = anchor - width * j, anchor - width * (j + 1) + 1 + LENGTH
        key = xxhash.xxh3_128_digest(raw[core_at:core_end] + h.to_bytes(8, "little", signed=True) + j.to_bytes(2, "little"))
        yield key, anchor - top, anchor - bottom, raw[anchor - top : core_at], raw[core_end : anchor - bottom + LENGTH]


BLOCK = pa.schema([("k", pa.binary()), ("q", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("z", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])
BLOCK_DDL = "k binary, q long, t long, n long, a long, z long, left binary, right binary"


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    k, t, n, a, z, left, right = zip(*rows, strict=True)
    q = [xxhash.xxh3_64_intdigest(x + y, len(x)) - (1 << 63) for x, y in zip(left, right, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((k, q, t, n, a, z, left, right), BLOCK, strict=True)], schema=BLOCK)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (k: core, q: surroundings, windows a to z of text t with n bytes) of the segments listed beside each text."""
    rows: list[tuple] = []
    for b in batches:
        for i in range(b.num_rows):
            raw = (b.column("text")[i].as_py() or "").encode("utf-8", "replace")
            t, n = b.column("t")[i].as_py(), len(raw)
            for s in b.column("segs")[i].as_py():
                place, h = s["place"], s["h"]
                rows += [(k, t, n, a, z, x, y) for k, a, z, x, y in block_rows(raw, place >> 20, place >> 10 & 1023, place & 1023, h)]
            if len(rows) > 20_000:
                yield _block_batch(rows)
                rows = []
    if rows:
        yield _block_batch(rows)


def _finer(width: int, finer: int):
    """Cut blocks of `width` windows into blocks of `finer` windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t, n, a, z, left, right in zip(*(b.column(c).to_pylist() for c in ("k", "t", "n", "a", "z", "left", "right")), strict=True):
                core_at = a + len(left)
                for j in range(width // finer):
                    # Windows that begin finer * j to finer * (j + 1) - 1 bytes before the core.
                    top, bottom = core_at - finer * (j + 1) + 1, core_at - finer * j
                    x, y = max(a, top), min(z, bottom)
                    if x > y:
                        continue
                    inner_left = left[len(left) - finer * j :] if finer * j else b""
                    inner_right = right[: width - finer * (j + 1)]
                    key = xxhash.xxh3_128_digest(k + inner_left + inner_right + j.to_bytes(2, "little"))
                    rows.append((key, t, n, x, y, left[len(left) - (core_at - x) : len(left) - finer * j], right[len(inner_right) : len(right) - (z - y)]))
            if rows:
                yield _block_batch(rows)

    return run


class Files:
    """The arrays of a construction as sequential files: each round reads one whole, in order, and writes the next.

    Files of up to `BUFFER` bytes stay in memory until they grow beyond it.
    """

    def __init__(self, **first: np.ndarray):
        self.kinds = {k: v.dtype for k, v in first.items()}
        self.files: dict = {}
        self.write(**first)

    def read(self) -> tuple[np.ndarray, ...]:
        out = []
        for k, kind in self.kinds.items():
            self.files[k].seek(0)
            out.append(np.frombuffer(self.files[k].read(), kind))
        return tuple(out)

    def write(self, **arrays: np.ndarray) -> None:
        self.close()
        for k, v in arrays.items():
            self.files[k] = tempfile.SpooledTemporaryFile(BUFFER, prefix="columns-")
            self.files[k].write(v.data)

    def close(self) -> None:
        for f in self.files.values():
            f.close()
        self.files = {}


def range_min(x: np.ndarray, low: np.ndarray, high: np.ndarray, block: int = 32) -> np.ndarray:
    """Least of x[low..high] for each pair of places, low <= high."""
    n = -(-len(x) // block)
    padded = np.full(n * block, 255, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(n, block)
    levels = [rows.min(axis=1)]
    while 2 << (len(levels) - 1) <= n:
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    a, b = low // block, high // block
    column = np.arange(block)
    left = np.where((column >= (low - a * block)[:, None]) & (column <= (high - a * block)[:, None]), rows[a], 255).min(axis=1)
    right = np.where((column >= (low - b * block)[:, None]) & (column <= (high - b * block)[:, None]), rows[b], 255).min(axis=1)
    out = np.minimum(left, right)
    span = b - a - 1
    some = np.flatnonzero(span > 0)
    if len(some):
        power = np.frexp(span[some].astype(np.float64))[1] - 1
        for p in np.unique(power).tolist():
            at = some[power == p]
            out[at] = np.minimum(out[at], np.minimum(levels[p][a[at] + 1], levels[p][b[at] - (1 << p)]))
    return out


def construct(strings: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(transform, common prefix with the suffix before, string, length) of all suffixes in order.

    strings: symbols from 1 on (16 bits), one row for each string, the last symbol in column 0; size: symbols in
    each. The transform has 0 where a suffix is a whole string. Common prefixes are below 255.
    """
    m = len(strings)
    files = Files(bwt=strings[:, 0].astype(np.uint16), lcp=np.zeros(m, np.uint8))
    columns = np.ascontiguousarray(strings.T)
    try:
        at = np.arange(m)  # where each string's last inserted symbol stands
        going = np.flatnonzero(size > 0)
        for j in range(1, int(size.max(initial=0)) + 1):
            going = going[size[going] >= j]
            bwt, lcp = files.read()
            order = np.argsort(bwt, kind="stable").astype(np.int32)
            ended = int(np.count_nonzero(bwt == 0))
            turn = np.empty(len(bwt), np.int32)
            turn[order] = np.arange(len(bwt), dtype=np.int32)
            here = at[going]
            k = turn[here].astype(np.int64)
            new = m + k - ended
            total = m + len(bwt) - ended
            before, after = order[np.maximum(k - 1, 0)], order[np.minimum(k + 1, len(bwt) - 1)]
            with_before = np.flatnonzero((k > ended) & (bwt[before] == bwt[here]))
            with_after = np.flatnonzero((k + 1 < len(bwt)) & (bwt[after] == bwt[here]))
            shared = range_min(lcp, np.r_[before[with_before], here[with_after]] + 1, np.r_[here[with_before], after[with_after]]) + 1
            old = np.ones(total, bool)
            old[new] = False
            symbols, prefixes = np.empty(total, np.uint16), np.empty(total, np.uint8)
            symbols[old], prefixes[old] = bwt, lcp
            symbols[new] = np.where(size[going] > j, columns[min(j, len(columns) - 1), going], 0)
            prefixes[new[new + 1 < total] + 1] = 0
            prefixes[new] = 0
            prefixes[new[with_before]] = shared[: len(with_before)]
            prefixes[new[with_after] + 1] = shared[len(with_before) :]
            at[going] = new
            files.write(bwt=symbols, lcp=prefixes)
        bwt, lcp = files.read()
    finally:
        files.close()
    # The last column's order leads from each string's empty suffix to longer and longer ones.
    ended = int(np.count_nonzero(bwt == 0))
    longer = np.empty(len(bwt), np.int64)
    longer[np.argsort(bwt, kind="stable")] = np.arange(len(bwt)) + m - ended
    who, long = np.zeros(len(bwt), np.int32), np.zeros(len(bwt), np.int32)
    walk, place = np.arange(m), np.arange(m)
    for j in range(int(size.max(initial=0)) + 1):
        who[place], long[place] = walk, j
        on = size[walk] > j
        walk, place = walk[on], longer[place[on]]
    return bwt, lcp, who, long


def repeated(group: list[int], left: list[bytes], right: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, bytes before the core) of every window that another block of its group holds too."""
    m = len(group)
    size = np.array([len(x) + len(y) + 1 for x, y in zip(left, right, strict=True)])
    strings = np.zeros((m, int(size.max())), np.uint16)
    for i, (g, x, y) in enumerate(zip(group, left, right, strict=True)):
        row = strings[i]
        row[: len(y)] = np.frombuffer(y, np.uint8)[::-1]
        row[: len(y)] += 1
        row[len(y)] = 257 + g
        row[len(y) + 1 : size[i]] = np.frombuffer(x, np.uint8)[::-1]
        row[len(y) + 1 : size[i]] += 1
    _, lcp, who, long = construct(strings, size)
    far = lcp >= width
    found = np.flatnonzero(far | np.r_[far[1:], False])
    tail = np.array([len(y) for y in right])
    return who[found], long[found].astype(np.int64) - 1 - tail[who[found]]


def _collected(width: int):
    """Repeated windows of blocks that come sorted by core."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        number: dict[bytes, int] = {}
        group = [number.setdefault(r[0], len(number)) for r in rows]
        block, before = repeated(group, [r[4] for r in rows], [r[5] for r in rows], width)
        core_at = np.array([r[3] + len(r[4]) for r in rows])  # r[3] is the first window
        a = core_at[block] - before
        names = [pa.array(np.array([r[c] for r in rows], np.int64)[block]) for c in (1, 2)]
        return pa.RecordBatch.from_arrays([*names, pa.array(a), pa.array(a)], ["t", "n", "a", "z"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("k", "t", "n", "a", "left", "right")), strict=True):
                if len(held) >= COLLECTION and row[0] != held[-1][0]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the byte ranges to remove and the number of shared bytes, from ranges of windows and fingerprints."""

    def ranges(w: np.ndarray) -> np.ndarray:
        w = w[np.argsort(w[:, 0], kind="stable")]
        end = np.maximum.accumulate(w[:, 1])
        first = np.r_[True, w[1:, 0] > end[:-1]]
        return np.stack([w[first, 0], end[np.r_[first[1:], True]]], axis=1)

    for b in batches:
        spans, shared = [], []
        for own, spots in zip(b.column("windows").to_pylist(), b.column("spots").to_pylist(), strict=True):
            w = ranges(np.array([(x["a"], x["z"] + LENGTH) for x in own], np.int64)) if own else np.zeros((0, 2), np.int64)
            spans.append(w.astype("<i8").tobytes() if own else None)
            every = np.concatenate([w, np.array(spots, np.int64)[:, None] + [0, SHORT]])
            shared.append(int(np.diff(ranges(every)).sum()) if len(every) else 0)
        yield pa.RecordBatch.from_arrays([b.column("t"), b.column("n"), pa.array(spans, pa.binary()), pa.array(shared, pa.int64())], ["t", "n", "spans", "shared"])


def named(docs: DataFrame) -> DataFrame:
    """docs with text (null as empty), t and n, which name the text."""
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("t", F.xxhash64("text")).withColumn("n", F.octet_length("text").cast("long"))


def _settle(rows: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """Rows whose first key stands twice, with `c` (rows with both keys), `d` (different second keys) and `one` (least t)."""
    both = rows.groupBy(*by).agg(F.count("*").alias("c"), F.min("t").alias("one"))
    heads = both.groupBy(by[0]).agg(F.count("*").alias("d"), F.sum("c").alias("_n")).filter("_n > 1").drop("_n")
    return rows.select(*by, *keep).join(both.join(heads, by[0]), by)


def removed(docs: DataFrame) -> DataFrame:
    """t, n, spans, shared of the texts that lose or share bytes: byte ranges (pairs of little-endian longs), number. docs: text."""
    keep = Scratch(docs.sparkSession)
    texts = named(docs.select("text")).filter(F.col("n") >= F.least(F.lit(LENGTH), F.lit(SHORT + WINNOW - 1)))
    segs = keep(by_batches(texts.select("t", "text"), _segmented, "h long, g long, t long, n long, place long"), "segments")
    prints = segs.filter("place < 0").select("h", "t", "n", F.shiftright(-1 - F.col("place"), 1).alias("a"), ((-1 - F.col("place")) % 2 == 0).alias("first"))
    common = prints.filter("first").groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h")
    shared = keep(prints.join(common, "h").select("t", "n", "a").distinct(), "shared")
    known = keep(_settle(segs.filter("place >= 0"), ["h", "g"], ["t", "n", "place"]), "known")
    keep.drop_but("known", "shared")
    first = F.shiftright("place", 20)
    done = [known.filter("c > 1").select("t", "n", first.alias("a"), (first + F.shiftright("place", 10).bitwiseAND(1023)).alias("z"))]
    # Segments that differ from others with their anchor, and one of each that stands twice to hold them against.
    # A text's copies have the same segments, so each text is listed once, and cut once.
    open_ = known.filter("d > 1 and (c = 1 or t = one)").select("t", "n", "h", "place").distinct().groupBy("t", "n").agg(F.collect_list(F.struct("h", "place")).alias("segs"))
    one = texts.join(open_.select("t", "n"), ["t", "n"], "left_semi").groupBy("t", "n").agg(F.any_value("text").alias("text"))
    blocks = keep(by_batches(one.join(open_, ["t", "n"]).select("t", "text", "segs"), _blocks, BLOCK_DDL), "blocks")
    for width, finer in zip(WIDTHS, [*WIDTHS[1:], None], strict=True):
        settled = keep(_settle(blocks, ["k", "q"], [c for c in BLOCK.names if c not in ("k", "q")]), f"settled-{width}")
        done.append(settled.filter("c > 1").select("t", "n", "a", "z"))
        if finer is None:
            break  # single windows differ in nothing but their core
        rest = settled.filter("d > 1 and (c = 1 or t = one)").dropDuplicates(["k", "q"])
        done.append(by_batches(rest.filter(F.col("d") <= HOT).repartition("k").sortWithinPartitions("k").select("k", "t", "n", "a", "left", "right"), _collected(width), "t long, n long, a long, z long"))
        hot = rest.filter(F.col("d") > HOT)
        if hot.isEmpty():
            break
        blocks = keep(by_batches(hot.select("k", "t", "n", "a", "z", "left", "right"), _finer(width, finer), BLOCK_DDL), f"blocks-{finer}")
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    window = F.collect_set(F.when(F.col("z").isNotNull(), F.struct("a", "z")))
    spot = F.collect_list(F.when(F.col("z").isNull(), F.col("a")))
    both = every.unionByName(shared.withColumn("z", F.lit(None).cast("long"))).groupBy("t", "n").agg(window.alias("windows"), spot.alias("spots"))
    out = keep(by_batches(both, _joined, "t long, n long, spans binary, shared long"), "removed")
    keep.drop_but("removed")
    return out


def kept_bytes(raw: bytes, spans: bytes | None) -> tuple[bytes, int]:
    """What is left of a text, and how many ranges were taken out."""
    if not spans:
        return raw, 0
    w = np.frombuffer(spans, "<i8").reshape(-1, 2).tolist()
    edges = [0, *(x for pair in w for x in pair), len(raw)]
    return b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)), len(w)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x in range(0, b.num_rows, 256):
            part = b.slice(x, 256)
            rows = []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                raw = text.encode("utf-8", "replace")
                kept, n = kept_bytes(raw, spans)
                rows.append((len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)), part.column("n_shared")], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"])


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """docs with `kept` (binary, in place of a column of that name): the text's bytes without those that are repeated."""

    def run(batches):
        for b in batches:
            kept = [kept_bytes(t.encode("utf-8", "replace"), s)[0] for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in callers), pa.array(kept, pa.binary())], [*callers, "kept"])

    text = F.coalesce("text", F.lit(""))
    callers = [f"caller_{k}" for k in range(len(docs.columns))]
    rows = docs.select(*packed(docs), text.alias("text"), F.xxhash64(text).alias("t"), F.octet_length(text).cast("long").alias("n"))
    both = rows.join(removed(docs), ["t", "n"], "left").select(*callers, "text", "spans")
    out = by_batches(both, run, T.StructType([*both.select(*callers).schema, T.StructField("kept", T.BinaryType())]))
    return restored(out, docs.columns, "kept")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = removed(docs)
    both = named(docs).join(found, ["t", "n"], "left")
    both = both.select("doc_id", "text", "spans", F.coalesce("shared", F.lit(0).cast("long")).alias("n_shared"))
    return by_batches(both, _kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long")
