"""Substring deduplication by content-defined chunking with a gear rolling hash.

The gear hash of a place depends on the last `WINDOW` bytes alone. Texts are cut where it falls under a
threshold, so an insertion moves no cut but those beside it, and the same passage is cut alike wherever it
stands. A cut too near to the one before is left out by a rule that again looks at nearby bytes only; cuts are
moved on to the next character. Every `STRETCH` places without a cut are cut at their least hash, so two copies of
a passage have common cuts within 32 + STRETCH bytes of its start and STRETCH bytes of its end, whatever stands
around them: of L bytes at least L - 32 - 2 * STRETCH are in common chunks, where no hash stands twice within
LEAST bytes. What is left at the ends, less than a chunk and what the hash looks back on, isn't found as repeated.

A chunk is kept where its digest occurs first (smallest doc_id, then place) and is a repeat elsewhere. Repeats
that follow each other make a run; runs of `LEAST_RUN` bytes or more are removed. Single short chunks that
happen to agree stay, so clean texts are left alone.

The first occurrence of a digest is an aggregate that starts on the map side, so a chunk that stands in very
many documents is not gathered; chunks are joined to it by digest, a join whose large partitions Spark splits.
Only places go through exchanges, never texts. Chunking is done once for the aggregate and once for the join,
as that costs less than keeping every chunk.

Defined results: a null text counts as empty and has no chunks; rows with a null doc_id come after all doc_ids under
2 ** 62, in the order of their texts' hashes, and are compared with each other unless their texts are equal; rows
that share a doc_id are not compared with each other, and rows that also share the text get the same result; an
empty table gives an empty result; extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batches, packed, table
from .words import PRIME, mixed, slices

WINDOW, LEAST = 16, 16
#: Chunks are shorter by far, as no stretch stays whole; places are packed by twice that.
LONGEST = 1024
#: Places in a row of which one is a cut.
STRETCH = 48
#: Places that are looked over at once.
PART = 1 << 20
#: Bytes between cuts, about, before those that are too near are left out.
MEAN = 40
LEAST_RUN = 96
GEAR = (mixed(np.arange(1, 257, dtype=np.uint64) * PRIME) >> np.uint64(32)).astype(np.uint32)
LAST = (1 << 63) - 1


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = (h[i - 1] << 2) + GEAR[data[i]] in 32 bits, for all places at once by doubling the window."""
    h = GEAR[data]
    for width in (1, 2, 4, 8):
        h[width:] = h[width:] + (h[:-width] << np.uint32(2 * width))
    return h


def cuts(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where texts and low hashes are cut, and of which text. data: bytes of all texts; starts: where texts begin, and the end."""
    at = np.flatnonzero(gear(data) < np.uint32(2**32 // MEAN)) + 1
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # characters' first bytes
    at = at[at <= lead[-1]] if len(lead) else at[:0]
    at = np.unique(lead[np.searchsorted(lead, at)])
    text = np.searchsorted(starts, at, side="right") - 1
    ok = at - starts[text] > WINDOW
    at, text = at[ok], text[ok]
    near = np.zeros(len(at), bool)
    near[1:] = (np.diff(at) < LEAST) & (text[1:] == text[:-1])
    at = at[~near]
    at = np.union1d(at, starts[:-1][np.diff(starts) > 0])
    return at, np.searchsorted(starts, at, side="right") - 1


def alike(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the same WINDOW bytes stand before the places a and b."""
    same = np.ones(len(a), bool)
    for k in range(1, WINDOW + 1):
        same &= data[a - k] == data[b - k]
    return same


def least_places(data: np.ndarray, starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Place of the least hash in each stretch of STRETCH places of one text that holds none of the cuts `at`."""
    n, far = len(data), np.uint64(1 << 32)
    found = [np.zeros(0, np.int64)]
    heads = starts[:-1][np.diff(starts) > 0]
    for x in range(0, n - STRETCH + 1, PART):
        y = min(n, x + PART + STRETCH - 1)
        low = max(0, x - WINDOW - 1)
        v = np.full(-(-(y - x) // STRETCH) * STRETCH + STRETCH, far)
        h = gear(data[low:y])
        first = max(x, 1)  # a cut at p comes after the hash of p - 1
        v[first - x : y - x] = h[first - 1 - low : y - 1 - low]
        v[: y - x][(data[x:y] & 0xC0) == 0x80] = far
        near = heads[(heads > x - WINDOW - 1) & (heads < y)]
        own = (near[:, None] + np.arange(WINDOW + 1)).ravel() - x
        v[own[(own >= 0) & (own < y - x)]] = far
        v = v << np.uint64(31) | np.arange(len(v), dtype=np.uint64)
        # Sliding minimum: the rest of one stretch and the beginning of the next.
        v = v.reshape(-1, STRETCH)
        m = y - x - STRETCH + 1
        least = np.minimum(np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()[:m], np.minimum.accumulate(v, axis=1).ravel()[STRETCH - 1 : STRETCH - 1 + m])
        cut = np.zeros(y - x + 1, np.int32)
        cut[at[np.searchsorted(at, x) : np.searchsorted(at, y)] - x + 1] = 1
        cut = np.cumsum(cut)
        least = least[(cut[STRETCH:] == cut[:-STRETCH]) & (least >> np.uint64(31) < far)]
        found.append((least[np.diff(least, prepend=~np.uint64(0)) != 0] & np.uint64((1 << 31) - 1)).astype(np.int64) + x)
    return np.unique(np.concatenate(found))


def chunks(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks begin, and of which text."""
    at, _ = cuts(data, starts)
    more = least_places(data, starts, at)
    if len(more):
        # Hashes that stand again within LEAST bytes are those of a repeated short string; one in about LEAST bytes is a cut.
        step = np.diff(more)
        same = np.zeros(len(more), bool)
        same[1:] = (step < LEAST) & alike(data, more[1:], more[:-1])
        head = np.flatnonzero(~same)
        rank = np.arange(len(more)) - np.repeat(head, np.diff(np.r_[head, len(more)]))
        every = np.ones(len(more), np.int64)
        every[1:][same[1:]] = -(-LEAST // step[same[1:]])
        at = np.union1d(at, more[rank % every == 0])
    return at, np.searchsorted(starts, at, side="right") - 1


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk: digest, row, place, and whether it repeats an earlier chunk of the same text."""
    for b in batches:
        for part, texts in slices(b):
            raws = [t.encode("utf-8", "replace") for t in texts]
            raw = b"".join(raws)
            if not raw:
                continue
            starts = np.r_[0, np.cumsum([len(x) for x in raws])]
            at, text = chunks(np.frombuffer(raw, np.uint8), starts)
            ends = np.r_[at[1:], len(raw)]
            digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(at.tolist(), ends.tolist(), strict=True)]), "<i8").reshape(-1, 2)
            order = np.lexsort((at, digest[:, 0], digest[:, 1], text))
            same = (np.diff(text[order]) == 0) & (np.diff(digest[order], axis=0) == 0).all(axis=1)
            again = np.zeros(len(at), bool)
            again[order[1:]] = same
            place = (at - starts[text]) << 11 | (ends - at)
            yield pa.RecordBatch.from_arrays([pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), part.column("id").take(pa.array(text)), part.column("th").take(pa.array(text)), pa.array(place), pa.array(again)], ["d1", "d2", "id", "th", "place", "again"])


def _long_runs(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of neighbouring places that are long enough. p: packed places, in order."""
    if not len(p):
        return p, p
    a, e = p >> 11, (p >> 11) + (p & 2047)
    first = np.r_[True, a[1:] != e[:-1]]
    a, e = a[first], e[np.r_[first[1:], True]]
    ok = e - a >= LEAST_RUN
    return a[ok], e[ok]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long runs of each row's shared chunks, and of those among them that repeat an earlier place."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        repeats_, removed, shared, spans = [], [], [], []
        for places in b.column("places").to_pylist():
            p = np.sort(np.array(places, np.int64))
            later = p[(p & 1) == 1] >> 1
            a, e = _long_runs(later)
            repeats_.append(len(later))
            removed.append(int((e - a).sum()))
            spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), e.tolist(), strict=True)])
            a, e = _long_runs(p >> 1)
            shared.append(int((e - a).sum()))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(repeats_, pa.int64()), pa.array(removed, pa.int64()), pa.array(shared, pa.int64()), pa.array(spans, kind)], ["id", "th", "n_repeats", "n_removed", "n_shared", "spans"])


def unnamed(th: str = "th") -> Column:
    """Where a row without a doc_id stands among doc_ids, by its text's hash: in the upper half of positive numbers."""
    return F.lit(1 << 62) + F.shiftrightunsigned(th, 2)


def repeats(docs: DataFrame) -> DataFrame:
    """id, th, n_repeats, n_removed, n_shared, spans of the rows that hold shared chunks; a null doc_id is id LAST.

    n_shared counts the bytes in long runs of chunks that stand elsewhere too, first occurrences included.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    rows = rows.withColumn("id", F.coalesce("id", unnamed()))
    chunks = by_batches(rows, _chunked, "d1 long, d2 long, id long, th long, place long, again boolean")
    first = chunks.filter("not again").groupBy("d1", "d2").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").drop("last")
    elsewhere = chunks.filter("not again").join(first, ["d1", "d2"]).select("id", "th", (F.col("place") * 2 + (F.col("id") > F.col("first")).cast("long")).alias("place"))
    within = chunks.filter("again").select("id", "th", (F.col("place") * 2 + 1).alias("place"))
    # Rows that are alike in doc_id and text give each place more than once.
    both = elsewhere.unionByName(within).withColumn("id", F.when(F.col("id") == unnamed(), F.lit(LAST)).otherwise(F.col("id")))
    return both.groupBy("id", "th").agg(F.collect_set("place").alias("places")).mapInArrow(_runs, "id long, th long, n_repeats long, n_removed long, n_shared long, spans array<struct<start:long,end:long>>")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """docs with the runs of repeated chunks taken out of `text`."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*packed(docs), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("th"))
    marked = rows.join(repeats(docs).select("id", "th", "spans"), ["id", "th"], "left")
    text = F.col(f"caller_{docs.columns.index('text')}")
    raw = F.encode(F.coalesce(text, F.lit("")), "utf-8")
    ends = F.transform("spans", lambda s: s["end"])
    kept = F.concat(F.array(F.lit(0).cast("long")), ends), F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.octet_length(raw).cast("long")))
    pieces = F.zip_with(*kept, lambda a, b: F.decode(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")), "utf-8"))
    left = F.when(F.coalesce(F.size("spans"), F.lit(0)) > 0, F.array_join(pieces, "")).otherwise(text)
    return marked.select(*[(left if c == "text" else F.col(f"caller_{k}")).alias(c) for k, c in enumerate(docs.columns)])


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    zero = F.lit(0).cast("long")
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("th"))
    out = slim.join(repeats(docs), ["id", "th"], "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_repeats", zero).alias("n_repeats"), F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_shared", zero).alias("n_shared"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"))
