"""Words of many texts at once, as hashes."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

#: Characters of text that are worked on at once.
SLICE = 200_000
PRIME = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def word_chars() -> np.ndarray:
    """For every code point whether it belongs to words: letters, marks, numbers, connecting lines."""
    import regex

    out = np.zeros(0x110000, bool)
    for a in range(0, 0x110000, 1 << 16):
        for m in regex.finditer(r"[\p{L}\p{M}\p{N}\p{Pc}]+", "".join(map(chr, range(a, a + (1 << 16))))):
            out[a + m.start() : a + m.end()] = True
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-case words of all texts, and how many words end with each text, after a 0."""
    texts = [t.lower() for t in texts]
    every = "".join(texts)
    ends = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]
    if not every:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    chars = np.frombuffer(every.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = word_chars()[chars]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = ends[:-1][ends[:-1] < len(chars)]
    start[heads] |= inside[heads]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    chars, inside = chars[starts[0] :], inside[starts[0] :]
    at = (starts - starts[0]).astype(np.int32)
    size = np.diff(np.r_[at, len(chars)])
    within = np.arange(len(chars), dtype=np.int32) - np.repeat(at, size)
    # Each character at each place has a random number of its own: no regular strings agree in their sums, as those do
    # that are read as polynomials.
    x = mixed((chars.astype(np.uint64) << np.uint64(32) | within.astype(np.uint64)) + PRIME)
    x[~inside] = 0
    return mixed(np.add.reduceat(x, at)), np.searchsorted(starts, ends)


def slices(batch: pa.RecordBatch, col: str = "text"):
    """Parts of a batch, each with its texts (null as empty), of about SLICE characters or one text."""
    n = batch.num_rows
    for a in range(0, n, 256):
        part = batch.slice(a, 256)
        texts = [t or "" for t in part.column(col).to_pylist()]
        x = 0
        while x < len(texts):
            y, size = x, 0
            while y < len(texts) and (y == x or size + len(texts[y]) <= SLICE):
                size += len(texts[y])
                y += 1
            yield part.slice(x, y - x), texts[x:y]
            x = y
