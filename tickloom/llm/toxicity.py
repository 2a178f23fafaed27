"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its words, its pairs of neighbouring words and its pairs of words with one or two words
between, each hashed to one of `DIMS` places and present or not. FTRL-proximal learns with a rate for each
coordinate and L1, which leaves few weights that aren't zero; those alone are sent to the executors.

The classifier is fitted on at most `SAMPLE` labelled rows, those with the least hash of their doc_id, so the
fit costs the same whatever the input; of a doc_id with several texts one is learned from. Every document is scored. Labels with the remainder that is held out
are never read for fitting. Fitting runs in one task, as each step needs the last one's weights; its input is
bounded by SAMPLE. Scoring is a plain pass without an exchange.

Defined results: null and empty texts are scored by the intercept alone; rows with one doc_id are scored each
for itself; conflicting labels of a doc_id count as toxic; without any usable label the score is 0 throughout;
a null doc_id isn't held out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_batches, packed, restored, table
from .words import PRIME, hashed_words, mixed, slices

DIMS = 1 << 20
SAMPLE = 8192
PASSES = 4
#: Rate and smoothing of FTRL-proximal, and its L1 and L2.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.0
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2


def features(words: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every feature that occurs; a feature may occur more than once."""
    text = np.repeat(np.arange(len(upto) - 1), np.diff(upto))
    rows, places = [text], [words]
    for apart in (1, 2, 3):
        if len(words) > apart:
            same = text[apart:] == text[:-apart]
            rows.append(text[apart:][same])
            places.append(mixed(words[:-apart][same] * PRIME + words[apart:][same] + np.uint64(apart)))
    return np.concatenate(rows), (np.concatenate(places) >> np.uint64(44)).astype(np.int64)


def fit(rows: list[np.ndarray], labels: np.ndarray, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and intercept. rows: the distinct places of each text, in the order of training."""
    z, n = np.zeros(DIMS + 1), np.zeros(DIMS + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        l1 = np.where(i == DIMS, 0.0, L1)
        return np.where(np.abs(z[i]) <= l1, 0.0, (np.sign(z[i]) * l1 - z[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(passes):
        for x, y in zip(rows, labels.tolist(), strict=True):
            i = np.append(x, DIMS)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / ALPHA * w
    w = weights(np.arange(DIMS + 1))
    return w[:-1], float(w[-1])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, texts in slices(b):
            row, place = features(*hashed_words(texts))
            key = np.unique(row * DIMS + place)
            cuts = np.searchsorted(key, np.arange(len(texts) + 1) * DIMS)
            places = [(key[x:y] - k * DIMS).astype("<i4").tobytes() for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
            yield pa.RecordBatch.from_arrays([part.column("at"), part.column("toxic"), pa.array(places, pa.binary())], ["at", "toxic", "places"])


def _fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("at", "places", "toxic")), strict=True)]
    found.sort()  # the order of training doesn't depend on how the rows came
    if found:
        w, b0 = fit([np.frombuffer(x, "<i4") for _, x, _ in found], np.array([y for *_, y in found]))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at], b0))], ["place", "weight"])


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Places, weights (at most DIMS) and intercept."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # At most `sample` rows, so they may be broadcast and meet in one task.
    chosen = usable.withColumn("at", F.xxhash64("doc_id")).orderBy("at", "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("at", "toxic", F.coalesce("text", F.lit("")).alias("text"))
    # One text of each doc_id, however many rows it has, so that the one task gets `sample` rows at most.
    one = by_batches(rows, _featured, "at long, toxic int, places binary").groupBy("at", "toxic").agg(F.min("places").alias("places"))
    got = one.repartition(1).mapInArrow(_fit_all, "place long, weight double").toPandas()
    got = got.sort_values("place")
    at = got["place"].to_numpy(np.int64)
    w = got["weight"].to_numpy(np.float64)
    return (at[1:], w[1:], float(w[0])) if len(at) else (np.zeros(0, np.int64), np.zeros(0), -np.inf)


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text") -> DataFrame:
    """caller_0 and so on (the columns of docs) and score (double, 0 to 1) of every row of docs."""
    callers = [f"caller_{k}" for k in range(len(docs.columns))]
    d = docs.select(*packed(docs), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([*d.select(*callers).schema, T.StructField("score", T.DoubleType())])
    shared = d.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        places, weights, intercept = shared.value
        dense = np.zeros(DIMS)
        dense[places] = weights
        for b in batches:
            for part, texts in slices(b):
                words, upto = hashed_words(texts)
                row, place = features(words, upto)
                some = dense[place] != 0
                key = np.unique(row[some] * DIMS + place[some])
                total = np.bincount(key // DIMS, dense[key % DIMS], len(texts)) + intercept
                with np.errstate(over="ignore"):
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in callers), pa.array(1 / (1 + np.exp(-total)))], [*callers, "score"])

    return by_batches(d, run, schema)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text") -> DataFrame:
    """docs with `score` (double, 0 to 1), in place of a column of that name."""
    return restored(scored(docs, model, text), docs.columns, "score")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score under the threshold, with the columns of docs."""
    return restored(scored(docs, learn(docs, labels)).filter(F.col("score") < threshold), docs.columns)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model).select("doc_id", held_out().alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
