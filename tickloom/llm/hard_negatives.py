"""Hard negatives for stated anchors, by an orthogonal rotation to principal components.

Rows are rotated so that the leading components carry most of every vector's length. A row's product with an anchor is
then summed up from the leading components; what the others can still add or take away is at most the product of
both residual lengths, and a slack for rounding. A row that can't come above the anchor's k-th score so far, or can't
fall into the range of scores that is asked for, is discarded early; the next components are added for the rest, and
what survives all cuts is verified by its product in whole numbers. So the rotation has no part in the results.

The rotation comes from the second moments of all rows, which are d * d sums whatever the number of rows. Rows are packed into
shards, shards into groups, anchors into blocks, all sized by the numbers they hold; each group meets each block once. One
group goes first; the k-th scores that it finds go with the anchors to the others.

A first search finds an anchor's positives, its best rows of the same label. A second finds for each of them the best rows
of other labels with a score from `low` to `high` percent of the positive's.

Defined results: rows with a null id or label, or a vector that is null, empty or holds null or a value that isn't finite
take no part; vectors of different lengths don't meet; rows that share the anchor's id are its own row; a repeated row counts
each time, as a positive too, but a repeated anchor asks once, and of different rows of one anchor id the least asks; an anchor
without positives, and a positive without negatives, has no rows; scores that a long can't hold are cut to its limits before
they are compared; vectors of any length are held, those that are longer than `ROTATED` without rotation; an empty table gives
an empty result; columns of other names aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table
from .topk import EXACT, scaled

#: Rows in a shard at most, numbers in a group or block, groups at least.
SHARD, TOGETHER, GROUPS = 4096, 1 << 22, 16
#: Vectors up to this length are rotated; shares of the components after which rows are discarded.
ROTATED, CUTS = 1024, (1 / 8, 1 / 4, 1 / 2)
#: Anchors and rows that are multiplied at once, and pairs that are looked at closer at once.
ANCHORS, ROWS, PAIRS = 512, 1024, 1 << 16
NONE = np.iinfo(np.int64).min
PACKED = pa.schema([("no", pa.int64()), ("dim", pa.int32()), ("kind", pa.string()), *((c, pa.binary()) for c in ("ids", "labels", "data", "positive", "high", "least"))])
PACKED_DDL = "no long, dim int, kind string, ids binary, labels binary, data binary, positive binary, high binary, least binary"
FOUND = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def second_moments(vectors: DataFrame, dim: int) -> np.ndarray:
    """The sums of products of any two components over all rows of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            x = np.asarray(b.column("v").flatten()).reshape(-1, dim)
            # Lengths are evened out, so that a few huge vectors don't decide.
            x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300) if len(x) else x
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "sums"])

    parts = vectors.filter(F.size("v") == dim).select("v").mapInArrow(run, "i int, sums array<double>")
    sums = parts.select("i", F.posexplode("sums").alias("j", "s")).groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    out = np.zeros((dim, dim))
    out[sums["i"], sums["j"]] = sums["s"]
    return out


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """An orthogonal matrix, the principal component first."""
    values, axes = np.linalg.eigh(second_moments(vectors, dim))
    return np.ascontiguousarray(axes[:, np.argsort(-values)])


def _packed(rows: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, list[list]] = {}
        part, n = TaskContext.get().partitionId(), 0

        def out(dim: int) -> pa.RecordBatch:
            nonlocal n
            ids, labels, vectors, *rest = held.pop(dim)
            x = np.concatenate(vectors)
            top = np.abs(x).max()
            kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
            n += 1
            raw = [np.array(ids, "<i8").tobytes(), np.array(labels, "<i8").tobytes(), x.astype(kind).tobytes(), *(np.array(c, "<i8").tobytes() for c in rest)]
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | n]), pa.array([dim], pa.int32()), pa.array([kind]), *(pa.array([r], pa.binary()) for r in raw)], schema=PACKED)

        for b in batches:
            vectors = b.column("v")
            flat, at = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            for k, (i, label, *rest) in enumerate(zip(*(b.column(c).to_pylist() for c in ("id", "label", "positive", "high", "least")), strict=True)):
                dim = int(at[k + 1] - at[k])
                own = held.setdefault(dim, [[], [], [], [], [], []])
                own[0].append(i)
                own[1].append(label)
                own[2].append(flat[at[k] : at[k + 1]].copy())
                for c, x in zip(own[3:], rest, strict=True):
                    c.extend(x)
                if len(own[0]) >= min(rows, max(1, TOGETHER // dim)):
                    yield out(dim)
        for dim in list(held):
            yield out(dim)

    return pack


class Best:
    """The k best rows so far of each slot: an anchor, or an anchor's positive."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score, self.id = np.full((slots, k), NONE), np.full((slots, k), np.iinfo(np.int64).max)

    def take(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        met = np.unique(slot)
        slot = np.concatenate([slot, np.repeat(met, self.k)])
        score, ids = np.concatenate([score, self.score[met].ravel()]), np.concatenate([ids, self.id[met].ravel()])
        order = np.lexsort((ids, -np.maximum(score, NONE + 1), slot))
        slot, score, ids = slot[order], score[order], ids[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        first = rank < self.k
        self.score[slot[first], rank[first]], self.id[slot[first], rank[first]] = score[first], ids[first]


class Search:
    """Anchors of one block: without `high` for rows of their label, else for rows of other labels within ranges of scores."""

    def __init__(self, labels: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, axes: np.ndarray | None, high: np.ndarray | None = None, low: np.ndarray | None = None, least: np.ndarray | None = None):
        self.labels, self.ids, self.q, self.axes = labels, ids, q, axes
        self.high, self.low = high, low  # anchors x positives
        self.best = Best(len(q) * (1 if high is None else high.shape[1]), k)
        self.least = np.full(len(self.best.score), NONE) if least is None else least.ravel()
        self.turned, self.rest, self.cuts = self.turn(q)
        self.verified = 0

    def turn(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[int]]:
        """x rotated, and the lengths of what lies beyond each cut."""
        d = x.shape[1]
        turned = x @ self.axes if self.axes is not None else x
        cuts = sorted({max(1, int(d * c)) for c in CUTS} - {d})
        squares = np.cumsum((turned * turned)[:, ::-1], axis=1)[:, ::-1]
        return turned, [np.sqrt(squares[:, c]) for c in cuts], cuts

    def bounds(self, some: slice) -> tuple[np.ndarray, np.ndarray]:
        """The scores between which a row may still be of use to each anchor."""
        floor = np.maximum(self.best.score[:, -1], self.least).astype(np.float64)
        if self.high is None:
            return floor[some], np.full(len(floor[some]), np.inf)
        floor = np.where(self.low <= self.high, np.maximum(floor.reshape(self.high.shape), self.low), np.inf)
        return floor[some].min(axis=1), self.high[some].max(axis=1).astype(np.float64)

    def run(self, labels: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        turned, rest, cuts = self.turn(x)
        length, own = np.sqrt((x * x).sum(axis=1)), np.sqrt((self.q * self.q).sum(axis=1))
        for b in range(0, len(x), ROWS):
            for a in range(0, len(self.q), ANCHORS):
                some, rows = slice(a, a + ANCHORS), slice(b, b + ROWS)
                may = (self.labels[some, None] == labels[None, rows]) == (self.high is None)
                may &= self.ids[some, None] != ids[None, rows]
                least, most = self.bounds(some)
                slack = 1e-9 * own[some, None] * length[None, rows] + 1e-6
                upto = cuts[0] if cuts else x.shape[1]
                sums = self.turned[some, :upto] @ turned[rows, :upto].T
                room = slack + (self.rest[0][some, None] * rest[0][None, rows] if cuts else 0)
                may &= (sums + room >= least[:, None]) & (sums - room <= most[:, None])
                i, j = np.nonzero(may)
                for at in range(0, len(i), PAIRS):
                    self._closer(i[at : at + PAIRS] + a, j[at : at + PAIRS] + b, sums[i[at : at + PAIRS], j[at : at + PAIRS]], x, turned, rest, cuts, length * 1e-9, own, ids)

    def _closer(self, i, j, sums, x, turned, rest, cuts, length, own, ids) -> None:
        least, most = self.bounds(slice(None))
        for k, cut in enumerate(cuts[1:], 1):
            sums = sums + np.einsum("pc,pc->p", self.turned[i, cuts[k - 1] : cut], turned[j, cuts[k - 1] : cut])
            room = self.rest[k][i] * rest[k][j] + own[i] * length[j] + 1e-6
            stay = (sums + room >= least[i]) & (sums - room <= most[i])
            i, j, sums = i[stay], j[stay], sums[stay]
        self.verified += len(i)
        score = np.einsum("pc,pc->p", self.q[i].astype(np.int64), x[j].astype(np.int64))
        if self.high is None:
            good = score >= np.maximum(self.best.score[i, -1], self.least[i])
            self.best.take(i[good], score[good], ids[j[good]])
            return
        for w in range(self.high.shape[1]):
            slot = i * self.high.shape[1] + w
            good = (score >= self.low[i, w]) & (score <= self.high[i, w]) & (score >= self.least[slot])
            self.best.take(slot[good], score[good], ids[j[good]])


def plain(labels, ids, q, rows: list[tuple], k: int, high=None, low=None) -> Best:
    """The same by whole numbers of any size, for vectors whose products doubles can't hold."""
    width = 1 if high is None else high.shape[1]
    best = Best(len(q) * width, k)
    for a, own in enumerate([[int(v) for v in row] for row in q.tolist()]):
        for theirs, i, x in rows:
            s = np.array([max(NONE + 1, min(np.iinfo(np.int64).max, sum(u * int(v) for u, v in zip(own, row, strict=True)))) for row in x.tolist()], np.int64)
            may = ((theirs == labels[a]) == (high is None)) & (i != ids[a])
            for w in range(width):
                good = may if high is None else may & (s >= low[a, w]) & (s <= high[a, w])
                best.take(np.full(good.sum(), a * width + w), s[good], i[good])
    return best


def _meeting(k: int, axes: dict[int, np.ndarray], share: tuple[int, int] | None):
    """share: the range of scores in percent of the positives'; None: the positives themselves are looked for."""

    def whole(x: bytes) -> np.ndarray:
        return np.frombuffer(x, "<i8")

    def meet(shards: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for dim in sorted(set(blocks["dim"]) & set(shards["dim"])):
            numbers = lambda d: [np.frombuffer(x, kind).reshape(-1, dim).astype(np.float64) for x, kind in zip(d["data"], d["kind"], strict=True)]  # noqa: E731, B023
            mine, theirs = blocks[blocks["dim"] == dim].sort_values("no"), shards[shards["dim"] == dim].sort_values("no")
            ids, labels, least, positive = (np.concatenate([whole(x) for x in mine[c]]) for c in ("ids", "labels", "least", "positive"))
            q = np.concatenate(numbers(mine))
            high = low = None
            if share:
                high = np.concatenate([whole(x) for x in mine["high"]]).reshape(len(q), -1)
                # Scores are whole, so the bounds are rounded inwards; Python's numbers don't overflow.
                cut = lambda f: np.array([[max(NONE, min(-NONE - 1, f(s))) for s in r] for r in scores.tolist()], np.int64).reshape(scores.shape)  # noqa: E731, B023
                scores = high
                low, high = cut(lambda s: -(-share[0] * s // 100)), cut(lambda s: s * share[1] // 100)
            rows = [(whole(lab), whole(i), x) for lab, i, x in zip(theirs["labels"], theirs["ids"], numbers(theirs), strict=True)]
            if np.abs(q).max(initial=0) * max(np.abs(x).max(initial=0) for _, _, x in rows) * dim >= EXACT:
                best = plain(labels, ids, q, rows, k, high, low)
            else:
                search = Search(labels, ids, q, k, axes.get(dim), high, low, least)
                for row in rows:
                    search.run(*row)
                best = search.best
            good = best.score > NONE
            slot = np.repeat(np.arange(len(best.score)), k)[good.ravel()]
            width = high.shape[1] if share else 1
            zero = np.zeros(len(slot), np.int64)
            out.append((ids[slot // width], positive[slot] if share else zero, scores.ravel()[slot] if share else zero, best.id[good], best.score[good]))
        cols = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(5)]
        return pd.DataFrame(dict(zip(("anchor_id", "positive_id", "positive_score", "vec_id", "score"), cols, strict=True)))

    return meet


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each anchor and positive, with `rank`."""
    w = W.partitionBy("anchor_id", "positive_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, k_positive: int = 5, k_negative: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. vectors: id, label, v; is_anchor: a condition on id."""
    keep = Scratch(vectors.sparkSession)
    none = F.array().cast("array<long>")
    rows = keep(vectors.select("id", F.col("label").cast("long").alias("label"), "v"), "rows")
    anchors = keep(rows.filter(is_anchor).groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v"), "anchors")
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dim").first()
    n, dim = rows.count(), lengths["dim"] if lengths else 1
    axes = {dim: rotation(rows, dim)} if lengths and dim <= ROTATED else {}
    n_groups = max(GROUPS, -(-n * dim // TOGETHER))
    n_blocks = max(1, -(-anchors.count() * dim // TOGETHER))
    per_shard = min(SHARD, max(64, -(-n // (8 * n_groups))))
    shards = rows.select("id", "label", "v", *[none.alias(c) for c in ("positive", "high", "least")]).mapInArrow(_packed(per_shard), PACKED_DDL)
    shards = keep(shards.withColumn("g", F.expr(f"cast(pmod(xxhash64(no), {n_groups}) as int)")), "shards")

    def met(asked: DataFrame, k: int, groups: tuple[int, int], share: tuple[int, int] | None) -> DataFrame:
        """The anchors, in blocks, meet the groups of shards from the one number to the other."""
        theirs = shards.filter(F.col("g").between(*groups)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        blocks = asked.mapInArrow(_packed(SHARD), PACKED_DDL).withColumn("b", F.expr(f"cast(pmod(xxhash64(no), {n_blocks}) as int)")).withColumn("g", F.explode(F.sequence(*map(F.lit, groups))))
        return theirs.groupBy("g", "b").cogroup(blocks.groupBy("g", "b")).applyInPandas(_meeting(k, axes, share), FOUND)

    def searched(asked: DataFrame, k: int, share: tuple[int, int] | None, name: str) -> DataFrame:
        """asked: with arrays positive, high and least, as long as each other."""
        start = F.transform("positive", lambda x: F.lit(int(NONE)))
        first = keep(met(asked.withColumn("least", start), k, (0, 0), share), f"{name}-first")
        known = first.groupBy("anchor_id", "positive_id").agg(F.min("score").alias("s"), F.count("*").alias("n")).filter(F.col("n") == k)
        known = known.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("positive_id", "s"))).alias("known"))
        better = F.transform("positive", lambda x: F.coalesce(F.try_element_at("known", x), F.lit(int(NONE))))
        rest = asked.join(known, F.col("id") == F.col("anchor_id"), "left").withColumn("least", F.coalesce(better, start))
        return first.unionByName(met(rest.select("id", "label", "v", "positive", "high", "least"), k, (1, n_groups - 1), share))

    zero = F.array(F.lit(0).cast("long"))
    found = searched(anchors.withColumns({"positive": zero, "high": zero}), k_positive, None, "positives")
    positives = keep(_first(found, k_positive).select("anchor_id", "vec_id", "score"), "positives")
    # At most k_positive an anchor. A positive that stands several times asks once and gets its rows each time.
    each = positives.groupBy("anchor_id", "vec_id", "score").agg(F.count("*").alias("times"))
    lists = each.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("vec_id", "score", "times"))).alias("p"))
    # All have as many, so that they lie as a table; what is made up has a range that holds nothing.
    filled = lambda f, x: F.concat(F.transform("p", lambda p: p[f]), F.array_repeat(F.lit(x).cast("long"), F.lit(k_positive) - F.size("p")))
    asked = anchors.join(lists, F.col("id") == F.col("anchor_id")).select("id", "label", "v", filled("vec_id", int(NONE)).alias("positive"), filled("score", -1).alias("high"))
    found = searched(asked, k_negative, (low, high), "negatives").filter(F.col("positive_id") != int(NONE))
    out = _first(found, k_negative)
    out = out.join(each.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "times"), ["anchor_id", "positive_id", "positive_score"])
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    out = keep(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "out")
    keep.drop_but("out")
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "embeddings").filter("label is not null")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(scaled(d.withColumn("label", label), also=("label",)), F.col("id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
