"""Exact top-k inner-product search by branch and bound in a ball tree for each shard.

Vectors are packed into shards of `SHARD` rows, and the stated queries into blocks. Each group of shards meets
each group of query blocks once. Within such a meeting every shard gets a ball tree; a query descends first
into the child whose upper bound (inner product with the centre, plus the query's length times the radius) is
larger, and leaves out a node whose bound is under its current k-th score. That score is carried from leaf to
leaf and from shard to shard. One group of shards goes first; the k-th scores that it finds go with the queries
to all others, which leave out and return nothing under them, so what meets in the last step is little more
than k rows a query, however many groups there are.

Where products may be beyond what doubles hold exactly, scores are taken by whole numbers of any size, one by
one and without the tree: the same results, for vectors with components of some 10^7 and more only.

Components are scaled to integers, so scores are exact and ties are true ties; a node is left out only if
its bound is strictly under the k-th score, as an equal score may have a smaller identifier.

Defined results: a vector that is null or empty, or holds null or a value that isn't finite, or whose
identifier is null takes no part; vectors of different lengths are not compared; rows that share the query's
identifier count as its own row; a repeated query row asks once and a repeated candidate counts for each row;
a query without candidates has no result; scores that a long can't hold are cut to its limits; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table

SHARD = 4096
LEAF = 128
#: Shards and query blocks that meet in one task.
SHARDS_TOGETHER, BLOCKS_TOGETHER = 16, 8
#: Integers up to this are exact as doubles.
EXACT = float(1 << 53)


class BallTree:
    """Nodes as (centre, radius, first row, end row, left child, right child); children -1 in leaves."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.nodes: list[list] = []
        todo = [(0, len(x), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            rows = x[self.order[a:b]]
            centre = rows.mean(axis=0)
            away = rows - centre
            radius = float(np.sqrt((away * away).sum(axis=1).max()))
            me = len(self.nodes)
            self.nodes.append([centre, radius, a, b, -1, -1])
            if parent >= 0:
                self.nodes[parent][4 + side] = me
            if b - a > leaf and radius > 0:
                mid = (b - a) // 2
                part = np.argpartition(rows[:, away.var(axis=0).argmax()], mid)
                self.order[a:b] = self.order[a:b][part]
                todo += [(a, a + mid, me, 0), (a + mid, b, me, 1)]
        self.x, self.ids = x[self.order], ids[self.order]


class Search:
    """The best k candidates so far of each query in a block."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, least: np.ndarray | None = None):
        self.ids, self.q, self.k = ids, q, k
        self.least = np.full(len(q), -np.inf) if least is None else least  # scores under these are of no use
        self.length = np.sqrt((q * q).sum(axis=1))
        self.score = np.full((len(q), k), -np.inf)
        self.found = np.full((len(q), k), np.iinfo(np.int64).max)
        self.leaves = 0

    def bound(self, node: list, who: np.ndarray) -> np.ndarray:
        bound = self.q[who] @ node[0] + self.length[who] * node[1]
        return bound + 1e-9 * np.abs(bound) + 1e-9 * self.length[who] * (node[1] + np.sqrt(node[0] @ node[0])) + 1e-6

    def run(self, tree: BallTree) -> None:
        if len(self.q):
            self._descend(tree, 0, np.arange(len(self.q)))

    def _descend(self, tree: BallTree, at: int, who: np.ndarray) -> None:
        node = tree.nodes[at]
        who = who[self.bound(node, who) >= np.maximum(self.score[who, -1], self.least[who])]
        if not len(who):
            return
        if node[4] < 0:
            self._leaf(tree, node[2], node[3], who)
            return
        left_first = self.bound(tree.nodes[node[4]], who) >= self.bound(tree.nodes[node[5]], who)
        for some, children in ((who[left_first], (4, 5)), (who[~left_first], (5, 4))):
            for c in children:
                if len(some):
                    self._descend(tree, node[c], some)

    def _leaf(self, tree: BallTree, a: int, b: int, who: np.ndarray) -> None:
        self.leaves += 1
        ids = tree.ids[a:b]
        s = self.q[who] @ tree.x[a:b].T
        s[self.ids[who][:, None] == ids[None, :]] = -np.inf
        s[s < self.least[who][:, None]] = -np.inf
        hit = ((s >= self.score[who, -1:]) & (s > -np.inf)).any(axis=1)
        if hit.any():
            who, s = who[hit], s[hit]
            score = np.concatenate([self.score[who], s], axis=1)
            found = np.concatenate([self.found[who], np.broadcast_to(ids, s.shape)], axis=1)
            best = np.lexsort((found, -score), axis=1)[:, : self.k]
            self.score[who] = np.take_along_axis(score, best, axis=1)
            self.found[who] = np.take_along_axis(found, best, axis=1)


def plain(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, candidate, score) by whole numbers of any size, for vectors whose products doubles can't hold."""
    big = [[int(v) for v in row] for row in x.tolist()]
    for qid, row in zip(qids.tolist(), q.tolist(), strict=True):
        own = [int(v) for v in row]
        best = sorted((-sum(u * v for u, v in zip(own, c, strict=True)), i) for i, c in zip(ids.tolist(), big, strict=True) if i != qid)[:k]
        yield from ((qid, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for s, i in best)


def _packed(rows: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, tuple[list, list, list]] = {}
        part, n = TaskContext.get().partitionId(), 0
        schema = pa.schema([("no", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("data", pa.binary()), ("least", pa.binary())])

        def out(dim: int):
            nonlocal n
            ids, vectors, least = held.pop(dim)
            n += 1
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | n]), pa.array([dim], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()]), pa.array([np.concatenate(vectors).astype("<f8").tobytes()]), pa.array([np.array(least, "<f8").tobytes()])], schema=schema)

        for b in batches:
            vectors = b.column("v")
            flat, at = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            for k, (i, x) in enumerate(zip(b.column("id").to_pylist(), b.column("least").to_pylist(), strict=True)):
                dim = int(at[k + 1] - at[k])
                ids, own, least = held.setdefault(dim, ([], [], []))
                ids.append(i)
                least.append(-np.inf if x is None else x)
                own.append(flat[at[k] : at[k + 1]])
                if len(ids) == rows:
                    yield out(dim)
        for dim in list(held):
            yield out(dim)

    return pack


def _meeting(k: int):
    def meet(shards: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for dim in sorted(set(blocks["dim"]) & set(shards["dim"])):
            mine = blocks[blocks["dim"] == dim].sort_values("no")
            qids = np.concatenate([np.frombuffer(x, "<i8") for x in mine["ids"]])
            q = np.concatenate([np.frombuffer(x, "<f8") for x in mine["data"]]).reshape(-1, dim)
            theirs = shards[shards["dim"] == dim].sort_values("no")
            parts = [(np.frombuffer(i, "<i8"), np.frombuffer(x, "<f8").reshape(-1, dim)) for i, x in zip(theirs["ids"], theirs["data"], strict=True)]
            if np.abs(q).max(initial=0) * max(np.abs(x).max(initial=0) for _, x in parts) * dim >= EXACT:
                rows = list(plain(qids, q, np.concatenate([i for i, _ in parts]), np.concatenate([x for _, x in parts]), k))
                out.append(tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3)
                continue
            search = Search(qids, q, k, np.concatenate([np.frombuffer(x, "<f8") for x in mine["least"]]))
            for ids, x in parts:
                search.run(BallTree(ids, x))
            good = search.score > -np.inf
            out.append((np.repeat(qids, k)[good.ravel()], search.found[good], search.score[good].astype(np.int64)))
        cols = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(3)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    return meet


def scaled(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding", scale: int = 256, also: tuple[str, ...] = ()) -> DataFrame:
    """id, v (array of whole doubles) of the vectors that take part, and what else is asked for."""
    ok = F.col(id_col).isNotNull() & (F.size(col) > 0) & F.forall(col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return vectors.filter(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(col, lambda x: _floor(F.lit(float(scale)) * x.cast("double"))).alias("v"), *also)


def _floor(x):
    """floor as a double, as large values don't fit in a long."""
    whole = F.rint(x)
    return whole - F.when(whole > x, 1.0).otherwise(0.0)


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score. vectors: id, v; is_query: a condition on id."""
    keep = Scratch(vectors.sparkSession)
    out = "no long, dim int, ids binary, data binary, least binary"
    asked = keep(vectors.filter(is_query).distinct(), "asked")
    n, n_asked = vectors.count(), asked.count()
    n_groups = max(8, -(-n // (SHARD * SHARDS_TOGETHER)))
    per_shard = min(SHARD, max(64, -(-n // 64)))
    n_blocks = max(1, -(-n_asked // (1024 * BLOCKS_TOGETHER)))
    none = F.lit(None).cast("double").alias("least")
    shards = keep(vectors.select("id", "v", none).mapInArrow(_packed(per_shard), out).withColumn("g", F.expr(f"cast(pmod(xxhash64(no), {n_groups}) as int)")), "shards")

    def met(some: DataFrame, queries: DataFrame, groups: list[int]) -> DataFrame:
        """The stated queries, in blocks, meet the groups of shards."""
        theirs = some.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        blocks = queries.mapInArrow(_packed(1024), out).withColumn("b", F.expr(f"cast(pmod(xxhash64(no), {n_blocks}) as int)")).withColumn("g", F.explode(F.sequence(*map(F.lit, groups))))
        return theirs.groupBy("g", "b").cogroup(blocks.groupBy("g", "b")).applyInPandas(_meeting(k), "query_id long, vec_id long, score long")

    first = keep(met(shards.filter("g = 0"), asked.select("id", "v", none), [0, 0]), "first")
    # Of a query that is asked with several vectors the scores are not told apart, so nothing is left out for it.
    known = first.groupBy("query_id").agg(F.min("score").cast("double").alias("least"), F.count("*").alias("n")).filter(F.col("n") == k)
    once = asked.groupBy("id").agg(F.count("*").alias("times")).filter("times = 1")
    known = known.join(once, F.col("query_id") == F.col("id"), "left_semi")
    # A long's limits stand for scores beyond them.
    known = known.filter(F.abs("least") < EXACT).select(F.col("query_id").alias("id"), "least")
    best = first.unionByName(met(shards.filter("g > 0"), asked.join(known, "id", "left").select("id", "v", "least"), [1, n_groups - 1]))
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(scaled(table(spark, sf_dir, "embeddings")), F.col("id") % 50 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
