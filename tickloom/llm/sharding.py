"""Consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into a fixed number of cells. A key's cell comes from a hash of its row; every shard owns
`vnodes` cells, and a key belongs to the first virtual node at or after its cell. A shard takes keys only up
to its capacity; what overflows continues clockwise to the next virtual node whose shard has room.

Keys are placed in ring order, so where they end depends only on how many keys each cell holds. Those counts
(at most `CELLS` rows, whatever the input) are all the driver sees; it turns them into at most
`CELLS + shards * vnodes` rank intervals, which are joined back to the rows by cell. Texts are never shuffled.

With slack 0 the capacities are the floor and the ceiling of rows / shards, so that counts differ by one at
most (law `rows`). The shards that would be fullest without bounds get the ceilings, which moves fewest keys.
With slack e > 0 each shard takes up to (1 + e) times the mean.

Defined results: a null text has size 1 and the checksum of the empty text; a null doc_id is hashed like any
value; repeated rows are separate keys, and which of two identical rows gets which slot is arbitrary; an empty
table gives an empty result; texts of any length are read where they stand; columns of the input that clash with
those added are replaced.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, packed, restored, table

#: Cells of the ring; a power of two. It bounds the counts that reach the driver.
CELLS = 8192
#: Keys that one row is spread to at once.
STEP = 65_536


def ring(n_shards: int, vnodes: int, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise. A node's place doesn't depend on the number of shards."""
    if n_shards < 1 or vnodes < 1 or n_shards * vnodes > cells:
        raise ValueError("need at least one shard and one virtual node, and no more nodes than cells")
    taken: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big") % cells
            while at in taken:
                at = (at + 1) % cells
            taken[at] = shard
    return sorted(taken.items())


def capacities(counts: dict[int, int], nodes: list[tuple[int, int]], n_shards: int, slack: float) -> list[int]:
    """Rows that each shard may take."""
    n = sum(counts.values())
    if slack > 0:
        return [-(-int(n * (1 + slack) * 1000) // (1000 * n_shards)) + 1] * n_shards
    load = [0] * n_shards
    node = 0
    for cell in sorted(counts):
        while node < len(nodes) and nodes[node][0] < cell:
            node += 1
        load[nodes[node % len(nodes)][1]] += counts[cell]
    fullest = sorted(range(n_shards), key=lambda s: (-load[s], s))[: n % n_shards]
    return [n // n_shards + (s in fullest) for s in range(n_shards)]


def walk(counts: dict[int, int], nodes: list[tuple[int, int]], n_shards: int, slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot): where the keys of each cell go."""
    room = capacities(counts, nodes, n_shards, slack)
    used, out = [0] * n_shards, []
    ahead = list(range(1, len(nodes))) + [0]  # the next node that may have room, shortened as shards fill

    def with_room(i: int) -> int:
        seen = []
        while used[nodes[i][1]] >= room[nodes[i][1]]:
            seen.append(i)
            i = ahead[i]
        for x in seen:
            ahead[x] = i
        return i

    node = 0
    for cell in sorted(counts):
        while node < len(nodes) and nodes[node][0] < cell:
            node += 1
        rank, left, at = 0, counts[cell], node % len(nodes)
        while left:
            at = with_room(at)
            shard = nodes[at][1]
            take = min(left, room[shard] - used[shard])
            out.append((cell, rank, rank + take, shard, used[shard]))
            used[shard] += take
            rank += take
            left -= take
    return out


def place(df: DataFrame, key: list[Column], n_shards: int = 16, vnodes: int = 64, slack: float = 0.0, times: Column | None = None) -> DataFrame:
    """df with `shard` (int) and `slot` (long, gapless from 0 in each shard). times: how many keys a row stands for."""
    spark, callers = df.sparkSession, [f"caller_{k}" for k in range(len(df.columns))]
    times = F.lit(1).cast("long") if times is None else times.cast("long")
    keyed = df.select(*packed(df), F.xxhash64(*key).alias("at"), F.struct(*key).alias("key"), times.alias("times")).withColumn("cell", F.expr(f"cast(pmod(at, {CELLS}) as int)"))
    nodes = ring(n_shards, vnodes)
    counts = {r["cell"]: r["n"] for r in keyed.groupBy("cell").agg(F.sum("times").alias("n")).collect()}
    plan = walk(counts, nodes, n_shards, slack)
    parts = json.dumps([dict(zip(("c", "a", "b", "s", "o"), x, strict=True)) for x in plan])
    plan_df = spark.range(1).select(F.inline(F.from_json(F.lit(parts), "array<struct<c:int,a:bigint,b:bigint,s:int,o:bigint>>")))
    ranked = keyed.withColumn("end", F.sum("times").over(W.partitionBy("cell").orderBy("at", "key").rowsBetween(W.unboundedPreceding, 0))).withColumn("first", F.col("end") - F.col("times"))
    # The plan has at most CELLS + shards * vnodes rows, so it may be broadcast whatever the input.
    joined = ranked.join(F.broadcast(plan_df), (F.col("cell") == F.col("c")) & (F.col("first") < F.col("b")) & (F.col("end") > F.col("a")))
    # A row that stands for many keys is spread in two steps, so that no list gets long.
    low, high = F.greatest("first", "a"), F.least("end", "b")
    step = F.explode(F.sequence(low, high - 1, F.lit(STEP).cast("long")))
    some = joined.select(*callers, F.col("s").alias("shard"), (F.col("o") - F.col("a")).alias("off"), high.alias("high"), step.alias("low"))
    each = some.select(*callers, "shard", "off", F.explode(F.sequence(F.col("low"), F.least(F.col("low") + STEP, F.col("high")) - 1)).alias("rank"))
    return restored(each.withColumn("slot", F.col("off") + F.col("rank")), df.columns, "shard", "slot")


def shard_documents(docs: DataFrame, n_shards: int = 16, vnodes: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, under the law `rows`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    # Rows that are alike are counted in each partition, so any number of them takes few rows of their cell.
    alike = rows.withColumn("part", F.spark_partition_id()).groupBy("doc_id", "size", "text_crc32", "part").agg(F.count("*").alias("n"))
    alike = Scratch(docs.sparkSession)(alike, "alike")
    placed = place(alike, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], n_shards, vnodes, times=F.col("n"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
