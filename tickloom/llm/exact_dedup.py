"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition turns its rows into one run, sorted by digest, in which equal digests are already
merged: smallest identifier, number of rows, number of rows with that identifier, and a second checksum.
Runs are cut by digest range into buckets, so that no task ever holds all digests. Within each bucket the
runs meet in binomial rounds: in round r the runs whose numbers agree but for their r-th digit (to the base
`fan_in`) are merged by one task into one run, until one run is left for each bucket. Every merge keeps the
smallest identifier and verifies the second checksum, which is of another kind, and the length, so that two
texts with one digest would stop the job instead of losing one.

A group of copies of any size enters a run as one entry, so it is never gathered. Only groups of two rows or
more leave the last round; they are joined to the rows by digest, a join whose large partitions Spark splits.

Defined results: a null text counts as empty; a null doc_id ranks after all others; of rows that agree in
text and smallest doc_id exactly one stays, whichever; an empty table gives an empty result; other columns of
the input may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, by_batches, packed, restored, table, trim

RUN = np.dtype([("digest", "S32"), ("no_id", "u1"), ("id", "<i8"), ("rows", "<i8"), ("ties", "<i8"), ("check", "<i8"), ("bytes", "<i8")])
#: Python's white space of the contract: runs of these become one space.
SPACES = r"[\x20\x09-\x0D]+"


def merge(runs: list[np.ndarray]) -> np.ndarray:
    """One sorted run with an entry for each digest. Sorting by merges makes one pass over sorted parts."""
    all_ = np.concatenate(runs)
    if not len(all_):
        return all_
    all_ = all_[np.lexsort((all_["id"], all_["no_id"]))] if len(runs) == 1 else all_
    all_ = all_[np.argsort(all_["digest"], kind="stable")]
    first = np.flatnonzero(np.r_[True, all_["digest"][1:] != all_["digest"][:-1]])
    of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(all_)]))
    if (all_["check"] != all_["check"][first][of]).any() or (all_["bytes"] != all_["bytes"][first][of]).any():
        raise ValueError("two different texts have one digest")
    out = all_[first].copy()
    out["no_id"] = np.minimum.reduceat(all_["no_id"], first)
    ids = np.where(all_["no_id"] == out["no_id"][of], all_["id"], np.iinfo(np.int64).max)
    out["id"] = np.minimum.reduceat(ids, first)
    out["rows"] = np.add.reduceat(all_["rows"], first)
    least = (all_["no_id"] == out["no_id"][of]) & (all_["id"] == out["id"][of])
    out["ties"] = np.add.reduceat(np.where(least, all_["ties"], 0), first)
    return out


def _runs(buckets: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts: list[np.ndarray] = []
        held = 0
        for b in batches:
            rows = np.zeros(b.num_rows, RUN)
            rows["digest"] = np.frombuffer(b.column("digest").cast(pa.binary(32)).buffers()[1], "S32", b.num_rows, b.column("digest").offset * 32) if b.num_rows else b""
            rows["no_id"] = b.column("id").is_null().to_numpy(zero_copy_only=False)
            rows["id"] = b.column("id").fill_null(0).to_numpy()
            rows["check"], rows["bytes"] = b.column("check").to_numpy(), b.column("bytes").to_numpy()
            rows["rows"] = rows["ties"] = 1
            parts.append(merge([rows]))
            held += len(parts[-1])
            if held > 2_000_000:
                parts = [merge(parts)]
                held = len(parts[0])
        run = merge(parts) if parts else np.zeros(0, RUN)
        if len(run):
            heads = run["digest"].astype("S4").view("S4")
            at = np.array([int.from_bytes(x.ljust(4, b"\0"), "big") for x in heads.tolist()], np.uint64) * np.uint64(buckets) >> np.uint64(32)
            cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True])
            n = TaskContext.get().partitionId()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield pa.RecordBatch.from_pylist([{"bucket": int(at[a]), "run": n, "data": run[a:b].tobytes()}], pa.schema([("bucket", pa.int32()), ("run", pa.int64()), ("data", pa.binary())]))

    return runs


def _merged(key, pdf: pd.DataFrame) -> pd.DataFrame:
    run = merge([np.frombuffer(x, RUN) for x in pdf["data"]])
    return pd.DataFrame({"bucket": [key[0]], "run": [key[1]], "data": [run.tobytes()]})


def _merged_groups(pdf: pd.DataFrame) -> pd.DataFrame:
    """The last merge of a bucket, and of its run the groups of two rows or more: one Python worker for both."""
    run = merge([np.frombuffer(x, RUN) for x in pdf["data"]])
    run = run[run["rows"] > 1]
    ids = [None if n else i for n, i in zip(run["no_id"].tolist(), run["id"].tolist(), strict=True)]
    out = pd.DataFrame({"digest": pd.Series([x.ljust(32, b"\0") for x in run["digest"].tolist()], dtype=object), "keep_id": pd.array(ids, "Int64"), "group_size": run["rows"].copy(), "ties": run["ties"].copy()})
    trim()
    return out


def groups(rows: DataFrame, fan_in: int = 8, buckets: int | None = None) -> DataFrame:
    """digest, keep_id, group_size, ties of every digest with two rows or more.

    rows: digest (32 bytes), id (long), check (long), bytes (long).
    """
    n = rows.rdd.getNumPartitions()
    buckets = buckets or max(16, min(65536, n))
    runs = by_batches(rows, _runs(buckets), "bucket int, run long, data binary")
    rounds = math.ceil(math.log(max(n, 2), fan_in) - 1e-9)
    for k in range(1, rounds + 1):
        met = runs.withColumn("run", F.floor(F.col("run") / fan_in)).groupBy("bucket", "run")
        if k == rounds:
            return met.applyInPandas(_merged_groups, "digest binary, keep_id long, group_size long, ties long")
        runs = met.applyInPandas(_merged, "bucket int, run long, data binary")
    raise AssertionError("there is one round at least")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """caller_0 and so on (the columns of docs), digest, keep_id, group_size, kept of every row of docs."""
    keep = Scratch(docs.sparkSession)
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    ident = F.col(id_col).cast("long").alias("id")
    marked = docs.select(*packed(docs), ident, F.unhex(F.sha2(text, 256)).alias("digest"))
    found = groups(docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), ident, F.xxhash64(text).alias("check"), F.octet_length(text).cast("long").alias("bytes")), fan_in)
    found = keep(found.withColumnRenamed("digest", "found"), "groups")
    alone = F.col("found").isNull()
    all_ = marked.join(found, F.col("digest") == F.col("found"), "left")
    all_ = all_.withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long"))).withColumn("keep_id", F.when(alone, F.col("id")).otherwise(F.col("keep_id")))
    least = alone | F.col("id").eqNullSafe(F.col("keep_id"))
    if found.filter("ties > 1").isEmpty():
        out = all_.withColumn("kept", least)
    else:  # rows that agree in text and doc_id are rare; only they are numbered, each by where it is written
        tied = least & (F.coalesce("ties", F.lit(1)) > 1)
        some = keep(all_.filter(tied).withColumn("at", F.monotonically_increasing_id()), "tied")
        first = some.groupBy("digest").agg(F.min("at").alias("first"))
        out = all_.filter(~tied).withColumn("kept", least).unionByName(some.join(first, "digest").withColumn("kept", F.col("at") == F.col("first")).drop("at", "first"))
    return out.select(*[f"caller_{k}" for k in range(len(docs.columns))], "digest", "keep_id", "group_size", "kept")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with the columns of docs."""
    return restored(exact_groups(docs).filter("kept"), docs.columns)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = exact_groups(docs).withColumn("text_sha256", F.lower(F.hex("digest")))
    return restored(out, docs.columns, "keep_id", "group_size", "kept", "text_sha256").drop("text")


OP6_SQL = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
"""
