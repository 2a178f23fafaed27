"""Signed manifests of an archive: a tree of digests over each file, and a chain of signatures over the batches.

A record's digest is over its key and payload, with their lengths. Digests of `FAN` neighbouring offsets make one, those of a
topic partition the next, those of a file its root; the tree depends on the records alone. A batch's files give the batch's
root. A manifest holds that, the chain up to it and a keyed digest (HMAC-SHA256) of the chain. So a byte that has changed
names its file, a manifest that has been left out or made up breaks the chain, and without the key none can be made.
"""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.versions import Files

FAN = 1024
START = hashlib.sha256(b"start").hexdigest()


def leaves(rows: DataFrame) -> DataFrame:
    """rows (topic, partition, offset, payload and more) with `leaf`, the record's digest in hex."""
    sized = lambda c: F.concat(F.encode(F.concat(F.octet_length(c).cast("string"), F.lit(":")), "UTF-8"), c)
    key = F.encode(F.concat_ws("-", "topic", F.col("partition").cast("string"), F.col("offset").cast("string")), "UTF-8")
    return rows.withColumn("leaf", F.sha2(F.concat(sized(key), sized(F.coalesce(F.col("payload"), F.unhex(F.lit(""))))), 256))


def _digest(at: str, *order: str) -> Column:
    """The digest over all digests of a group, in the stated order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, at))), lambda x: x[at]), ""), 256)


def roots(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, root of the records of each group; rows as `leaves` gives them. A list holds FAN digests, or a file's blocks."""
    d = rows.groupBy(*by, "topic", "partition", F.floor(F.col("offset") / FAN).alias("_block")).agg(_digest("leaf", "offset").alias("_d"))
    d = d.groupBy(*by, "topic", "partition").agg(_digest("_d", "_block").alias("_d"))
    return d.groupBy(*by).agg(_digest("_d", "topic", "partition").alias("root"))


def file_roots(spark: SparkSession, path: str) -> DataFrame:
    """file, records, firstOffset, lastOffset, root of every file below path."""
    rows = spark.read.parquet(path).select("topic", "partition", "offset", "payload", F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("file"))
    sums = rows.groupBy("file").agg(F.count("*").alias("records"), F.min("offset").alias("firstOffset"), F.max("offset").alias("lastOffset"))
    return sums.join(roots(leaves(rows), ["file"]), "file")


def _batch_root(files: DataFrame, root: str) -> str:
    return files.agg(_digest(root, "file").alias("r")).first()["r"]


def signature(key: bytes, chain: str) -> str:
    return hmac.new(key, chain.encode(), hashlib.sha256).hexdigest()


def written(spark: SparkSession, archive: str, batch_id: int) -> bool:
    """Whether the manifest of a batch stands; its files must not be touched then."""
    return Files(spark, archive).exists(f"{archive}-manifests/{batch_id:012d}.json")


def write_manifest(spark: SparkSession, archive: str, batch_id: int, key: bytes, previous: str | None = None) -> dict:
    """Write the manifest of a batch's files (`archive`/batch=N) beside them, unless it stands there; what it says.

    previous: the chain up to the batch before; by default that of the last manifest of an earlier batch.
    """
    files, at = Files(spark, archive), f"{archive}-manifests"
    name = f"{at}/{batch_id:012d}.json"
    if files.exists(name):
        return json.loads(files.read(name))
    if previous is None:
        before = [n for n in files.names(at) if n.endswith(".json") and n < f"{batch_id:012d}.json"]
        previous = json.loads(files.read(f"{at}/{before[-1]}"))["chain"] if before else START
    to = f"{at}/files-{batch_id:012d}"
    file_roots(spark, f"{archive}/batch={batch_id}").write.mode("overwrite").parquet(to)
    root = _batch_root(spark.read.parquet(to), "root")
    chain = hashlib.sha256(f"{batch_id}:{previous}:{root}".encode()).hexdigest()
    manifest = {"batch": batch_id, "previous": previous, "root": root, "chain": chain, "signature": signature(key, chain)}
    files.appear(name, json.dumps(manifest))
    return manifest


def verified(spark: SparkSession, archive: str, key: bytes) -> DataFrame:
    """batch, file, fault of everything that isn't as it was signed; empty if all is.

    Faults: CHANGED, MISSING and UNKNOWN files; a batch whose manifest's files, chain or signature don't agree: MANIFEST.
    """
    files, at = Files(spark, archive), f"{archive}-manifests"
    faults, previous, out = [], START, None
    for name in [n for n in files.names(at) if n.endswith(".json")]:
        m = json.loads(files.read(f"{at}/{name}"))
        said = spark.read.parquet(f"{at}/files-{m['batch']:012d}").select("file", F.col("root").alias("said"))
        chain = hashlib.sha256(f"{m['batch']}:{previous}:{_batch_root(said, 'said')}".encode()).hexdigest()
        if chain != m["chain"] or not hmac.compare_digest(m["signature"], signature(key, chain)):
            faults.append((m["batch"], None, "MANIFEST"))
        previous = m["chain"]
        now = file_roots(spark, f"{archive}/batch={m['batch']}").select("file", "root")
        fault = F.when(F.col("root").isNull(), "MISSING").when(F.col("said").isNull(), "UNKNOWN").when(F.col("said") != F.col("root"), "CHANGED")
        d = said.join(now, "file", "full_outer").select(F.lit(m["batch"]).cast("long").alias("batch"), "file", fault.alias("fault")).filter("fault is not null")
        out = d if out is None else out.unionByName(d)
    found = spark.createDataFrame(faults, "batch long, file string, fault string")
    return found if out is None else found.unionByName(out)
