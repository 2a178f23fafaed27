"""Keyed tables that several readers see change together, one version after the other.

A version is a small file that names the parts of every table: one base and the changes since. It appears under its
number by one rename, when all its parts are written, so a reader sees all tables as of one batch or none of it. A batch
that is run again after its version has appeared changes nothing. After `compact_after` changes a new base is written;
parts and versions that the last `keep` versions don't name are deleted.

A batch writes only the keys that it changes. Reading takes each key's last change, or the sum of its changes (`Added`), an aggregate that starts on the map side.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GONE = "_gone"


class Added(list):
    """Key columns of a table whose changes add up: reading sums `sums` over all of a key's changes and takes the greatest of the others.

    A batch then writes what it adds, in as many rows of a key as it likes, and needs nothing of what stands there. Such a table loses no keys.
    """

    def __init__(self, keys: list[str], sums: list[str]):
        super().__init__(keys)
        self.sums = sums


class Files:
    """Small files in any store that Hadoop knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.root = self.at(path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        where = self.at(path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.at(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def appear(self, path: str, text: str) -> bool:
        """Write a file whole or not at all; False if there is one of this name."""
        draft = self.at(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(draft)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.fs.exists(self.at(path)) or not self.fs.rename(draft, self.at(path)):
            self.fs.delete(draft, False)
            return False
        return True

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.at(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self.at(path), True)


class Versions:
    """keys: the key columns of each table. A change whose column `_gone` is true takes its key out of the table."""

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, list[str]], compact_after: int = 8, keep: int = 3):
        self.spark, self.path, self.keys, self.compact_after, self.keep = spark, path, keys, compact_after, keep
        self.files = Files(spark, path)

    def _all(self) -> list[str]:
        return [n for n in self.files.names(f"{self.path}/versions") if n.isdigit()]

    def numbered(self, number: int) -> dict:
        return json.loads(self.files.read(f"{self.path}/versions/{number:012d}")) | {"number": number}

    def current(self, before: int | None = None) -> dict | None:
        """The last version, or the last that is of a batch before the stated one; null if there is none."""
        for name in reversed(self._all()):
            version = self.numbered(int(name))
            if before is None or version["batch"] < before:
                return version
        return None

    def read(self, table: str, version: dict | None) -> DataFrame | None:
        """A table as of a version that `current` gave: pass the same to all that must agree. Null before the first."""
        if version is None or not version["parts"].get(table):
            return None
        schema = T.StructType.fromJson(version["schema"][table])
        return self._merged(table, [self.spark.read.schema(schema).parquet(p) for p in version["parts"][table]])

    def _merged(self, table: str, parts: list[DataFrame]) -> DataFrame:
        numbered = [p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)]
        every = numbered[0]
        for p in numbered[1:]:
            every = every.unionByName(p)
        keys, rest = self.keys[table], [c for c in parts[0].columns if c not in self.keys[table]]
        if isinstance(keys, Added):
            return every.groupBy(*keys).agg(*[(F.sum if c in keys.sums else F.max)(c).alias(c) for c in rest if c != GONE])
        last = every.groupBy(*self.keys[table]).agg(F.max_by(F.struct(*rest), "_part").alias("_last"))
        d = last.select(*self.keys[table], *[F.col(f"_last.{c}").alias(c) for c in rest])
        return d.filter(f"not {GONE}").drop(GONE) if GONE in rest else d

    def publish(self, batch_id: int, changes: dict[str, DataFrame]) -> bool:
        """Write the changes of a batch, at most one a key (of `Added` any number), and let them appear as one version; False if they have before."""
        now = self.current()
        if now and batch_id <= now["batch"]:
            return False
        now = now or {"number": -1, "parts": {}, "schema": {}}
        parts, schema = dict(now["parts"]), dict(now["schema"])
        for table, df in changes.items():
            if GONE not in df.columns:
                df = df.withColumn(GONE, F.lit(False))
            schema.setdefault(table, df.schema.jsonValue())
            df = df.select(*T.StructType.fromJson(schema[table]).names)
            parts[table] = [*parts.get(table, []), self._write(table, df, f"changes-{batch_id}")]
            if len(parts[table]) > self.compact_after:
                read = self.spark.read.schema(T.StructType.fromJson(schema[table]))
                whole = self._merged(table, [read.parquet(p) for p in parts[table]]).withColumn(GONE, F.lit(False))
                parts[table] = [self._write(table, whole.select(*df.columns), f"base-{batch_id}")]
        version = {"batch": batch_id, "parts": parts, "schema": schema}
        if not self.files.appear(f"{self.path}/versions/{now['number'] + 1:012d}", json.dumps(version)):
            raise RuntimeError("another writer has published a version meanwhile")
        self._clean()
        return True

    def _write(self, table: str, df: DataFrame, name: str) -> str:
        to = f"{self.path}/{table}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(to)
        return to

    def _clean(self) -> None:
        names = self._all()
        old, kept = names[: -self.keep], names[-self.keep :]
        if not old:
            return
        parts = lambda some: {p for n in some for ps in json.loads(self.files.read(f"{self.path}/versions/{n}"))["parts"].values() for p in ps}
        for p in parts(old) - parts(kept):
            self.files.delete(p)
        for n in old:
            self.files.delete(f"{self.path}/versions/{n}")
