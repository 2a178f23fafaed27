"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that Python workers get at once, unless the session asks for another number than Spark's default.
BATCH, BATCH_CONF = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, read by Spark only, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow in batches of few rows, as texts have any length; workers give back what memory a batch has used."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF) == "10000":
        conf.set(BATCH_CONF, str(BATCH))

    def fed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b
            trim()

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(fed(batches))
        trim()

    return df.mapInArrow(trimmed, schema)


def trim() -> None:
    """Give freed memory back to the system; a reused worker would keep it through all stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where the session names none, as in tests."""
    sc = spark.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tickloom-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there: a lost executor costs no recomputation before it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """The tables that one run of an operator writes to the shared folder, by name."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.names = spark, f"{shared_folder(spark)}/run-{uuid.uuid4().hex}", set()

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        """Write df; what comes after reads it and needs nothing before it."""
        df.write.parquet(f"{self.folder}/{name}")
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop_but(self, *names: str) -> None:
        """Delete all tables but these, once nothing that is still to run reads them."""
        for name in sorted(self.names - set(names)):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.names &= set(names)


def unclashing(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many lines before it as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def packed(df: DataFrame) -> list[Column]:
    """All columns of df as `caller_0`, `caller_1` and so on, so that no name of theirs meets one of ours."""
    return [c.alias(f"caller_{k}") for k, c in enumerate(columns(df))]


def restored(df: DataFrame, names: list[str], *added: str) -> DataFrame:
    """The caller's columns under their names, but for those that clash with the added ones, and the added ones."""
    taken = {c.lower() for c in added}
    return df.select(*[F.col(f"caller_{k}").alias(c) for k, c in enumerate(names) if c.lower() not in taken], *added)
