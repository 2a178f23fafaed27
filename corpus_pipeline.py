"""A training corpus from raw documents: five stages, each an operator of tickloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents.

Defined results of every stage: a null text counts as empty; empty and very long texts are worked on like any
other; an empty table gives an empty table; extra columns of any name come back as they were, in the last stage
those that are neither doc_id, lang nor source are left out. What ties, repeated rows and null doc_ids mean is
stated for each stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from tickloom.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that score under the threshold; equal texts score alike, so repeated rows go or stay together."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id, null last; of rows that tie in that, any one."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the document with the smallest doc_id, with all its rows; a null doc_id or a text without words stays."""
    return near_dedup.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, up to twice; no document is left out, and repeated rows are drawn each for itself."""
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, and whether decoding gives the text again, of every row."""
    out = bpe.encoded(docs.select("doc_id", "lang", "source", "text"), *bpe.rank_file(), check=True)
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").alias("n_tokens"), "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: Learned weights, signatures and merges can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
