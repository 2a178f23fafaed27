"""Cohort retention matrix over bucketed tables.

Clicks, starts and clients are written as tables that are bucketed and sorted by client, with as many buckets as the
session has shuffle partitions. All that follows joins them bucket by bucket, by sort-merge joins without a shuffle:
a click meets its client's start and segment, and each bucket adds up partial cells. Only these cells are shuffled;
their number is bounded by states, segments and pairs of days, whatever the clicks.

A client with more than `1 / (4 * buckets)` of the clicks is cut into pieces, by a hash of the click, which are buckets'
keys of their own; its start and segment stand in each. There are at most `4 * buckets` such clients, which bounds the
list of them that is broadcast. Where a piece only knows its own clicks of a client, the client's partial cells of all
pieces are brought together before it is counted, once.

Equal clicks are counted once by a 128-bit digest of the row, in an aggregate that begins before the shuffle, so that
it makes no difference how often a row is repeated.

Defined results: a null ts or client_id drops the click; a null click_id arrives when arrived_at says, a null
arrived_at is known to the state without a limit only; a value that is null, not finite or beyond a long as cents counts
as 0; rows are equal if all seven columns are, whatever else they have, -0.0 and 0.0 being equal; of a client with
several rows in `clients` the least segment that isn't null holds; clients without a start and empty tables have no
rows; props of any length are only digested; columns of other names are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

DAY_US = 86_400_000_000
#: Microseconds of 2024-02-15 00:00, up to which state 0 knows.
CUT_US = 1_707_955_200_000_000
#: Clicks of a client that are never cut into pieces.
LEAST = 1000
KEY = ["client_id", "piece"]


def micros(col: str) -> Column:
    """Microseconds of a timestamp as it is written, in any session time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({col} as timestamp_ntz))")


def _crc(col: str) -> Column:
    return F.crc32(F.col(col).cast("string"))


def _cents() -> Column:
    x = F.lit(100.0) * F.col("value").cast("double") + 0.5
    return F.coalesce(F.when(F.abs(x) < 9.2e18, F.floor(x)), F.lit(0)).cast("long")


def _digest() -> Column:
    """128 bits of what makes clicks of one client and time equal; each part with its length, so that none runs into the next."""
    parts = [F.col("click_id").cast("string"), F.col("arrived_at").cast("string"), F.col("kind"), (F.col("value").cast("double") + F.lit(0.0)).cast("string"), F.col("props")]
    sized = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.substring(F.unhex(F.sha2(F.concat(*sized), 256)), 1, 16)


def usable(clicks: DataFrame, cut_us: int = CUT_US) -> DataFrame:
    """client_id, us, early (known to state 0), signup, cents, digest of the clicks that take part; repeated rows as they are."""
    h = _crc("click_id")
    arrives = micros("arrived_at") + F.coalesce(F.when(h % 3 == 0, h % 100 * DAY_US), F.lit(0))
    d = clicks.filter("ts is not null and client_id is not null")
    return d.select(F.col("client_id").cast("long").alias("client_id"), micros("ts").alias("us"), F.coalesce(arrives < cut_us, F.lit(False)).alias("early"), F.coalesce(F.col("kind") == "signup", F.lit(False)).alias("signup"), _cents().alias("cents"), _digest().alias("digest"))


def starts(clicks: DataFrame) -> DataFrame:
    """client_id, start0, start1: the first signup that is known to either state."""
    d = clicks.filter("signup").groupBy("client_id")
    return d.agg(F.min(F.when(F.col("early"), F.col("us"))).alias("start0"), F.min("us").alias("start1"))


def split_clients(clicks: DataFrame, n_buckets: int, least: int = LEAST) -> DataFrame:
    """client_id, pieces of the clients that are cut; at most 4 * n_buckets rows."""
    limit = max(least, -(-clicks.count() // (4 * n_buckets)))
    return clicks.groupBy("client_id").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("client_id", F.ceil(F.col("n") / limit).cast("int").alias("pieces"))


class Tables:
    """The bucketed tables of one run."""

    def __init__(self, spark: SparkSession, n_buckets: int):
        self.spark, self.n, self.prefix, self.names = spark, n_buckets, f"cohorts_{uuid.uuid4().hex}", []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        """Write df bucketed and sorted by client and piece, a file for each bucket."""
        self.names.append(f"{self.prefix}_{name}")
        df.repartition(self.n, *KEY).write.bucketBy(self.n, *KEY).sortBy(*KEY).saveAsTable(self.names[-1])
        return self.spark.table(self.names[-1])

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def in_pieces(df: DataFrame, split: DataFrame) -> DataFrame:
    """A row for each piece of its client."""
    d = df.join(F.broadcast(split), "client_id", "left")
    return d.withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))).drop("pieces")


def partial_cells(clicks: DataFrame, started: DataFrame, segments: DataFrame, period_days: int = 1, cohort_days: int = 1) -> DataFrame:
    """For each client, piece, state and period its cell and cents. No shuffle: all three come bucketed by client and piece."""
    d = clicks.join(started.hint("merge"), KEY).join(segments.hint("merge"), KEY, "left")
    # Whole numbers throughout, as a double doesn't hold all microseconds.
    cohort = lambda us: F.expr(f"({us} - pmod({us}, {DAY_US * cohort_days})) div {DAY_US * cohort_days}")
    states = F.array(F.struct(F.lit(0).alias("state"), F.when(F.col("early"), F.col("start0")).alias("start")), F.struct(F.lit(1).alias("state"), F.col("start1").alias("start")))
    d = d.withColumn("moved", F.coalesce(cohort("start0") != cohort("start1"), F.lit(False)).cast("long"))
    d = d.select(*KEY, "split", "us", "cents", "moved", F.coalesce("segment", F.lit("")).alias("segment"), F.inline(states)).filter("us >= start")
    d = d.select(*KEY, "split", "segment", "state", cohort("start").alias("cohort"), F.expr(f"(us - start) div {DAY_US * period_days}").alias("period"), "moved", "cents")
    return d.groupBy(*KEY, "split", "segment", "state", "cohort", "period", "moved").agg(F.sum("cents").alias("cents"))


def summed(partial: DataFrame) -> DataFrame:
    """The matrix. Cells of clients in pieces are first brought together by client."""
    cell = ["state", "segment", "cohort", "period"]
    key = F.when(F.col("split"), F.col("client_id")).alias("alone")
    d = partial.select(*cell, key, _crc("client_id").alias("crc"), "moved", "cents").groupBy(*cell, "alone")
    d = d.agg(F.count("*").alias("n"), F.sum("crc").alias("crcs"), F.max("crc").alias("crc"), F.sum("moved").alias("moves"), F.max("moved").alias("moved"), F.sum("cents").alias("cents"))
    each = lambda one, many: F.sum(F.when(F.col("alone").isNull(), F.col(many)).otherwise(one)).cast("long")
    return d.groupBy(*cell).agg(each(F.lit(1), "n").alias("users"), each(F.col("crc"), "crcs").alias("users_crc32"), each(F.col("moved"), "moves").alias("moved"), F.sum("cents").cast("long").alias("cents"))


def retention(clicks: DataFrame, clients: DataFrame, cut_us: int = CUT_US, least: int = LEAST) -> DataFrame:
    """state, segment, cohort, period, users, users_crc32, moved, cents of every cell that isn't empty."""
    spark = clicks.sparkSession
    n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keep, tables, used = Scratch(spark), Tables(spark, n_buckets), usable(clicks, cut_us)
    try:
        split = keep(split_clients(used, n_buckets, least), "split")
        once = used.distinct().join(F.broadcast(split), "client_id", "left")
        piece = F.pmod(F.xxhash64("digest"), F.coalesce("pieces", F.lit(1))).cast("int")
        clicked = tables(once.select("client_id", piece.alias("piece"), F.col("pieces").isNotNull().alias("split"), "us", "early", "cents"), "clicks")
        started = tables(in_pieces(starts(used), split), "starts")
        known = clients.filter("client_id is not null").groupBy(F.col("client_id").cast("long").alias("client_id")).agg(F.min("segment").alias("segment"))
        segments = tables(in_pieces(known, split), "clients")
        out = keep(summed(partial_cells(clicked, started, segments)), "cells")
    finally:
        tables.drop()
    keep.drop_but("cells")
    return out


def op12_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "clients"))


_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length({s}) + 1), lambda i: CAST(ascii(substr({s}, i, 1)) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"
OP12_SQL = f"""
WITH crc AS (SELECT list_transform(range(256), lambda c: list_reduce(list_prepend(c, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
d AS (SELECT DISTINCT click_id, ts, arrived_at, client_id, kind, value, props FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL),
i AS (SELECT click_id, {_CRC.format(s="CAST(click_id AS VARCHAR)")} AS h FROM (SELECT DISTINCT click_id FROM d), crc),
u AS (SELECT client_id, {_CRC.format(s="CAST(client_id AS VARCHAR)")} AS crc FROM (SELECT DISTINCT client_id FROM d), crc),
k AS (SELECT d.*, epoch_us(ts) AS us, coalesce(epoch_us(arrived_at) + CASE WHEN h % 3 = 0 THEN h % 100 * {DAY_US} ELSE 0 END < {CUT_US}, false) AS early,
  CASE WHEN isfinite(value) AND abs(100 * value + 0.5) < 9.2e18 THEN CAST(floor(100 * value + 0.5) AS BIGINT) ELSE 0 END AS cents FROM d LEFT JOIN i ON d.click_id = i.click_id),
s AS (SELECT client_id, min(us) FILTER (early) AS start0, min(us) AS start1 FROM k WHERE kind = 'signup' GROUP BY 1),
g AS (SELECT client_id, min(segment) AS segment FROM clients GROUP BY 1),
r AS (SELECT 0 AS state, k.client_id, us, cents, start0 AS start, start0, start1 FROM k JOIN s ON k.client_id = s.client_id WHERE early AND us >= start0
  UNION ALL SELECT 1, k.client_id, us, cents, start1, start0, start1 FROM k JOIN s ON k.client_id = s.client_id WHERE us >= start1),
p AS (SELECT state, coalesce(segment, '') AS segment, CAST(floor(start / {DAY_US}.0) AS BIGINT) AS cohort, (us - start) // {DAY_US} AS period, r.client_id, u.crc,
  coalesce(floor(start0 / {DAY_US}.0) <> floor(start1 / {DAY_US}.0), false) AS moved, sum(cents) AS cents
  FROM r JOIN u ON r.client_id = u.client_id LEFT JOIN g ON r.client_id = g.client_id GROUP BY ALL)
SELECT CAST(state AS INTEGER) AS state, segment, cohort, CAST(period AS BIGINT) AS period, count(*) AS users, CAST(sum(crc) AS BIGINT) AS users_crc32, count(*) FILTER (moved) AS moved, CAST(sum(cents) AS BIGINT) AS cents
FROM p GROUP BY state, segment, cohort, period
"""
