"""Every core query with SQL gives on DuckDB what it gives on Spark, over the smallest tables.

The ones with money or many ranges also over larger ones, where ties and splits are met.
"""

import math

import duckdb
import pytest

from tickloom.plans import queries as Q

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
MONEY = ["enrich_asof", "enrich_full", "vwap", "window_buckets", "window_accepts", "positions_snapshot", "price_deviation_alerts", "dead_letter_rows", "stream_market_state", "live_enrichment", "price_scalars"]


def connected(sf):
    c = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def duck():
    return connected(SF)


@pytest.fixture(scope="module")
def larger():
    return connected(LARGER)


def shown(rows):
    cell = lambda v: "null" if v is None else repr(v) if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, duck, name):
    compare(spark, duck, name, SF)


@pytest.mark.parametrize("name", MONEY)
def test_query_equals_sql_over_larger_tables(spark, larger, name):
    compare(spark, larger, name, LARGER)


def compare(spark, duck, name, sf):
    df = Q.QUERIES[name](spark, sf)
    rel = duck.sql(Q.SQL[name])
    cols = sorted(rel.columns)
    assert sorted(df.columns) == cols
    assert shown(df.select(*cols).collect()) == shown([tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()])


def test_every_query_has_sql(spark):
    assert set(Q.QUERIES) == set(Q.SQL) and Q.entry(spark).count() > 0
