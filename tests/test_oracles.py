"""Every registered query against its SQL in another engine, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import rows_of
from tabulens.plans.registry import all_queries

FOLDER = "/root/testdata/sf0.001"
QUERIES = {name: query for name, query in entry.queries().items() if name in all_queries()}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}
# Rows only: approximate or dependent on the partitioning.
WITHOUT_SQL = {"uniq_counts_approx", "numeric_stats_approx"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_sql_or_is_known_not_to():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        assert got
        return
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, result.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert {r["column_name"] for r in df.collect()} == {"all", "event_id", "user_id", "event_type", "value", "props"}
