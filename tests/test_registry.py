"""Registered queries against their SQL on another engine, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SMALL
from tools.check_queries import compare

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def base():
    connection = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, base, name):
    assert compare(entry.queries()[name](spark, SMALL), base.sql(SQL[name])).startswith("ok")


def test_entry(spark):
    assert entry.entry(spark).count() == 1_500
