"""Every registered query against its SQL in another engine, at the small scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from sysloom.plans import catalog, oracle
from tools.compare import compare

SF_DIR = "/root/testdata/sf0.001"
SQL = oracle.oracle_sql()
QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF_DIR):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF_DIR}/{f}'")
    return c


def test_every_sql_has_a_query():
    assert set(SQL) == set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result, _ = compare(spark, con, name, QUERIES[name], SQL.get(name), SF_DIR)
    assert not result.startswith("FAIL"), result
    assert not result.endswith(" 0"), "query gives no rows"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
