"""Every registered query against its SQL on the smallest data, whole results compared."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

PATH = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(PATH)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, message, n, _ = compare(spark, con, name, QUERIES[name], SQL.get(name), PATH)
    assert ok, message
    assert n > 0 or name == "leaked_rows"


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"item_id", "n_matched"}


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
