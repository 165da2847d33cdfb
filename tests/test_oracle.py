"""Every registered query against its SQL on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry_module
from tests.compare import connect, difference
from workload.oracle import all_sql
from workload.queries import all_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem = difference(QUERIES[name](spark, SF_DIR), con, SQL[name])
    assert problem is None, problem


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0
