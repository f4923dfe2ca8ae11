"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(entry.own_queries()) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.own_queries()))
def test_query_agrees_with_sql(spark, con, name):
    fault = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert fault is None, fault


def test_entry_returns_one_row_per_rule(spark):
    assert entry.entry(spark).count() == 15
