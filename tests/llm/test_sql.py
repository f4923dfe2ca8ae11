"""The corpus queries that SQL can express, beside their SQL, on the smallest tables."""

import os

import pytest

from plumbline.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    fault = compare(spark, connect(SF_DIR), name, QUERIES[name], ORACLES[name], SF_DIR)
    assert fault is None, fault
