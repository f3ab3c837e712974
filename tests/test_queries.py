"""Every named query against its SQL on the smallest scale, and the driver contract."""

from __future__ import annotations

import os

import pytest
from check_queries import differences, oracle_connection

import __spark_entry__ as entry_point
from rowlens.catalog import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, oracle, name):
    query = QUERIES[name]
    assert query.sql is not None
    assert differences(query.run(spark, FOLDER), oracle.sql(query.oracle())) == []


def test_contract(spark):
    assert set(QUERIES) <= entry_point.oracle_sql().keys() <= entry_point.queries().keys()
    frame = entry_point.entry(spark)
    assert frame.columns[:2] == ["table_name", "group"]
    assert frame.count() > 0
