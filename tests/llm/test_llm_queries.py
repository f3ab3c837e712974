"""Queries that SQL can express, against that SQL; all queries run on the smallest scale."""

import os

import pytest
from check_queries import oracle_connection

from rowlens.llm.queries import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    found = QUERIES[name](spark, FOLDER)
    relation = oracle_connection(FOLDER).sql(ORACLES[name])
    assert sorted(relation.columns) == sorted(found.columns)
    place = [relation.columns.index(c) for c in found.columns]
    expected = [tuple(r[k] for k in place) for r in relation.fetchall()]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
