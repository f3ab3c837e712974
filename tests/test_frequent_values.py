"""The most frequent values where counts and beginnings tie, against sorting all values."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from rowlens.operators import counts
from rowlens.operators.counts import most_frequent
from rowlens.operators.profile import categorical_profile

HEADER = "<html><head><title>one page like the other</title>" + "x" * 500


def plain(columns, k):
    out = []
    for name, values in columns.items():
        tally = Counter(v for v in values if v is not None)
        for rank, (value, n) in enumerate(sorted(tally.items(), key=lambda p: (-p[1], p[0].encode()))[:k], 1):
            out.append((name, rank, value, n))
    return sorted(out)


@pytest.fixture(scope="module")
def columns():
    pick = random.Random(1)
    pages = [HEADER + f"{pick.randrange(10**9):09d}" * 30 for _ in range(400)]
    head = "h" * counts.HEAD_LENGTH
    return {
        # All differ, and only after 550 characters.
        "pages": pages,
        # The head alone, what begins with it, and copies.
        "nested": ([head, head + "a", head + "a", head + "ab", head + "b" * 90, head + "b" * 91] * 67)[:400],
        "long common part": [f"{HEADER}{'y' * 3000}{k % 7}{'z' * 2000}{k}" for k in range(400)],
        "beginnings": [head + "q" * k for k in range(400)],
        "two kinds": [("é" * 50 + str(k % 90)) if k % 2 else "日" * 41 + str(k) for k in range(400)],
        "short": [str(k % 13) for k in range(399)] + [None],
        "empty": [None] * 400,
    }


@pytest.mark.parametrize("k", [1, 5, 10])
def test_ties_on_long_beginnings(spark, columns, k):
    rows = list(zip(*columns.values()))
    table = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in columns)).repartition(5)
    found = most_frequent(table, list(columns), k)
    assert sorted(map(tuple, found.select("column", "rank", "value", "n").collect())) == plain(columns, k)


def test_only_wanted_texts_are_fetched(spark, columns):
    """The join that brings whole texts asks for at most k values of a column."""
    table = spark.createDataFrame([(v,) for v in columns["pages"]], "pages string")
    plan = most_frequent(table, ["pages"], 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan and plan.count("Join") == 1
    assert most_frequent(table, ["pages"], 5).count() == 5


def test_short_values_need_no_second_pass(spark, columns):
    table = spark.createDataFrame([(v,) for v in columns["short"]], "short string")
    plan = most_frequent(table, ["short"], 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("LocalRelation")


def test_profile_of_the_same(spark, columns):
    rows = list(zip(*columns.values()))
    table = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in columns))
    expected = plain(columns, 5)
    for row in categorical_profile(table).collect():
        values = columns[row["column"]]
        there = [v for v in values if v is not None]
        assert row["unique_values"] == (len(set(there)) or None)
        assert [tuple(t) for t in row["top_values"] or []] == [e[2:] for e in expected if e[0] == row["column"]]
        assert row["missing_count"] == (len(values) - len(there) if there else None)
