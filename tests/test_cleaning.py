from __future__ import annotations

from datetime import datetime

from conftest import rows
from pyspark.sql import functions as F

from rowlens.functions.numbers import is_formatted_number, to_number
from rowlens.operators import cleaning


def test_messy_table(spark):
    """Three of four ages are numbers, so the column converts; the gaps get the medians."""
    data = [
        ("Ann", "31", "Rome", 50000.0), ("Ann", "31", "Rome", 50000.0),
        ("Ben", "thirty", "Oslo", None), ("Cid", None, "Bonn", 90000.0),
        ("Dee", "28", "Lima", 80000.0), ("Eve", "25", "Nice", 87000.0),
    ]
    df = spark.createDataFrame(data, "name string, age string, city string, pay double")
    cleaned = cleaning.clean_with_report(df)
    assert (cleaned.original_rows, cleaned.duplicates_removed, cleaned.rows_after_cleaning) == (6, 1, 5)
    assert rows(cleaned.table) == [
        ("Ann", 31.0, "Rome", 50000.0), ("Ben", 28.0, "Oslo", 83500.0), ("Cid", 28.0, "Bonn", 90000.0),
        ("Dee", 28.0, "Lima", 80000.0), ("Eve", 25.0, "Nice", 87000.0),
    ]
    assert ("age", "missing", "median_fill", "28.0", 2) in rows(cleaned.actions)
    assert ("pay", "missing", "median_fill", "83500.0", 1) in rows(cleaned.actions)
    assert ("age", "conversion", "formatted_string_to_numeric", None, 3) in rows(cleaned.actions)


def test_formatted_numbers(spark):
    texts = ["$1,234", "€5", "12%", "-3.5", "£ 7", "1,23", "12,3456", "abc", "1.2.3", "¥9.99%", "+5", "1e3"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = {r[0]: r[1] for r in df.select("t", is_formatted_number(F.col("t"))).collect()}
    assert [t for t in texts if found[t]] == ["$1,234", "€5", "12%", "-3.5", "£ 7", "¥9.99%"]


def test_percent_signs_are_dropped(spark):
    df = spark.createDataFrame([("12%",), ("7%",), ("3%",)], "rate string")
    assert rows(cleaning.formatted_text_to_numbers(df)) == [(12.0,), (3.0,), (7.0,)]


def test_rejected_column_stays_untouched(spark):
    """All values look like numbers, but only half of all rows convert."""
    data = [("$1",), ("$2",), (None,), (None,)]
    df = spark.createDataFrame(data, "t string")
    assert rows(cleaning.formatted_text_to_numbers(df)) == [("$1",), ("$2",), (None,), (None,)]


def test_number_text(spark):
    texts = ["5d", "nan", " 12 ", "1e3", ".5", "5.", "+7", "-0", "1_000", "", "0x1F", "inf"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = {r[0]: r[1] for r in df.select("t", to_number(F.col("t"))).collect()}
    assert found == {
        "5d": None, "nan": None, " 12 ": 12.0, "1e3": 1000.0, ".5": 0.5, "5.": 5.0, "+7": 7.0,
        "-0": 0.0, "1_000": None, "": None, "0x1F": None, "inf": float("inf"),
    }


def test_near_numeric_needs_few_failures(spark):
    good = [(f"+{i}", f"+{i}") for i in range(96)]
    df = spark.createDataFrame(good + [("bad", "bad")] * 4 + [("+1", "bad")], "a string, b string")
    conversions = cleaning.text_conversions(cleaning.text_number_facts(df, ["a", "b"]))
    assert conversions == {"a": "object_to_numeric", "b": "object_to_numeric"}
    worse = df.unionByName(spark.createDataFrame([("+2", "bad")], "a string, b string"))
    conversions = cleaning.text_conversions(cleaning.text_number_facts(worse, ["a", "b"]))
    assert conversions == {"a": "object_to_numeric"}


def test_nulls_block_the_near_numeric_rule(spark):
    data = [(i, f"+{i}" if i < 94 else None) for i in range(100)]
    df = spark.createDataFrame(data, "k int, a string")
    assert cleaning.text_conversions(cleaning.text_number_facts(df, ["a"])) == {}
    assert cleaning.clean(df).where("a = 'Unknown'").count() == 6


def test_kinds_of_gaps(spark):
    data = [(1, "a", datetime(2024, 1, 1), True, None), (None, None, None, None, None), (3, "b", datetime(2024, 1, 3), False, None)]
    df = spark.createDataFrame(data, "n int, t string, d timestamp_ntz, f boolean, e double")
    cleaned = cleaning.clean_with_report(df)
    assert rows(cleaned.table) == [
        (1.0, "a", datetime(2024, 1, 1), "True", 0.0), (2.0, "Unknown", None, "Unknown", 0.0),
        (3.0, "b", datetime(2024, 1, 3), "False", 0.0),
    ]
    assert ("d", "missing", "retained_nat", "NaT", 1) in rows(cleaned.actions)


def test_headers_are_trimmed_and_empty_input_is_reported(spark):
    df = spark.createDataFrame([], " a int, `b ` string")
    cleaned = cleaning.clean_with_report(df)
    assert cleaned.table.columns == ["a", "b"]
    assert rows(cleaned.report, "n_affected") == [(0,), (0,), (0,)]


def test_rows_without_date_or_measure(spark):
    df = spark.createDataFrame([(1.0, "x"), (float("nan"), "x"), (None, "y"), (2.0, None)], "v double, t string")
    assert rows(cleaning.drop_null_rows_on(df, ["v", "t"])) == [(1.0, "x")]
