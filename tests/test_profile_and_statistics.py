from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest
from conftest import rows

from rowlens.functions.statistics import sample_skewness
from rowlens.operators import charts, findings, profile, roles, statistics
from rowlens.operators.correlation import correlation_pairs
from rowlens.operators.counts import distinct_counts, value_frequencies


def test_identifier_by_name_and_by_sequence(spark):
    data = [(5, 10, 1, 7), (3, 12, 1, 9), (4, 11, 2, 8)]
    df = spark.createDataFrame(data, "seq int, order_id int, plain int, holes int")
    found = roles.find_roles(df)
    assert found.identifier == ["seq", "order_id", "holes"] and found.numeric == ["plain"]
    gap = spark.createDataFrame([(1,), (2,), (4,)], "v int")
    assert roles.find_roles(gap).numeric == ["v"]
    repeated = spark.createDataFrame([(1,), (1,), (3,)], "v int")
    assert roles.find_roles(repeated).numeric == ["v"]
    with_null = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    assert roles.find_roles(with_null).numeric == ["v"]


def test_one_row_integer_is_an_identifier(spark):
    df = spark.createDataFrame([(9, 9.5)], "v int, w double")
    assert roles.find_roles(df).identifier == ["v"]


def test_roles_of_all_kinds(spark):
    df = spark.createDataFrame(
        [(1.5, "a", datetime(2024, 1, 1), True, [1], Decimal("1.5"))],
        "m double, t string, d timestamp_ntz, f boolean, a array<int>, dec decimal(10,2)",
    )
    assert rows(roles.column_roles(df), "column", "role") == [
        ("a", "other"), ("d", "datetime"), ("dec", "numeric"), ("f", "boolean"), ("m", "numeric"),
        ("t", "categorical"),
    ]


def test_numeric_profile_of_special_columns(spark):
    inf, nan = float("inf"), float("nan")
    data = [(1.0, None, 3.0, Decimal("1.0")), (2.0, None, 3.0, Decimal("2.0")), (nan, None, 3.0, None), (10.0, None, 3.0, Decimal("3.5"))]
    df = spark.createDataFrame(data, "x double, empty double, same double, dec decimal(5,1)")
    found = {r["column"]: r.asDict() for r in profile.numeric_profile(df).collect()}
    assert found["x"]["missing_count"] == 1 and found["x"]["missing_percent"] == 25.0
    assert found["x"]["median"] == 2.0 and found["x"]["unique_values"] == 3
    assert found["empty"]["skipped_reason"] == "All values are NaN"
    assert found["empty"]["mean"] is None and found["empty"]["unique_values"] is None
    assert found["same"]["std"] == 0.0 and found["same"]["skewness"] == 0.0
    assert found["dec"]["mean"] == 2.1667
    infinite = profile.numeric_profile(spark.createDataFrame([(1.0,), (inf,)], "x double"), ["x"]).first()
    assert infinite["max"] is None and infinite["min"] == 1.0


def test_single_value_has_no_spread(spark):
    found = profile.numeric_profile(spark.createDataFrame([(4.0,)], "x double"), ["x"]).first()
    assert (found["std"], found["skewness"], found["median"]) == (0.0, 0.0, 4.0)


def test_sample_skewness(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 10.0)], "x double")
    assert df.agg(sample_skewness(df.x)).first()[0] == pytest.approx(1.763632614803888)


def test_categorical_profile(spark):
    data = [("b", "x"), ("a", "x"), ("b", None), ("a", "y"), (None, "x"), ("c", "x")]
    df = spark.createDataFrame(data, "t string, u string")
    found = {r["column"]: r.asDict(True) for r in profile.categorical_profile(df).collect()}
    assert found["t"]["most_frequent"] == "a"  # ties go to the smaller value
    assert found["t"]["top_values"] == [{"value": "a", "n": 2}, {"value": "b", "n": 2}, {"value": "c", "n": 1}]
    assert found["t"]["cardinality_ratio"] == 0.6 and found["t"]["missing_count"] == 1
    assert found["t"]["is_high_cardinality"] is False
    names = spark.createDataFrame([(f"n{i}",) for i in range(21)], "t string")
    assert profile.categorical_profile(names).first()["is_high_cardinality"] is True


def test_profile_without_such_columns(spark):
    df = spark.createDataFrame([("a",)], "t string")
    assert profile.numeric_profile(df).count() == 0
    assert profile.datetime_profile(df).count() == 0
    assert profile.categorical_profile(spark.range(3)).count() == 0


def test_span_is_in_whole_days(spark):
    data = [(datetime(2024, 1, 1, 23),), (datetime(2024, 1, 3, 22),), (None,)]
    found = profile.datetime_profile(spark.createDataFrame(data, "d timestamp_ntz")).first()
    assert (found["timespan_days"], found["unique_dates"], found["missing_count"]) == (1, 2, 1)
    assert found["min_date"] == "2024-01-01 23:00:00"


def test_distinct_counts(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (1, "b", -0.0), (2, None, None)], "i int, t string, d double")
    assert rows(distinct_counts(df, ["i", "t", "d"])) == [("d", 1), ("i", 2), ("t", 2)]
    assert rows(distinct_counts(df, ["i", "t"], approx=True)) == [("i", 2), ("t", 2)]
    wide = spark.range(5000).selectExpr("cast(id as string) as many", "cast(id % 30 as string) as few")
    assert rows(distinct_counts(wide, ["many", "few"])) == [("few", 30), ("many", 5000)]


def test_top_values_of_long_texts(spark):
    """Texts alike in their first characters are told apart; no long text is shuffled to be counted."""
    head = "x" * 60
    data = [(head + "b",)] * 3 + [(head + "a",)] * 3 + [(head + "c",)] + [("short",)] * 2 + [(None,)]
    df = spark.createDataFrame(data, "t string")
    found = profile.top_values(df, ["t"], 3).orderBy("rank").collect()
    assert [(r["value"], r["n"]) for r in found] == [(head + "a", 3), (head + "b", 3), ("short", 2)]
    ties = spark.createDataFrame([(head + str(k),) for k in range(9)], "t string")
    assert [r["value"][-1] for r in profile.top_values(ties, ["t"], 2).orderBy("rank").collect()] == ["0", "1"]
    counted = value_frequencies(df, ["t"])._jdf.queryExecution().optimizedPlan().toString()
    assert "key" in counted.splitlines()[0]


def test_correlation(spark):
    df = spark.createDataFrame([(1, 10, 5.0), (2, 20, 5.0), (3, 30, 5.0), (4, 40, 5.0)], "a int, b int, same double")
    found = {(r["left_column"], r["right_column"]): r["r"] for r in statistics.correlation_matrix(df, ["a", "b", "same"]).collect()}
    assert found["a", "b"] == found["b", "a"] == pytest.approx(1.0)
    assert found["a", "a"] == 1.0
    assert found["same", "same"] is None and found["a", "same"] is None
    assert len(found) == 9


def test_correlation_uses_complete_pairs(spark):
    data = [(1.0, 2.0, 1.0), (2.0, 4.0, None), (3.0, 7.0, 3.0), (None, 9.0, 4.0)]
    found = correlation_pairs(spark.createDataFrame(data, "a double, b double, c double"), ["a", "b", "c"])
    pairs = {(r["left_column"], r["right_column"]): r["r"] for r in found.collect()}
    assert pairs["a", "b"] == pytest.approx(0.9933992677987828)
    assert pairs["a", "c"] == pytest.approx(1.0)


def test_correlation_with_infinite_values_is_undefined(spark):
    inf, nan = float("inf"), float("nan")
    data = [(1.0, 2.0, 1.0), (2.0, 4.1, inf), (3.0, 6.0, 3.0), (nan, 9.0, 4.0)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    matrix = statistics.correlation_matrix(df, ["a", "b", "c"])
    found = {(r["left_column"], r["right_column"]): r["r"] for r in matrix.collect()}
    assert found["a", "c"] is None and found["c", "c"] is None and found["a", "b"] > 0.99
    assert findings.strongest_pair(matrix).first()["left_column"] == "a"
    assert [r["column"] for r in findings.driver_ranking(matrix).collect()] == ["a", "b"]
    assert findings.relationship_strength(matrix).count() == 1
    assert findings.confidence_bands(matrix).count() == 1


def test_correlation_far_from_zero(spark):
    df = spark.range(1000).selectExpr("id * 0.001D + 1e9 as a", "1e9 - id * 0.002D as b", "1e15D as same")
    found = {(r["left_column"], r["right_column"]): r["r"] for r in correlation_pairs(df, ["a", "b", "same"]).collect()}
    assert found["a", "b"] == pytest.approx(-1.0, abs=1e-6) and found["a", "same"] is None


def test_correlation_of_forty_columns_reads_twice(spark):
    """One scan finds the centres, one the sums of all 780 pairs."""
    df = spark.range(200).selectExpr(*[f"cast((id * {k + 3}) % 101 as double) as c{k}" for k in range(40)])
    matrix = statistics.correlation_matrix(df, df.columns)
    plan = matrix._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1
    assert matrix.count() == 1600


def test_trend(spark):
    data = [
        (datetime(2024, 3, 1), 200.0, 0.0, 5), (datetime(2024, 1, 1), 100.0, 0.0, None),
        (datetime(2024, 2, 1), 150.0, 1.0, 4), (None, 999.0, 9.0, 9), (datetime(2024, 4, 1), None, 3.0, None),
    ]
    df = spark.createDataFrame(data, "d timestamp_ntz, revenue double, zero double, gaps int")
    found = {r["column"]: (r["first_value"], r["last_value"], r["percent_change"])
             for r in statistics.trend_change(df, "d", ["revenue", "zero", "gaps"], []).collect()}
    assert found == {"revenue": (100.0, 200.0, 100.0), "zero": (0.0, 3.0, 0.0), "gaps": (4.0, 5.0, 25.0)}


def test_nothing_is_cut_off(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 1, 1 + k), *[f"{k % 3}"] * 6, *[float(k + j) for j in range(9)]) for k in range(6)],
        "d timestamp_ntz, " + ", ".join(f"t{k} string" for k in range(6)) + ", "
        + ", ".join(f"m{k} double" for k in range(9)),
    )
    texts, measures = [f"t{k}" for k in range(6)], [f"m{k}" for k in range(9)]
    assert statistics.trend_change(df, "d", measures, []).count() == 9
    assert {r["column"] for r in statistics.value_counts(df, texts).collect()} == set(texts)
    assert charts.correlation_heatmap(df).count() == 81


def test_trend_ties_are_decided(spark):
    data = [(datetime(2024, 1, 1), k, float(k)) for k in range(5)]
    df = spark.createDataFrame(data, "d timestamp_ntz, k int, v double").repartition(5)
    found = statistics.trend_change(df, "d", ["v"], ["k"]).first()
    assert (found["first_value"], found["last_value"]) == (0.0, 4.0)


def test_outliers(spark):
    data = [(v, p) for v, p in zip((95.0, 100.0, 105.0, 110.0, 500.0, 102.0, 98.0), (18.0, 19.0, 20.0, 19.5, 20.0, 18.5, 21.0))]
    df = spark.createDataFrame(data + [(None, None)], "units double, price double")
    found = {r["column"]: (r["outlier_count"], r["lower_bound"], r["upper_bound"]) for r in statistics.iqr_outliers(df, ["units", "price"]).collect()}
    assert found["units"] == (1, 86.25, 120.25)
    assert found["price"][0] == 0
    assert rows(statistics.outlier_rows(df, ["units", "price"]), "units") == [(500.0,)]
    few = spark.createDataFrame([(1.0,), (2.0,), (99.0,)], "v double")
    assert statistics.iqr_outliers(few, ["v"]).count() == 0


def test_value_counts_show_missing_and_keep_ten(spark):
    data = [(f"v{i:02d}",) for i in range(12)] * 2 + [(None,)] * 3
    found = statistics.value_counts(spark.createDataFrame(data, "t string"), ["t"]).orderBy("rank").collect()
    assert len(found) == 10 and (found[0]["value"], found[0]["n"]) == ("nan", 3)
    assert found[1]["value"] == "v00"


def test_grouped_summary(spark):
    data = [("n", 5), ("n", 4), ("n", 5), ("s", 4), ("s", 3), ("s", 4), ("e", 4), ("e", 7), ("w", None), (None, 100)]
    found = statistics.grouped_summary(spark.createDataFrame(data, "g string, v int"), "g", "v")
    assert [(r["group"], r["total"], r["count"], r["rank"]) for r in found.orderBy("rank", "group").collect()] == [
        ("n", 14.0, 3, 1), ("e", 11.0, 2, 2), ("s", 11.0, 3, 2), ("w", 0.0, 0, 3),
    ]
    wide = spark.createDataFrame([(str(k), "ab"[k % 2], 1.5 * k) for k in range(30)], "name string, g string, v double")
    assert sorted(r["group"] for r in statistics.grouped_summary(wide, auto=True).collect()) == ["a", "b"]
    single = statistics.grouped_summary(spark.createDataFrame([("a", 1.0)], "g string, v double"), "g", "v").first()
    assert single["std_dev"] is None


def test_run_analyses(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (5, "z")], "a int, c string")
    found = roles.find_roles(df)
    results, log = statistics.run_analyses(df, ["descriptive_stats", "correlation_analysis", "magic"], found)
    assert list(results) == ["descriptive_stats"]
    assert rows(log) == [
        ("correlation_analysis", "skipped", "needs 2 measure column(s), 1 found"),
        ("descriptive_stats", "done", None), ("magic", "unsupported", None),
    ]
    with pytest.raises(ValueError):
        statistics.run_analyses(df, [], found)
    with pytest.raises(ValueError):
        statistics.run_analyses(df, ["magic"], found)


def test_skip_reasons_of_text_table(spark):
    df = spark.createDataFrame([("a", "b")], "name string, note string")
    assert [n for n, _ in statistics.skip_reasons(roles.find_roles(df))] == [
        "descriptive_stats", "correlation_analysis", "trend_analysis", "outlier_detection",
        "grouped_summary_analysis",
    ]
