from __future__ import annotations

from datetime import date, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rowlens.operators import charts
from rowlens.plans.chart_data import run_charts
from rowlens.plans.rules import CHART_KINDS, Chart, chart_kind, kind_of


def test_primary_metric(spark):
    def of(*names):
        return charts.primary_metric(spark.createDataFrame([], ", ".join(f"`{n}` double" for n in names)))

    assert of("price", "total cost") == "total cost"
    assert of("id", "units", "zip") == "units"
    assert of("order_id", "zip") == "order_id"
    assert charts.primary_metric(spark.createDataFrame([], "t string")) is None


def test_usable_categories(spark):
    df = spark.range(100).selectExpr(
        "cast(id as string) as name", "cast(id % 3 as string) as g", "'x' as same"
    )
    assert charts.usable_categories(df) == ["g"]
    assert charts.usable_categories(df.select("name", "same")) == ["name", "same"]


def test_date_column(spark):
    texts = spark.createDataFrame([("x", "2024-01-05"), ("y", None)], "update_note string, month string")
    assert charts.date_column(texts) == "month"
    assert charts.date_column(spark.createDataFrame([("a",)], "t string")) is None


def test_empty_months_are_zero(spark):
    data = [(datetime(2024, 1, 15), 10.0), (datetime(2024, 4, 2), 5.0), (datetime(2024, 5, 31), 1.0), (None, 7.0), (datetime(2024, 2, 1), None)]
    series = charts.time_series(spark.createDataFrame(data, "d timestamp_ntz, v double"), "d", "v")
    assert rows(series) == [
        (date(2024, 1, 31), 10.0, 10.0), (date(2024, 2, 29), 0.0, 5.0),
        (date(2024, 3, 31), 0.0, pytest.approx(10 / 3)), (date(2024, 4, 30), 5.0, pytest.approx(5 / 3)),
        (date(2024, 5, 31), 1.0, 2.0),
    ]


def test_weeks_end_on_sunday(spark):
    data = [(datetime(2024, 1, 7), 1.0), (datetime(2024, 1, 8), 2.0), (datetime(2024, 1, 24), 4.0)]
    found = charts.resample_sum(spark.createDataFrame(data, "d timestamp_ntz, v double"), "d", "v")
    assert rows(found) == [
        (date(2024, 1, 7), 1.0), (date(2024, 1, 14), 2.0), (date(2024, 1, 21), 0.0), (date(2024, 1, 28), 4.0),
    ]


def test_days(spark):
    data = [("2024-01-01", 1.0), ("2024-01-03", 2.0)]
    found = charts.resample_sum(spark.createDataFrame(data, "day_date string, v double"), "day_date", "v")
    assert rows(found) == [(date(2024, 1, 1), 1.0), (date(2024, 1, 2), 0.0), (date(2024, 1, 3), 2.0)]


def test_time_series_needs_a_date(spark):
    with pytest.raises(ValueError):
        charts.time_series(spark.createDataFrame([(1.0,)], "v double"))
    empty = spark.createDataFrame([(None, 1.0)], "d timestamp_ntz, v double")
    with pytest.raises(ValueError):
        charts.time_series(empty, "d", "v")


def test_pareto_ties_and_counts(spark):
    df = spark.createDataFrame([("B", 2.0), ("A", 2.0), ("C", None), (None, 50.0), ("C", None)], "c string, v double")
    found = charts.pareto_top10(df, "c", "v").collect()
    assert [tuple(r) for r in found] == [("A", 2.0), ("B", 2.0), ("C", 0.0)]
    assert charts.pareto_top10(df, "c").first()["category"] == "C"


def test_stacked_keeps_seven_categories(spark):
    df = spark.range(100).selectExpr("concat('c', cast(floor(sqrt(id)) as string)) as c", "cast(id % 2 as string) as s", "1.0D as v")
    wide = charts.pivot_sum(df, "c", "s", "v", ["0", "1"])
    assert wide.columns == ["category", "0", "1"]
    assert sorted(r["category"] for r in wide.collect()) == [f"c{i}" for i in range(3, 10)]


def test_pivots_of_many_values_are_long(spark):
    df = spark.range(600).selectExpr("'a' as c", "cast(id % 300 as string) as s", "1.0D as v")
    assert charts.pivot_sum(df, "c", "s", "v").agg(F.count("*"), F.sum("total")).first() == (300, 600.0)
    assert charts.crosstab_count(df, "c", "s").columns == ["category", "series", "total"]


def test_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 17, 18, 18)] + [(None,)], "v double")
    found = {r["bin"]: r["n"] for r in charts.histogram(df, "v").collect()}
    assert len(found) == 18 and sum(found.values()) == 5
    assert (found[1], found[2], found[18]) == (1, 1, 3)
    same = charts.histogram(spark.createDataFrame([(2.0,)] * 4, "v double"), "v").orderBy("bin").collect()
    assert (same[0]["low"], round(same[-1]["high"], 9)) == (1.5, 2.5) and sum(r["n"] for r in same) == 4
    with pytest.raises(ValueError):
        charts.histogram(spark.createDataFrame([(None,)], "v double"), "v")


def test_scatter_counts_every_point_once(spark):
    df = spark.range(1000).selectExpr("cast(id as double) as x", "cast(id % 10 as double) as y")
    assert charts.scatter_density(df, "x", "y").agg(F.sum("n")).first()[0] == 1000
    assert charts.scatter_points(df, "x", "y").count() == 1000


def test_linear_trend(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (3.0, 7.0), (None, 9.0)], "x double, y double")
    assert rows(charts.linear_trend(df, "x", "y")) == [(3, pytest.approx(2.0), pytest.approx(1.0))]
    flat = spark.createDataFrame([(1.0, 3.0), (1.0, 5.0)], "x double, y double")
    assert charts.linear_trend(flat, "x", "y").first()["slope"] is None


def test_heatmap_takes_all_columns(spark):
    df = spark.range(5).selectExpr(*[f"cast(id * {i} + id * id as double) as c{i}" for i in range(1, 11)])
    assert charts.correlation_heatmap(df).count() == 100
    with pytest.raises(ValueError):
        charts.correlation_heatmap(df.select("c1"))


def test_chart_spellings(spark):
    texts = [*CHART_KINDS, " Bar Chart ", "TIME-SERIES", "pie", ""]
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    found = {r["raw"]: r["kind"] for r in df.withColumn("kind", chart_kind(F.col("raw"))).collect()}
    assert found == {t: kind_of(t) for t in texts}
    assert found["pie"] == "pareto_bar" and found["TIME-SERIES"] == "line"


def test_impossible_charts_do_not_stop_the_others(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "c string, v double")
    tables, log = run_charts(df, (Chart("line", (), "no date"), Chart("pie", ("c",), "unknown kind"), Chart("scatter", ("v",), "one column")))
    assert list(tables) == [2]
    assert rows(log, "chart_type", "status") == [("line", "unsupported"), ("pareto_bar", "done"), ("scatter", "unsupported")]
