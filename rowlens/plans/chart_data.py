"""Chart tables for a list of planned charts, in one long form."""

from __future__ import annotations

from functools import partial

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.operators import charts as c
from rowlens.operators.roles import numeric_names
from rowlens.plans.rules import Chart, kind_of
from rowlens.session import pin, run_together, small_table


def _long(frame: DataFrame, label: Column, **series: Column) -> DataFrame:
    """(series, label, value) with one row per named value column."""
    cells = [
        F.struct(F.lit(name).alias("series"), label.cast("string").alias("label"),
                 value.cast("double").alias("value"))
        for name, value in series.items()
    ]
    return frame.select(F.inline(F.array(*cells)))


def _named(df: DataFrame, chart: Chart, place: int) -> str | None:
    """The chart's column at a place, if the table has it."""
    if place < len(chart.columns) and chart.columns[place] in df.columns:
        return chart.columns[place]
    return None


def _line(df: DataFrame, chart: Chart) -> DataFrame:
    date, asked = c.date_column(df), _named(df, chart, 0)
    measure = asked if asked in numeric_names(df) else c.primary_metric(df)
    series = c.time_series(df, date, measure)
    return _long(
        series, F.col("period"), total=F.col("total"), rolling_mean=F.col("rolling_mean")
    )


def _pareto(df: DataFrame, chart: Chart) -> DataFrame:
    category = _named(df, chart, 0) or next(iter(c.usable_categories(df)), None)
    if not category:
        raise ValueError("a Pareto chart needs a category")
    measure = _named(df, chart, 1) or c.primary_metric(df)
    return _long(c.pareto_top10(df, category, measure), F.col("category"), total=F.col("total"))


def _stacked(df: DataFrame, chart: Chart) -> DataFrame:
    first, second = _named(df, chart, 0), _named(df, chart, 1)
    if not first or not second:
        usable = c.usable_categories(df)
        first = first or next(iter(usable), None)
        second = second or (usable[1] if len(usable) > 1 else first)
    if not first:
        raise ValueError("a stacked chart needs a category")
    measure = c.primary_metric(df)
    if first != second and measure:
        cells = c.pivot_sum_long(df, first, second, measure)
    else:
        cells = c.crosstab_long(df, first, second)
    return cells.select(
        "series", F.col("category").alias("label"), F.col("total").cast("double").alias("value")
    )


def _histogram(df: DataFrame, chart: Chart) -> DataFrame:
    measure = _named(df, chart, 0) or c.primary_metric(df)
    if not measure:
        raise ValueError("a histogram needs a measure")
    bins = _long(c.histogram(df, measure), F.lpad(F.col("bin").cast("string"), 2, "0"), n=F.col("n"))
    markers = _long(
        c.p50_p90(df, [measure]), F.lit("marker"), p50=F.col("p50"), p90=F.col("p90")
    )
    return bins.unionByName(markers)


def _scatter(df: DataFrame, chart: Chart) -> DataFrame:
    x, y = _named(df, chart, 0), _named(df, chart, 1)
    if not x or not y:
        raise ValueError(f"a scatter chart needs two columns of the table, got {chart.columns}")
    cell = F.concat_ws(",", "x_bin", "y_bin")
    cells = _long(c.scatter_density(df, x, y), cell, n=F.col("n"))
    line = _long(
        c.linear_trend(df, x, y), F.lit("trend"),
        slope=F.col("slope"), intercept=F.col("intercept"),
    )
    return cells.unionByName(line)


def _heatmap(df: DataFrame, chart: Chart) -> DataFrame:
    return c.correlation_heatmap(df).select(
        F.col("right_column").alias("series"),
        F.col("left_column").alias("label"),
        F.col("r").alias("value"),
    )


_TABLES = {
    "line": _line, "pareto_bar": _pareto, "stacked_bar": _stacked, "quantile_hist": _histogram,
    "scatter": _scatter, "correlation_heatmap": _heatmap,
}


def chart_data(df: DataFrame, chart: Chart) -> DataFrame:
    """(series, label, value) behind one chart."""
    return _TABLES[kind_of(chart.chart_type)](df, chart)


def run_charts(
    df: DataFrame, charts: tuple[Chart, ...]
) -> tuple[dict[int, DataFrame], DataFrame]:
    """Chart tables by number, and (chart_no, chart_type, status, reason) for all charts.

    Each table is computed here, so a chart that fails, when it is planned or when it runs, is
    recorded and does not stop the others.
    """
    def attempt(chart: Chart) -> DataFrame | str:
        try:
            return pin(chart_data(df, chart))
        except (ValueError, PySparkException) as problem:
            return f"{chart.chart_type}: {str(problem).splitlines()[0]}"

    numbered = dict(enumerate(charts, 1))
    done = run_together(
        df.sparkSession, {i: partial(attempt, chart) for i, chart in numbered.items()}
    )
    tables = {i: table for i, table in done.items() if not isinstance(table, str)}
    log = [
        (i, kind_of(c.chart_type), "done" if i in tables else "unsupported",
         c.reason if i in tables else done[i])
        for i, c in numbered.items()
    ]
    schema = "chart_no int, chart_type string, status string, reason string"
    return tables, small_table(df.sparkSession, log, schema)


def charts_long(tables: dict[int, DataFrame]) -> DataFrame:
    """All chart tables as (chart_no, series, label, value)."""
    parts = None
    for number, table in tables.items():
        part = table.select(F.lit(number).alias("chart_no"), "series", "label", "value")
        parts = part if parts is None else parts.unionByName(part)
    return parts
