"""The tables behind the charts: time series, top categories, pivots, histograms, regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowlens.operators.counts import distinct_counts
from rowlens.operators.quantiles import column_quantiles, numeric_value
from rowlens.operators.roles import datetime_names, numeric_names, text_names
from rowlens.operators.statistics import correlation_matrix
from rowlens.session import column, small_table
from rowlens.sources.dates import parse_date

# Name parts that mark the main measure, strongest first, and those that rule a
# column out as a fall-back.
METRIC_NAME_PARTS = (
    "cost", "sales", "revenue", "amount", "total", "price", "profit", "net", "gross", "income",
)
NOT_METRIC_NAME_PARTS = ("id", "code", "zip", "postal", "year", "number")
DATE_NAME_PARTS = ("date", "time", "month")

HISTOGRAM_BINS = 18
SCATTER_BINS = 20
TOP_CATEGORIES = 10
STACKED_CATEGORIES = 7
USABLE_CATEGORY_VALUES = (2, 30)


def primary_metric(df: DataFrame) -> str | None:
    """The measure charts use when none is named."""
    names = numeric_names(df)
    for part in METRIC_NAME_PARTS:
        for name in names:
            if part in name.lower():
                return name
    plain = [n for n in names if not any(p in n.lower() for p in NOT_METRIC_NAME_PARTS)]
    return (plain or names or [None])[0]


def usable_categories(df: DataFrame) -> list[str]:
    """Text columns with 2 to 30 values; all text columns if there are none."""
    names = text_names(df)
    low, high = USABLE_CATEGORY_VALUES
    if not names:
        return []
    counts = {r["column"]: r["distinct_count"] for r in distinct_counts(df, names).collect()}
    return [n for n in names if low <= counts.get(n, 0) <= high] or names


def date_column(df: DataFrame) -> str | None:
    """The first date column, else the first text column named like a date that parses entirely."""
    dates = datetime_names(df)
    if dates:
        return dates[0]
    named = [n for n in text_names(df) if any(p in n.lower() for p in DATE_NAME_PARTS)]
    if not named:
        return None
    unparsed = df.agg(
        *[
            F.count_if(column(n).isNotNull() & parse_date(column(n)).isNull()).alias(f"c{i}")
            for i, n in enumerate(named)
        ]
    ).first()
    return next((n for n, bad in zip(named, unparsed) if bad == 0), None)


def _as_time(df: DataFrame, name: str) -> Column:
    if name in text_names(df):
        return parse_date(column(name))
    return column(name).cast("timestamp_ntz")


def _frequency(span_days: Column) -> Column:
    return F.when(span_days > 90, "month").when(span_days > 14, "week").otherwise("day")


def resample_frequency(df: DataFrame, date: str) -> DataFrame:
    """Range of a date column and the period length that suits it."""
    when = _as_time(df, date)
    low, high = F.min(when), F.max(when)
    span = F.coalesce(F.timestamp_diff("DAY", low, high), F.lit(0))
    return df.agg(
        low.cast("date").alias("first_day"),
        high.cast("date").alias("last_day"),
        span.alias("span_days"),
        _frequency(span).alias("frequency"),
    )


def _period(day: Column, frequency: str) -> Column:
    """The last day of the period a day belongs to; weeks end on Sunday."""
    if frequency == "month":
        return F.last_day(day)
    if frequency == "week":
        return F.date_add(F.date_trunc("week", day).cast("date"), 6)
    return day


_STEP = {"month": "INTERVAL 1 MONTH", "week": "INTERVAL 7 DAY", "day": "INTERVAL 1 DAY"}


def resample_sum(
    df: DataFrame, date: str, measure: str, frequency: str | None = None
) -> DataFrame:
    """(period, total) with a row for every period in the range, 0 where there is no data."""
    value = numeric_value(measure)
    points = df.select(
        _as_time(df, date).alias("time"), value.alias("value")
    ).dropna()
    covered = resample_frequency(points, "time").first()
    if covered["first_day"] is None:
        raise ValueError(f"no rows with both {date} and {measure}")
    frequency = frequency or covered["frequency"]
    sums = points.groupBy(_period(F.col("time").cast("date"), frequency).alias("period")).agg(
        F.sum("value").alias("total")
    )
    # One row per period between the first and the last day, whatever the size of the table.
    low, high = (F.lit(covered[k]) for k in ("first_day", "last_day"))
    if frequency != "day":
        low, high = F.trunc(low, frequency), F.trunc(high, frequency)
    calendar = (
        df.sparkSession.range(1)
        .select(F.explode(F.sequence(low, high, F.expr(_STEP[frequency]))).alias("day"))
        .select(_period(F.col("day"), frequency).alias("period"))
    )
    return calendar.join(sums, "period", "left").select(
        "period", F.coalesce("total", F.lit(0.0)).alias("total")
    )


def rolling_mean_3(periods: DataFrame) -> DataFrame:
    """Mean of each period and the two before it; runs on period rows only."""
    window = W.orderBy("period").rowsBetween(-2, 0)
    return periods.withColumn("rolling_mean", F.avg("total").over(window))


def time_series(
    df: DataFrame, date: str | None = None, measure: str | None = None
) -> DataFrame:
    """Totals per period with their three-period mean."""
    date = date or date_column(df)
    measure = measure or primary_metric(df)
    if not date or not measure:
        raise ValueError("a time series needs a date column and a measure")
    return rolling_mean_3(resample_sum(df, date, measure))


def pareto_top10(df: DataFrame, category: str, measure: str | None = None) -> DataFrame:
    """The ten categories with the largest totals, or the most frequent ones without a measure."""
    grouped = df.where(column(category).isNotNull()).groupBy(
        column(category).cast("string").alias("category")
    )
    if measure and measure != category:
        value = F.coalesce(F.sum(numeric_value(measure)), F.lit(0.0))
    else:
        value = F.count("*").cast("double")
    return (
        grouped.agg(value.alias("total"))
        .orderBy(F.desc("total"), F.asc("category"))
        .limit(TOP_CATEGORIES)
    )


def top_k_semi_filter(df: DataFrame, category: str, k: int = STACKED_CATEGORIES) -> DataFrame:
    """Rows of the k most frequent values of a column."""
    top = (
        df.where(column(category).isNotNull())
        .groupBy(column(category))
        .agg(F.count("*").alias("__n"))
        .orderBy(F.desc("__n"), column(category).asc())
        .limit(k)
        .select(column(category))
    )
    return df.join(top, category, "left_semi")


def _cells(df: DataFrame, first: str, second: str, value: Column) -> DataFrame:
    return (
        df.where(column(first).isNotNull() & column(second).isNotNull())
        .groupBy(
            column(first).cast("string").alias("category"),
            column(second).cast("string").alias("series"),
        )
        .agg(value.alias("total"))
    )


def pivot_sum_long(df: DataFrame, first: str, second: str, measure: str) -> DataFrame:
    """(category, series, total) for the seven most frequent categories."""
    rows = top_k_semi_filter(df, first)
    return _cells(rows, first, second, F.coalesce(F.sum(numeric_value(measure)), F.lit(0.0)))


def crosstab_long(df: DataFrame, first: str, second: str) -> DataFrame:
    return _cells(df, first, second, F.count("*"))


def _wide(cells: DataFrame, values: list[str]) -> DataFrame:
    return cells.groupBy("category").pivot("series", values).agg(F.first("total")).fillna(0)


def pivot_sum(
    df: DataFrame, first: str, second: str, measure: str, values: list[str] | None = None
) -> DataFrame:
    """A measure by two categories: (category, series, total) with one row per cell.

    With ``values`` of the second category there is one column for each of them instead, missing
    cells 0. Sums are taken per (category, series) first, so only those cells reach the pivot.
    """
    cells = pivot_sum_long(df, first, second, measure)
    return cells if values is None else _wide(cells, values)


def crosstab_count(
    df: DataFrame, first: str, second: str, values: list[str] | None = None
) -> DataFrame:
    """Rows by two categories, in long form or with one column per given value."""
    cells = crosstab_long(df, first, second)
    return cells if values is None else _wide(cells, values)


def _bin(value: Column, low: float, high: float, bins: int) -> Column:
    """1-based bin of equal width; the last one is closed."""
    position = F.floor((value - low) / (high - low) * bins).cast("int") + 1
    return F.least(position, F.lit(bins))


def _finite(name: str) -> Column:
    return F.when(F.abs(numeric_value(name)) < float("inf"), numeric_value(name))


def _range_of(df: DataFrame, names: list[str]) -> list[tuple[float, float] | None]:
    """Smallest and largest finite value per column, widened by a half on each side if they are equal."""
    row = df.agg(
        *[
            e.alias(f"{kind}{i}")
            for i, n in enumerate(names)
            for kind, e in (("low", F.min(_finite(n))), ("high", F.max(_finite(n))))
        ]
    ).first()
    ranges = []
    for i in range(len(names)):
        low, high = row[f"low{i}"], row[f"high{i}"]
        if low is None:
            ranges.append(None)
        else:
            ranges.append((low - 0.5, high + 0.5) if low == high else (low, high))
    return ranges


def histogram(df: DataFrame, measure: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(bin, low, high, n) with every bin present.

    The bins cover the finite values; infinite ones, if there are any, are counted in a further row
    without bin and bounds.
    """
    (limits,) = _range_of(df, [measure])
    if limits is None:
        raise ValueError(f"{measure} has no values")
    low, high = limits
    width = (high - low) / bins
    value = numeric_value(measure)
    counted = (
        df.where(column(measure).isNotNull() & value.isNotNull())
        .groupBy(F.when(F.abs(value) < float("inf"), _bin(_finite(measure), low, high, bins)).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    endless = counted.where("bin IS NULL").select(
        "bin", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), "n"
    )
    frame = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counted, "bin", "left").select(
        "bin",
        (F.lit(low) + (F.col("bin") - 1) * width).alias("low"),
        (F.lit(low) + F.col("bin") * width).alias("high"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    ).unionAll(endless)


def p50_p90(df: DataFrame, measures: list[str], approx: bool = False) -> DataFrame:
    """Median and 90th percentile per measure, the markers of the histogram."""
    values = column_quantiles(df, measures, [0.5, 0.9], approx)
    rows = [(n, *values[n]) for n in measures]
    return small_table(df.sparkSession, rows, "column string, p50 double, p90 double")


def scatter_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """Complete pairs of two columns, unreduced."""
    return df.select(numeric_value(x).alias("x"), numeric_value(y).alias("y")).dropna()


def scatter_density(df: DataFrame, x: str, y: str, bins: int = SCATTER_BINS) -> DataFrame:
    """The scatter as counts on a grid: as many rows as filled cells, whatever the table size."""
    points = scatter_points(df, x, y).where(
        (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    )
    x_range, y_range = _range_of(points, ["x", "y"])
    if x_range is None:
        raise ValueError(f"{x} and {y} have no complete pairs")
    return points.groupBy(
        _bin(F.col("x"), *x_range, bins).alias("x_bin"),
        _bin(F.col("y"), *y_range, bins).alias("y_bin"),
    ).agg(F.count("*").alias("n"), F.avg("x").alias("x_mean"), F.avg("y").alias("y_mean"))


def linear_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line through the complete pairs; null if x is constant."""
    xs, ys = numeric_value(x), numeric_value(y)
    return df.agg(
        F.regr_count(ys, xs).alias("n"),
        F.regr_slope(ys, xs).alias("slope"),
        F.regr_intercept(ys, xs).alias("intercept"),
    )


def correlation_heatmap(df: DataFrame, include: list[str] | None = None) -> DataFrame:
    """Correlations of all numeric columns, identifiers included, or of the columns in a list."""
    names = numeric_names(df) if include is None else include
    if len(names) < 2:
        raise ValueError("a correlation heatmap needs two numeric columns")
    return correlation_matrix(df, names)
