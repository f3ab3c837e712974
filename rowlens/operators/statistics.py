"""The six analyses: descriptive, correlation, trend, outliers, value counts, grouped summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlens.operators.correlation import correlation_matrix
from rowlens.operators.counts import distinct_counts, present
from rowlens.operators.profile import (
    MEASURES_PER_AGGREGATE,
    QUARTILES,
    per_column,
    top_values,
)
from rowlens.operators.quantiles import column_quantiles, numeric_value
from rowlens.operators.roles import Roles, find_roles
from rowlens.session import column, small_table

TOP_VALUES = 10
TOP_GROUPS = 10
# Groups a category needs to be worth comparing.
COMPARABLE_GROUPS = (2, 20)
# Text that stands for a missing value in value counts.
MISSING_TEXT = "nan"
ANALYSES = (
    "descriptive_stats", "correlation_analysis", "trend_analysis", "outlier_detection",
    "value_counts_analysis", "grouped_summary_analysis",
)


Quartiles = dict[str, list[float | None]]


def descriptive_stats(
    df: DataFrame, names: list[str], approx: bool = False, quartiles: Quartiles | None = None
) -> DataFrame:
    """Unrounded summary per measure; measures without values are left out.

    ``quartiles`` may be given where they are known already, here and in the outlier functions.
    """
    quartiles = quartiles or column_quantiles(df, names, QUARTILES, approx)

    def fields(name: str) -> list[Column]:
        c = numeric_value(name)
        q25, median, q75 = (F.lit(q).cast("double") for q in quartiles[name])
        return [
            F.count(c).alias("count"),
            F.avg(c).alias("mean"),
            F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std"),
            F.min(c).alias("min"),
            q25.alias("p25"),
            median.alias("p50"),
            q75.alias("p75"),
            F.max(c).alias("max"),
            F.sum(c).alias("sum"),
        ]

    return per_column(df, names, fields, MEASURES_PER_AGGREGATE).where("count > 0")


def default_tie_break(df: DataFrame, roles: Roles, used: list[str]) -> list[str]:
    """Columns that decide between rows of the same date: identifiers, else all other columns."""
    orderable = [
        f.name for f in df.schema
        if not isinstance(f.dataType, (T.MapType, T.VariantType)) and f.name not in used
    ]
    return [n for n in roles.identifier if n in orderable] or orderable


def trend_change(
    df: DataFrame, date: str, names: list[str], tie_break: list[str]
) -> DataFrame:
    """First and last value by date and the change in percent, for each measure.

    A plain minimum and maximum finds the first and last date at which each measure has a value;
    only the rows of those dates are then put in order by the tie-break columns, and the filter on
    the dates reaches the scan. Rows with a missing date or value are ignored.
    """
    present_at = [F.when(numeric_value(n).isNotNull(), column(date)) for n in names]
    ends = df.agg(
        *[
            end(c).cast("string").alias(f"{end.__name__}{i}")
            for i, c in enumerate(present_at)
            for end in (F.min, F.max)
        ]
    ).first()
    dtype = df.schema[date].dataType
    days = [F.lit(day).cast(dtype) for day in sorted({d for d in ends if d is not None})]
    rows = df.where(column(date).isin(*days))

    def fields(name: str) -> list[Column]:
        value = numeric_value(name)
        order = F.when(
            value.isNotNull(),
            F.struct(column(date), *[column(t) for t in tie_break if t != name], value),
        )
        first, last = F.min_by(value, order), F.max_by(value, order)
        return [
            F.lit(date).alias("date_column"),
            first.alias("first_value"),
            last.alias("last_value"),
            F.when(first == 0, 0.0)
            .otherwise(F.try_divide(last - first, first) * 100)
            .alias("percent_change"),
        ]

    return per_column(rows, names, fields, MEASURES_PER_AGGREGATE).where("first_value IS NOT NULL")


def outlier_fences(
    df: DataFrame, names: list[str], approx: bool = False, quartiles: Quartiles | None = None
) -> dict[str, tuple[float, float]]:
    """Quartiles widened by 1.5 interquartile ranges, for columns with values."""
    if quartiles is None:
        found = column_quantiles(df, names, [0.25, 0.75], approx)
        quartiles = {n: [q1, None, q3] for n, (q1, q3) in found.items()}
    fences = {}
    for name in names:
        q1, _, q3 = quartiles[name]
        if q1 is not None:
            fences[name] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return fences


def _outside(name: str, fence: tuple[float, float]) -> Column:
    value = numeric_value(name)
    return (value < fence[0]) | (value > fence[1])


def iqr_outliers(
    df: DataFrame, names: list[str], approx: bool = False, quartiles: Quartiles | None = None
) -> DataFrame:
    """Values strictly outside the fences per measure with at least four values."""
    fences = outlier_fences(df, names, approx, quartiles)
    known = [n for n in names if n in fences]
    if not known:
        return small_table(df.sparkSession, [], OUTLIER_SCHEMA)

    def fields(name: str) -> list[Column]:
        low, high = fences[name]
        return [
            F.count(numeric_value(name)).alias("n_values"),
            F.count_if(_outside(name, fences[name])).alias("outlier_count"),
            F.lit(low).alias("lower_bound"),
            F.lit(high).alias("upper_bound"),
        ]

    return (
        per_column(df, known, fields, 4 * MEASURES_PER_AGGREGATE)
        .where("n_values >= 4")
        .drop("n_values")
    )


OUTLIER_SCHEMA = (
    "position int, column string, outlier_count bigint, lower_bound double, upper_bound double"
)


def outlier_rows(df: DataFrame, names: list[str], approx: bool = False) -> DataFrame:
    """Rows with a value outside the fences, and in which columns."""
    fences = outlier_fences(df, names, approx)
    hits = F.array_compact(
        F.array(*[F.when(_outside(n, fence), n) for n, fence in fences.items()])
    )
    return df.withColumn("outlier_columns", hits).where(F.size("outlier_columns") > 0)


def value_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """The ten most frequent values of each category; missing shows as text."""
    texts = df.select(
        *[F.coalesce(present(df, n).cast("string"), F.lit(MISSING_TEXT)).alias(n) for n in names]
    )
    return top_values(texts, names, TOP_VALUES)


def grouping_category(df: DataFrame, names: list[str]) -> str | None:
    """The first category with 2 to 20 values; the columns are counted together in one pass."""
    if not names:
        return None
    counts = {r["column"]: r["distinct_count"] for r in distinct_counts(df, names).collect()}
    low, high = COMPARABLE_GROUPS
    return next((n for n in names if low <= counts[n] <= high), None)


def grouped_summary(
    df: DataFrame, category: str | None = None, measure: str | None = None, auto: bool = False
) -> DataFrame:
    """Total, average, count and spread of a measure for the ten largest groups, with their rank.

    With ``auto`` a category or measure that is not given is chosen by the columns' roles: the first
    category with 2 to 20 values and the first measure.
    """
    if auto and not (category and measure):
        roles = find_roles(df)
        category = category or grouping_category(df, roles.categorical)
        measure = measure or next(iter(roles.numeric), None)
    if not category or not measure:
        raise ValueError("a grouped summary needs a category and a measure")
    value = numeric_value(measure)
    top = (
        df.where(column(category).isNotNull())
        .groupBy(column(category).cast("string").alias("group"))
        .agg(
            F.coalesce(F.sum(value), F.lit(0.0)).alias("total"),
            F.avg(value).alias("average"),
            F.count(value).alias("count"),
            F.stddev_samp(value).alias("std_dev"),
        )
        .orderBy(F.desc("total"), F.asc("group"))
        .limit(TOP_GROUPS)
    )
    return dense_rank_groups(top)


def dense_rank_groups(top: DataFrame) -> DataFrame:
    """Dense rank by total; meant for the few groups a top-k has kept."""
    return top.withColumn("rank", F.dense_rank().over(W.orderBy(F.desc("total"))).cast("bigint"))


# What each analysis takes: measures, categories and dates at least.
NEEDS = {
    "descriptive_stats": (1, 0, 0), "correlation_analysis": (2, 0, 0), "trend_analysis": (1, 0, 1),
    "outlier_detection": (1, 0, 0), "value_counts_analysis": (0, 1, 0),
    "grouped_summary_analysis": (1, 1, 0),
}


def skip_reasons(roles: Roles) -> list[tuple[str, str]]:
    """Analyses the columns of a table do not allow, and what they lack."""
    there = (len(roles.numeric), len(roles.categorical), len(roles.datetime))
    kinds = ("measure", "category", "date")
    lacking = {
        name: [f"{least} {kind} column(s), {has} found"
               for least, kind, has in zip(needs, kinds, there) if has < least]
        for name, needs in NEEDS.items()
    }
    return [(name, "needs " + "; ".join(gaps)) for name, gaps in lacking.items() if gaps]


def run_analyses(
    df: DataFrame,
    analyses: list[str],
    roles: Roles,
    approx: bool = False,
    tie_break: list[str] | None = None,
    quartiles: Quartiles | None = None,
    group_by: str | None = None,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Result table per analysis, and (analysis, status, reason) for all that was asked for.

    ``group_by`` is the category of the grouped summary; without it the first one with 2 to 20 values
    is taken, and if there is none the first. Unknown names do not stop the others; an empty request or one with no known name does.
    Quartiles are computed once for the analyses that share them.
    """
    if not analyses:
        raise ValueError("no analyses requested")
    reasons = dict(skip_reasons(roles))
    results: dict[str, DataFrame] = {}
    status = []
    if quartiles is None and {"descriptive_stats", "outlier_detection"} & set(analyses):
        quartiles = column_quantiles(df, roles.numeric, QUARTILES, approx)
    for name in dict.fromkeys(analyses):
        if name not in ANALYSES:
            status.append((name, "unsupported", None))
        elif name in reasons:
            status.append((name, "skipped", reasons[name]))
        else:
            results[name] = _analysis(df, name, roles, quartiles, tie_break, group_by)
            status.append((name, "done", None))
    if all(state == "unsupported" for _, state, _ in status):
        raise ValueError("none of the requested analyses is known")
    log = small_table(df.sparkSession, status, "analysis string, status string, reason string")
    return results, log


def _analysis(
    df: DataFrame, name: str, roles: Roles, quartiles: Quartiles, tie_break: list[str] | None,
    group_by: str | None,
) -> DataFrame:
    if name == "descriptive_stats":
        return descriptive_stats(df, roles.numeric, quartiles=quartiles)
    if name == "correlation_analysis":
        return correlation_matrix(df, roles.numeric)
    if name == "trend_analysis":
        date = roles.datetime[0]
        ties = default_tie_break(df, roles, [date]) if tie_break is None else tie_break
        return trend_change(df, date, roles.numeric, ties)
    if name == "outlier_detection":
        return iqr_outliers(df, roles.numeric, quartiles=quartiles)
    if name == "value_counts_analysis":
        return value_counts(df, roles.categorical)
    category = group_by or grouping_category(df, roles.categorical) or roles.categorical[0]
    return grouped_summary(df, category, roles.numeric[0])


# How each result maps to (column, metric, value): key column, then value columns.
_LONG_FORM = {
    "descriptive_stats": ("column", ["count", "mean", "std", "min", "p25", "p50", "p75", "max", "sum"]),
    "trend_analysis": ("column", ["first_value", "last_value", "percent_change"]),
    "outlier_detection": ("column", ["outlier_count", "lower_bound", "upper_bound"]),
    "grouped_summary_analysis": ("group", ["total", "average", "count", "std_dev", "rank"]),
}


def stats_long(results: dict[str, DataFrame]) -> DataFrame:
    """All analysis results as (analysis, column, metric, value)."""
    parts = None
    for name, frame in results.items():
        if name == "correlation_analysis":
            part = frame.select(
                F.col("left_column").alias("column"),
                F.col("right_column").alias("metric"),
                F.col("r").alias("value"),
            )
        elif name == "value_counts_analysis":
            part = frame.select(
                "column", F.col("value").alias("metric"), F.col("n").cast("double").alias("value")
            )
        else:
            key, metrics = _LONG_FORM[name]
            cells = [
                F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                for m in metrics
            ]
            part = frame.select(F.col(key).alias("column"), F.inline(F.array(*cells)))
        part = part.select(F.lit(name).alias("analysis"), "column", "metric", "value")
        parts = part if parts is None else parts.unionByName(part)
    return parts
