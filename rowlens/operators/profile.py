"""Per-column profiles of measures, categories and dates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowlens.functions.numbers import finite_or_null, fixed, sanitized
from rowlens.functions.statistics import percent, sample_skewness
from rowlens.operators.counts import distinct_counts, frequent_and_totals, most_frequent
from rowlens.operators.quantiles import column_quantiles, numeric_value
from rowlens.operators.roles import Roles, find_roles, numeric_names
from rowlens.session import column, pin, run_together, small_table

# Measures per aggregate, so that the buffers of one aggregate stay within generated code.
MEASURES_PER_AGGREGATE = 6
QUARTILES = [0.25, 0.5, 0.75]
ALL_MISSING = "All values are NaN"


@dataclass
class Profile:
    """The profile of a table: roles, quartiles, and one result table per kind of column."""

    row_count: int
    roles: Roles
    quartiles: dict[str, list[float | None]]
    numeric: DataFrame
    categorical: DataFrame
    datetime: DataFrame


def per_column(df: DataFrame, names: list[str], fields, batch: int) -> DataFrame:
    """One row per column from wide aggregates; ``fields(name)`` gives the row's expressions."""
    parts = None
    for start in range(0, len(names), batch):
        chunk = list(enumerate(names[start : start + batch], start))
        part = df.agg(
            *[
                F.struct(
                    F.lit(i).alias("position"), F.lit(n).alias("column"), *fields(n)
                ).alias(f"c{i}")
                for i, n in chunk
            ]
        ).select(F.inline(F.array(*[F.col(f"c{i}") for i, _ in chunk])))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def numeric_profile(
    df: DataFrame,
    names: list[str] | None = None,
    approx: bool = False,
    quartiles: dict[str, list[float | None]] | None = None,
    rounded: bool = True,
) -> DataFrame:
    """One row per measure; a measure without values only gets a skip reason.

    ``quartiles`` may be given where they are known already. Figures have four decimals and percentages
    two, unless ``rounded`` is false.
    """
    names = find_roles(df).numeric if names is None else names
    if not names:
        return small_table(df.sparkSession, [], NUMERIC_SCHEMA)
    quartiles = quartiles or column_quantiles(df, names, QUARTILES, approx)

    def shown(c: Column, digits: int = 4) -> Column:
        return F.round(finite_or_null(c), digits) if rounded else finite_or_null(c)

    def fields(name: str) -> list[Column]:
        c = numeric_value(name)
        q25, median, q75 = (F.lit(q).cast("double") for q in quartiles[name])
        n, zeros = F.count(c), F.count_if(c == 0)
        missing = F.count("*") - n
        filled = n > 0

        def if_filled(value: Column) -> Column:
            return F.when(filled, value)

        return [
            shown(F.avg(c)).alias("mean"),
            shown(median).alias("median"),
            if_filled(shown(F.coalesce(F.stddev_samp(c), F.lit(0.0)))).alias("std"),
            shown(F.min(c)).alias("min"),
            shown(q25).alias("q25"),
            shown(q75).alias("q75"),
            shown(q75 - q25).alias("iqr"),
            shown(F.max(c)).alias("max"),
            if_filled(shown(sample_skewness(c))).alias("skewness"),
            if_filled(zeros).alias("zero_count"),
            if_filled(shown(percent(zeros, n), 2)).alias("zero_percent"),
            if_filled(missing).alias("missing_count"),
            if_filled(shown(percent(missing, F.count("*")), 2)).alias("missing_percent"),
            F.when(~filled, ALL_MISSING).alias("skipped_reason"),
        ]

    rows = per_column(df, names, fields, MEASURES_PER_AGGREGATE)
    return (
        rows.join(distinct_counts(df, names, approx), "column")
        .withColumn("unique_values", F.when(F.col("skipped_reason").isNull(), F.col("distinct_count")))
        .select(*NUMERIC_COLUMNS)
    )


NUMERIC_COLUMNS = [
    "position", "column", "mean", "median", "std", "min", "q25", "q75", "iqr", "max", "skewness",
    "unique_values", "zero_count", "zero_percent", "missing_count", "missing_percent",
    "skipped_reason",
]
NUMERIC_SCHEMA = (
    "position int, column string, mean double, median double, std double, min double, q25 double, "
    "q75 double, iqr double, max double, skewness double, unique_values bigint, zero_count bigint, "
    "zero_percent double, missing_count bigint, missing_percent double, skipped_reason string"
)
CATEGORICAL_SCHEMA = (
    "position int, column string, unique_values bigint, cardinality_ratio double, "
    "is_high_cardinality boolean, most_frequent string, "
    "top_values array<struct<value:string,n:bigint>>, missing_count bigint, "
    "missing_percent double, skipped_reason string"
)
DATETIME_SCHEMA = (
    "position int, column string, min_date string, max_date string, timespan_days bigint, "
    "unique_dates bigint, missing_count bigint, skipped_reason string"
)


def skewness_table(df: DataFrame, names: list[str]) -> DataFrame:
    return per_column(
        df, names, lambda n: [sample_skewness(numeric_value(n)).alias("skewness")],
        MEASURES_PER_AGGREGATE,
    )


def top_values(df: DataFrame, names: list[str], k: int = 5) -> DataFrame:
    """(column, rank, value, n): the k most frequent values of each column, ties by value.

    The limit per column is applied before the shuffle as well as after it, so a column with very
    many values does not gather in one task.
    """
    return most_frequent(df, names, k)


def mode_values(df: DataFrame, names: list[str]) -> DataFrame:
    """The most frequent value of each column, the smallest among ties."""
    return top_values(df, names, 1).select("column", F.col("value").alias("most_frequent"), "n")


def categorical_profile(
    df: DataFrame, names: list[str] | None = None, k: int = 5
) -> DataFrame:
    """One row per text column. All figures come from one counting of (column, value)."""
    names = find_roles(df).categorical if names is None else names
    if not names:
        return small_table(df.sparkSession, [], CATEGORICAL_SCHEMA)
    done = run_together(
        df.sparkSession, {"top": lambda: frequent_and_totals(df, names, k), "rows": df.count}
    )
    frequent, totals = done["top"]
    top = (
        frequent.groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("top"))
        .select(
            "column",
            F.transform(
                "top", lambda t: F.struct(t["value"].alias("value"), t["n"].alias("n"))
            ).alias("top_values"),
        )
    )
    cells = small_table(
        df.sparkSession,
        [
            (i, n, done["rows"], totals[n]["n"] if n in totals else 0,
             totals[n]["distinct"] if n in totals else None)
            for i, n in enumerate(names)
        ],
        "position int, column string, n_rows bigint, n_values bigint, unique_values bigint",
    )
    ratio = F.round(F.try_divide(F.col("unique_values"), F.col("n_values")), 4)
    missing = F.col("n_rows") - F.col("n_values")
    filled = F.col("n_values") > 0
    return (
        cells.join(top, "column", "left")
        .select(
            "position",
            "column",
            "unique_values",
            ratio.alias("cardinality_ratio"),
            ((ratio > 0.4) & (F.col("unique_values") > 20)).alias("is_high_cardinality"),
            F.get("top_values", F.lit(0))["value"].alias("most_frequent"),
            "top_values",
            F.when(filled, missing).alias("missing_count"),
            F.when(filled, F.round(percent(missing, F.col("n_rows")), 2)).alias("missing_percent"),
            F.when(~filled, ALL_MISSING).alias("skipped_reason"),
        )
    )


def datetime_profile(
    df: DataFrame, names: list[str] | None = None, approx: bool = False
) -> DataFrame:
    """One row per date column; the span is in whole days."""
    names = find_roles(df).datetime if names is None else names
    if not names:
        return small_table(df.sparkSession, [], DATETIME_SCHEMA)

    def fields(name: str) -> list[Column]:
        c = column(name).cast("timestamp_ntz")
        filled = F.count(c) > 0
        return [
            sanitized(F.min(c), "timestamp_ntz").alias("min_date"),
            sanitized(F.max(c), "timestamp_ntz").alias("max_date"),
            F.timestamp_diff("DAY", F.min(c), F.max(c)).alias("timespan_days"),
            F.when(filled, F.count("*") - F.count(c)).alias("missing_count"),
            F.when(~filled, ALL_MISSING).alias("skipped_reason"),
        ]

    rows = per_column(df, names, fields, 4 * MEASURES_PER_AGGREGATE)
    return rows.join(distinct_counts(df, names, approx), "column").select(
        "position",
        "column",
        "min_date",
        "max_date",
        "timespan_days",
        F.when(F.col("skipped_reason").isNull(), F.col("distinct_count")).alias("unique_dates"),
        "missing_count",
        "skipped_reason",
    )


def all_null_skip(df: DataFrame) -> DataFrame:
    """Columns without any value and why the profile leaves them out."""
    rows = per_column(
        df, df.columns, lambda n: [F.count(column(n)).alias("n_values")], 4 * MEASURES_PER_AGGREGATE
    )
    return rows.where("n_values = 0").select("column", F.lit(ALL_MISSING).alias("skipped_reason"))


def dataset_profile(df: DataFrame, approx: bool = False, rounded: bool = True) -> Profile:
    """Profile all columns; the three kinds run at the same time. ``rounded`` is that of ``numeric_profile``."""
    roles = find_roles(df)

    def measures() -> tuple[dict[str, list[float | None]], DataFrame]:
        quartiles = column_quantiles(df, roles.numeric, QUARTILES, approx)
        return quartiles, pin(numeric_profile(df, roles.numeric, approx, quartiles, rounded))

    done = run_together(
        df.sparkSession,
        {
            "rows": df.count,
            "measures": measures,
            "categories": lambda: pin(categorical_profile(df, roles.categorical)),
            "dates": lambda: pin(datetime_profile(df, roles.datetime, approx)),
        },
    )
    quartiles, numeric = done["measures"]
    return Profile(done["rows"], roles, quartiles, numeric, done["categories"], done["dates"])


def profile_long(profile: Profile, digits: int | None = None) -> DataFrame:
    """All profile figures as (kind, column, metric, value as text).

    With ``digits`` numbers have that many decimals; take an unrounded profile for it, since rounding twice
    can go the other way.
    """
    parts = None
    for kind, frame in (
        ("numeric", profile.numeric),
        ("categorical", profile.categorical),
        ("datetime", profile.datetime),
    ):
        metrics = [c for c in frame.columns if c not in ("position", "column", "top_values")]
        numbers = numeric_names(frame) if digits is not None else []
        cells = [
            F.struct(
                F.lit(m).alias("metric"),
                (fixed(F.col(m), digits, False) if m in numbers else F.col(m).cast("string")).alias("value"),
            )
            for m in metrics
        ]
        part = frame.select(F.lit(kind).alias("kind"), "column", F.inline(F.array(*cells)))
        part = part.where(F.col("value").isNotNull())
        parts = part if parts is None else parts.unionByName(part)
    return parts


def dataset_overview(df: DataFrame, roles: Roles | None = None) -> DataFrame:
    """Rows, columns and the number of columns per kind."""
    roles = roles or find_roles(df)
    figures = [
        ("Total Rows", F.count("*")),
        ("Total Columns", F.lit(len(df.columns))),
        ("Numeric Columns", F.lit(len(roles.numeric))),
        ("Categorical Columns", F.lit(len(roles.categorical))),
        ("Datetime Columns", F.lit(len(roles.datetime))),
    ]
    cells = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(label).alias("metric"),
            value.cast("bigint").alias("value"),
        ).alias(f"c{i}")
        for i, (label, value) in enumerate(figures, 1)
    ]
    return df.agg(*cells).select(F.inline(F.array(*[F.col(f"c{i}") for i in range(1, 6)])))


def sanitize_values(df: DataFrame) -> DataFrame:
    """Every column in the form the profile shows: finite, four decimals, times as text."""
    return df.select(
        *[sanitized(column(f.name), f.dataType.simpleString()).alias(f.name) for f in df.schema]
    )


