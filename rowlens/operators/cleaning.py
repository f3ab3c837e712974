"""Cleaning: duplicates, number-like text, missing values.

Which text columns become numbers depends on the data, so one aggregate over all text columns
decides; the cleaned table itself is a plain projection of the de-duplicated, converted table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.functions.numbers import (
    formatted_text_to_number,
    is_formatted_number,
    is_number,
    strip_number_decoration,
    to_number,
)
from rowlens.operators.counts import present
from rowlens.operators.quality import (
    COLUMNS_PER_AGGREGATE,
    Repeated,
    repeated_hashes,
    without_duplicates,
)
from rowlens.operators.quantiles import column_quantiles
from rowlens.operators.roles import boolean_names, datetime_names, numeric_names, text_names
from rowlens.session import column, small_table, stage_table

FILL_TEXT = "Unknown"
REPORT_SCHEMA = (
    "column string, action string, strategy string, fill_value string, n_affected bigint"
)


@dataclass
class Cleaned:
    """A cleaned table and what was done to it."""

    table: DataFrame
    actions: DataFrame
    original_rows: int
    duplicates_removed: int
    rows_after_cleaning: int

    @property
    def report(self) -> DataFrame:
        """One row per step: row counts first, then per column."""
        totals = [
            (None, "rows_before", None, None, self.original_rows),
            (None, "duplicates_removed", None, None, self.duplicates_removed),
            (None, "rows_after", None, None, self.rows_after_cleaning),
        ]
        return small_table(self.table.sparkSession, totals, REPORT_SCHEMA).unionByName(self.actions)


def trim_headers(df: DataFrame) -> DataFrame:
    """Blanks around column names go; a name that is taken by then gets the next free number."""
    names: list[str] = []
    for name in (n.strip() for n in df.columns):
        free, number = name, 2
        while free in names:
            free, number = f"{name}_{number}", number + 1
        names.append(free)
    return df.toDF(*names)


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One of each group of equal rows."""
    return without_duplicates(df)


def text_number_facts(df: DataFrame, names: list[str]) -> dict[str, dict]:
    """Per text column: rows, values, values that look like formatted numbers, convertible values."""
    facts: dict[str, dict] = {}
    for start in range(0, len(names), COLUMNS_PER_AGGREGATE // 2):
        chunk = names[start : start + COLUMNS_PER_AGGREGATE // 2]
        row = df.agg(
            *[
                F.struct(
                    F.count("*").alias("n_rows"),
                    F.count(column(n)).alias("n_values"),
                    F.count_if(is_formatted_number(column(n))).alias("n_formatted"),
                    # What looks formatted always converts; only the rest needs the second look.
                    F.count_if(
                        is_formatted_number(column(n))
                        | is_number(strip_number_decoration(column(n)))
                    ).alias("n_from_formatted"),
                    F.count_if(is_number(column(n))).alias("n_plain"),
                ).alias(f"c{i}")
                for i, n in enumerate(chunk)
            ]
        ).first()
        facts.update({n: r.asDict() for n, r in zip(chunk, row)})
    return facts


def text_conversions(facts: dict[str, dict]) -> dict[str, str]:
    """Which text columns become numbers, and how.

    Formatted: more than half of the values look like numbers and more than half of all rows
    convert. Plain: fewer than 5 % of all rows, nulls included, do not convert.
    """
    chosen = {}
    for name, f in facts.items():
        formatted = f["n_values"] and f["n_formatted"] / f["n_values"] > 0.5
        if formatted and f["n_from_formatted"] / f["n_rows"] > 0.5:
            chosen[name] = "formatted_string_to_numeric"
        elif f["n_plain"] and (f["n_rows"] - f["n_plain"]) / f["n_rows"] < 0.05:
            chosen[name] = "object_to_numeric"
    return chosen


def _converted(df: DataFrame, conversions: dict[str, str]) -> DataFrame:
    how = {
        "formatted_string_to_numeric": formatted_text_to_number,
        "object_to_numeric": to_number,
    }
    return df.select(
        *[
            (how[conversions[n]](column(n)) if n in conversions else present(df, n)).alias(n)
            for n in df.columns
        ]
    )


def formatted_text_to_numbers(df: DataFrame) -> DataFrame:
    """Convert the columns that hold formatted numbers; others stay as they are."""
    chosen = text_conversions(text_number_facts(df, text_names(df)))
    return _converted(df, {n: h for n, h in chosen.items() if h == "formatted_string_to_numeric"})


def near_numeric_text_to_numbers(df: DataFrame) -> DataFrame:
    """Convert nearly numeric text columns, the unconvertible rest becoming the median."""
    chosen = text_conversions(text_number_facts(df, text_names(df)))
    plain = {n: h for n, h in chosen.items() if h == "object_to_numeric"}
    converted = _converted(df, plain)
    medians = column_quantiles(converted, list(plain), [0.5])
    return converted.fillna({n: medians[n][0] for n in plain}) if plain else converted


def fill_numeric_median(df: DataFrame, names: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Missing numbers become the exact median, 0 in a column without values."""
    names = numeric_names(df) if names is None else names
    medians = column_quantiles(df, names, [0.5], approx)
    return df.select(
        *[_filled(df, n, medians[n][0]) if n in names else column(n) for n in df.columns]
    )


def _filled(df: DataFrame, name: str, median: float | None) -> Column:
    return F.coalesce(present(df, name).cast("double"), F.lit(median or 0.0)).alias(name)


def fill_text_unknown(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    names = text_names(df) if names is None else names
    return df.fillna(FILL_TEXT, subset=names) if names else df


def drop_null_rows_on(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows with a missing value in any of the columns are removed; NaN counts as missing."""
    return df.dropna(subset=names)


def missing_dates(df: DataFrame) -> DataFrame:
    """Date columns that keep their nulls, with the number of them."""
    names = datetime_names(df)
    if not names:
        return small_table(df.sparkSession, [], "column string, n_missing bigint")
    counts = df.agg(
        *[F.count_if(column(n).isNull()).alias(f"c{i}") for i, n in enumerate(names)]
    )
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("column"), F.col(f"c{i}").alias("n_missing"))
                    for i, n in enumerate(names)
                ]
            )
        )
    ).where("n_missing > 0")


def clean_with_report(
    df: DataFrame, approx: bool = False, repeated: Repeated | None = None
) -> Cleaned:
    """De-duplicate, convert number-like text, fill missing values.

    ``repeated`` are the hashes of possible copies, where they are known already.
    """
    spark = df.sparkSession
    df = trim_headers(df)
    original = df.count()
    if original == 0:
        return Cleaned(df, small_table(spark, [], REPORT_SCHEMA), 0, 0, 0)

    repeated = repeated or repeated_hashes(df)
    df = without_duplicates(df, repeated)
    facts = text_number_facts(df, text_names(df))
    conversions = text_conversions(facts)
    numbers = _converted(df, conversions)
    if repeated.count or conversions:
        # Many passes follow; a written copy lets each read only the columns it needs, converted.
        numbers = stage_table(numbers, "converted")
    rows, *gaps = numbers.agg(
        F.count("*").alias("n"),
        *[F.count_if(column(n).isNull()).alias(f"c{i}") for i, n in enumerate(numbers.columns)],
    ).first()
    missing = dict(zip(numbers.columns, gaps))

    to_fill = [n for n in numeric_names(numbers) if missing[n]]
    medians = {
        n: q[0] if q[0] is not None else 0.0
        for n, q in column_quantiles(numbers, to_fill, [0.5], approx).items()
    }
    dates, flags = datetime_names(numbers), boolean_names(numbers)
    texts = text_names(numbers)

    actions, columns = [], []
    for name in numbers.columns:
        how, gaps = conversions.get(name), missing[name]
        value = column(name)
        if how:
            actions.append((name, "conversion", how, None, rows - gaps))
        if name in medians:
            value = _filled(numbers, name, medians[name])
            if how != "object_to_numeric":
                actions.append((name, "missing", "median_fill", repr(medians[name]), gaps))
            elif rows > facts[name]["n_values"]:
                # Such a column is filled as text before it turns out to be numeric.
                nulls = rows - facts[name]["n_values"]
                actions.append((name, "missing", "constant_fill", FILL_TEXT, nulls))
        elif gaps and name in dates:
            actions.append((name, "missing", "retained_nat", "NaT", gaps))
        elif gaps and (name in texts or name in flags):
            text = F.initcap(value.cast("string")) if name in flags else value
            value = F.coalesce(text, F.lit(FILL_TEXT))
            actions.append((name, "missing", "constant_fill", FILL_TEXT, gaps))
        columns.append(value.alias(name))
    return Cleaned(
        numbers.select(*columns),
        small_table(spark, actions, REPORT_SCHEMA),
        original,
        original - rows,
        rows,
    )


def clean(df: DataFrame) -> DataFrame:
    return clean_with_report(df).table


def cleaning_report(df: DataFrame) -> DataFrame:
    return clean_with_report(df).report
