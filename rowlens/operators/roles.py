"""What each column is for: identifier, measure, category, date."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlens.session import column, small_table

# Name parts that mark an identifier, after removing blanks and underscores.
IDENTIFIER_NAME_PARTS = ("id", "index", "rownumber", "recordid", "uuid", "key")


@dataclass
class Roles:
    """Column names by role, each list in table order."""

    numeric: list[str] = field(default_factory=list)
    identifier: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    datetime: list[str] = field(default_factory=list)
    boolean: list[str] = field(default_factory=list)
    other: list[str] = field(default_factory=list)

    def of(self, name: str) -> str:
        return next(role for role, names in vars(self).items() if name in names)


def numeric_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def datetime_names(df: DataFrame) -> list[str]:
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def boolean_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)]


def named_like_identifier(name: str) -> bool:
    plain = name.lower().replace("_", "").replace(" ", "")
    return any(part in plain for part in IDENTIFIER_NAME_PARTS)


def gap_free_sequences(df: DataFrame, names: list[str]) -> list[str]:
    """Integer columns whose sorted values go up by one from row to row.

    Range and count come first and cost one pass without a shuffle; distinct values are counted, all
    columns in one job, only where the range already fits the number of rows.
    """
    integers = [n for n in names if isinstance(df.schema[n].dataType, T.IntegralType)]
    if not integers:
        return []
    checks = []
    for name in integers:
        c = column(name)
        width = F.max(c).cast("decimal(38,0)") - F.min(c).cast("decimal(38,0)") + 1
        fits = (F.count(c) == F.count("*")) & (width == F.count("*"))
        checks.append(F.struct(fits.alias("fits"), F.min(c).cast("bigint").alias("least"), F.count("*").alias("n")))
    found = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(checks)]).first()
    fitting = {n: facts for n, facts in zip(integers, found) if facts["fits"]}
    distinct = _distinct_in_range(df, {n: facts["least"] for n, facts in fitting.items()})
    return [n for n, facts in fitting.items() if distinct[n] == facts["n"]]


def _distinct_in_range(df: DataFrame, least: dict[str, int]) -> dict[str, int]:
    """Distinct values of integer columns by bitmaps, one bit for each value above the least.

    One job for all columns. A task sets bits, so equal and neighbouring values are one entry of its shuffle;
    bitmaps of 32 768 values are put together by ``or`` and counted.
    """
    if not least:
        return {}
    cells = [
        F.struct(F.lit(i).alias("place"), (column(n).cast("bigint") - F.lit(low) + 1).alias("at"))
        for i, (n, low) in enumerate(least.items())
    ]
    bits = (
        df.select(F.inline(F.array(*cells)))
        .groupBy("place", F.bitmap_bucket_number("at").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    )
    counted = bits.groupBy("place").agg(F.sum(F.bitmap_count("bits")).alias("n")).collect()
    by_place = {row["place"]: row["n"] for row in counted}
    return {n: by_place.get(i, 0) for i, n in enumerate(least)}


def find_roles(df: DataFrame) -> Roles:
    numbers = numeric_names(df)
    by_name = [n for n in numbers if named_like_identifier(n)]
    sequences = gap_free_sequences(df, [n for n in numbers if n not in by_name])
    identifiers = [n for n in numbers if n in by_name or n in sequences]
    roles = Roles(
        numeric=[n for n in numbers if n not in identifiers],
        identifier=identifiers,
        categorical=text_names(df),
        datetime=datetime_names(df),
        boolean=boolean_names(df),
    )
    known = {n for names in vars(roles).values() for n in names}
    roles.other = [n for n in df.columns if n not in known]
    return roles


def column_roles(df: DataFrame) -> DataFrame:
    roles = find_roles(df)
    rows = [(i, n, roles.of(n)) for i, n in enumerate(df.columns)]
    return small_table(df.sparkSession, rows, "position int, column string, role string")


def identifier_columns(df: DataFrame) -> DataFrame:
    """Identifier columns with the range they cover."""
    names = find_roles(df).identifier
    if not names:
        return small_table(
            df.sparkSession,
            [],
            "column string, min_value double, max_value double, n_values bigint",
        )
    ranges = df.agg(
        *[
            F.struct(
                F.lit(n).alias("column"),
                F.min(column(n)).cast("double").alias("min_value"),
                F.max(column(n)).cast("double").alias("max_value"),
                F.count(column(n)).alias("n_values"),
            ).alias(f"c{i}")
            for i, n in enumerate(names)
        ]
    )
    return ranges.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(names))])))
