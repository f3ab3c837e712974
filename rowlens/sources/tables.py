"""Reading tables: CSV with inferred types, and Parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from rowlens.functions.numbers import (
    BOOLEAN_TEXTS,
    INTEGER_TEXT,
    is_number,
    null_token_to_null,
)
from rowlens.operators.cleaning import trim_headers
from rowlens.operators.roles import text_names
from rowlens.session import column, quoted, stage_table
from rowlens.sources.dates import DATE_HINTS, date_candidates, date_evidence, date_kind, parse_date_columns
from rowlens.sources.records import Borders, csv_records, find_borders, record_text, text_lines

COLUMNS_PER_AGGREGATE = 20
# What Spark writes for bytes that are not valid UTF-8.
REPLACEMENT = "�"
NO_DATA = "the file holds no rows or no columns"


class LoadError(ValueError):
    """A file cannot be read as a table."""


def null_tokens(df: DataFrame) -> DataFrame:
    """The usual spellings of a missing value become null in all text columns."""
    texts = set(text_names(df))
    return df.select(
        *[
            (null_token_to_null(column(n)) if n in texts else column(n)).alias(n)
            for n in df.columns
        ]
    )


def _text_facts(
    df: DataFrame, names: list[str], more: dict[str, Column] | None = None, pruned: DataFrame | None = None
) -> tuple[dict[str, Row], Row | None]:
    """Per text column: values, how many fit each type, how many hold undecodable bytes, and what the
    values tell about dates where the name hints at one. One scan for every 20 columns.

    ``more`` are further aggregates of the first scan, which is the only one that reads ``df`` if there is
    a ``pruned`` table with the same columns.
    """
    facts, found = {}, None
    for start in range(0, max(len(names), 1), COLUMNS_PER_AGGREGATE):
        chunk = names[start : start + COLUMNS_PER_AGGREGATE]
        own = [F.struct(*[c.alias(n) for n, c in more.items()]).alias("more")] if more and not start else []
        hinted = [n for n in chunk if any(hint in n.lower() for hint in DATE_HINTS)]
        table = df if pruned is None or not start else pruned
        # As columns of their own, the kinds are computed once for all counts.
        row = table.select("*", *[date_kind(column(n)).alias(f"{KIND}{n}") for n in hinted]).agg(
            *own,
            *[
                F.struct(
                    F.count("*").alias("n_rows"),
                    F.count(column(n)).alias("n"),
                    F.count(
                        F.when(column(n).rlike(INTEGER_TEXT), F.trim(column(n)).try_cast("bigint"))
                    ).alias("bigint"),
                    F.count_if(is_number(column(n))).alias("double"),
                    F.count_if(column(n).isin(*BOOLEAN_TEXTS)).alias("boolean"),
                    F.count_if(column(n).contains(REPLACEMENT)).alias("undecoded"),
                    (date_evidence(column(n), column(f"{KIND}{n}")) if n in hinted else F.lit(None)).alias("dates"),
                ).alias(f"c{i}")
                for i, n in enumerate(chunk)
            ],
        ).first()
        if own:
            found = row["more"]
        facts.update({n: row[f"c{i}"] for i, n in enumerate(chunk)})
    return facts, found


def _type_from(facts: Row) -> str:
    """The narrowest type that fits all values; a column without values counts as numeric."""
    if not facts["n"]:
        return "double"
    for kind in ("bigint", "double", "boolean"):
        if facts[kind] == facts["n"]:
            return kind
    return "string"


def _typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.select(
        *[
            (F.trim(column(n)).try_cast(types[n]) if types.get(n, "string") != "string" else column(n))
            .alias(n)
            for n in df.columns
        ]
    )


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns become bigint, double or boolean if all their values fit."""
    facts, _ = _text_facts(df, text_names(df))
    return _typed(df, {n: _type_from(f) for n, f in facts.items()})


def _read_text(spark: SparkSession, path: str, encoding: str, multiline: bool) -> DataFrame:
    return (
        spark.read.option("header", True)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .csv(path)
    )


RECORD, KIND = "__record", "__kind_of_"
_FORM = {"quote": '"', "escape": '"'}


def _plain_table(spark: SparkSession, path: str, names: list[str], encoding: str, multiline: bool, checked: bool) -> DataFrame:
    """All columns as text by Spark's reader; ``checked`` adds the record of rows of another width."""
    schema = ", ".join(f"{quoted(n)} string" for n in names) + (f", {RECORD} string" if checked else "")
    return (
        spark.read.schema(schema).options(**_FORM, header=True, encoding=encoding, multiLine=multiline)
        # A row's width shows only if the whole row is parsed.
        .options(columnPruning=not checked, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord=RECORD)
        .csv(path)
    )


def _broken_table(lines: DataFrame, borders: Borders, names: list[str], encoding: str) -> DataFrame:
    """The same from records that may hold line breaks, with the record of rows of another width."""
    text = csv_records(lines, borders).select(record_text(F.col("record"), encoding).alias("record"))
    schema = ", ".join(f"{quoted(n)} string" for n in [*names, RECORD])
    form = {**_FORM, "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": RECORD}
    return text.where(F.trim("record") != "").select(F.from_csv("record", schema, form).alias("row")).select("row.*")


def _wide_rows(names: list[str]) -> dict[str, Column]:
    """How many rows have more fields than the header, and one of them; rows with fewer end in nulls."""
    record = column(RECORD)
    plain = F.regexp_replace(record, '"(?:[^"]|"")*"', "")
    wide = record.isNotNull() & (F.regexp_count(plain, F.lit(",")) >= len(names))
    return {"n": F.count_if(wide), "one": F.min(F.when(wide, F.substring(record, 1, 200)))}


def load_csv(
    spark: SparkSession, path: str, multiline: bool | None = None, stage: bool = False
) -> DataFrame:
    """A CSV file, or a folder of them, as a typed table.

    One scan counts quotes, one settles types, missing-value spellings, dates and the width of all rows,
    and the result reads the text a third time. Files are read by byte ranges throughout, also where line
    breaks stand inside quotes; only files that have these and lone carriage returns as well are read in one
    task each. Bytes that are not UTF-8 make the file read as Latin-1. Nothing is lost silently: rows
    with more fields than the header are an error that shows one of them. ``multiline`` False says that
    no value holds a line break, which saves the first scan. ``stage`` writes the typed table once as
    Parquet to the shared folder, which pays off before a run with many passes.
    """
    if not path.rstrip("/").lower().endswith(".csv"):
        raise LoadError(f"not a .csv file or folder: {path}")
    try:
        lines = text_lines(spark, path)
        borders = Borders() if multiline is False else find_borders(lines)
        names = _read_text(spark, path, "UTF-8", borders.broken).columns
    except AnalysisException as error:
        raise LoadError(f"no such file: {path}") from error
    if not names:
        raise LoadError(NO_DATA)
    by_ranges = borders.broken and not borders.lone_returns

    def read(encoding: str, checked: bool) -> DataFrame:
        if by_ranges:
            return _broken_table(lines, borders, names, encoding)
        return _plain_table(spark, path, names, encoding, borders.broken, checked)

    def facts_of(encoding: str) -> tuple[dict[str, Row], Row | None]:
        return _text_facts(
            null_tokens(read(encoding, True)), names, _wide_rows(names),
            None if by_ranges else null_tokens(read(encoding, False)),
        )

    encoding = "UTF-8"
    facts, wide = facts_of(encoding)
    if any(f["undecoded"] for f in facts.values()) or any(REPLACEMENT in n for n in names):
        encoding = "ISO-8859-1"
        names = _read_text(spark, path, encoding, borders.broken).columns
        facts, wide = facts_of(encoding)
    if wide["n"]:
        raise LoadError(
            f"{wide['n']} row(s) of {path} have more fields than the {len(names)} of the header, "
            f"for example: {wide['one']}"
        )
    if not next(iter(facts.values()))["n_rows"]:
        raise LoadError(NO_DATA)
    text = null_tokens(read(encoding, False)).select(*[column(n) for n in names])
    typed = trim_headers(_typed(text, {n: _type_from(f) for n, f in facts.items()}))
    dates = dict(zip(typed.columns, (facts[n]["dates"] for n in names)))
    table = parse_date_columns(typed, {n: dates[n] for n in date_candidates(typed)})
    return stage_table(table, "loaded") if stage else table


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with trimmed column names."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as error:
        raise LoadError(f"no such file: {path}") from error
    return trim_headers(df)
