"""Queries of the data quality operators."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.catalog import sql
from rowlens.catalog.registry import Query, Tables, stacked, union_all
from rowlens.catalog.views import DIRTY, DIRTY_COLUMNS
from rowlens.operators import quality as q

# Types of the dirty view as Spark names them.
DIRTY_TYPES = (
    "bigint", "string", "string", "double", "timestamp_ntz", "string", "string", "double", "string",
)


def _dirty(t: Tables) -> DataFrame:
    return t.view(DIRTY, "orders")


def _report(df: DataFrame) -> DataFrame:
    return q.validation_report(df).select(
        *[
            F.array_join(c, ",").alias(c) if c in ("empty_columns", "constant_columns")
            else F.array_join(c, " | ").alias(c) if c == "warnings" else F.col(c)
            for c in REPORT_NAMES
        ]
    )


def _reports(t: Tables) -> dict:
    frames = {"dirty": _dirty(t), **{n: t[n] for n in TABLE_COLUMNS}}
    return {name: partial(_report, frame) for name, frame in frames.items()}


REPORT_NAMES = (
    "row_count", "column_count", "missing_cells", "missing_percent", "duplicate_rows",
    "duplicate_percent", "empty_columns", "constant_columns", "health_score", "health_grade",
    "warnings",
)
_REPORT_COLUMNS = (
    "row_count:i column_count:i missing_cells:i missing_percent:2 duplicate_rows:i "
    "duplicate_percent:2 empty_columns:s constant_columns:s health_score:2 health_grade:s warnings:s"
)
DIRTY_REPORT = sql.validation(DIRTY, DIRTY_COLUMNS)
TABLE_COLUMNS = {
    "orders": (
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
    ),
    "region": ("r_regionkey", "r_name"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
}


def checklist(report: str) -> str:
    def verdict(good: str, fair: str) -> str:
        return f"CASE WHEN {good} THEN 'PASS' WHEN {fair} THEN 'WARN' ELSE 'FAIL' END"

    checks = (
        ("Missing Values", verdict("missing_percent < 5", "missing_percent < 15"),
         f"{sql.fixed('missing_percent', 1)} || '% missing'"),
        ("Duplicate Rows", verdict("duplicate_rows = 0", "duplicate_rows < 10"),
         "duplicate_rows || ' duplicate(s) found'"),
        ("Overall Data Health", verdict("health_score >= 85", "health_score >= 60"),
         f"{sql.score_text('health_score')} || '/100'"),
        ("Cleaning Applied", "'PASS'", "duplicate_rows || ' row(s) cleaned'"),
    )
    return union_all(
        f"""SELECT {i} AS position, '{name}' AS "check", {status} AS status, {detail} AS detail
            FROM ({report})"""
        for i, (name, status, detail) in enumerate(checks, 1)
    )


_NOT_EMPTY = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{t}' AS dtype, count("{c}") AS n_values,
        count_if("{c}" IS NULL) AS n_missing, count(*) AS n_rows, min("{c}") = max("{c}") AS same
        FROM ({DIRTY})"""
    for c, t in zip(DIRTY_COLUMNS, DIRTY_TYPES)
)

QUERIES = [
    Query(
        "shape", "row_count:i column_count:i cell_count:i", lambda t: q.shape(_dirty(t)),
        f"SELECT count(*) AS row_count, 9 AS column_count, count(*) * 9 AS cell_count FROM ({DIRTY})",
    ),
    Query(
        "missing_cells", "missing_cells:i missing_percent:2", lambda t: q.missing_cells(_dirty(t)),
        DIRTY_REPORT,
    ),
    Query(
        "duplicate_rows", "duplicate_rows:i duplicate_percent:2",
        lambda t: q.duplicate_rows(_dirty(t)), DIRTY_REPORT,
    ),
    Query(
        "dtype_summary", "column:s dtype:s n_values:i n_missing:i",
        lambda t: q.dtype_summary(_dirty(t)), _NOT_EMPTY,
    ),
    Query(
        "empty_columns", "column:s n_rows:i", lambda t: q.empty_columns(_dirty(t)),
        f"SELECT * FROM ({_NOT_EMPTY}) WHERE n_values = 0",
    ),
    Query(
        "constant_columns", "column:s n_values:i", lambda t: q.constant_columns(_dirty(t)),
        f"SELECT * FROM ({_NOT_EMPTY}) WHERE n_values > 0 AND same",
    ),
    Query(
        "health_score", "table_name:s health_score:2",
        lambda t: stacked(_reports(t)),
        f"SELECT 'dirty' AS table_name, health_score FROM ({DIRTY_REPORT}) UNION ALL "
        + " UNION ALL ".join(
            f"SELECT '{n}' AS table_name, health_score "
            f"FROM ({sql.validation(f'SELECT * FROM {n}', c)})"
            for n, c in TABLE_COLUMNS.items()
        ),
    ),
    Query("health_grade", "health_grade:s", lambda t: _report(_dirty(t)), DIRTY_REPORT),
    Query(
        "quality_warnings", "position:i warning:s", lambda t: q.quality_warnings(_dirty(t)),
        f"""SELECT unnest(warnings) AS warning, generate_subscripts(warnings, 1) - 1 AS position
            FROM ({DIRTY_REPORT})""",
    ),
    Query(
        "validation_report", "table_name:s " + _REPORT_COLUMNS,
        lambda t: stacked(_reports(t)),
        "\nUNION ALL\n".join(
            f"""SELECT '{n}' AS table_name, * REPLACE (array_to_string(warnings, ' | ') AS warnings)
                FROM ({sql.validation(rel, c)})"""
            for n, rel, c in (
                ("dirty", DIRTY, DIRTY_COLUMNS),
                *((n, f"SELECT * FROM {n}", c) for n, c in TABLE_COLUMNS.items()),
            )
        ),
    ),
    Query(
        "reliability_checklist", "position:i check:s status:s detail:s",
        lambda t: q.reliability_checklist(q.validation_report(_dirty(t))), checklist(DIRTY_REPORT),
    ),
]
