"""Queries of the sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.catalog import sql
from rowlens.catalog.cleaning import CLEAN_COLUMNS, CLEAN_SQL
from rowlens.catalog.registry import Query, Tables, union_all
from rowlens.catalog.views import DIRTY, DUCK_RAW, SPARK_RAW
from rowlens.operators.cleaning import clean, trim_headers
from rowlens.operators.statistics import grouped_summary, value_counts
from rowlens.session import scratch_path
from rowlens.sources.dates import parse_date_columns
from rowlens.sources.sinks import write_cleaned, write_results
from rowlens.sources.tables import infer_types, load_csv, load_parquet, null_tokens


def _raw(t: Tables) -> DataFrame:
    return t.view(SPARK_RAW, "orders")


def _load_csv(t: Tables) -> DataFrame:
    path = write_cleaned(_raw(t), scratch_path(t.spark, "orders.csv"))
    return load_csv(t.spark, path)


def _write_cleaned(t: Tables) -> DataFrame:
    path = write_cleaned(clean(t.view(DIRTY, "orders")), scratch_path(t.spark, "cleaned.csv"))
    return load_csv(t.spark, path)


def _write_results(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "results")
    for run, table, category, measure in (
        ("run-1", "lineitem", "l_returnflag", "l_extendedprice"),
        ("run-2", "orders", "o_orderpriority", "o_totalprice"),
    ):
        paths = write_results(
            {
                "groups": grouped_summary(t[table], category, measure),
                "values": value_counts(t[table], [category]),
            },
            folder, run,
        )
    groups, values = (t.spark.read.parquet(paths[n]) for n in ("groups", "values"))
    return groups.select(
        "run_id", F.lit("groups").alias("kind"), F.col("group").alias("name"),
        F.col("total").alias("value"),
    ).unionByName(
        values.select(
            "run_id", F.lit("values").alias("kind"), F.col("value").alias("name"),
            F.col("n").cast("double").alias("value"),
        )
    )


_MISSING = "CASE WHEN {c} IN ('N/A', 'NULL', '<NA>', 'nan') THEN NULL ELSE {c} END"
_PARSED = """CASE WHEN odate = 'unknown day' THEN NULL WHEN odate LIKE '____-__-__' THEN
    strptime(odate, '%Y-%m-%d') WHEN odate LIKE '____/__/__' THEN strptime(odate, '%Y/%m/%d')
    ELSE strptime(odate, '%m/%d/%Y') END"""
_TYPED = f"""SELECT CAST(" o_orderkey " AS BIGINT) AS o_orderkey,
    {_MISSING.format(c='status')} AS status,
    CAST({_MISSING.format(c='"price "')} AS DOUBLE) AS price, urgent = 'True' AS urgent,
    {{odate}} AS odate, update_note FROM ({DUCK_RAW})"""

QUERIES = [
    Query(
        "load_csv", "o_orderkey:i status:s price:2 urgent:b odate:s update_note:s", _load_csv,
        _TYPED.format(odate=_PARSED),
    ),
    Query(
        "null_tokens", "o_orderkey:s status:s price:s urgent:s odate:s update_note:s",
        lambda t: null_tokens(_raw(t)).toDF(
            "o_orderkey", "status", "price", "urgent", "odate", "update_note"
        ),
        f"""SELECT " o_orderkey " AS o_orderkey, {_MISSING.format(c='status')} AS status,
            {_MISSING.format(c='"price "')} AS price, urgent, odate, update_note FROM ({DUCK_RAW})""",
    ),
    Query(
        "infer_types", "o_orderkey:i status:s price:2 urgent:b odate:s",
        lambda t: trim_headers(infer_types(null_tokens(_raw(t)))),
        _TYPED.format(odate="odate"),
    ),
    Query(
        "trim_headers", "o_orderkey:s status:s price:s urgent:s odate:s update_note:s",
        lambda t: trim_headers(_raw(t)),
        f"""SELECT " o_orderkey " AS o_orderkey, status, "price " AS price, urgent, odate, update_note
            FROM ({DUCK_RAW})""",
    ),
    Query(
        "parse_date_columns", "o_orderkey:s odate:s update_note:s",
        lambda t: trim_headers(parse_date_columns(_raw(t))),
        f'SELECT " o_orderkey " AS o_orderkey, {_PARSED} AS odate, update_note FROM ({DUCK_RAW})',
    ),
    Query(
        "load_parquet",
        "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:2 o_orderdate:s o_orderpriority:s",
        lambda t: load_parquet(t.spark, f"{t.folder}/orders.parquet"), "SELECT * FROM orders",
    ),
    Query("write_cleaned", CLEAN_COLUMNS, _write_cleaned, CLEAN_SQL),
    Query(
        "write_results", "run_id:s kind:s name:s value:2", _write_results,
        union_all(
            union_all(
                (
                    f"""SELECT '{run}' AS run_id, 'groups' AS kind, "group" AS name, total AS value
                        FROM ({sql.grouped(f'SELECT * FROM {table}', category, measure)})""",
                    f"""SELECT '{run}' AS run_id, 'values' AS kind, value AS name,
                        CAST(n AS DOUBLE) AS value
                        FROM ({sql.value_counts(f'SELECT * FROM {table}', [category])})""",
                )
            )
            for run, table, category, measure in (
                ("run-1", "lineitem", "l_returnflag", "l_extendedprice"),
                ("run-2", "orders", "o_orderpriority", "o_totalprice"),
            )
        ),
    ),
]
