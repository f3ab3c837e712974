"""Queries of the analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.catalog import sql
from rowlens.catalog.registry import Query, Tables, stacked, union_all
from rowlens.catalog.views import GAPS, SALES, SALES_MEASURES
from rowlens.operators import statistics as s
from rowlens.operators.roles import find_roles
from rowlens.session import small_table

LINEITEM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_GAP_MEASURES = LINEITEM + ("constant", "gross")
_GROUPED = (
    ("lineitem", "l_returnflag", "l_extendedprice"), ("part", "p_brand", "p_retailprice"),
    ("customer", "c_mktsegment", "c_acctbal"), ("documents", "source", "n_chars"),
    ("events", "user_id", "value"),
)
SALES_TIES = ("l_orderkey", "l_partkey", "l_suppkey")


def sales(t: Tables) -> DataFrame:
    return t.view(SALES, "lineitem")


# The analyses of the sales view as SQL, by name.
SALES_SQL = {
    "descriptive_stats": sql.descriptive(SALES, SALES_MEASURES),
    "correlation_analysis": sql.correlations(SALES, SALES_MEASURES),
    "trend_analysis": sql.trend(SALES, "l_shipdate", SALES_MEASURES, SALES_TIES),
    "outlier_detection": sql.outliers(SALES, SALES_MEASURES),
    "value_counts_analysis": sql.value_counts(SALES, ("l_returnflag", "l_linestatus")),
    "grouped_summary_analysis": sql.grouped(SALES, "l_returnflag", "quantity"),
}


def sales_results(t: Tables, analyses=s.ANALYSES) -> dict[str, DataFrame]:
    df = sales(t)
    results, _ = s.run_analyses(df, list(analyses), find_roles(df))
    return results


def _run(t: Tables) -> DataFrame:
    df = t["orders"]
    names = [*s.ANALYSES, "forecast"]
    results, log = s.run_analyses(df, names, find_roles(df), tie_break=["o_orderkey"])
    done = s.stats_long(results)
    return done.select(
        "analysis", F.lit("done").alias("status"), "column", "metric", "value",
        F.lit(None).cast("string").alias("reason"),
    ).unionByName(
        log.where("status <> 'done'").select(
            "analysis", "status", F.lit(None).cast("string").alias("column"),
            F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value"),
            "reason",
        )
    )


_ORDERS = "SELECT * FROM orders"
ORDER_RESULTS = {
    "descriptive_stats": sql.descriptive(_ORDERS, ("o_totalprice",)),
    "trend_analysis": sql.trend(_ORDERS, "o_orderdate", ("o_totalprice",), ("o_orderkey",)),
    "outlier_detection": sql.outliers(_ORDERS, ("o_totalprice",)),
    "value_counts_analysis": sql.value_counts(_ORDERS, ("o_orderstatus", "o_orderpriority")),
    "grouped_summary_analysis": sql.grouped(_ORDERS, "o_orderstatus", "o_totalprice"),
}

# Roles of the tables for which analyses are missing: measures, categories and dates.
_SHAPES = {
    "region": (0, 1, 0), "nation": (0, 1, 0), "customer": (1, 2, 0), "orders": (1, 2, 1),
    "lineitem": (5, 2, 1), "labels": (2, 0, 0), "embeddings": (1, 0, 0),
}


def _skipped(t: Tables, name: str) -> DataFrame:
    rows = s.skip_reasons(find_roles(t[name]))
    return small_table(t.spark, rows, "analysis string, skipped_reason string")


def _skipped_sql(table: str, shape: tuple[int, int, int]) -> str:
    measures, categories, dates = shape
    def lacks(*needs: tuple[int, str, int]) -> str:
        gaps = [f"{least} {kind} column(s), {has} found" for least, kind, has in needs if has < least]
        return "needs " + "; ".join(gaps) if gaps else ""

    number, text, date = (1, "measure", measures), (1, "category", categories), (1, "date", dates)
    rules = [
        (name, bool(why), why)
        for name, why in (
            ("descriptive_stats", lacks(number)),
            ("correlation_analysis", lacks((2, "measure", measures))),
            ("trend_analysis", lacks(number, date)), ("outlier_detection", lacks(number)),
            ("value_counts_analysis", lacks(text)), ("grouped_summary_analysis", lacks(number, text)),
        )
    ]
    return union_all(
        f"SELECT '{table}' AS table_name, '{name}' AS analysis, '{why}' AS skipped_reason "
        f"FROM {table} LIMIT 1"
        for name, applies, why in rules
        if applies
    )


QUERIES = [
    Query(
        "descriptive_stats",
        "table_name:s column:s count:i mean:4 std:4 min:4 p25:4 p50:4 p75:4 max:4 sum:2",
        lambda t: stacked(
            {
                "lineitem": lambda: s.descriptive_stats(t["lineitem"], list(LINEITEM)),
                "events": lambda: s.descriptive_stats(t["events"], ["value"]),
                "gaps": lambda: s.descriptive_stats(
                    t.view(GAPS, "lineitem"), ["constant", "gross"]
                ),
            }
        ),
        f"""SELECT 'lineitem' AS table_name, *
            FROM ({sql.descriptive('SELECT * FROM lineitem', LINEITEM)})
            UNION ALL SELECT 'events', * FROM ({sql.descriptive('SELECT * FROM events', ['value'])})
            UNION ALL SELECT 'gaps', * FROM ({sql.descriptive(GAPS, ['constant', 'gross'])})""",
    ),
    Query(
        "correlation_matrix", "left_column:s right_column:s r:6",
        lambda t: s.correlation_matrix(t.view(GAPS, "lineitem"), list(_GAP_MEASURES)),
        sql.correlations(GAPS, _GAP_MEASURES),
    ),
    Query(
        "trend_change",
        "table_name:s column:s date_column:s first_value:4 last_value:4 percent_change:4",
        lambda t: stacked(
            {
                "sales": s.trend_change(
                    sales(t), "l_shipdate", list(SALES_MEASURES), list(SALES_TIES)
                ),
                "events": s.trend_change(t["events"], "ts", ["value"], ["event_id"]),
                "orders": s.trend_change(
                    t["orders"], "o_orderdate", ["o_totalprice"], ["o_orderkey"]
                ),
            }
        ),
        f"""SELECT 'sales' AS table_name, * FROM ({SALES_SQL['trend_analysis']})
            UNION ALL SELECT 'events', *
            FROM ({sql.trend('SELECT * FROM events', 'ts', ('value',), ('event_id',))})
            UNION ALL SELECT 'orders', * FROM ({ORDER_RESULTS['trend_analysis']})""",
    ),
    Query(
        "iqr_outliers", "table_name:s column:s outlier_count:i lower_bound:6 upper_bound:6",
        lambda t: stacked(
            {
                "sales": lambda: s.iqr_outliers(sales(t), list(SALES_MEASURES)),
                "events": lambda: s.iqr_outliers(t["events"], ["value"]),
            }
        ),
        f"""SELECT 'sales' AS table_name, * FROM ({SALES_SQL['outlier_detection']}) UNION ALL
            SELECT 'events', * FROM ({sql.outliers('SELECT * FROM events', ['value'])})""",
    ),
    Query(
        "outlier_rows", "event_id:i value:2 outlier_columns:s",
        lambda t: s.outlier_rows(t["events"], ["value"]).withColumn(
            "outlier_columns", F.array_join("outlier_columns", ",")
        ),
        f"""SELECT event_id, value, 'value' AS outlier_columns
            FROM events, ({sql.fences('SELECT * FROM events', 'value')})
            WHERE value < lower_bound OR value > upper_bound""",
    ),
    Query(
        "value_counts", "table_name:s column:s rank:i value:s n:i",
        lambda t: stacked(
            {
                "part": s.value_counts(t["part"], ["p_name", "p_brand", "p_type"]),
                "documents": s.value_counts(t["documents"], ["lang", "source", "text"]),
                "events": s.value_counts(t["events"], ["event_type", "props"]),
            }
        ),
        union_all(
            f"SELECT '{n}' AS table_name, * FROM ({sql.value_counts(f'SELECT * FROM {n}', c)})"
            for n, c in (
                ("part", ("p_name", "p_brand", "p_type")),
                ("documents", ("lang", "source", "text")),
                ("events", ("event_type", "props")),
            )
        ),
    ),
    Query(
        "grouped_summary", "table_name:s group:s total:2 average:4 count:i std_dev:4 rank:i",
        lambda t: stacked({n: s.grouped_summary(t[n], c, m) for n, c, m in _GROUPED}),
        union_all(
            f"""SELECT '{n}' AS table_name, CAST("group" AS VARCHAR) AS "group", total, average,
                "count", std_dev, rank FROM ({sql.grouped(f'SELECT CAST({c} AS VARCHAR) AS {c}, {m} FROM {n}', c, m)})"""
            for n, c, m in _GROUPED
        ),
    ),
    Query(
        "planned_grouping", "group:s total:2 average:4 count:i std_dev:4 rank:i",
        lambda t: s.run_analyses(
            t["documents"], ["grouped_summary_analysis"], find_roles(t["documents"])
        )[0]["grouped_summary_analysis"],
        sql.grouped("SELECT * FROM documents", "lang", "n_chars"),
    ),
    Query(
        "infinite_correlations", "left_column:s right_column:s r:6",
        lambda t: s.correlation_matrix(
            t["lineitem"].withColumn(
                "endless",
                F.when(F.col("l_orderkey") == 1, F.lit(float("inf"))).otherwise(F.col("l_tax")),
            ),
            [*LINEITEM[:3], "endless"],
        ),
        f"""SELECT left_column, right_column, r
            FROM ({sql.correlations('SELECT * FROM lineitem', LINEITEM[:3])}) UNION ALL """
        + union_all(
            f"""SELECT '{a}' AS left_column, '{b}' AS right_column, NULL::DOUBLE AS r FROM lineitem
                LIMIT 1"""
            for name in (*LINEITEM[:3], "endless")
            for a, b in {(name, "endless"), ("endless", name)}
        ),
    ),
    Query(
        "dense_rank_groups", "group:s total:i rank:i",
        lambda t: s.dense_rank_groups(
            t["conversations"].groupBy(F.col("conv_id").cast("string").alias("group"))
            .agg(F.count("*").alias("total")).orderBy(F.desc("total"), "group").limit(10)
        ),
        """SELECT *, dense_rank() OVER (ORDER BY total DESC) AS rank FROM (
            SELECT CAST(conv_id AS VARCHAR) AS "group", count(*) AS total FROM conversations
            GROUP BY 1 ORDER BY total DESC, "group" LIMIT 10)""",
    ),
    Query(
        "run_analyses", "analysis:s status:s column:s metric:s value:2 reason:s", _run,
        union_all(
            [
                f"""SELECT analysis, 'done' AS status, "column", metric, value, NULL AS reason
                    FROM ({sql.melted(n, q)})""" for n, q in ORDER_RESULTS.items()
            ]
            + [
                f"""SELECT '{n}' AS analysis, '{state}' AS status, NULL AS "column", NULL AS metric,
                    NULL AS value, {why} AS reason FROM orders LIMIT 1"""
                for n, state, why in (
                    ("correlation_analysis", "skipped", "'needs 2 measure column(s), 1 found'"),
                    ("forecast", "unsupported", "NULL"),
                )
            ]
        ),
    ),
    Query(
        "skip_reasons", "table_name:s analysis:s skipped_reason:s",
        lambda t: stacked({n: _skipped(t, n) for n in _SHAPES}),
        union_all(_skipped_sql(n, shape) for n, shape in _SHAPES.items() if n != "lineitem"),
    ),
    Query(
        "stats_long", "analysis:s column:s metric:s value:2",
        lambda t: s.stats_long(sales_results(t)),
        union_all(sql.melted(n, q) for n, q in SALES_SQL.items()),
    ),
]
