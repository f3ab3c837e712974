"""Queries of the profiling operators."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.catalog import sql
from rowlens.catalog.registry import Query, Tables, stacked, union_all
from rowlens.catalog.views import DIRTY
from rowlens.operators import profile as p
from rowlens.operators.counts import distinct_counts
from rowlens.operators.quantiles import quantile_table
from rowlens.operators.roles import column_roles, identifier_columns

MEASURES = {
    "lineitem": ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    "events": ("value",),
    "customer": ("c_acctbal",),
}
CATEGORIES = {
    "orders": ("o_orderstatus", "o_orderpriority"),
    "part": ("p_name", "p_brand", "p_type"),
    "documents": ("text", "lang", "source"),
    "pages": ("url", "html"),
    "conversations": ("role", "text"),
}
DATES = {"orders": ("o_orderdate",), "events": ("ts",), "lineitem": ("l_shipdate",)}
_ROLES = {
    "orders": "identifier identifier categorical numeric datetime categorical",
    "lineitem": "identifier identifier identifier numeric numeric numeric numeric numeric "
                "categorical categorical datetime",
    "events": "identifier datetime identifier categorical numeric categorical",
    "embeddings": "identifier other numeric",
    "conversations": "identifier numeric categorical categorical",
}
_NAMES = {
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice "
                "l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "embeddings": "vec_id embedding label",
    "conversations": "conv_id turn role text",
}
_IDENTIFIERS = {
    "orders": ("o_orderkey", "o_custkey"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey"),
    "events": ("event_id", "user_id"),
    "labels": ("doc_id",),
}
# A gap-free integer column whose name says nothing, next to one with a hole.
_SEQUENCES = """SELECT event_id + 5 AS position, event_id * 2 AS doubled, value FROM events"""


def each(parts: dict, one) -> str:
    """Union of ``one(table, column)`` over all columns of all tables."""
    return union_all(one(t, c) for t, names in parts.items() for c in names)


def over(parts: dict, frame) -> dict:
    """The frame of each table, to be built together."""
    return {name: partial(frame, name, list(columns)) for name, columns in parts.items()}


def numeric_sql(table: str, c: str) -> str:
    return f"""SELECT '{table}' AS table_name, '{c}' AS "column", avg("{c}") AS mean,
        median("{c}") AS median, coalesce(stddev_samp("{c}"), 0) AS std, min("{c}") AS min,
        quantile_cont("{c}", 0.25) AS q25, quantile_cont("{c}", 0.75) AS q75,
        quantile_cont("{c}", 0.75) - quantile_cont("{c}", 0.25) AS iqr, max("{c}") AS max,
        coalesce(skewness("{c}"), 0) AS skewness, count(DISTINCT "{c}") AS unique_values,
        count_if("{c}" = 0) AS zero_count, count_if("{c}" = 0) / count("{c}") * 100 AS zero_percent,
        count_if("{c}" IS NULL) AS missing_count,
        count_if("{c}" IS NULL) / count(*) * 100 AS missing_percent,
        NULL AS skipped_reason FROM {table}"""


def categorical_sql(table: str, c: str) -> str:
    return f"""WITH counted AS (SELECT "{c}" AS value, count(*) AS n FROM {table}
        WHERE "{c}" IS NOT NULL GROUP BY 1),
        ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS place FROM counted)
        SELECT '{table}' AS table_name, '{c}' AS "column", count(*) AS unique_values,
        round(count(*) / sum(n), 4) AS cardinality_ratio,
        round(count(*) / sum(n), 4) > 0.4 AND count(*) > 20 AS is_high_cardinality,
        any_value(value) FILTER (place = 1) AS most_frequent,
        string_agg(value || ':' || n, '|' ORDER BY place) FILTER (place <= 5) AS top_values,
        (SELECT count_if("{c}" IS NULL) FROM {table}) AS missing_count,
        (SELECT round(count_if("{c}" IS NULL) / count(*) * 100, 2) FROM {table}) AS missing_percent
        FROM ranked"""


def _categorical(df: DataFrame) -> DataFrame:
    entries = F.transform("top_values", lambda v: F.concat_ws(":", v["value"], v["n"]))
    return df.withColumn("top_values", F.array_join(entries, "|"))


_DATE_SQL = """SELECT '{t}' AS table_name, '{c}' AS "column", CAST(min({c}) AS VARCHAR) AS min_date,
    CAST(max({c}) AS VARCHAR) AS max_date, datesub('day', min({c}), max({c})) AS timespan_days,
    count(DISTINCT {c}) AS unique_dates, count_if({c} IS NULL) AS missing_count FROM {t}"""


def _odd_values(t: Tables) -> DataFrame:
    value = F.when(F.col("event_type") == "error", F.lit(float("nan"))).when(
        F.col("event_type") == "click", F.lit(float("inf"))
    ).otherwise(F.col("value") / 7)
    return t["events"].select("event_id", value.alias("value"), "ts", "event_type")


_ORDER_FIGURES = union_all(
    [
        f"""SELECT kind, "column", metric, value FROM (
            SELECT '{kind}' AS kind, "column", unnest([{', '.join(f"'{m}'" for m in metrics)}]) AS metric,
            unnest([{', '.join(texts)}]) AS value FROM ({body})) WHERE value IS NOT NULL"""
        for kind, body, metrics, texts in (
            (
                "numeric", numeric_sql("orders", "o_totalprice"),
                ("mean", "median", "std", "min", "q25", "q75", "iqr", "max", "skewness",
                 "unique_values", "zero_count", "zero_percent", "missing_count", "missing_percent"),
                [f"format('{{:.3f}}', CAST({m} AS DOUBLE))" for m in
                 ("mean", "median", "std", "min", "q25", "q75", "iqr", "max", "skewness",
                  "unique_values", "zero_count", "zero_percent", "missing_count",
                  "missing_percent")],
            ),
            (
                "categorical",
                union_all(categorical_sql("orders", c) for c in CATEGORIES["orders"]),
                ("unique_values", "cardinality_ratio", "is_high_cardinality", "most_frequent",
                 "missing_count", "missing_percent"),
                ["format('{:.3f}', CAST(unique_values AS DOUBLE))",
                 "format('{:.3f}', CAST(cardinality_ratio AS DOUBLE))",
                 "CAST(is_high_cardinality AS VARCHAR)", "most_frequent",
                 "format('{:.3f}', CAST(missing_count AS DOUBLE))",
                 "format('{:.3f}', CAST(missing_percent AS DOUBLE))"],
            ),
            (
                "datetime", _DATE_SQL.format(t="orders", c="o_orderdate"),
                ("min_date", "max_date", "timespan_days", "unique_dates", "missing_count"),
                ["min_date", "max_date"] + [f"format('{{:.3f}}', CAST({m} AS DOUBLE))" for m in
                                            ("timespan_days", "unique_dates", "missing_count")],
            ),
        )
    ]
)


def _order_figures(t: Tables) -> DataFrame:
    return p.profile_long(p.dataset_profile(t["orders"], rounded=False), digits=3)


_FREQUENT = {"part": ("p_name", "p_brand", "p_type"), "documents": ("lang", "source"),
             "events": ("event_type", "props"), "orders": ("o_custkey", "o_orderpriority")}

QUERIES = [
    Query(
        "identifier_columns", "table_name:s column:s min_value:2 max_value:2 n_values:i",
        lambda t: stacked(
            {
                **{n: identifier_columns(t[n]) for n in _IDENTIFIERS},
                "sequences": identifier_columns(t.view(_SEQUENCES, "events")),
            }
        ),
        each(
            {**_IDENTIFIERS, "sequences": ("position",)},
            lambda t, c: f"""SELECT '{t}' AS table_name, '{c}' AS "column", min("{c}") AS min_value,
                max("{c}") AS max_value, count("{c}") AS n_values
                FROM {t if t != 'sequences' else f'({_SEQUENCES})'}""",
        ),
    ),
    Query(
        "column_roles", "table_name:s position:i column:s role:s",
        lambda t: stacked({n: column_roles(t[n]) for n in _ROLES}),
        union_all(
            f"""SELECT '{t}' AS table_name, {i} AS position, '{name}' AS "column", '{role}' AS role
                FROM {t} LIMIT 1"""
            for t in _ROLES
            for i, (name, role) in enumerate(zip(_NAMES[t].split(), _ROLES[t].split()))
        ),
    ),
    Query(
        "numeric_profile",
        "table_name:s column:s mean:4 median:4 std:4 min:4 q25:4 q75:4 iqr:4 max:4 skewness:4 "
        "unique_values:i zero_count:i zero_percent:2 missing_count:i missing_percent:2 "
        "skipped_reason:s",
        lambda t: stacked(over(MEASURES, lambda n, c: p.numeric_profile(t[n], c))),
        each(MEASURES, numeric_sql),
    ),
    Query(
        "sample_skewness", "table_name:s column:s skewness:6",
        lambda t: stacked(over(MEASURES, lambda n, c: p.skewness_table(t[n], c))),
        each(MEASURES, lambda t, c: f"""SELECT '{t}' AS table_name, '{c}' AS "column",
            coalesce(skewness("{c}"), 0) AS skewness FROM {t}"""),
    ),
    Query(
        "quantiles", "table_name:s column:s probability:2 value:6",
        lambda t: stacked(
            over(MEASURES, lambda n, c: quantile_table(t[n], c, [0.0, 0.05, 0.25, 0.5, 0.75, 0.99, 1.0]))
        ),
        each(MEASURES, lambda t, c: f"""SELECT '{t}' AS table_name, '{c}' AS "column",
            unnest([0, 0.05, 0.25, 0.5, 0.75, 0.99, 1]) AS probability,
            unnest(quantile_cont(CAST("{c}" AS DOUBLE), [0, 0.05, 0.25, 0.5, 0.75, 0.99, 1])) AS value
            FROM {t}"""),
    ),
    Query(
        "distinct_count", "table_name:s column:s distinct_count:i",
        lambda t: stacked(
            {n: distinct_counts(t[n], _NAMES[n].split()) for n in ("orders", "lineitem", "events")}
        ),
        each(
            {n: _NAMES[n].split() for n in ("orders", "lineitem", "events")},
            lambda t, c: f"""SELECT '{t}' AS table_name, '{c}' AS "column",
                count(DISTINCT "{c}") AS distinct_count FROM {t}""",
        ),
    ),
    Query(
        "categorical_profile",
        "table_name:s column:s unique_values:i cardinality_ratio:4 is_high_cardinality:b "
        "most_frequent:s top_values:s missing_count:i",
        lambda t: _categorical(
            stacked(over(CATEGORIES, lambda n, c: p.categorical_profile(t[n], c)))
        ),
        each(CATEGORIES, categorical_sql),
    ),
    Query(
        "mode_value", "table_name:s column:s most_frequent:s n:i",
        lambda t: stacked(over(_FREQUENT, lambda n, c: p.mode_values(t[n], c))),
        each(_FREQUENT, lambda t, c: f"""SELECT '{t}' AS table_name, "column",
            value AS most_frequent, n FROM ({sql.value_counts(f'SELECT * FROM {t}', [c], 1, None)})"""),
    ),
    Query(
        "top_values", "table_name:s column:s rank:i value:s n:i",
        lambda t: stacked(over(_FREQUENT, lambda n, c: p.top_values(t[n], c))),
        each(_FREQUENT, lambda t, c: f"""SELECT '{t}' AS table_name, *
            FROM ({sql.value_counts(f'SELECT * FROM {t}', [c], 5, None)})"""),
    ),
    Query(
        "datetime_profile",
        "table_name:s column:s min_date:s max_date:s timespan_days:i unique_dates:i missing_count:i",
        lambda t: stacked(over(DATES, lambda n, c: p.datetime_profile(t[n], c))),
        each(DATES, lambda t, c: _DATE_SQL.format(t=t, c=c)),
    ),
    Query(
        "all_null_skip", "column:s skipped_reason:s",
        lambda t: p.all_null_skip(t.view(DIRTY, "orders")),
        f"""SELECT 'empty_col' AS "column", 'All values are NaN' AS skipped_reason FROM ({DIRTY})
            HAVING count(empty_col) = 0""",
    ),
    Query("dataset_profile", "kind:s column:s metric:s value:s", _order_figures, _ORDER_FIGURES),
    Query(
        "dataset_overview", "position:i metric:s value:i",
        lambda t: p.dataset_overview(t["lineitem"]),
        union_all(
            f"SELECT {i} AS position, '{label}' AS metric, {value} AS value FROM lineitem"
            for i, (label, value) in enumerate(
                (
                    ("Total Rows", "count(*)"), ("Total Columns", "11 * sign(count(*))"),
                    ("Numeric Columns", "5 * sign(count(*))"),
                    ("Categorical Columns", "2 * sign(count(*))"),
                    ("Datetime Columns", "sign(count(*))"),
                ),
                1,
            )
        ),
    ),
    Query(
        "sanitize_values", "event_id:i value:4 ts:s event_type:s",
        lambda t: p.sanitize_values(_odd_values(t)),
        """SELECT event_id, CASE WHEN event_type NOT IN ('error', 'click') THEN value / 7 END AS value,
            ts, event_type FROM events""",
    ),
]
