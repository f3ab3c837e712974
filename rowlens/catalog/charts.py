"""Queries of the chart tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.catalog import sql
from rowlens.catalog.registry import Query, Tables, stacked, union_all
from rowlens.catalog.views import DAY_GAP, GAPS, MONTH_GAP
from rowlens.operators import charts as c
from rowlens.plans.chart_data import charts_long, run_charts
from rowlens.plans.rules import Chart, auto_charts, chart_kind, chart_table, with_auto_charts

_METRICS = {
    "lineitem": "l_extendedprice", "orders": "o_totalprice", "part": "p_retailprice",
    "customer": "c_custkey", "events": "value", "documents": "n_chars", "labels": "quality",
    "conversations": "turn",
}
_CATEGORIES = {
    "lineitem": ("l_returnflag", "l_linestatus"), "orders": ("o_orderstatus", "o_orderpriority"),
    "part": ("p_brand", "p_type"), "documents": ("lang", "source"), "pages": ("url", "html"),
    "customer": ("c_mktsegment",), "events": ("event_type",),
}
_DATES = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}

_TEXT_DATES = "SELECT o_orderkey, {day} AS note, {day} AS order_month FROM orders"


def _primary_metric(t: Tables, name: str) -> DataFrame:
    metric = c.primary_metric(t[name])
    return t[name].agg(F.lit(metric).alias("metric"), F.sum(metric).cast("double").alias("total"))


def _categories(t: Tables, name: str) -> DataFrame:
    names = c.usable_categories(t[name])
    counts = t[name].agg(*[F.count_distinct(n).alias(n) for n in names])
    return counts.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(n).alias("column"), F.col(n).alias("n_values")) for n in names]
            )
        )
    )


def _date_column(t: Tables) -> DataFrame:
    frames = {n: t[n] for n in _DATES}
    frames["texts"] = t.view(
        _TEXT_DATES.format(day="date_format(o_orderdate, 'yyyy-MM-dd')"), "orders"
    )
    return stacked(
        {
            n: df.agg(
                F.lit(c.date_column(df)).alias("column"),
                F.min(c.date_column(df)).cast("date").alias("first_day"),
            )
            for n, df in frames.items()
        }
    )


def calendar(points: str, frequency: str) -> str:
    """Totals per period of rows (day, value), with 0 for periods without rows."""
    period = {
        "month": "last_day(CAST({d} AS DATE))",
        "week": "CAST(date_trunc('week', CAST({d} AS DATE)) AS DATE) + 6",
        "day": "CAST({d} AS DATE)",
    }[frequency]
    return f"""WITH points AS ({points}),
        sums AS (SELECT {period.format(d='day')} AS period, sum(value) AS total FROM points GROUP BY 1),
        periods AS (SELECT DISTINCT {period.format(d='d')} AS period FROM (
            SELECT unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP),
                INTERVAL 1 DAY)) AS d FROM points))
        SELECT period, coalesce(total, 0) AS total FROM periods LEFT JOIN sums USING (period)"""


def rolled(series: str) -> str:
    return f"""SELECT period, total, avg(total) OVER (ORDER BY period
        ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_mean FROM ({series})"""


_MONTHS = calendar(
    f"""SELECT CAST(o_orderdate AS DATE) AS day, o_totalprice AS value FROM ({MONTH_GAP})
        WHERE o_totalprice IS NOT NULL""",
    "month",
)
_WEEKS = calendar("SELECT CAST(ts AS DATE) AS day, value FROM events", "week")
_DAYS = calendar(
    f"SELECT CAST(ts AS DATE) AS day, value FROM ({DAY_GAP}) WHERE value IS NOT NULL", "day"
)
_ORDER_MONTHS = calendar("SELECT CAST(o_orderdate AS DATE) AS day, o_totalprice AS value FROM orders", "month")


def pareto(table: str, category: str, value: str) -> str:
    return f"""SELECT {category} AS category, {value} AS total FROM {table}
        WHERE {category} IS NOT NULL GROUP BY 1 ORDER BY total DESC, category LIMIT 10"""


def binned(table: str, measure: str, bins: int = 18) -> str:
    return f"""WITH limits AS (SELECT min({measure}) AS low, max({measure}) AS high FROM {table}),
        counted AS (SELECT least(CAST(floor(({measure} - low) / (high - low) * {bins}) AS INT) + 1,
            {bins}) AS bin, count(*) AS n FROM {table}, limits GROUP BY 1),
        bins AS (SELECT unnest(range(1, {bins + 1})) AS bin)
        SELECT bin, low + (bin - 1) * ((high - low) / {bins}) AS low,
        low + bin * ((high - low) / {bins}) AS high, coalesce(n, 0) AS n
        FROM bins CROSS JOIN limits LEFT JOIN counted USING (bin)"""


_TOP_BRANDS = """SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 7"""
_PIVOT = """SELECT {c} AS category, {s} AS series, {v} AS total FROM {t}
    WHERE {c} IN (SELECT {c} FROM {t} GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 7) GROUP BY 1, 2"""
_STATUS = ("F", "O", "P")

# Spellings of chart types made from the events; the last ones are unknown.
_SPELLINGS = (
    "Bar", "bar chart", " Pareto-Bar ", "PARETO", "horizontal bar", "Line", "line-chart",
    "Time Series", "stacked bar", "Stacked", "CrossTab", "histogram", "Hist", "quantile hist",
    "Distribution", "scatter", "Scatter-Plot", "heatmap", "Correlation", "correlation heatmap",
    "pie", "bar  chart", "",
)
_KINDS = (
    *["pareto_bar"] * 5, *["line"] * 3, *["stacked_bar"] * 3, *["quantile_hist"] * 4,
    *["scatter"] * 2, *["correlation_heatmap"] * 3, *["pareto_bar"] * 3,
)
_SPELLED = "SELECT event_id, CASE event_id % {n} {cases} END AS raw FROM events".format(
    n=len(_SPELLINGS),
    cases=" ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SPELLINGS)),
)

_AUTO_TABLES = ("orders", "lineitem", "documents", "customer", "events", "labels")


def _auto_sql(table: str, metric: str | None, cats: tuple, date: str | None, numbers: tuple) -> str:
    rows = []
    if date and metric:
        rows.append(("line", metric, f"{metric} by period"))
    if cats and metric:
        rows.append(("pareto_bar", f"{cats[0]},{metric}",
                     f"Largest totals of {metric} among {cats[0]}"))
    if len(cats) > 1:
        rows.append(("stacked_bar", f"{cats[0]},{cats[1]}",
                     f"{cats[0]} split by {cats[1]}"))
    if metric:
        rows.append(("quantile_hist", metric,
                     f"Values of {metric} with median and 90th percentile"))
    if len(numbers) > 1:
        rows.append(("correlation_heatmap", ",".join(numbers),
                     "Correlations of " + ", ".join(numbers)))
    return union_all(
        f"""SELECT '{table}' AS table_name, {i} AS position, '{kind}' AS chart_type,
            '{columns}' AS columns, '{reason}' AS reason, TRUE AS auto_generated FROM {table} LIMIT 1"""
        for i, (kind, columns, reason) in enumerate(rows, 1)
    )


def _auto(t: Tables, name: str) -> DataFrame:
    return chart_table(t.spark, tuple(auto_charts(t[name])))


_NUMBERS = {
    "orders": ("o_orderkey", "o_custkey", "o_totalprice"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax"),
    "documents": ("doc_id", "n_chars"), "customer": ("c_custkey", "c_nationkey", "c_acctbal"),
    "events": ("event_id", "user_id", "value"), "labels": ("doc_id", "quality", "toxic"),
}

_PLANNED = (
    Chart("Time Series", ("o_totalprice",), "Totals over time"),
    Chart("crosstab", ("o_orderstatus", "o_orderpriority"), "Status by priority"),
    Chart("scatter", ("o_totalprice", "nothing"), "Cannot be drawn"),
    Chart("pie", ("o_orderpriority",), "Shares"),
    Chart("hist", ("o_totalprice",), "Distribution"),
    Chart("scatter plot", ("o_custkey", "o_totalprice"), "Price by customer"),
    Chart("correlation", (), "Correlations"),
)


def _run_charts(t: Tables) -> DataFrame:
    tables, log = run_charts(t["orders"], _PLANNED)
    return charts_long(tables).unionByName(
        log.where("status <> 'done'").select(
            "chart_no", F.col("status").alias("series"), F.col("chart_type").alias("label"),
            F.lit(None).cast("double").alias("value"),
        )
    )


def scatter(table: str, x: str, y: str) -> str:
    return f"""WITH limits AS (SELECT min({x}) AS xl, max({x}) AS xh, min({y}) AS yl, max({y}) AS yh
        FROM {table}) SELECT least(CAST(floor(({x} - xl) / (xh - xl) * 20) AS INT) + 1, 20) AS x_bin,
        least(CAST(floor(({y} - yl) / (yh - yl) * 20) AS INT) + 1, 20) AS y_bin, count(*) AS n,
        avg({x}) AS x_mean, avg({y}) AS y_mean FROM {table}, limits GROUP BY 1, 2"""


_CHART_SQL = union_all(
    [
        f"""SELECT 1 AS chart_no, 'total' AS series, CAST(period AS VARCHAR) AS label, total AS value
            FROM ({_ORDER_MONTHS})""",
        f"""SELECT 1 AS chart_no, 'rolling_mean' AS series, CAST(period AS VARCHAR) AS label,
            rolling_mean AS value FROM ({rolled(_ORDER_MONTHS)})""",
        f"""SELECT 2 AS chart_no, series, category AS label, total AS value FROM
            ({_PIVOT.format(c='o_orderstatus', s='o_orderpriority', v='sum(o_totalprice)', t='orders')})""",
        "SELECT 3 AS chart_no, 'unsupported' AS series, 'scatter' AS label, NULL AS value FROM orders LIMIT 1",
        f"""SELECT 4 AS chart_no, 'total' AS series, category AS label, total AS value
            FROM ({pareto('orders', 'o_orderpriority', 'sum(o_totalprice)')})""",
        f"""SELECT 5 AS chart_no, 'n' AS series, lpad(CAST(bin AS VARCHAR), 2, '0') AS label,
            n AS value FROM ({binned('orders', 'o_totalprice')})""",
        """SELECT 5 AS chart_no, 'p50' AS series, 'marker' AS label,
            quantile_cont(o_totalprice, 0.5) AS value FROM orders""",
        """SELECT 5 AS chart_no, 'p90' AS series, 'marker' AS label,
            quantile_cont(o_totalprice, 0.9) AS value FROM orders""",
        f"""SELECT 6 AS chart_no, 'n' AS series, x_bin || ',' || y_bin AS label, n AS value
            FROM ({scatter('orders', 'o_custkey', 'o_totalprice')})""",
        """SELECT 6 AS chart_no, 'slope' AS series, 'trend' AS label,
            regr_slope(o_totalprice, o_custkey) AS value FROM orders""",
        """SELECT 6 AS chart_no, 'intercept' AS series, 'trend' AS label,
            regr_intercept(o_totalprice, o_custkey) AS value FROM orders""",
        f"""SELECT 7 AS chart_no, right_column AS series, left_column AS label, r AS value
            FROM ({sql.correlations('SELECT * FROM orders', _NUMBERS['orders'])})""",
    ]
)

QUERIES = [
    Query(
        "primary_metric", "table_name:s metric:s total:2",
        lambda t: stacked({n: _primary_metric(t, n) for n in _METRICS}),
        union_all(
            f"SELECT '{n}' AS table_name, '{m}' AS metric, sum({m}) AS total FROM {n}"
            for n, m in _METRICS.items()
        ),
    ),
    Query(
        "usable_categories", "table_name:s column:s n_values:i",
        lambda t: stacked({n: partial(_categories, t, n) for n in _CATEGORIES}),
        union_all(
            f"""SELECT '{n}' AS table_name, '{col}' AS "column", count(DISTINCT {col}) AS n_values
                FROM {n}"""
            for n, names in _CATEGORIES.items()
            for col in names
        ),
    ),
    Query(
        "date_column", "table_name:s column:s first_day:s", _date_column,
        union_all(
            f"""SELECT '{n}' AS table_name, '{d}' AS "column", CAST(min({s}) AS DATE) AS first_day
                FROM {src}"""
            for n, d, s, src in (
                *((n, d, d, n) for n, d in _DATES.items()),
                ("texts", "order_month", "o_orderdate", "orders"),
            )
        ),
    ),
    Query(
        "resample_frequency", "table_name:s first_day:s last_day:s span_days:i frequency:s",
        lambda t: stacked(
            {
                **{n: c.resample_frequency(t[n], d) for n, d in _DATES.items()},
                "days": c.resample_frequency(t.view(DAY_GAP, "events").dropna(), "ts"),
            }
        ),
        union_all(
            f"""SELECT *, CASE WHEN span_days > 90 THEN 'month' WHEN span_days > 14 THEN 'week'
                ELSE 'day' END AS frequency FROM (SELECT '{n}' AS table_name,
                CAST(min({d}) AS DATE) AS first_day, CAST(max({d}) AS DATE) AS last_day,
                datesub('day', min({d}), max({d})) AS span_days FROM {src})"""
            for n, d, src in (
                *((n, d, n) for n, d in _DATES.items()),
                ("days", "ts", f"({DAY_GAP}) WHERE value IS NOT NULL"),
            )
        ),
    ),
    Query(
        "resample_sum", "table_name:s period:s total:2",
        lambda t: stacked(
            {
                "months": c.resample_sum(
                    t.view(MONTH_GAP, "orders"), "o_orderdate", "o_totalprice"
                ),
                "weeks": c.resample_sum(t["events"], "ts", "value"),
                "days": c.resample_sum(t.view(DAY_GAP, "events"), "ts", "value"),
            }
        ),
        union_all(
            f"SELECT '{n}' AS table_name, * FROM ({q})"
            for n, q in (("months", _MONTHS), ("weeks", _WEEKS), ("days", _DAYS))
        ),
    ),
    Query(
        "rolling_mean_3", "period:s total:2 rolling_mean:2",
        lambda t: c.rolling_mean_3(
            c.resample_sum(t.view(MONTH_GAP, "orders"), "o_orderdate", "o_totalprice")
        ),
        rolled(_MONTHS),
    ),
    Query(
        "time_series", "table_name:s period:s total:2 rolling_mean:2",
        lambda t: stacked(
            {"orders": c.time_series(t["orders"]), "events": c.time_series(t["events"])}
        ),
        f"""SELECT 'orders' AS table_name, * FROM ({rolled(_ORDER_MONTHS)})
            UNION ALL SELECT 'events', * FROM ({rolled(_WEEKS)})""",
    ),
    Query(
        "pareto_top10", "table_name:s category:s total:2",
        lambda t: stacked(
            {
                "brand": c.pareto_top10(t["part"], "p_brand", "p_retailprice"),
                "source": c.pareto_top10(t["documents"], "source"),
                "user": c.pareto_top10(
                    t["events"].withColumn("user_id", F.col("user_id").cast("string")),
                    "user_id", "value",
                ),
            }
        ),
        union_all(
            f"SELECT '{n}' AS table_name, * FROM ({q})"
            for n, q in (
                ("brand", pareto("part", "p_brand", "sum(p_retailprice)")),
                ("source", pareto("documents", "source", "CAST(count(*) AS DOUBLE)")),
                ("user", pareto("(SELECT CAST(user_id AS VARCHAR) AS u, value FROM events)", "u",
                                "sum(value)")),
            )
        ),
    ),
    Query(
        "pivot_sum", "category:s F:2 O:2 P:2",
        lambda t: c.pivot_sum(
            t["orders"], "o_orderpriority", "o_orderstatus", "o_totalprice", list(_STATUS)
        ),
        "SELECT o_orderpriority AS category, " + ", ".join(
            f"""coalesce(sum(o_totalprice) FILTER (o_orderstatus = '{s}'), 0) AS "{s}\""""
            for s in _STATUS
        ) + " FROM orders GROUP BY 1",
    ),
    Query(
        "top_k_semi_filter", "p_partkey:i p_brand:s p_retailprice:2",
        lambda t: c.top_k_semi_filter(t["part"], "p_brand"),
        f"SELECT * FROM part WHERE p_brand IN ({_TOP_BRANDS})",
    ),
    Query(
        "crosstab_count", "category:s F:i O:i P:i",
        lambda t: c.crosstab_count(
            t["orders"], "o_orderpriority", "o_orderstatus", list(_STATUS)
        ),
        "SELECT o_orderpriority AS category, " + ", ".join(
            f"""count(*) FILTER (o_orderstatus = '{s}') AS "{s}\"""" for s in _STATUS
        ) + " FROM orders GROUP BY 1",
    ),
    Query(
        "histogram_18", "table_name:s bin:i low:4 high:4 n:i",
        lambda t: stacked(
            {
                "events": lambda: c.histogram(t["events"], "value"),
                "lineitem": lambda: c.histogram(t["lineitem"], "l_extendedprice"),
                "part": lambda: c.histogram(t["part"], "p_size"),
            }
        ),
        union_all(
            f"SELECT '{n}' AS table_name, * FROM ({binned(n, m)})"
            for n, m in (("events", "value"), ("lineitem", "l_extendedprice"), ("part", "p_size"))
        ),
    ),
    Query(
        "p50_p90", "column:s p50:4 p90:4",
        lambda t: c.p50_p90(t["lineitem"], ["l_quantity", "l_extendedprice", "l_discount"]),
        union_all(
            f"""SELECT '{m}' AS "column", quantile_cont({m}, 0.5) AS p50,
                quantile_cont({m}, 0.9) AS p90 FROM lineitem"""
            for m in ("l_quantity", "l_extendedprice", "l_discount")
        ),
    ),
    Query(
        "scatter_points", "x:4 y:4",
        lambda t: c.scatter_points(t.view(GAPS, "lineitem"), "l_quantity", "gross"),
        f"""SELECT l_quantity AS x, gross AS y FROM ({GAPS})
            WHERE l_quantity IS NOT NULL AND gross IS NOT NULL""",
    ),
    Query(
        "scatter_density", "x_bin:i y_bin:i n:i x_mean:3 y_mean:3",
        lambda t: c.scatter_density(t["lineitem"], "l_quantity", "l_extendedprice"),
        scatter("lineitem", "l_quantity", "l_extendedprice"),
    ),
    Query(
        "linear_trend", "table_name:s n:i slope:6 intercept:4",
        lambda t: stacked(
            {
                "lineitem": c.linear_trend(t["lineitem"], "l_quantity", "l_extendedprice"),
                "part": c.linear_trend(t["part"], "p_partkey", "p_retailprice"),
            }
        ),
        union_all(
            f"""SELECT '{n}' AS table_name, regr_count({y}, {x}) AS n, regr_slope({y}, {x}) AS slope,
                regr_intercept({y}, {x}) AS intercept FROM {n}"""
            for n, x, y in (
                ("lineitem", "l_quantity", "l_extendedprice"), ("part", "p_partkey", "p_retailprice")
            )
        ),
    ),
    Query(
        "correlation_heatmap", "left_column:s right_column:s r:5",
        lambda t: c.correlation_heatmap(t["lineitem"]),
        sql.correlations("SELECT * FROM lineitem", _NUMBERS["lineitem"]),
    ),
    Query(
        "chart_type_alias", "event_id:i raw:s kind:s",
        lambda t: t.view(_SPELLED, "events").withColumn("kind", chart_kind(F.col("raw"))),
        "SELECT event_id, raw, CASE event_id % {n} {cases} END AS kind FROM ({src})".format(
            n=len(_SPELLINGS), src=_SPELLED,
            cases=" ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)),
        ),
    ),
    Query(
        "auto_chart_plan",
        "table_name:s position:i chart_type:s columns:s reason:s auto_generated:b",
        lambda t: stacked(
            {
                **{n: partial(_auto, t, n) for n in _AUTO_TABLES},
                "planned": lambda: chart_table(
                    t.spark,
                    with_auto_charts(
                        t["events"],
                        (Chart("line", ("value",), "Given"), Chart("histogram", ("value",), "Given")),
                    ),
                ),
            }
        ),
        union_all(
            [
                _auto_sql(n, _METRICS[n], _CATEGORIES.get(n, ()), _DATES.get(n), _NUMBERS[n])
                for n in _AUTO_TABLES
            ]
            + [
                """SELECT 'planned' AS table_name, unnest([1, 2]) AS position,
                    unnest(['line', 'histogram']) AS chart_type, 'value' AS columns,
                    'Given' AS reason, FALSE AS auto_generated FROM events LIMIT 2""",
                f"""SELECT 'planned' AS table_name, position + 1 AS position, chart_type, columns,
                    reason, TRUE AS auto_generated FROM ({_auto_sql(
                        'events', 'value', ('event_type',), 'ts', _NUMBERS['events'])})
                    WHERE chart_type <> 'line'""",
            ]
        ),
    ),
    Query("run_charts", "chart_no:i series:s label:s value:2", _run_charts, _CHART_SQL),
]
