"""Queries of the findings, and of the report tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlens.catalog import sql
from rowlens.catalog.quality import DIRTY_REPORT, checklist
from rowlens.catalog.registry import Query, Tables, stacked, union_all
from rowlens.catalog.statistics import ORDER_RESULTS, SALES_SQL, sales, sales_results
from rowlens.catalog.views import DIRTY, GAPS, SALES, SALES_COLUMNS
from rowlens.functions.numbers import compact_number, display_number, title_label
from rowlens.operators import findings as fd
from rowlens.operators.profile import dataset_overview
from rowlens.operators.quality import validation_report
from rowlens.operators.review import template_insights
from rowlens.operators.statistics import correlation_matrix, iqr_outliers, stats_long
from rowlens.plans.analyze import analyze, report_tables
from rowlens.session import pin, run_together

SALES_REPORT = sql.validation(SALES, SALES_COLUMNS)
_GAP_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "constant", "gross")
_GAP_PAIRS = sql.correlations(GAPS, _GAP_COLUMNS)
STABLE, STAY = fd.STABLE, fd.STAY


# --- Spark side -----------------------------------------------------------------------------


def pinned(results: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Small results as local data, computed at the same time."""
    tasks = {name: partial(pin, frame) for name, frame in results.items()}
    return run_together(SparkSession.active(), tasks)


def _facts(df: DataFrame, results) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The facts of a table and the results they come from; ``results`` computes the latter."""
    done = run_together(
        df.sparkSession,
        {"report": lambda: pin(validation_report(df)), "results": lambda: pinned(results())},
    )
    return pin(fd.finding_facts(done["report"], done["results"])), done["results"]


def _both(t: Tables, finding) -> DataFrame:
    """A finding for the sales view and for the dirty view."""
    kinds = ("correlation_analysis", "trend_analysis", "outlier_detection")
    dirty = t.view(DIRTY, "orders")
    return stacked(
        {
            "sales": lambda: finding(*_facts(sales(t), lambda: sales_results(t, kinds))),
            "dirty": lambda: finding(
                *_facts(dirty, lambda: {"outlier_detection": iqr_outliers(dirty, ["price"])})
            ),
        }
    )


def _gap_matrix(t: Tables) -> DataFrame:
    return correlation_matrix(t.view(GAPS, "lineitem"), list(_GAP_COLUMNS))


def _report(t: Tables) -> DataFrame:
    df = sales(t)
    done = run_together(
        t.spark,
        {
            "validation": lambda: pin(validation_report(df)),
            "results": lambda: pinned(sales_results(t)),
        },
    )
    validation, results = done["validation"], done["results"]
    insights = pin(template_insights(results, "quantity", "l_returnflag"))
    return report_tables(
        pin(fd.finding_facts(validation, results)), results, validation, insights, None,
        dataset_overview(df), 0, "All six analyses.",
    )


_ORDER_COLUMNS = (
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
)


def _whole_run(t: Tables) -> DataFrame:
    """The figures of a whole run over orders: statistics, health and rows after cleaning."""
    run = analyze(t["orders"])
    figures = [
        run.validation.select(
            F.lit("validation").alias("analysis"), F.lit("orders").alias("column"),
            F.lit("health_score").alias("metric"), F.col("health_score").alias("value"),
        ),
        run.cleaned.table.agg(F.count("*").cast("double").alias("value")).select(
            F.lit("cleaning").alias("analysis"), F.lit("orders").alias("column"),
            F.lit("rows").alias("metric"), "value",
        ),
    ]
    found = stats_long(run.results)
    for part in figures:
        found = found.unionByName(part)
    return found


# --- checks ---------------------------------------------------------------------------------


def facts(report: str, outliers: str, pairs: str | None = None, trend: str | None = None) -> str:
    pair = f"""SELECT left_column, right_column, r FROM ({pairs}) WHERE left_pos < right_pos
        AND r IS NOT NULL ORDER BY abs(r) DESC, left_pos, right_pos LIMIT 1""" if pairs else \
        "SELECT NULL::VARCHAR AS left_column, NULL::VARCHAR AS right_column, NULL::DOUBLE AS r"
    best = f"""SELECT "column" AS best_trend, percent_change AS best_change FROM ({trend})
        ORDER BY abs(percent_change) DESC, position LIMIT 1""" if trend else \
        "SELECT NULL::VARCHAR AS best_trend, NULL::DOUBLE AS best_change"
    first = f"""SELECT "column" AS first_trend, percent_change AS first_change FROM ({trend})
        ORDER BY position LIMIT 1""" if trend else \
        "SELECT NULL::VARCHAR AS first_trend, NULL::DOUBLE AS first_change"
    return f"""SELECT * FROM ({report}), (SELECT sum(outlier_count) AS total_outliers
        FROM ({outliers})), ({pair}), ({best}), ({first})"""


SALES_FACTS = facts(
    SALES_REPORT, SALES_SQL["outlier_detection"], SALES_SQL["correlation_analysis"],
    SALES_SQL["trend_analysis"],
)
DIRTY_FACTS = facts(DIRTY_REPORT, sql.outliers(DIRTY, ["price"]))
_HEALTH = "CAST(greatest(0, least(100, trunc(health_score - least(total_outliers * 2, 15)))) AS INT)"
_DRIVER = f"coalesce({sql.title('left_column')}, 'N/A')"


def both(finding) -> str:
    return f"""SELECT 'sales' AS table_name, * FROM ({finding(SALES_FACTS, True)})
        UNION ALL SELECT 'dirty' AS table_name, * FROM ({finding(DIRTY_FACTS, False)})"""


def labelled(source: str, *pairs: tuple[str, str]) -> str:
    return union_all(
        f"SELECT {i} AS position, '{label}' AS label, CAST({value} AS VARCHAR) AS value FROM ({source})"
        for i, (label, value) in enumerate(pairs, 1)
    )


def kpis(source: str, *_) -> str:
    return labelled(
        source,
        ("Business Health", f"{_HEALTH} || '/100'"),
        ("Data Reliability", f"{sql.fixed('health_score', 0)} || '%'"),
        ("Strongest Predictor", _DRIVER),
        ("Outliers Detected", "CAST(total_outliers AS BIGINT)"),
    )


def status(source: str, *_) -> str:
    return labelled(
        source,
        ("Business Status", f"""CASE WHEN {_HEALTH} >= 80 THEN 'Healthy'
            WHEN {_HEALTH} >= 60 THEN 'Needs Attention' ELSE 'At Risk' END"""),
        ("Primary Driver", _DRIVER),
        ("Top Risk", "'None identified'"),
        ("Overall Health Score", f"{_HEALTH} || '/100'"),
    )


def fired(source: str, rules, extra: tuple[str, ...] = (), closing: tuple[str, str] = ("", ""),
          keep: int = 4) -> str:
    """The first rules that hold, numbered; the closing statement only if none does."""
    rows = [
        f"""SELECT {i} AS priority, 0 AS place, '{code}' AS code, {text} AS text
            FROM ({source}) WHERE {holds}"""
        for i, code, holds, text in rules
    ]
    return f"""WITH fired AS ({union_all([*rows, *extra])}),
        closed AS (SELECT * FROM fired UNION ALL SELECT 1000, 0, '{closing[0]}', '{closing[1]}'
                   FROM ({source}) WHERE (SELECT count(*) FROM fired) = 0)
        SELECT row_number() OVER (ORDER BY priority, place) AS position, code, text FROM closed
        QUALIFY position <= {keep}"""


def percent(c: str) -> str:
    return f"{sql.fixed(f'abs({c})', 1, False)} || '%'"


def findings(source: str, *_, insight: str | None = None) -> str:
    score = sql.score_text("health_score")
    rules = (
        (0, "trend", "best_change IS NOT NULL",
         f"""{sql.title('best_trend')} || CASE WHEN best_change >= 0 THEN ' went up by '
             ELSE ' went down by ' END || {percent('best_change')}
             || ' between the first and the last date.'"""),
        (1, "correlation", "r IS NOT NULL",
         f"""'Closest pair: ' || {sql.title('left_column')} || ' and ' || {sql.title('right_column')}
             || ', r = ' || {sql.fixed('r', 2)}"""),
        (2, "outliers", "total_outliers > 0",
         """CAST(total_outliers AS BIGINT)
            || ' value(s) lie far from the rest of their column.'"""),
        (3, "quality", "TRUE",
         f"""CASE WHEN health_score >= 95 THEN 'Quality score ' || {score}
             || ' of 100: the results rest on solid data.'
             WHEN health_score >= 85 THEN 'Quality score ' || {score}
             || ' of 100: usable, some cleaning would help.'
             ELSE 'Quality score ' || {score}
             || ' of 100: look at the data before relying on results.' END"""),
    )
    extra = ()
    if insight:
        extra = (f"""SELECT 4 AS priority, 0 AS place, 'insight' AS code,
            'First insight: ' || text AS text FROM ({insight}) WHERE position = 1""",)
    return fired(source, rules, extra, ("stable", STABLE), 4)


def advice(source: str, has_results: bool) -> str:
    spaced = """replace("column", '_', ' ')"""
    rules = (
        (3, "quality", "health_score < 90",
         """'Check new data as it comes in: the quality score is below 90.'"""),
    )
    outliers = SALES_SQL["outlier_detection"] if has_results else sql.outliers(DIRTY, ["price"])
    extra = [
        f"""SELECT 1 AS priority, position AS place, 'outliers' AS code, 'Look at '
            || outlier_count || ' unusual value(s) of ' || {spaced}
            || ' before using them.' AS text
            FROM ({outliers}) WHERE outlier_count > 0"""
    ]
    if has_results:
        extra += [
            f"""SELECT 0 AS priority, position AS place, 'trend' AS code,
                CASE WHEN percent_change < 0 THEN 'Find out why ' || {sql.title('"column"')}
                || ' fell by ' || {percent('percent_change')} || '.'
                ELSE {sql.title('"column"')} || ' rose by ' || {percent('percent_change')}
                || ': see what it depends on.' END AS text
                FROM ({SALES_SQL['trend_analysis']}) WHERE percent_change < 0 OR percent_change > 20""",
            f"""SELECT 2 AS priority, left_pos * 100000 + right_pos AS place, 'correlation' AS code,
                replace(left_column, '_', ' ') || ' and ' || replace(right_column, '_', ' ')
                || ' tell much the same (r = ' || {sql.fixed('r', 2)} || ').' AS text FROM ({SALES_SQL['correlation_analysis']})
                WHERE left_pos < right_pos AND abs(r) > 0.7""",
        ]
    return fired(source, rules, tuple(extra), ("stay", STAY), 5)


def alarms(source: str, *_) -> str:
    return fired(
        source,
        (
            (0, "POSITIVE", "health_score = 100 AND missing_cells = 0",
             "'Full quality score, every cell filled'"),
            (1, "CRITICAL", "health_score < 70",
             f"""'Quality score ' || {sql.score_text('health_score')}
                 || ' of 100: look at how the data is collected'"""),
            (2, "WARNING", "total_outliers > 0",
             """CAST(total_outliers AS BIGINT) || ' unusual value(s) in the measures'"""),
        ),
        (), ("INFO", "No alert"), 4,
    )


def snapshot(source: str, has_results: bool, summary: str | None = None) -> str:
    rows = [
        ("Dataset size", "row_count || ' rows x ' || column_count || ' columns'",
         "'How much the results rest on'"),
        ("Data health", f"{sql.score_text('health_score')} || ' / 100'",
         "'How far the source can be trusted'"),
    ]
    if has_results:
        rows.append(
            ("Primary trend",
             f"{sql.title('first_trend')} || ' ' || {sql.fixed('first_change', 1, False)} || '%'",
             "'Where the first measure is heading'")
        )
    if summary:
        rows.append(("Plan summary", "'As planned'", f"'{summary}'"))
    places = {"Dataset size": 1, "Data health": 2, "Primary trend": 3, "Plan summary": 4}
    return union_all(
        f"""SELECT {places[d]} AS position, '{d}' AS dimension, {v} AS value, {w} AS why
            FROM ({source})"""
        for d, v, w in rows
    )


_PAIRS = "SELECT * FROM ({m}) WHERE left_pos < right_pos AND r IS NOT NULL"


def relationships(matrix: str) -> str:
    return f"""SELECT left_column, right_column, r, CASE WHEN abs(r) >= 0.7 THEN 'Strong'
        WHEN abs(r) >= 0.4 THEN 'Medium' ELSE 'Weak' END AS strength
        FROM ({_PAIRS.format(m=matrix)}) ORDER BY abs(r) DESC, left_pos, right_pos LIMIT 8"""


def drivers(matrix: str) -> str:
    return f"""SELECT row_number() OVER (ORDER BY mean_strength DESC, left_pos) AS rank, "column",
        mean_strength, greatest(1, CAST(round_even(mean_strength * 5, 0) AS INT)) AS stars FROM (
        SELECT left_pos, left_column AS "column", avg(abs(r)) AS mean_strength FROM ({matrix})
        WHERE left_pos <> right_pos AND r IS NOT NULL GROUP BY 1, 2) QUALIFY rank <= 6"""


def insights() -> str:
    """The six leading statements about the sales view."""
    def show(c: str) -> str:
        return sql.display(c)

    column = sql.title('"column"')
    rows = (
        ("descriptive_stats", "position",
         f"""{column} || ' averages ' || {show('mean')} || ' over ' || {show('"count"')}
             || ' records and ranges from ' || {show('min')} || ' to ' || {show('max')} || '.'"""),
        ("correlation_analysis", "left_pos >= right_pos, abs(r) DESC, left_pos, right_pos",
         f"""{sql.title('left_column')} || ' and ' || {sql.title('right_column')}
             || ' have a correlation of ' || {sql.fixed('r', 2)} || '.'"""),
        ("trend_analysis", "position",
         f"""{column} || CASE WHEN percent_change >= 0 THEN ' rose by ' ELSE ' fell by ' END
             || {percent('percent_change')} || ' from ' || {show('first_value')} || ' to '
             || {show('last_value')} || '.'"""),
        ("outlier_detection", "outlier_count DESC, position",
         f"""{column} || ' has ' || {show('outlier_count')} || ' values outside '
             || {show('lower_bound')} || ' to ' || {show('upper_bound')} || '.'"""),
        ("value_counts_analysis", 'rank, n DESC, "column"',
         f"""value || ' is the most frequent ' || {column} || ' with ' || {show('n')}
             || ' records.'"""),
        ("grouped_summary_analysis", 'total DESC, "group"',
         f""""group" || ' ranks ' || rank || ' among L Returnflag values with a total Quantity of '
             || {show('total')} || ' over ' || {show('"count"')} || ' records.'"""),
    )
    return union_all(
        f"""SELECT {i} AS position, '{name}' AS source_analysis, {text} AS text
            FROM (SELECT * FROM ({SALES_SQL[name]}) ORDER BY {order} LIMIT 1)"""
        for i, (name, order, text) in enumerate(rows, 1)
    )


def _section(number: int, name: str, body: str, label: str, value: str, position: str) -> str:
    return f"""SELECT {number} AS section_no, '{name}' AS section, {position} AS position,
        CAST({label} AS VARCHAR) AS label, CAST({value} AS VARCHAR) AS value FROM ({body})"""


def statistic_lines() -> str:
    body = union_all(sql.melted(n, q) for n, q in SALES_SQL.items())
    return f"""SELECT {sql.title('"column"')} || ' (' || replace(metric, '_', ' ') || ')' AS label,
        CASE WHEN metric = 'percent_change' THEN CASE WHEN value >= 0 THEN '▲ ' ELSE '▼ ' END
        || {percent('value')} ELSE {sql.display('value')} END AS text FROM ({body})"""


def _overview() -> str:
    return union_all(
        f"SELECT {i} AS position, '{label}' AS metric, {value} AS value FROM lineitem"
        for i, (label, value) in enumerate(
            (
                ("Total Rows", "count(*)"), ("Total Columns", "CAST(10 * sign(count(*)) AS INT)"),
                ("Numeric Columns", "CAST(4 * sign(count(*)) AS INT)"),
                ("Categorical Columns", "CAST(2 * sign(count(*)) AS INT)"),
                ("Datetime Columns", "CAST(sign(count(*)) AS INT)"),
            ),
            1,
        )
    )


_MATRIX = SALES_SQL["correlation_analysis"]
_REPORT_SQL = union_all(
    _section(i, *section)
    for i, section in enumerate(
        (
            ("Key Figures", kpis(SALES_FACTS), "label", "value", "position"),
            ("Executive Snapshot", snapshot(SALES_FACTS, True, "All six analyses."),
             "dimension", "value", "position"),
            ("Key Findings", findings(SALES_FACTS, insight=insights()), "code", "text", "position"),
            ("Insights", insights(), "source_analysis", "text", "position"),
            ("Dataset Overview", _overview(), "metric", "value", "position"),
            ("Data Reliability Checklist", checklist(SALES_REPORT), '"check"',
             "status || ': ' || detail", "position"),
            ("Statistical Analyses", statistic_lines(), "label", "text", "0"),
            ("Relationship Analysis", relationships(_MATRIX),
             "left_column || ' / ' || right_column",
             f"{sql.fixed('r', 3)} || ' ' || strength", "0"),
            ("Driver Ranking", drivers(_MATRIX), '"column"', "stars", "rank"),
            ("Alerts", alarms(SALES_FACTS), "code", "text", "position"),
            ("Recommendations", advice(SALES_FACTS, True), "code", "text", "position"),
            ("Conclusion", status(SALES_FACTS), "label", "value", "position"),
        ),
        1,
    )
)

_NUMBERS = {
    "plain": "o_totalprice", "large": "o_totalprice * 1000", "huge": "o_totalprice * 1000000",
    "small": "o_totalprice / 100000", "whole": "CAST(o_orderkey AS DOUBLE)",
    "negative": "0 - o_totalprice / 10",
}
_NUMBER_VIEW = "SELECT o_orderkey, " + ", ".join(
    f"{e} AS {n}" for n, e in _NUMBERS.items()
) + " FROM orders"
_TEXTS = "o_orderkey:i " + " ".join(f"{n}:s" for n in _NUMBERS)


def _formatted(t: Tables, form) -> DataFrame:
    return t.view(_NUMBER_VIEW, "orders").select(
        "o_orderkey", *[form(F.col(n)).alias(n) for n in _NUMBERS]
    )


def _formatted_sql(form) -> str:
    shown = ", ".join(f"{form(n)} AS {n}" for n in _NUMBERS)
    return f"SELECT o_orderkey, {shown} FROM ({_NUMBER_VIEW})"


QUERIES = [
    Query(
        "business_health", "table_name:s business_health:i",
        lambda t: _both(t, lambda f, _: fd.business_health(f)),
        both(lambda f, _: f"SELECT {_HEALTH} AS business_health FROM ({f})"),
    ),
    Query(
        "health_status", "table_name:s position:i label:s value:s",
        lambda t: _both(t, lambda f, _: fd.health_status(f)), both(status),
    ),
    Query(
        "strongest_pair", "left_column:s right_column:s r:6",
        lambda t: fd.strongest_pair(_gap_matrix(t)),
        f"""SELECT left_column, right_column, r FROM ({_PAIRS.format(m=_GAP_PAIRS)})
            ORDER BY abs(r) DESC, left_pos, right_pos LIMIT 1""",
    ),
    Query(
        "kpi_cards", "table_name:s position:i label:s value:s",
        lambda t: _both(t, lambda f, _: fd.kpi_cards(f)), both(kpis),
    ),
    Query(
        "relationship_strength", "left_column:s right_column:s r:6 strength:s",
        lambda t: fd.relationship_strength(pin(_gap_matrix(t))), relationships(_GAP_PAIRS),
    ),
    Query(
        "driver_ranking", "rank:i column:s mean_strength:6 stars:i",
        lambda t: fd.driver_ranking(pin(_gap_matrix(t))), drivers(_GAP_PAIRS),
    ),
    Query(
        "key_findings", "table_name:s position:i code:s text:s",
        lambda t: _both(t, lambda f, _: fd.key_findings(f)), both(findings),
    ),
    Query(
        "recommendations", "table_name:s position:i code:s text:s",
        lambda t: _both(t, fd.recommendations), both(advice),
    ),
    Query(
        "alerts", "table_name:s position:i code:s text:s",
        lambda t: _both(t, lambda f, _: fd.alerts(f)), both(alarms),
    ),
    Query(
        "executive_snapshot", "table_name:s position:i dimension:s value:s why:s",
        lambda t: _both(t, lambda f, _: fd.executive_snapshot(f)), both(snapshot),
    ),
    Query(
        "compact_number", _TEXTS, lambda t: _formatted(t, compact_number),
        _formatted_sql(sql.compact),
    ),
    Query(
        "display_number", _TEXTS, lambda t: _formatted(t, display_number),
        _formatted_sql(sql.display),
    ),
    Query(
        "title_label", "p_partkey:i label:s type_label:s",
        lambda t: t["part"].select(
            "p_partkey",
            title_label(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("label"),
            title_label(F.concat_ws("_", F.lower("p_type"), "p_brand")).alias("type_label"),
        ),
        f"""SELECT p_partkey, {sql.title("replace(p_name, ' ', '_')")} AS label,
            {sql.title("lower(p_type) || '_' || p_brand")} AS type_label FROM part""",
    ),
    Query(
        "report_tables", "section_no:i section:s position:i label:s value:s", _report, _REPORT_SQL
    ),
    Query(
        "analyze", "analysis:s column:s metric:s value:2", _whole_run,
        union_all(
            [sql.melted(n, q) for n, q in ORDER_RESULTS.items()]
            + [
                f"""SELECT 'validation' AS analysis, 'orders' AS "column", 'health_score' AS metric,
                    health_score AS value
                    FROM ({sql.validation('SELECT * FROM orders', _ORDER_COLUMNS)})""",
                """SELECT 'cleaning' AS analysis, 'orders' AS "column", 'rows' AS metric,
                    CAST((SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS DOUBLE) AS value""",
            ]
        ),
    ),
    Query(
        "confidence_band", "left_column:s right_column:s r:6 confidence:s",
        lambda t: fd.confidence_bands(_gap_matrix(t)),
        f"""SELECT left_column, right_column, r, CASE WHEN abs(r) > 0.7 THEN 'High'
            WHEN abs(r) >= 0.4 THEN 'Medium' ELSE 'Low' END AS confidence
            FROM ({_GAP_PAIRS}) WHERE left_pos < right_pos AND r IS NOT NULL""",
    ),
]
