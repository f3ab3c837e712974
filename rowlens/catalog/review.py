"""Queries of the plan and review rules."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.catalog.findings import insights, pinned
from rowlens.catalog.registry import Query, Tables, stacked, union_all
from rowlens.catalog.statistics import sales_results
from rowlens.operators import review as r
from rowlens.operators.responses import normalize_json_responses
from rowlens.operators.roles import find_roles
from rowlens.operators.statistics import ANALYSES, run_analyses
from rowlens.plans.rules import (
    Chart,
    Plan,
    analysis_plan,
    guard_plan,
    plan_table,
    propose_plan,
    table_facts,
)
from rowlens.session import small_table

# Number of measures and dates, and the text columns, per table.
_SHAPES = {
    "orders": (1, 1, ("o_orderstatus", "o_orderpriority")),
    "lineitem": (5, 1, ("l_returnflag", "l_linestatus")),
    "documents": (1, 0, ("text", "lang", "source")),
    "region": (0, 0, ("r_name",)),
    "labels": (2, 0, ()),
    "pages": (0, 0, ("url", "html")),
}


def _grouping(table: str, texts: tuple[str, ...]) -> str:
    """The first text column with 2 to 20 values, null if there is none."""
    if not texts:
        return "NULL"
    options = ", ".join(
        f"CASE WHEN (SELECT count(DISTINCT {c}) FROM {table}) BETWEEN 2 AND 20 THEN '{c}' END"
        for c in texts
    )
    return f"coalesce({options}, NULL)"


def _plan_sql(table: str, measures: int, dates: int, texts: tuple[str, ...]) -> str:
    group = _grouping(table, texts)
    rows = (
        ("descriptive_stats", f"{measures} >= 1", f"'{measures} measure(s)'"),
        ("correlation_analysis", f"{measures} >= 2", f"'{measures} measure(s)'"),
        ("trend_analysis", f"{measures} >= 1 AND {dates} >= 1", f"'{dates} date column(s)'"),
        ("outlier_detection", f"{measures} >= 1", f"'{measures} measure(s)'"),
        ("value_counts_analysis", f"{len(texts)} >= 1", f"'{len(texts)} categorical column(s)'"),
        ("grouped_summary_analysis", f"{measures} >= 1 AND {group} IS NOT NULL",
         f"coalesce('groups by ' || {group}, 'no category with 2 to 20 values')"),
    )
    return union_all(
        f"""SELECT '{table}' AS table_name, {i} AS position, '{a}' AS analysis,
            {chosen} AS selected, {why} AS reason"""
        for i, (a, chosen, why) in enumerate(rows, 1)
    )


# A proposal that fits none of the tables, to see what the rules make of it.
_PROPOSAL = Plan(
    analyses=("descriptive_stats", "correlation_analysis", "grouped_summary_analysis"),
    charts=(
        Chart("bar", ("o_totalprice",), "Bars of a measure"),
        Chart("bar", ("text",), "Bars of texts"),
        Chart("bar", ("o_orderpriority",), "Priorities"),
        Chart("scatter", ("n_chars", "doc_id"), "Length by document"),
    ),
)
_GUARDED = ("orders", "documents", "region")


def _guarded(t: Tables, name: str) -> DataFrame:
    return plan_table(t.spark, guard_plan(_PROPOSAL, table_facts(t[name])))


def _guarded_rows(table: str, kind: str, rows, wanted: int = 99) -> str:
    return union_all(
        f"""SELECT '{table}' AS table_name, '{kind}' AS kind, {i} AS position, '{n}' AS name,
            {f"'{c}'" if c else 'NULL'} AS columns, {f"'{w}'" if w else 'NULL'} AS reason,
            {i <= wanted} AS wanted FROM {table} LIMIT 1"""
        for i, (n, c, w) in enumerate(rows, 1)
    )


def _guarded_sql() -> str:
    """What must come out, chart by chart; the unique-text rule is checked on the data."""
    scatter = ("scatter", "n_chars,doc_id", "Length by document")
    priorities = ("bar", "o_orderpriority", "Priorities")
    price = ("bar", "o_totalprice", "Bars of a measure")
    orders = (
        _guarded_rows("orders", "analysis", [
            (a, None, None) for a in ("trend_analysis", *_PROPOSAL.analyses)
        ]),
        _guarded_rows("orders", "chart", [
            ("line", "o_orderdate", "Course of the measures along o_orderdate"),
            ("bar", "text", "Bars of texts"), priorities, scatter,
            ("bar", "o_orderstatus", "Groups of o_orderstatus side by side"),
            ("histogram", "o_totalprice", "How o_totalprice is spread"),
        ], 6),
    )
    crowded = "(SELECT count(DISTINCT text) / count(*) FROM documents) > 0.5"
    kept = [
        price, priorities, scatter,
        ("bar", "lang", "Groups of lang side by side"),
        ("histogram", "n_chars", "How n_chars is spread"),
    ]
    documents = (
        _guarded_rows("documents", "analysis", [(a, None, None) for a in _PROPOSAL.analyses]),
        f"SELECT * FROM ({_guarded_rows('documents', 'chart', kept, 5)}) WHERE {crowded}",
    )
    region = (
        _guarded_rows("region", "analysis", [("value_counts_analysis", None, None)]),
        _guarded_rows("region", "chart", [price, ("bar", "text", "Bars of texts"), priorities], 3),
    )
    return union_all([*orders, *documents, *region])


def _coverage(t: Tables, name: str) -> DataFrame:
    """What is still missing after only two analyses were asked for."""
    df = t[name]
    facts = table_facts(df)
    expected = small_table(
        t.spark, [(a,) for a in propose_plan(facts).analyses], "analysis string"
    )
    _, log = run_analyses(df, ["value_counts_analysis", "correlation_analysis"], find_roles(df))
    return r.analysis_coverage(expected, log)


_COVERED = ("orders", "lineitem", "documents", "pages", "labels")
_COVERAGE_SQL = union_all(
    f"""SELECT table_name, analysis FROM ({_plan_sql(n, *_SHAPES[n])}) WHERE selected
        AND NOT (analysis = 'correlation_analysis' AND {_SHAPES[n][0]} >= 2)
        AND NOT (analysis = 'value_counts_analysis' AND {len(_SHAPES[n][2])} >= 1)"""
    for n in _COVERED
)

# Review rounds made from conversations: each turn asks for analyses by its role and length.
_ROUNDS = """SELECT conv_id AS run, turn AS round, role = 'assistant' AND conv_id % 3 = 0 AS approved,
    CASE WHEN conv_id % 2 = 0 THEN 'outlier_detection,trend_analysis'
         WHEN role = 'user' THEN 'trend_analysis,descriptive_stats,trend_analysis'
         ELSE 'descriptive_stats,trend_analysis' END AS wanted FROM conversations"""
_DECISION_SQL = f"""WITH rounds AS (SELECT run, round, approved,
        list_sort(list_distinct(string_split(wanted, ','))) AS missing FROM ({_ROUNDS})),
    decided AS (SELECT n.run, n.round, n.missing, CASE WHEN n.round >= 2 THEN 'revision limit'
        WHEN n.approved THEN 'approved' WHEN n.round > 0 AND n.missing = coalesce(b.missing, [])
        THEN 'repeated feedback' ELSE 'needs revision' END AS decision
        FROM rounds n LEFT JOIN rounds b ON n.run = b.run AND n.round = b.round + 1)
    SELECT run, round, decision <> 'needs revision' AS approved, decision,
    CASE WHEN decision = 'needs revision' THEN array_to_string(missing, ',') END AS missing
    FROM decided"""

# JSON responses made from parts: fenced or not, texts or records, other field names, not JSON.
RESPONSES = """SELECT p_partkey, CASE WHEN p_size % 10 = 9 THEN concat('No JSON for ', p_name)
    ELSE concat(CASE WHEN p_size % 2 = 0 THEN '```json\n' ELSE '' END,
    '{{"business_story": "', p_name, '", "opportunities": ["', p_name, ' of brand ', p_brand,
    ' and type ', p_type, ' should be sold in larger numbers"',
    CASE WHEN p_size % 3 = 0 THEN concat(', {{"title": "', p_brand,
        '", "recommendation": "Keep", "expected_impact": "Stable", "confidence": "High"}}, 7')
        ELSE '' END,
    '], "risks": [', CASE WHEN p_size % 4 = 0 THEN concat('{{"title": "', p_type, '"}}')
        ELSE concat('"', p_type, '"') END,
    '], "column_intelligence": [{{"column": "p_size", ',
    CASE WHEN p_size % 5 = 0 THEN '"importance": "high", "confidence": "", "correlation": 0.83'
         WHEN p_size % 5 = 1 THEN '"purpose": "Size", "risk_note": "Few", "correlation": 0.5'
         ELSE '"purpose": "", "business_interpretation": "Sells", "correlation": 0' END,
    '}}, "not a record"]}}', CASE WHEN p_size % 2 = 0 THEN '\n```' ELSE '' END) END AS text
    FROM part"""


def _responses(t: Tables) -> DataFrame:
    normal = normalize_json_responses(t.view(RESPONSES, "part"))

    def flat(records: str, *names: str):
        texts = F.transform(
            records, lambda x: F.concat_ws("|", *[F.coalesce(x[n], F.lit("-")) for n in names])
        )
        return F.array_join(texts, ";").alias(records)

    return normal.select(
        "p_partkey", "business_story", "valid",
        flat("opportunities", "title", "recommendation", "expected_impact", "confidence"),
        flat("risks", "title", "description", "priority"),
        flat("column_intelligence", "column", "purpose", "business_interpretation", "risk_note"),
    )


_TEXT = ("p_name || ' of brand ' || p_brand || ' and type ' || p_type "
         "|| ' should be sold in larger numbers'")
_RESPONSES_SQL = f"""SELECT p_partkey,
    CASE WHEN p_size % 10 <> 9 THEN p_name END AS business_story,
    p_size % 10 <> 9 AND p_size % 4 <> 0 AS valid,
    CASE WHEN p_size % 10 <> 9 THEN left({_TEXT}, 60) || '|' || {_TEXT} || '|Not specified.|Medium'
        || CASE WHEN p_size % 3 = 0 THEN ';' || p_brand || '|Keep|Stable|High' ELSE '' END
        END AS opportunities,
    CASE WHEN p_size % 10 <> 9 THEN CASE WHEN p_size % 4 = 0 THEN p_type || '|-|-'
        ELSE p_type || '|' || p_type || '|Medium' END END AS risks,
    CASE WHEN p_size % 10 <> 9 THEN CASE
        WHEN p_size % 5 = 0 THEN 'p_size|high|Not specified.|0.83'
        WHEN p_size % 5 = 1 THEN 'p_size|Size|Not specified.|Few'
        ELSE 'p_size|Not specified.|Sells|None identified.' END END AS column_intelligence
    FROM part"""

QUERIES = [
    Query(
        "analysis_plan", "table_name:s position:i analysis:s selected:b reason:s",
        lambda t: stacked({n: partial(analysis_plan, t[n]) for n in _SHAPES}),
        union_all(_plan_sql(n, *shape) for n, shape in _SHAPES.items()),
    ),
    Query(
        "plan_guardrails", "table_name:s kind:s position:i name:s columns:s reason:s wanted:b",
        lambda t: stacked({n: partial(_guarded, t, n) for n in _GUARDED}), _guarded_sql(),
    ),
    Query(
        "analysis_coverage", "table_name:s analysis:s",
        lambda t: stacked({n: partial(_coverage, t, n) for n in _COVERED}), _COVERAGE_SQL,
    ),
    Query(
        "review_decision", "run:i round:i approved:b decision:s missing:s",
        lambda t: r.review_decision(
            t.view(_ROUNDS, "conversations").withColumn("missing", F.split("wanted", ","))
        ),
        _DECISION_SQL,
    ),
    Query(
        "cap_per_source", "conv_id:i turn:i role:s text:s",
        lambda t: r.cap_per_source(t["conversations"], ["conv_id", "role"], ["turn"]),
        """SELECT * FROM conversations
            QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) <= 2""",
    ),
    Query(
        "grounded_text", "table_name:s id:i text:s",
        lambda t: stacked(
            {
                "documents": r.grounded_text(t["documents"].select(F.col("doc_id").alias("id"), "text")),
                "conversations": r.grounded_text(
                    t["conversations"].select(F.col("conv_id").alias("id"), "text")
                ),
            }
        ),
        """SELECT 'documents' AS table_name, doc_id AS id, text FROM documents
            WHERE regexp_matches(text, '[0-9]')
            UNION ALL SELECT 'conversations', conv_id, text FROM conversations
            WHERE regexp_matches(text, '[0-9]')""",
    ),
    Query(
        "template_insights", "position:i source_analysis:s text:s",
        lambda t: r.template_insights(
            pinned(sales_results(t, ANALYSES)), "quantity", "l_returnflag"
        ),
        insights(),
    ),
    Query(
        "normalize_json_responses",
        "p_partkey:i business_story:s valid:b opportunities:s risks:s column_intelligence:s",
        _responses, _RESPONSES_SQL,
    ),
]
