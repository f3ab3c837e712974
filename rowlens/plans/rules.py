"""Choosing analyses and charts from what is known about a table.

The rules work on column names, roles and value counts: a handful of facts that Spark jobs have
measured, so they run on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlens.operators.charts import date_column, primary_metric, usable_categories
from rowlens.operators.counts import distinct_counts
from rowlens.operators.roles import Roles, find_roles, numeric_names
from rowlens.operators.statistics import ANALYSES, COMPARABLE_GROUPS
from rowlens.session import small_table

# Chart names people use, and the kind of chart they mean.
CHART_KINDS = {
    "bar": "pareto_bar", "bar_chart": "pareto_bar", "pareto_bar": "pareto_bar",
    "pareto": "pareto_bar", "horizontal_bar": "pareto_bar",
    "line": "line", "line_chart": "line", "time_series": "line",
    "stacked_bar": "stacked_bar", "stacked": "stacked_bar", "crosstab": "stacked_bar",
    "histogram": "quantile_hist", "hist": "quantile_hist", "quantile_hist": "quantile_hist",
    "distribution": "quantile_hist",
    "scatter": "scatter", "scatter_plot": "scatter",
    "heatmap": "correlation_heatmap", "correlation": "correlation_heatmap",
    "correlation_heatmap": "correlation_heatmap",
}
DEFAULT_CHART = "pareto_bar"
# The share of distinct values that makes a category a name column, and how many
# charts a reader is meant to look at.
NAME_LIKE_SHARE = 0.5
ENOUGH_CHARTS = 4
FEWEST_WANTED, MOST_WANTED = 3, 6
CHART_SCHEMA = (
    "position int, chart_type string, columns string, reason string, auto_generated boolean"
)


@dataclass(frozen=True)
class Chart:
    chart_type: str
    columns: tuple[str, ...]
    reason: str
    auto_generated: bool = False

    @property
    def kind(self) -> str:
        return kind_of(self.chart_type)


@dataclass(frozen=True)
class Plan:
    analyses: tuple[str, ...] = ()
    charts: tuple[Chart, ...] = ()
    summary: str = ""
    #: The category by which groups are compared.
    group_by: str | None = None

    @property
    def wanted_charts(self) -> int:
        """How many of the charts, in order, a reader is meant to look at; all are computed."""
        return max(FEWEST_WANTED, min(len(self.analyses) + 2, MOST_WANTED))


@dataclass
class TableFacts:
    """What the rules need to know about a table."""

    row_count: int
    roles: Roles
    category_values: dict[str, int] = field(default_factory=dict)

    def comparable_category(self) -> str | None:
        low, high = COMPARABLE_GROUPS
        return next(
            (c for c in self.roles.categorical if low <= self.category_values.get(c, 0) <= high),
            None,
        )


def table_facts(df: DataFrame, roles: Roles | None = None) -> TableFacts:
    roles = roles or find_roles(df)
    values = {}
    if roles.categorical:
        values = {
            r["column"]: r["distinct_count"]
            for r in distinct_counts(df, roles.categorical).collect()
        }
    return TableFacts(df.count(), roles, values)


def choose_analyses(facts: TableFacts) -> list[tuple[str, bool, str]]:
    """(analysis, selected, reason) for the six analyses."""
    roles = facts.roles
    numbers, texts, dates = len(roles.numeric), len(roles.categorical), len(roles.datetime)
    grouping = facts.comparable_category()
    return [
        ("descriptive_stats", numbers >= 1, f"{numbers} measure(s)"),
        ("correlation_analysis", numbers >= 2, f"{numbers} measure(s)"),
        ("trend_analysis", numbers >= 1 and dates >= 1, f"{dates} date column(s)"),
        ("outlier_detection", numbers >= 1, f"{numbers} measure(s)"),
        ("value_counts_analysis", texts >= 1, f"{texts} categorical column(s)"),
        (
            "grouped_summary_analysis",
            numbers >= 1 and grouping is not None,
            f"groups by {grouping}" if grouping else "no category with 2 to 20 values",
        ),
    ]


def analysis_plan(df: DataFrame, facts: TableFacts | None = None) -> DataFrame:
    rows = choose_analyses(facts or table_facts(df))
    numbered = [(i, *row) for i, row in enumerate(rows, 1)]
    return small_table(
        df.sparkSession, numbered,
        "position int, analysis string, selected boolean, reason string",
    )


@dataclass(frozen=True)
class Topic:
    """Something a table should be shown by: the columns it takes, and the chart that shows it.

    ``takes`` names slots of a table (see :func:`slots`); a table without one of them has no such
    topic. ``shows`` are the slots that become the chart's columns. ``part_of`` is the analysis whose
    results the chart pictures: it is required of a plan, unless ``brings`` says that the topic adds it.
    """

    kind: str
    chart_type: str
    takes: tuple[str, ...]
    shows: tuple[str, ...]
    why: str
    part_of: str | None = None
    brings: bool = False

    def chart(self, found: dict[str, object]) -> Chart | None:
        if not all(found.get(slot) for slot in self.takes):
            return None
        columns: list[str] = []
        for slot in self.shows:
            value = found[slot]
            columns += value if isinstance(value, list) else [value]
        words = {k: ", ".join(v) if isinstance(v, list) else v for k, v in found.items()}
        return Chart(self.chart_type, tuple(columns), self.why.format(**words))


# What a plan for a table has to picture, the most telling first.
PLAN_TOPICS = (
    Topic("line", "line", ("date", "measure"), ("date",), "Course of the measures along {date}",
          part_of="trend_analysis", brings=True),
    Topic("pareto_bar", "bar", ("grouping", "measure"), ("grouping",), "Groups of {grouping} side by side",
          part_of="grouped_summary_analysis"),
    Topic("quantile_hist", "histogram", ("measure",), ("measure",), "How {measure} is spread"),
    Topic("correlation_heatmap", "correlation_heatmap", ("several",), ("several",),
          "How the measures move together", part_of="correlation_analysis"),
)
# What a table can be shown by when hardly anything is planned.
AUTO_TOPICS = (
    Topic("line", "line", ("date", "measure"), ("measure",), "{measure} by period"),
    Topic("pareto_bar", "pareto_bar", ("category", "measure"), ("category", "measure"),
          "Largest totals of {measure} among {category}"),
    Topic("stacked_bar", "stacked_bar", ("category", "other"), ("category", "other"),
          "{category} split by {other}"),
    Topic("quantile_hist", "quantile_hist", ("measure",), ("measure",),
          "Values of {measure} with median and 90th percentile"),
    Topic("correlation_heatmap", "correlation_heatmap", ("several",), ("several",),
          "Correlations of {several}"),
    Topic("pareto_bar", "pareto_bar", ("other", "measure", "single"), ("other", "measure"),
          "Largest totals of {measure} among {other}"),
)


def slots(measures: list[str], date: str | None, categories: list[str], grouping: str | None,
          metric: str | None) -> dict[str, object]:
    """Which columns of a table play which part in charts; parts nobody plays are empty."""
    return {
        "measure": metric, "date": date, "grouping": grouping,
        "category": categories[0] if categories else None,
        "other": categories[1] if len(categories) > 1 else None,
        "several": measures if len(measures) > 1 else None,
        "single": metric if len(measures) < 2 else None,
    }


def _needs_measure(analysis: str) -> bool:
    return analysis in ANALYSES and analysis != "value_counts_analysis"


def _fits(chart: Chart, facts: TableFacts) -> bool:
    """Whether a chart says something about the table.

    Kinds other than bars need a measure. Bars need repeated values: not a measure, and no category
    whose values mostly occur once.
    """
    if chart.kind not in ("pareto_bar", "stacked_bar"):
        return bool(facts.roles.numeric)
    if chart.chart_type != "bar" or not chart.columns:
        return True
    (name, *_), roles = chart.columns, facts.roles
    if name in roles.categorical:
        return facts.category_values.get(name, 0) <= NAME_LIKE_SHARE * max(facts.row_count, 1)
    return name not in roles.numeric


def guard_plan(plan: Plan, facts: TableFacts) -> Plan:
    """Make a proposed plan fit the table: each topic of the table pictured, nothing that cannot be.

    No chart is cut off; :attr:`Plan.wanted_charts` says how many are meant to be looked at.
    """
    roles = facts.roles
    grouping = facts.comparable_category()
    found = slots(
        roles.numeric, next(iter(roles.datetime), None), roles.categorical, grouping,
        next(iter(roles.numeric), None),
    )
    analyses = [a for a in plan.analyses if roles.numeric or not _needs_measure(a)]
    if not roles.numeric and roles.categorical:
        analyses = list(dict.fromkeys([*analyses, "value_counts_analysis"]))
    charts = [c for c in plan.charts if _fits(c, facts)]
    for topic in PLAN_TOPICS:
        chart = topic.chart(found)
        if chart is None:
            continue
        if topic.brings:
            analyses = [*({topic.part_of} - set(analyses)), *analyses]
        required = topic.part_of is None or topic.part_of in analyses
        same = [c for c in charts if c.kind == topic.kind]
        if topic.kind == "pareto_bar":
            same = [c for c in same if c.columns[:1] == chart.columns]
        if required and not same:
            charts = [chart, *charts] if topic.brings else [*charts, chart]
    return replace(
        plan, analyses=tuple(analyses), charts=tuple(charts), group_by=plan.group_by or grouping
    )


def auto_charts(df: DataFrame) -> list[Chart]:
    """Charts a table allows by its columns alone."""
    found = slots(
        numeric_names(df), date_column(df), usable_categories(df), None, primary_metric(df)
    )
    charts = [topic.chart(found) for topic in AUTO_TOPICS]
    return [replace(c, auto_generated=True) for c in charts if c is not None]


def with_auto_charts(df: DataFrame, planned: tuple[Chart, ...]) -> tuple[Chart, ...]:
    """A short chart list is filled up with automatic charts of types it does not have."""
    if len(planned) >= ENOUGH_CHARTS:
        return tuple(planned)
    types = {c.chart_type for c in planned}
    return (*planned, *(c for c in auto_charts(df) if c.chart_type not in types))


def chart_table(spark: SparkSession, charts: tuple[Chart, ...]) -> DataFrame:
    rows = [
        (i, c.chart_type, ",".join(c.columns), c.reason, c.auto_generated)
        for i, c in enumerate(charts, 1)
    ]
    return small_table(spark, rows, CHART_SCHEMA)


def plan_table(spark: SparkSession, plan: Plan) -> DataFrame:
    """Analyses and charts of a plan as rows (kind, position, name, columns, reason, wanted)."""
    rows = [("analysis", i, a, None, None, True) for i, a in enumerate(plan.analyses, 1)]
    rows += [
        ("chart", i, c.chart_type, ",".join(c.columns), c.reason, i <= plan.wanted_charts)
        for i, c in enumerate(plan.charts, 1)
    ]
    return small_table(
        spark, rows,
        "kind string, position int, name string, columns string, reason string, wanted boolean",
    )


def chart_kind(raw: Column) -> Column:
    """The kind of chart a free spelling means; unknown spellings become a Pareto chart."""
    plain = F.regexp_replace(F.lower(F.trim(raw)), "[ -]", "_")
    kinds = F.create_map(*[F.lit(x) for pair in CHART_KINDS.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, plain), F.lit(DEFAULT_CHART))


def kind_of(raw: str) -> str:
    plain = raw.strip().lower().replace(" ", "_").replace("-", "_")
    return CHART_KINDS.get(plain, DEFAULT_CHART)


def propose_plan(facts: TableFacts) -> Plan:
    """The plan the rules make without any proposal."""
    chosen = tuple(name for name, selected, _ in choose_analyses(facts) if selected)
    roles = facts.roles
    summary = (
        f"{len(chosen)} analyses over {len(roles.numeric)} measure(s), "
        f"{len(roles.categorical)} categorical and {len(roles.datetime)} date column(s)."
    )
    return guard_plan(Plan(analyses=chosen, summary=summary), facts)
