"""A whole run: quality, cleaning, profile, plan, analyses, charts, findings, report tables."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.operators import findings as fd
from rowlens.operators.cleaning import Cleaned, clean_with_report
from rowlens.operators.profile import Profile, dataset_overview, dataset_profile
from rowlens.operators.quality import (
    duplicate_count,
    reliability_checklist,
    repeated_hashes,
    validation_report,
)
from rowlens.operators.review import analysis_coverage, template_insights
from rowlens.operators.statistics import run_analyses, stats_long
from rowlens.plans.chart_data import charts_long, run_charts
from rowlens.plans.rules import Plan, TableFacts, propose_plan, with_auto_charts
from rowlens.session import pin, run_together, small_table


@dataclass
class Analysis:
    """Everything a run produced. The result tables are small; the cleaned table is not."""

    validation: DataFrame
    cleaned: Cleaned
    profile: Profile
    plan: Plan
    results: dict[str, DataFrame]
    analysis_log: DataFrame
    missing_analyses: DataFrame
    chart_tables: dict[int, DataFrame]
    chart_log: DataFrame
    insights: DataFrame | None
    facts: DataFrame
    report: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        """Result tables by kind, as the sink takes them."""
        found = {
            "validation": self.validation,
            "cleaning": self.cleaned.report,
            "profile_numeric": self.profile.numeric,
            "profile_categorical": self.profile.categorical,
            "profile_datetime": self.profile.datetime,
            "analysis_log": self.analysis_log,
            "statistics": stats_long(self.results),
            "chart_log": self.chart_log,
            "report": self.report,
        }
        if self.chart_tables:
            found["charts"] = charts_long(self.chart_tables)
        return found


def analyze(df: DataFrame, plan: Plan | None = None, approx: bool = False) -> Analysis:
    """Analyse a table.

    Every result table is computed once and kept as local data, because findings and report are
    built from several of them. Passes over the data read only the columns they need.
    """
    spark = df.sparkSession
    repeated = repeated_hashes(df)
    validation = pin(validation_report(df, duplicate_count(df, repeated)))
    if validation.first()["row_count"] == 0:
        raise ValueError("the table has no rows")
    cleaned = clean_with_report(df, approx, repeated)
    table = cleaned.table

    profile = dataset_profile(table, approx)
    roles = profile.roles
    values = {
        r["column"]: r["unique_values"] or 0
        for r in profile.categorical.select("column", "unique_values").collect()
    }
    facts = TableFacts(profile.row_count, roles, values)
    proposed = propose_plan(facts)
    plan = replace(plan, group_by=plan.group_by or proposed.group_by) if plan else proposed
    lazy, log = run_analyses(table, list(plan.analyses), roles, approx, quartiles=profile.quartiles, group_by=plan.group_by)

    # Analyses and charts do not depend on each other.
    steps = {name: partial(pin, frame) for name, frame in lazy.items()}
    steps["charts"] = lambda: run_charts(table, with_auto_charts(table, plan.charts))
    done = run_together(spark, steps)
    chart_tables, chart_log = done.pop("charts")
    results = {name: done[name] for name in lazy}

    expected = small_table(spark, [(name,) for name in proposed.analyses], "analysis string")
    missing = analysis_coverage(expected, log)
    insights = None
    if results:
        measure = next(iter(roles.numeric), None)
        category = plan.group_by or proposed.group_by or next(iter(roles.categorical), None)
        insights = pin(template_insights(results, measure, category))
    found = pin(fd.finding_facts(validation, results))
    report = report_tables(
        found, results, validation, insights, chart_log, dataset_overview(table, roles),
        cleaned.duplicates_removed, plan.summary,
    )
    return Analysis(
        validation, cleaned, profile, plan, results, log, missing, chart_tables, chart_log,
        insights, found, report,
    )


def report_tables(
    facts: DataFrame,
    results: dict[str, DataFrame],
    validation: DataFrame,
    insights: DataFrame | None,
    chart_log: DataFrame | None,
    overview: DataFrame,
    duplicates_removed: int,
    plan_summary: str | None,
) -> DataFrame:
    """All report sections in order as (section_no, section, position, label, value)."""
    col = F.col
    sections = [
        ("Key Figures", fd.kpi_cards(facts), col("label"), col("value"), col("position")),
        (
            "Executive Snapshot", fd.executive_snapshot(facts, plan_summary),
            col("dimension"), col("value"), col("position"),
        ),
        (
            "Key Findings", fd.key_findings(facts, insights),
            col("code"), col("text"), col("position"),
        ),
    ]
    if insights is not None:
        sections.append(
            ("Insights", insights, col("source_analysis"), col("text"), col("position"))
        )
    checklist = reliability_checklist(validation, F.lit(duplicates_removed))
    sections += [
        ("Dataset Overview", overview, col("metric"), col("value"), col("position")),
        (
            "Data Reliability Checklist", checklist, col("check"),
            F.concat_ws(": ", "status", "detail"), col("position"),
        ),
    ]
    if results:
        lines = fd.statistic_lines(stats_long(results))
        sections.append(("Statistical Analyses", lines, col("label"), col("text"), F.lit(0)))
    if "correlation_analysis" in results:
        matrix = results["correlation_analysis"]
        pair = F.concat_ws(" / ", "left_column", "right_column")
        strength = F.concat_ws(" ", F.format_number("r", 3), "strength")
        sections += [
            (
                "Relationship Analysis", fd.relationship_strength(matrix), pair, strength,
                F.lit(0),
            ),
            ("Driver Ranking", fd.driver_ranking(matrix), col("column"), col("stars"), col("rank")),
        ]
    sections += [
        ("Alerts", fd.alerts(facts), col("code"), col("text"), col("position")),
        (
            "Recommendations", fd.recommendations(facts, results),
            col("code"), col("text"), col("position"),
        ),
    ]
    if chart_log is not None:
        sections.append(("Charts", chart_log, col("chart_type"), col("reason"), col("chart_no")))
    sections.append(
        ("Conclusion", fd.health_status(facts), col("label"), col("value"), col("position"))
    )
    parts = None
    for number, (name, frame, label, value, position) in enumerate(sections, 1):
        part = fd.report_section(name, number, frame, label, value, position)
        parts = part if parts is None else parts.unionByName(part)
    return parts
