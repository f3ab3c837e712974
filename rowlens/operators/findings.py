"""Findings, key figures, alerts and recommendations derived from result tables.

All inputs are small result tables (one row per column or pair); nothing here reads the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowlens.functions.numbers import display_number, fixed, title_label
from rowlens.functions.statistics import confidence_band, correlation_strength
from rowlens.operators.quality import score_text
from rowlens.session import beside

RELATIONSHIPS_SHOWN = 8
DRIVERS_SHOWN = 6
FINDINGS_SHOWN, ALERTS_SHOWN = 4, 4
RECOMMENDATIONS_SHOWN = 5
NOTHING_STRONG = "N/A"
STABLE = "Nothing in the results stands out."
STAY = "The figures call for no action; keep watching them."
FACTS_SCHEMA = {
    "health_score": "double", "missing_percent": "double", "missing_cells": "bigint",
    "duplicate_rows": "bigint", "row_count": "bigint", "column_count": "bigint",
    "total_outliers": "bigint", "left_column": "string", "right_column": "string", "r": "double",
    "best_trend": "string", "best_change": "double", "first_trend": "string",
    "first_change": "double",
}


def strongest_pair(matrix: DataFrame) -> DataFrame:
    """The pair of different columns with the largest absolute correlation, first in table order."""
    pairs = matrix.where("left_pos < right_pos AND r IS NOT NULL")
    order = F.struct(F.abs("r"), -F.col("left_pos"), -F.col("right_pos"))
    best = F.max_by(F.struct("left_column", "right_column", "r"), order)
    return pairs.agg(best.alias("best")).where("best IS NOT NULL").select("best.*")


def total_outliers(outliers: DataFrame) -> DataFrame:
    return outliers.agg(
        F.coalesce(F.sum("outlier_count"), F.lit(0)).cast("bigint").alias("total_outliers")
    )


def _trend_facts(trend: DataFrame) -> DataFrame:
    largest = F.struct(F.abs("percent_change"), -F.col("position"))
    return trend.agg(
        F.max_by("column", largest).alias("best_trend"),
        F.max_by("percent_change", largest).alias("best_change"),
        F.min_by("column", "position").alias("first_trend"),
        F.min_by("percent_change", "position").alias("first_change"),
    )


def finding_facts(report: DataFrame, results: dict[str, DataFrame]) -> DataFrame:
    """One row with everything the findings are made of; what was not analysed is null."""
    parts = [
        report.select(
            "health_score", "missing_percent", "missing_cells", "duplicate_rows", "row_count",
            "column_count",
        )
    ]
    if "outlier_detection" in results:
        parts.append(total_outliers(results["outlier_detection"]))
    if "correlation_analysis" in results:
        parts.append(strongest_pair(results["correlation_analysis"]))
    if "trend_analysis" in results:
        parts.append(_trend_facts(results["trend_analysis"]))
    row = beside(*parts)
    return row.select(
        *[
            (F.col(n) if n in row.columns else F.lit(None)).cast(t).alias(n)
            for n, t in FACTS_SCHEMA.items()
        ]
    )


def _outliers() -> Column:
    return F.coalesce("total_outliers", F.lit(0))


def business_health_value() -> Column:
    score = F.col("health_score") - F.least(_outliers() * 2, F.lit(15))
    return F.greatest(F.lit(0), F.least(F.lit(100), score.cast("int")))


def business_health(facts: DataFrame) -> DataFrame:
    """Health score less two points per outlier, at most 15, as a whole number."""
    return facts.select(business_health_value().alias("business_health"))


def _driver() -> Column:
    return F.coalesce(title_label(F.col("left_column")), F.lit(NOTHING_STRONG))


def _rows(*pairs: tuple[str, Column]) -> Column:
    return F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("position"), F.lit(label).alias("label"), value.alias("value")
                )
                for i, (label, value) in enumerate(pairs, 1)
            ]
        )
    )


def health_status(facts: DataFrame, top_risk: str | None = None) -> DataFrame:
    score = business_health_value()
    status = (
        F.when(score >= 80, "Healthy").when(score >= 60, "Needs Attention").otherwise("At Risk")
    )
    return facts.select(
        _rows(
            ("Business Status", status),
            ("Primary Driver", _driver()),
            ("Top Risk", F.lit(top_risk or "None identified")),
            ("Overall Health Score", F.concat(score, F.lit("/100"))),
        )
    )


def kpi_cards(facts: DataFrame) -> DataFrame:
    return facts.select(
        _rows(
            ("Business Health", F.concat(business_health_value(), F.lit("/100"))),
            ("Data Reliability", F.concat(fixed(F.col("health_score"), 0), F.lit("%"))),
            ("Strongest Predictor", _driver()),
            ("Outliers Detected", _outliers().cast("string")),
        )
    )


def relationship_strength(matrix: DataFrame) -> DataFrame:
    """The eight strongest unordered pairs."""
    return (
        matrix.where("left_pos < right_pos AND r IS NOT NULL")
        .orderBy(F.desc(F.abs("r")), "left_pos", "right_pos")
        .limit(RELATIONSHIPS_SHOWN)
        .select("left_column", "right_column", "r", correlation_strength(F.col("r")).alias("strength"))
    )


def driver_ranking(matrix: DataFrame) -> DataFrame:
    """Columns by mean absolute correlation with all others, with one to five stars."""
    mean = (
        matrix.where("left_pos <> right_pos AND r IS NOT NULL")
        .groupBy("left_pos", F.col("left_column").alias("column"))
        .agg(F.avg(F.abs("r")).alias("mean_strength"))
        .orderBy(F.desc("mean_strength"), "left_pos")
        .limit(DRIVERS_SHOWN)
    )
    rank = F.row_number().over(W.orderBy(F.desc("mean_strength"), "left_pos"))
    stars = F.greatest(F.lit(1), F.bround(F.col("mean_strength") * 5).cast("int"))
    return mean.select(rank.alias("rank"), "column", "mean_strength", stars.alias("stars"))


def confidence_bands(matrix: DataFrame) -> DataFrame:
    return matrix.where("left_pos < right_pos AND r IS NOT NULL").select(
        "left_column", "right_column", "r", confidence_band(F.col("r")).alias("confidence")
    )


def _change(c: Column) -> Column:
    return F.concat(fixed(F.abs(c), 1, False), F.lit("%"))


def _numbered(rows: DataFrame, keep: int) -> DataFrame:
    """Give the first ``keep`` rows by (priority, place) their final position."""
    order = W.orderBy("priority", "place")
    return (
        rows.orderBy("priority", "place")
        .limit(keep)
        .select(F.row_number().over(order).alias("position"), "code", "text")
    )


def _rules(facts: DataFrame, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """(priority, place, code, text) for every rule whose condition holds."""
    return facts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("priority"),
                        F.lit(0).alias("place"),
                        F.lit(code).alias("code"),
                        F.when(holds, text).alias("text"),
                    )
                    for i, (code, holds, text) in enumerate(rules)
                ]
            )
        )
    ).where("text IS NOT NULL")


def key_findings(facts: DataFrame, insights: DataFrame | None = None) -> DataFrame:
    """Up to four findings in fixed order of importance."""
    score, shown = F.col("health_score"), score_text(F.col("health_score"))
    quality = (
        F.when(
            score >= 95,
            F.concat(
                F.lit("Quality score "), shown, F.lit(" of 100: the results rest on solid data."),
            ),
        )
        .when(
            score >= 85,
            F.concat(
                F.lit("Quality score "), shown, F.lit(" of 100: usable, some cleaning would help."),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("Quality score "), shown,
                F.lit(" of 100: look at the data before relying on results."),
            )
        )
    )
    rules = [
        (
            "trend",
            F.col("best_change").isNotNull(),
            F.concat(
                title_label(F.col("best_trend")),
                F.when(F.col("best_change") >= 0, " went up by ").otherwise(" went down by "),
                _change(F.col("best_change")),
                F.lit(" between the first and the last date."),
            ),
        ),
        (
            "correlation",
            F.col("r").isNotNull(),
            F.concat(
                F.lit("Closest pair: "), title_label(F.col("left_column")), F.lit(" and "),
                title_label(F.col("right_column")), F.lit(", r = "), fixed(F.col("r"), 2),
            ),
        ),
        (
            "outliers",
            _outliers() > 0,
            F.concat(
                _outliers().cast("string"), F.lit(" value(s) lie far from the rest of their column."),
            ),
        ),
        ("quality", score.isNotNull(), quality),
    ]
    rows = _rules(facts, rules)
    if insights is not None:
        first = insights.orderBy("position").limit(1).select(
            F.lit(len(rules)).alias("priority"),
            F.lit(0).alias("place"),
            F.lit("insight").alias("code"),
            F.concat(F.lit("First insight: "), F.col("text")).alias("text"),
        )
        rows = rows.unionByName(first)
    return _numbered(_or_else(rows, facts, FINDINGS_SHOWN, "stable", STABLE), FINDINGS_SHOWN)


def _or_else(rows: DataFrame, facts: DataFrame, keep: int, code: str, text: str) -> DataFrame:
    """The first ``keep`` rows, or a closing statement where there are none.

    The limit comes first, task by task, so the window below sees a handful of rows.
    """
    rows = rows.orderBy("priority", "place").limit(keep)
    closing = facts.select(
        F.lit(1000).alias("priority"),
        F.lit(0).alias("place"),
        F.lit(code).alias("code"),
        F.lit(text).alias("text"),
    )
    both = rows.unionByName(closing)
    anything = F.min("priority").over(W.partitionBy()) < 1000
    return (
        both.withColumn("anything", anything)
        .where("priority < 1000 OR NOT anything")
        .drop("anything")
    )


def recommendations(facts: DataFrame, results: dict[str, DataFrame]) -> DataFrame:
    """Up to five recommendations: trends, outliers, strong pairs, data quality."""
    score = F.col("health_score")
    rows = _rules(
        facts,
        [
            (
                "quality",
                score < 90,
                F.lit("Check new data as it comes in: the quality score is below 90."),
            )
        ],
    ).withColumn("priority", F.lit(3))
    spaced = F.replace(F.col("column"), F.lit("_"), F.lit(" "))
    if "trend_analysis" in results:
        change = F.col("percent_change")
        text = F.when(
            change < 0,
            F.concat(
                F.lit("Find out why "), title_label(F.col("column")), F.lit(" fell by "),
                _change(change), F.lit("."),
            ),
        ).when(
            change > 20,
            F.concat(
                title_label(F.col("column")), F.lit(" rose by "), _change(change),
                F.lit(": see what it depends on."),
            ),
        )
        rows = rows.unionByName(
            results["trend_analysis"].select(
                F.lit(0).alias("priority"), F.col("position").alias("place"),
                F.lit("trend").alias("code"), text.alias("text"),
            )
        )
    if "outlier_detection" in results:
        text = F.when(
            F.col("outlier_count") > 0,
            F.concat(
                F.lit("Look at "), F.col("outlier_count"), F.lit(" unusual value(s) of "), spaced,
                F.lit(" before using them."),
            ),
        )
        rows = rows.unionByName(
            results["outlier_detection"].select(
                F.lit(1).alias("priority"), F.col("position").alias("place"),
                F.lit("outliers").alias("code"), text.alias("text"),
            )
        )
    if "correlation_analysis" in results:
        text = F.when(
            F.abs("r") > 0.7,
            F.concat(
                F.replace(F.col("left_column"), F.lit("_"), F.lit(" ")), F.lit(" and "),
                F.replace(F.col("right_column"), F.lit("_"), F.lit(" ")),
                F.lit(" tell much the same (r = "), fixed(F.col("r"), 2), F.lit(")."),
            ),
        )
        rows = rows.unionByName(
            results["correlation_analysis"]
            .where("left_pos < right_pos")
            .select(
                F.lit(2).alias("priority"),
                (F.col("left_pos") * 100_000 + F.col("right_pos")).alias("place"),
                F.lit("correlation").alias("code"), text.alias("text"),
            )
        )
    rows = rows.where("text IS NOT NULL")
    return _numbered(_or_else(rows, facts, RECOMMENDATIONS_SHOWN, "stay", STAY), RECOMMENDATIONS_SHOWN)


def alerts(facts: DataFrame) -> DataFrame:
    score = F.col("health_score")
    rows = _rules(
        facts,
        [
            (
                "POSITIVE",
                (score == 100) & (F.col("missing_cells") == 0),
                F.lit("Full quality score, every cell filled"),
            ),
            (
                "CRITICAL",
                score < 70,
                F.concat(
                    F.lit("Quality score "), score_text(score),
                    F.lit(" of 100: look at how the data is collected"),
                ),
            ),
            (
                "WARNING",
                _outliers() > 0,
                F.concat(_outliers(), F.lit(" unusual value(s) in the measures")),
            ),
        ],
    )
    text = "No alert"
    return _numbered(_or_else(rows, facts, ALERTS_SHOWN, "INFO", text), ALERTS_SHOWN)


def executive_snapshot(facts: DataFrame, plan_summary: str | None = None) -> DataFrame:
    """The few facts at the top of a report, with why each matters."""
    rows = [
        (
            "Dataset size",
            F.concat(F.col("row_count"), F.lit(" rows x "), F.col("column_count"), F.lit(" columns")),
            F.lit("How much the results rest on"),
        ),
        (
            "Data health",
            F.concat(score_text(F.col("health_score")), F.lit(" / 100")),
            F.lit("How far the source can be trusted"),
        ),
        (
            "Primary trend",
            F.concat(
                title_label(F.col("first_trend")), F.lit(" "),
                fixed(F.col("first_change"), 1, False), F.lit("%"),
            ),
            F.lit("Where the first measure is heading"),
        ),
        (
            "Plan summary",
            F.when(F.lit(bool(plan_summary)), "As planned"),
            F.lit(plan_summary),
        ),
    ]
    return facts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("position"),
                        F.lit(dimension).alias("dimension"),
                        value.alias("value"),
                        why.cast("string").alias("why"),
                    )
                    for i, (dimension, value, why) in enumerate(rows, 1)
                ]
            )
        )
    ).where("value IS NOT NULL")


def report_section(name: str, number: int, frame: DataFrame, label: Column, value: Column,
                   position: Column) -> DataFrame:
    return frame.select(
        F.lit(number).alias("section_no"),
        F.lit(name).alias("section"),
        position.cast("int").alias("position"),
        label.cast("string").alias("label"),
        value.cast("string").alias("value"),
    )


def statistic_lines(stats: DataFrame) -> DataFrame:
    """Melted statistics with their display text; changes show direction and one decimal."""
    arrow = F.when(F.col("value") >= 0, "▲ ").otherwise("▼ ")
    text = F.when(
        F.col("metric") == "percent_change", F.concat(arrow, _change(F.col("value")))
    ).otherwise(display_number(F.col("value")))
    metric = F.replace(F.col("metric"), F.lit("_"), F.lit(" "))
    label = F.concat(title_label(F.col("column")), F.lit(" ("), metric, F.lit(")"))
    return stats.select("analysis", "column", "metric", label.alias("label"), text.alias("text"))
