"""Insight texts and the review rules on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowlens.functions.numbers import display_number, fixed, title_label
from rowlens.operators.findings import strongest_pair

# How often a run may be sent back, how many insights may share a source, and the
# number of insights wanted.
MAX_REVISIONS = 2
INSIGHTS_PER_SOURCE = 2
FEWEST_INSIGHTS, MOST_INSIGHTS = 3, 6


def cap_per_source(
    insights: DataFrame, source: list[str], order: list[str], keep: int = INSIGHTS_PER_SOURCE
) -> DataFrame:
    """The first ``keep`` rows of each source.

    Spark cuts every task's share of a source to ``keep`` rows before the shuffle, so a source
    that holds most rows stays cheap.
    """
    place = F.row_number().over(W.partitionBy(*source).orderBy(*order))
    return insights.withColumn("__place", place).where(F.col("__place") <= keep).drop("__place")


def grounded_text(insights: DataFrame, text: str = "text") -> DataFrame:
    """Only texts that contain a digit."""
    return insights.where(F.col(text).rlike("[0-9]"))


def _candidates(frame: DataFrame, source: str, order: Column, text: Column) -> DataFrame:
    """The two leading statements of one analysis."""
    rank = F.row_number().over(W.orderBy(order))
    top = frame.orderBy(order).limit(INSIGHTS_PER_SOURCE)
    return top.select(F.lit(source).alias("source_analysis"), rank.alias("rank"), text.alias("text"))


def _sentences(results: dict[str, DataFrame], measure: str | None, category: str | None):
    def shown(name: str) -> Column:
        return display_number(F.col(name))

    def named(name: str) -> Column:
        return title_label(F.col(name))

    def sentence(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    if "descriptive_stats" in results:
        yield _candidates(
            results["descriptive_stats"], "descriptive_stats", F.col("position").asc(),
            sentence(
                named("column"), " averages ", shown("mean"), " over ", shown("count"),
                " records and ranges from ", shown("min"), " to ", shown("max"), ".",
            ),
        )
    if "correlation_analysis" in results:
        pair = strongest_pair(results["correlation_analysis"])
        yield _candidates(
            pair, "correlation_analysis", F.desc(F.abs("r")),
            sentence(
                named("left_column"), " and ", named("right_column"), " have a correlation of ",
                fixed(F.col("r"), 2), ".",
            ),
        )
    if "trend_analysis" in results:
        direction = F.when(F.col("percent_change") >= 0, " rose by ").otherwise(" fell by ")
        yield _candidates(
            results["trend_analysis"], "trend_analysis", F.col("position").asc(),
            sentence(
                named("column"), direction, fixed(F.abs("percent_change"), 1, False),
                "% from ", shown("first_value"), " to ", shown("last_value"), ".",
            ),
        )
    if "outlier_detection" in results:
        found = results["outlier_detection"].orderBy(F.desc("outlier_count"), "position").limit(2)
        yield _candidates(
            found, "outlier_detection",
            F.struct(-F.col("outlier_count"), F.col("position")).asc(),
            sentence(
                named("column"), " has ", shown("outlier_count"), " values outside ",
                shown("lower_bound"), " to ", shown("upper_bound"), ".",
            ),
        )
    if "value_counts_analysis" in results:
        tops = results["value_counts_analysis"].where("rank = 1")
        yield _candidates(
            tops, "value_counts_analysis", F.struct(-F.col("n"), F.col("column")).asc(),
            sentence(
                F.col("value"), " is the most frequent ", named("column"), " with ", shown("n"),
                " records.",
            ),
        )
    if "grouped_summary_analysis" in results:
        yield _candidates(
            results["grouped_summary_analysis"], "grouped_summary_analysis",
            F.struct(-F.col("total"), F.col("group")).asc(),
            sentence(
                F.col("group"), " ranks ", F.col("rank"), " among ",
                title_label(F.lit(category or "group")), " values with a total ",
                title_label(F.lit(measure or "value")), " of ", shown("total"), " over ",
                shown("count"), " records.",
            ),
        )


def template_insights(
    results: dict[str, DataFrame], measure: str | None = None, category: str | None = None
) -> DataFrame:
    """One numeric statement per analysis with results; a second one only to reach three."""
    parts = None
    for order, part in enumerate(_sentences(results, measure, category)):
        part = part.withColumn("source_no", F.lit(order))
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        raise ValueError("no results to describe")
    texts = grounded_text(cap_per_source(parts, ["source_analysis"], ["rank"]))
    numbered = texts.withColumn(
        "position", F.row_number().over(W.orderBy("rank", "source_no"))
    )
    wanted = (F.col("rank") == 1) | (F.col("position") <= FEWEST_INSIGHTS)
    return numbered.where(wanted & (F.col("position") <= MOST_INSIGHTS)).select(
        "position", "source_analysis", "text"
    )


def analysis_coverage(expected: DataFrame, produced: DataFrame) -> DataFrame:
    """Expected analyses without a result; ``produced`` has a status per analysis."""
    done = produced.where("status = 'done'").select("analysis")
    return expected.select("analysis").join(done, "analysis", "left_anti")


def review_decision(rounds: DataFrame) -> DataFrame:
    """(run, round, approved, decision) from review rounds (run, round, approved, missing).

    A run is sent back at most twice, and not again if the same analyses are asked for as in the
    round before. Several rows of one round are one round: approved if one of them is, and asking for
    all that any of them asks for. The round before is found by an equi-join on run and round, so a run
    with very many rounds is spread over tasks.
    """
    none = F.array().cast("array<string>")
    rounds = rounds.groupBy("run", "round").agg(
        F.max(F.coalesce("approved", F.lit(False))).alias("approved"),
        F.array_sort(
            F.array_distinct(F.flatten(F.collect_set(F.coalesce("missing", none))))
        ).alias("missing"),
    )
    before = rounds.select(
        "run", (F.col("round") + 1).alias("round"), F.col("missing").alias("missing_before")
    )
    decision = (
        F.when(F.col("round") >= MAX_REVISIONS, "revision limit")
        .when(F.col("approved"), "approved")
        .when(
            (F.col("round") > 0)
            & (F.col("missing") == F.coalesce("missing_before", F.array().cast("array<string>"))),
            "repeated feedback",
        )
        .otherwise("needs revision")
    )
    return rounds.join(before, ["run", "round"], "left").select(
        "run",
        "round",
        (decision != "needs revision").alias("approved"),
        decision.alias("decision"),
        F.when(decision == "needs revision", F.array_join("missing", ",")).alias("missing"),
    )
