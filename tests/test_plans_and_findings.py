from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rowlens.functions.numbers import compact_number, display_number, title_label
from rowlens.operators import findings, review
from rowlens.operators.responses import normalize_json_responses
from rowlens.operators.roles import Roles
from rowlens.plans.analyze import analyze
from rowlens.plans.rules import (
    Chart,
    Plan,
    TableFacts,
    auto_charts,
    choose_analyses,
    guard_plan,
    propose_plan,
    with_auto_charts,
)
from rowlens.session import beside, pin, small_table

FACTS = TableFacts(
    100, Roles(numeric=["a", "b"], categorical=["name", "group"], datetime=["day"]),
    {"name": 100, "group": 4},
)


def test_all_analyses_for_a_rich_table():
    assert [s for _, s, _ in choose_analyses(FACTS)] == [True] * 6


def test_guard_adds_what_is_missing():
    plan = guard_plan(Plan(("correlation_analysis", "grouped_summary_analysis")), FACTS)
    assert plan.analyses[0] == "trend_analysis"
    assert [c.chart_type for c in plan.charts] == ["line", "bar", "histogram", "correlation_heatmap"]
    assert plan.charts[1].columns == ("group",) and plan.charts[3].columns == ("a", "b")


def test_guard_drops_pointless_bars_and_cuts_nothing():
    bars = (Chart("bar", ("a",), "measure"), Chart("bar", ("name",), "names"))
    plan = guard_plan(Plan(("descriptive_stats",), bars + (Chart("scatter", ("a", "b"), "s"),) * 9), FACTS)
    assert all(c.chart_type != "bar" for c in plan.charts)
    assert len(plan.charts) == 11 and plan.wanted_charts == 4


def test_guard_without_measures():
    facts = TableFacts(10, Roles(categorical=["t"]), {"t": 3})
    plan = guard_plan(Plan(("descriptive_stats",), (Chart("histogram", ("t",), ""),)), facts)
    assert plan.analyses == ("value_counts_analysis",) and plan.charts == ()


def test_auto_charts_fill_short_plans(spark):
    df = spark.createDataFrame([("a", "x", 1.0, 2.0), ("b", "y", 2.0, 5.0)], "g string, h string, sales double, w double")
    assert [c.chart_type for c in auto_charts(df)] == ["pareto_bar", "stacked_bar", "quantile_hist", "correlation_heatmap"]
    full = (Chart("line", (), ""),) * 4
    assert with_auto_charts(df, full) == full
    one = df.drop("w")
    assert auto_charts(one)[-1].columns == ("h", "sales")


def test_numbers_as_text(spark):
    values = [1.23e9, 4.5e6, 7800.0, 1250.0, 999.0, 0.25, -2e6, 2.675]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = {r[0]: (r[1], r[2]) for r in df.select("v", compact_number(F.col("v")), display_number(F.col("v"))).collect()}
    assert found == {
        1.23e9: ("1.23B", "1,230,000,000"), 4.5e6: ("4.50M", "4,500,000"), 7800.0: ("7.8K", "7,800"),
        1250.0: ("1.2K", "1,250"), 999.0: ("999", "999"), 0.25: ("0.25", "0.25"),
        -2e6: ("-2.00M", "-2,000,000"), 2.675: ("2.67", "2.675"),
    }
    names = spark.createDataFrame([("unit_price",), ("q1sales",), ("TOTAL cost",)], "n string")
    assert rows(names.select(title_label(F.col("n")))) == [("Q1Sales",), ("Total Cost",), ("Unit Price",)]


@pytest.fixture(scope="module")
def facts(spark):
    return small_table(
        spark,
        [(97.5, 0.0, 0, 0, 100, 5, 2, "revenue", "units", 0.83, "revenue", 45.0, "revenue", 45.0)],
        ", ".join(f"{n} {t}" for n, t in findings.FACTS_SCHEMA.items()),
    )


@pytest.fixture(scope="module")
def results(spark):
    trend = small_table(spark, [(0, "revenue", 45.0), (1, "net_cost", -5.0), (2, "flat", 3.0)], "position int, column string, percent_change double")
    outliers = small_table(spark, [(0, "revenue", 0), (1, "net_cost", 2)], "position int, column string, outlier_count bigint")
    pairs = small_table(
        spark, [(0, 1, "revenue", "net_cost", 0.83), (0, 2, "revenue", "flat", -0.75), (1, 2, "net_cost", "flat", 0.1)],
        "left_pos int, right_pos int, left_column string, right_column string, r double",
    )
    return {"trend_analysis": trend, "outlier_detection": outliers, "correlation_analysis": pairs}


def test_health(facts):
    assert findings.business_health(facts).first()[0] == 93
    assert findings.health_status(facts).orderBy("position").first()["value"] == "Healthy"
    many = facts.withColumn("total_outliers", F.lit(50).cast("bigint"))
    assert findings.business_health(many).first()[0] == 82
    assert [r["value"] for r in findings.kpi_cards(facts).orderBy("position").collect()] == ["93/100", "98%", "Revenue", "2"]


def test_key_findings_keep_four(spark, facts):
    insights = small_table(spark, [(1, "s", "Sold 5.")], "position int, source string, text string")
    found = findings.key_findings(facts, insights).orderBy("position").collect()
    assert [r["code"] for r in found] == ["trend", "correlation", "outliers", "quality"]
    assert found[0]["text"] == "Revenue went up by 45.0% between the first and the last date."
    assert found[3]["text"] == "Quality score 97.5 of 100: the results rest on solid data."


def test_recommendations(facts, results):
    found = findings.recommendations(facts, results).orderBy("position").collect()
    assert [r["code"] for r in found] == ["trend", "trend", "outliers", "correlation", "correlation"]
    assert found[1]["text"] == "Find out why Net Cost fell by 5.0%."
    assert "(r = -0.75)" in found[4]["text"]
    assert findings.recommendations(facts, {}).first()["code"] == "stay"


def test_alerts(facts):
    assert [r["code"] for r in findings.alerts(facts).collect()] == ["WARNING"]
    bad = facts.withColumn("health_score", F.lit(50.0))
    assert [r["code"] for r in findings.alerts(bad).orderBy("position").collect()] == ["CRITICAL", "WARNING"]
    calm = facts.withColumn("total_outliers", F.lit(None).cast("bigint"))
    assert [r["code"] for r in findings.alerts(calm).collect()] == ["INFO"]


def test_rankings(results):
    matrix = results["correlation_analysis"]
    both = matrix.unionByName(matrix.select(F.col("right_pos").alias("left_pos"), F.col("left_pos").alias("right_pos"), F.col("right_column").alias("left_column"), F.col("left_column").alias("right_column"), "r"))
    assert [(r["column"], r["stars"]) for r in findings.driver_ranking(both).orderBy("rank").collect()] == [("revenue", 4), ("net_cost", 2), ("flat", 2)]
    assert [r["strength"] for r in findings.relationship_strength(both).collect()] == ["Strong", "Strong", "Weak"]
    assert findings.strongest_pair(both).first()["left_column"] == "revenue"
    assert findings.strongest_pair(both.where("r > 5")).count() == 0


def test_cap_per_source_with_a_hot_source(spark):
    hot = spark.range(20_000).select(F.lit("hot").alias("s"), F.col("id").alias("p"))
    cold = spark.range(20_000).select(F.col("id").cast("string").alias("s"), F.lit(0).alias("p"))
    capped = review.cap_per_source(hot.unionByName(cold), ["s"], ["p"])
    assert capped.count() == 20_002
    assert rows(capped.where("s = 'hot'"), "p") == [(0,), (1,)]
    plan = capped._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before and after the shuffle


def test_review_rounds(spark):
    data = [
        ("a", 0, False, ["x", "y"]), ("a", 1, False, ["y", "x", "x"]), ("b", 0, False, ["x"]), ("b", 1, False, ["z"]),
        ("b", 2, False, ["q"]), ("c", 0, True, []), ("d", 0, False, []),
    ]
    found = review.review_decision(spark.createDataFrame(data, "run string, round int, approved boolean, missing array<string>"))
    assert rows(found, "run", "round", "decision") == [
        ("a", 0, "needs revision"), ("a", 1, "repeated feedback"), ("b", 0, "needs revision"),
        ("b", 1, "needs revision"), ("b", 2, "revision limit"), ("c", 0, "approved"), ("d", 0, "needs revision"),
    ]


def test_responses(spark):
    texts = [
        '```json\n{"business_story": "s", "opportunities": ["' + "x" * 70 + '", {"title": "t"}, 3], "risks": [], "column_intelligence": [{"importance": "i"}, "no"]}\n```',
        '  {"business_story": "s", "risks": ["{not json"]}  ', "plain words", "[1, 2]", None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string")
    found = {r["k"]: r.asDict(True) for r in normalize_json_responses(df).collect()}
    first = found[0]
    assert first["opportunities"][0]["title"] == "x" * 60 and first["opportunities"][0]["confidence"] == "Medium"
    assert first["opportunities"][1] == {"title": "t", "recommendation": None, "expected_impact": None, "confidence": None}
    assert len(first["opportunities"]) == 2 and first["valid"] is False
    assert first["column_intelligence"] == [{"column": "Unknown", "purpose": "i", "business_interpretation": "Not specified.", "risk_note": "None identified."}]
    assert found[1]["valid"] and found[1]["risks"][0]["description"] == "{not json"
    assert not any(found[i]["valid"] for i in (2, 3, 4)) and found[3]["risks"] is None


def test_small_result_helpers(spark):
    one = spark.range(1).selectExpr("1 as a", "array('x') as l")
    other = spark.range(1).selectExpr("'t' as b", "true as f")
    assert rows(beside(one, other)) == [(1, ["x"], "t", True)]
    lazy = spark.range(50)
    assert pin(lazy, 10).inputFiles() and pin(lazy, 10).count() == 50 and pin(lazy).count() == 50


def test_whole_run(spark):
    start = datetime(2024, 1, 1)
    data = [(i, f"c{i % 3}", "abc"[i % 3] if i % 9 else None, float(i * i), f"${i},000" if i else None, start + timedelta(days=i)) for i in range(120)]
    df = spark.createDataFrame(data + data[:6], "row_id int, kind string, grade string, revenue double, price string, sold_on timestamp_ntz")
    done = analyze(df)
    assert done.cleaned.duplicates_removed == 6 and done.profile.row_count == 120
    assert done.profile.roles.identifier == ["row_id"] and done.profile.roles.numeric == ["revenue", "price"]
    assert set(done.results) == {
        "descriptive_stats", "correlation_analysis", "trend_analysis", "outlier_detection",
        "value_counts_analysis", "grouped_summary_analysis",
    }
    assert done.missing_analyses.count() == 0
    assert rows(done.chart_log.where("status <> 'done'")) == []
    sections = {r["section"] for r in done.report.select("section").distinct().collect()}
    assert {"Key Figures", "Key Findings", "Alerts", "Recommendations", "Conclusion"} <= sections
    assert done.cleaned.table.where("grade = 'Unknown'").count() == 14
    assert all(frame.count() > 0 for frame in done.tables().values())


def test_whole_run_on_edges(spark):
    texts = analyze(spark.createDataFrame([("a", "b")], "name string, note string"))
    assert texts.plan.analyses == ("value_counts_analysis",)
    one = analyze(spark.createDataFrame([("a", 2.5, datetime(2024, 1, 1))], "name string, v double, day timestamp_ntz"))
    assert "descriptive_stats" in one.results
    with pytest.raises(ValueError):
        analyze(spark.createDataFrame([], "a int"))


def test_plan_without_categories():
    plan = propose_plan(TableFacts(5, Roles(numeric=["v"])))
    assert plan.analyses == ("descriptive_stats", "outlier_detection")
    assert [c.chart_type for c in plan.charts] == ["histogram"]


def test_repeated_rounds_count_once(spark):
    rounds = [("r", 0, False, ["b"]), ("r", 0, False, ["a", "b"]), ("r", 0, None, None), ("r", 1, False, ["a", "b"]),
              ("r", 1, False, ["b", "a"]), ("s", 0, False, ["a"]), ("s", 0, True, [])]
    df = spark.createDataFrame(rounds, "run string, round int, approved boolean, missing array<string>")
    assert rows(review.review_decision(df), "run", "round", "decision", "missing") == [
        ("r", 0, "needs revision", "a,b"), ("r", 1, "repeated feedback", None), ("s", 0, "approved", None),
    ]


def test_whole_run_groups_by_the_planned_category(spark):
    data = [(f"text {k}", "ab"[k % 2], 1.5 * k) for k in range(30)]
    run = analyze(spark.createDataFrame(data, "text string, lang string, size double"))
    assert run.plan.group_by == "lang"
    assert sorted(r["group"] for r in run.results["grouped_summary_analysis"].collect()) == ["a", "b"]
    assert any("Lang" in r["text"] for r in run.insights.collect())
