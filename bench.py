"""Time the headline queries; prints one JSON line.

Each query is built and run to the end once, after one query that starts up the session.
BENCH_SF_DIR names the tables, BENCH_CPUS the number of threads, BENCH_QUERIES (comma-separated
names, or "all") overrides the choice.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from rowlens.catalog import QUERIES  # noqa: E402
from rowlens.session import build_session, clear_scratch  # noqa: E402

HEADLINE = (
    "load_csv", "validation_report", "duplicate_rows", "clean", "drop_duplicates",
    "fill_numeric_median", "numeric_profile", "categorical_profile", "datetime_profile", "quantiles",
    "distinct_count", "top_values", "descriptive_stats", "correlation_matrix", "trend_change",
    "iqr_outliers", "outlier_rows", "value_counts", "grouped_summary", "time_series", "pareto_top10",
    "pivot_sum", "histogram_18", "scatter_points", "linear_trend", "run_charts", "review_decision",
    "cap_per_source", "normalize_json_responses", "key_findings",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if asked == "all" else asked.split(",") if asked else list(HEADLINE)
    spark = build_session(
        "rowlens-bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds = round(time.perf_counter() - start, 3)
        clear_scratch(spark)
        return seconds

    run("shape")
    seconds = {}
    for name in names:
        seconds[name] = run(name)
        if asked:
            print(f"{name:32} {seconds[name]:8.2f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
