"""Gap-free integer columns by bitmaps."""

from __future__ import annotations

from pyspark.sql import functions as F
from test_quantiles import jobs_of

from rowlens.operators.roles import find_roles, gap_free_sequences


def test_sequences_and_what_only_looks_like_one(spark):
    n = 100_000
    df = spark.range(n).repartition(5).select(
        (F.col("id") - 40_000).alias("falling below zero"),
        F.col("id").cast("int").alias("small"),
        # One value twice, one not at all: the range and the count are those of a sequence.
        F.when(F.col("id") == 77, 78).otherwise(F.col("id")).alias("twice"),
        F.when(F.col("id") == 32_769, 32_768).otherwise(F.col("id") + 2**40).alias("low outlier"),
        (F.col("id") + 9_007_199_254_740_993).alias("beyond doubles"),
        F.when(F.col("id") > 5, F.col("id")).alias("gaps"),
        (F.col("id") * 2).alias("doubled"),
        F.lit(3).alias("constant"),
    )
    assert gap_free_sequences(df, df.columns) == ["falling below zero", "small", "beyond doubles"]
    assert gap_free_sequences(df.limit(0), df.columns) == []
    one = spark.createDataFrame([(5, 2.5)], "n long, x double")
    assert gap_free_sequences(one, ["n", "x"]) == ["n"]


def test_one_job_for_all_candidates(spark):
    def table(columns):
        return spark.range(5000).select(*[((F.col("id") * 7 + k) % 5000).alias(f"c{k}") for k in range(columns)])

    few = jobs_of(spark, "one column", lambda: find_roles(table(1)))
    many = jobs_of(spark, "many columns", lambda: find_roles(table(30)))
    assert 0 < many <= few
    assert len(find_roles(table(30)).identifier) == 30
