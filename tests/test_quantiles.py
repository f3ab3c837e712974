"""Quantiles against pandas on data that is hard for bracketing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rowlens.operators import quantiles

PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.505, 0.75, 0.9, 1.0]


def assert_same(frame, df, names, probabilities):
    found = quantiles.exact_quantiles(df, names, probabilities)
    for name in names:
        values = frame[name].dropna()
        wanted = [values.quantile(p) if len(values) else None for p in probabilities]
        for got, want in zip(found[name], wanted):
            assert got == want or got == pytest.approx(want, rel=1e-12), (name, found[name], wanted)


@pytest.fixture(scope="module")
def hard():
    rng, n = np.random.default_rng(1), 60_000
    frame = pd.DataFrame(
        {
            "uniform": rng.random(n),
            "hot value": np.where(rng.random(n) < 0.5, 7.0, rng.normal(size=n) * 100),
            "third at the end": np.where(rng.random(n) < 0.34, 0.0, rng.random(n)),
            "heavy.tail": np.exp(rng.normal(size=n) * 30),
            "few": rng.integers(0, 5, n).astype(float),
            "constant": 3.0,
            "rounded": np.round(rng.normal(size=n), 1),
        }
    )
    frame["gaps"] = frame["uniform"].where(rng.random(n) < 0.3)
    frame["empty"] = np.nan
    return frame


def test_hard_columns(spark, hard):
    df = spark.createDataFrame(hard).repartition(8)
    assert_same(hard, df, list(hard.columns), PROBABILITIES)


def test_many_narrowing_rounds(spark, hard, monkeypatch):
    """Tiny sketches force misses, widening and repeated narrowing; the result stays exact."""
    monkeypatch.setattr(quantiles, "SKETCH_SIZE", 64)
    monkeypatch.setattr(quantiles, "SLACK", 0.01)
    monkeypatch.setattr(quantiles, "EXACT_VALUES", 4)
    names = ["uniform", "hot value", "third at the end", "heavy.tail", "gaps"]
    part = hard.head(5000)
    assert_same(part, spark.createDataFrame(part).repartition(4), names, [0.0, 0.3, 0.5, 1.0])


def test_small_and_empty(spark):
    df = spark.createDataFrame([(1.0,), (4.0,)], "x double")
    assert quantiles.exact_quantiles(df, ["x"], [0.25, 0.5]) == {"x": [1.75, 2.5]}
    nothing = df.where("x > 9")
    assert quantiles.exact_quantiles(nothing, ["x"], [0.5]) == {"x": [None]}
    assert quantiles.approximate_quantiles(nothing, ["x"], [0.5]) == {"x": [None]}
    assert quantiles.exact_quantiles(df, [], [0.5]) == {}


def test_approximate_is_close(spark, hard):
    df = spark.createDataFrame(hard[["uniform"]])
    (median,) = quantiles.approximate_quantiles(df, ["uniform"], [0.5])["uniform"]
    assert abs((hard["uniform"] <= median).mean() - 0.5) < 0.005


@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    values=st.lists(
        st.one_of(st.none(), st.floats(-1e6, 1e6), st.sampled_from([0.0, 1.0, -1.0])),
        min_size=1, max_size=60,
    ),
    probability=st.floats(0, 1),
)
def test_any_column(spark, values, probability):
    frame = pd.DataFrame({"x": pd.Series(values, dtype="float64")})
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = quantiles.exact_quantiles(df, ["x"], [probability])["x"][0]
    wanted = frame["x"].dropna().quantile(probability)
    assert (found is None and np.isnan(wanted)) or found == pytest.approx(wanted, rel=1e-9, abs=1e-9)


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
    finally:
        spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_scans_do_not_grow_with_columns_and_probabilities(spark, tmp_path):
    """A round counts and sketches all columns and probabilities together."""
    rng = np.random.default_rng(5)
    values = rng.random((20_000, 40))
    names = [f"c{k}" for k in range(40)]
    path = str(tmp_path / "wide")
    spark.createDataFrame(pd.DataFrame(values, columns=names)).write.parquet(path)
    df = spark.read.parquet(path)
    probabilities = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    found = {}
    few = jobs_of(spark, "few", lambda: quantiles.exact_quantiles(df, ["c0"], [0.5]))
    many = jobs_of(spark, "many", lambda: found.update(quantiles.exact_quantiles(df, names, probabilities)))
    assert 0 < many <= 2 * few
    for k in (0, 17, 39):
        assert found[f"c{k}"] == pytest.approx(list(np.quantile(values[:, k], probabilities)), rel=1e-12)
