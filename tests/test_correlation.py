"""Correlations of few and many columns against pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from rowlens.operators import correlation


@pytest.fixture(scope="module")
def frame():
    rng, n = np.random.default_rng(4), 3000
    base = rng.normal(size=n)
    columns = {f"c{k}": base * rng.normal() + rng.normal(size=n) * (1 + k % 5) for k in range(30)}
    columns["far"] = 1e9 + base * 1e-2
    columns["large"] = rng.normal(size=n) * 1e150
    columns["same"] = np.full(n, 0.1)
    columns["same in part"] = np.where(np.arange(n) % 2, 0.1, rng.normal(size=n))
    columns["odd.rows"] = np.where(np.arange(n) % 2, rng.normal(size=n), np.nan)
    columns["gaps"] = np.where(rng.random(n) < 0.4, np.nan, base + rng.normal(size=n))
    columns["none"] = np.full(n, np.nan)
    columns["endless"] = np.where(np.arange(n) == 17, np.inf, base)
    # Rising, so that tasks have different means.
    columns["rising"] = np.arange(n) * 10.0 + rng.normal(size=n)
    columns["falling"] = 1e6 - np.arange(n) * 3.0 + rng.normal(size=n)
    return pd.DataFrame(columns)


def expected(frame, a, b):
    pair = pd.DataFrame({"a": frame[a], "b": frame[b]}).dropna()
    if len(pair) < 2 or np.isinf(pair.to_numpy()).any() or (pair.nunique() < 2).any():
        return None
    scaled = (pair - pair.mean()) / pair.abs().max()
    return float(np.corrcoef(scaled["a"], scaled["b"])[0, 1])


@pytest.mark.parametrize(("native", "tile"), [(100, 256), (1, 256), (1, 7)])
def test_all_pairs(spark, frame, monkeypatch, native, tile):
    monkeypatch.setattr(correlation, "NATIVE_COLUMNS", native)
    monkeypatch.setattr(correlation, "TILE", tile)
    names = list(frame.columns) if native == 1 else [n for n in frame.columns if n[0] != "c"][:9] + ["c0", "c1"]
    df = spark.createDataFrame(frame[names]).repartition(5)
    found = correlation.correlation_pairs(df, names).collect()
    assert len(found) == len(names) * (len(names) + 1) // 2
    for row in found:
        want = expected(frame, row["left_column"], row["right_column"])
        if want is None:
            assert row["r"] is None, row
        else:
            # Nine of the sixteen digits of "far" do not vary.
            near = 1e-4 if "far" in (row["left_column"], row["right_column"]) else 1e-9
            assert row["r"] == pytest.approx(want, abs=near), row


def test_no_rows(spark, frame, monkeypatch):
    for native in (1, 100):
        monkeypatch.setattr(correlation, "NATIVE_COLUMNS", native)
        df = spark.createDataFrame(frame.head(1)).where("c0 > 1e300")
        assert [r["r"] for r in correlation.correlation_pairs(df, ["c0", "c1"]).collect()] == [None] * 3


def scans(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Range (")


def test_scans(spark, monkeypatch):
    """One scan for the pairs of a tile, few columns or many; no Python for few."""
    few = spark.range(50).selectExpr(*[f"id * {k + 1} % 7 as c{k}" for k in range(6)])
    calls = []
    whole = correlation._shifted_sums
    monkeypatch.setattr(correlation, "_shifted_sums", lambda *a: calls.append(1) or whole(*a))
    pairs = correlation.correlation_pairs(few, few.columns)
    assert len(calls) == 1 and scans(pairs) == 0
    off = spark.range(50).selectExpr("IF(id = 0, 1e7D, id * 1e-3D) a", "IF(id = 0, 0, id % 7) b")
    (r,) = [p["r"] for p in correlation.correlation_pairs(off, ["a", "b"]).where("left_pos < right_pos").collect()]
    frame = off.toPandas()
    assert r == pytest.approx(np.corrcoef(frame["a"], frame["b"])[0, 1], abs=1e-9)
    many = spark.range(50).selectExpr(*[f"id * {k + 1} % 7 as c{k}" for k in range(correlation.TILE)])
    assert scans(correlation.correlation_pairs(many, many.columns)) == 1


def test_wide_table_goes_by_tiles(spark):
    """600 columns: no task holds more than the moments of one tile, and reads two tiles of columns at most."""
    rng = np.random.default_rng(2)
    values = rng.normal(size=(40, 600)) + rng.normal(size=(40, 1))
    names = [f"c{k}" for k in range(600)]
    df = spark.createDataFrame(pd.DataFrame(values, columns=names)).repartition(2)
    for part in (range(0, 256), range(256, 512)):
        moments = correlation.pair_moments(df, names, range(0, 256), part)
        assert moments.groupBy("part").count().agg({"count": "max"}).first()[0] <= 256 * 256
    found = correlation.correlation_pairs(df, names).where("left_pos IN (3, 300) AND right_pos IN (3, 290, 300, 599)")
    want = np.corrcoef(values.T)
    for row in found.collect():
        assert row["r"] == pytest.approx(want[row["left_pos"], row["right_pos"]])
