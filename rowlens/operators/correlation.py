"""Correlations of all column pairs by centred moments that are merged, in one scan.

A few columns go through plain sums, taken from a value of each column so that no digits are lost. Many columns go through matrix products: each task centres by its first batch, keeps sums of
a tile of pairs, and hands centred moments on that are merged in the same way. Tables wider than a
tile are read tile by tile, only the columns of that tile, so no task holds the moments of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from rowlens.operators.quantiles import numeric_value
from rowlens.session import small_table

# Up to so many columns, pairs are rows of Spark's aggregate; above, matrix products are cheaper.
NATIVE_COLUMNS = 12
# Columns along the side of a tile of pairs.
TILE = 256
# Moments of all tasks are merged by this many groups before the last merge.
MERGE_GROUPS = 256
# A centred sum below this share of the sum it is taken from is rounding, not variation; likewise a
# distance of means below this share of a mean.
ROUNDING, LAST_DIGITS = 1e-12, 4e-15
# Below this share so many digits are lost that sums are taken again from the means.
LOST = 1e-5
# Rows looked at for a value of each column.
FIRST_ROWS = 1000
_MOMENTS = ("n", "mx", "my", "cxx", "cyy", "cxy", "unbounded")


def _shifted_sums(values: DataFrame, pairs: list[tuple[int, int]], shift: list[float]) -> dict[tuple[int, int], Row]:
    """Sums over the complete rows of each pair, taken from ``shift``: one scan of columns c0, c1, ..."""
    cells = [
        F.struct(
            F.lit(k).alias("pair"), (F.col(f"c{i}") - shift[i]).alias("x"), (F.col(f"c{j}") - shift[j]).alias("y")
        )
        for k, (i, j) in enumerate(pairs)
    ]
    x, y = F.col("x"), F.col("y")
    rows = values.select(F.inline(F.array(*cells))).where(x.isNotNull() & y.isNotNull())
    sums = rows.groupBy("pair").agg(
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"),
        F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"),
    )
    return {pairs[row["pair"]]: row for row in sums.collect()}


def _native_pairs(df: DataFrame, names: list[str]) -> DataFrame:
    """(left_pos, right_pos, r) by plain sums over rows of pairs, taken from a value of each column.

    Where that value proves to be so far off that digits are lost, all sums are taken once more from the means.
    """
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    values = df.select(*[numeric_value(n).alias(f"c{i}") for i, n in enumerate(names)])
    some = [F.first(F.when(F.abs(c) < math.inf, F.col(c)), ignorenulls=True).alias(c) for c in values.columns]
    shift = [v or 0.0 for v in values.limit(FIRST_ROWS).agg(*some).first()]
    sums = _shifted_sums(values, pairs, shift)
    if any(_far_off(*side) for row in sums.values() for side in _sides(row)):
        means = [sums.get((i, i)) for i in range(len(names))]
        shift = [s + row["sx"] / row["n"] if row and math.isfinite(row["sx"]) else s for s, row in zip(shift, means)]
        sums = _shifted_sums(values, pairs, shift)
    rows = []
    for (i, j), row in sums.items():
        spread = [max(square - total * total / n, 0.0) for n, total, square in _sides(row)]
        if all(math.isfinite(v) and v > ROUNDING * square for v, (_, _, square) in zip(spread, _sides(row))):
            shared = row["sxy"] - row["sx"] * row["sy"] / row["n"]
            rows.append((i, j, shared / math.sqrt(spread[0]) / math.sqrt(spread[1])))
    return small_table(df.sparkSession, rows, "left_pos int, right_pos int, r double")


def _sides(row: Row) -> list[tuple[int, float, float]]:
    """(n, sum, sum of squares) of both columns of a pair."""
    return [(row["n"], row["sx"], row["sxx"]), (row["n"], row["sy"], row["syy"])]


def _far_off(n: int, total: float, square: float) -> bool:
    """Whether nearly all of the squares are the distance to the mean, but not by rounding alone."""
    centred = square - total * total / n
    return ROUNDING * square < centred < LOST * square


def _centred(squares: np.ndarray, sums: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Centred squares, without what is only rounding."""
    value = squares - sums * sums / count
    return np.where(value > ROUNDING * squares, value, 0.0)


def pair_moments(df: DataFrame, names: list[str], left: range, right: range) -> DataFrame:
    """Centred moments over the complete rows of the pairs of a tile, one row per task and pair.

    ``n`` rows with means ``mx`` and ``my`` and centred sums; ``unbounded`` of them hold an infinite value.
    """
    wanted = list(dict.fromkeys([*left, *right]))
    at = {position: k for k, position in enumerate(wanted)}
    rows_at, columns_at = [at[i] for i in left], [at[j] for j in right]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, sums = None, [np.zeros((len(left), len(right))) for _ in range(7)]
        for batch in batches:
            values = np.column_stack(
                [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]
            )
            there, endless = ~np.isnan(values), np.isinf(values)
            fine = there & ~endless
            if shift is None:
                found = fine.sum(axis=0)
                shift = np.where(fine, values, 0.0).sum(axis=0) / np.maximum(found, 1)
            shifted = np.where(fine, values - shift, 0.0)
            known, odd = fine.astype(np.float64), endless.astype(np.float64)
            x, y, kx, ky = shifted[:, rows_at], shifted[:, columns_at], known[:, rows_at], known[:, columns_at]
            parts = (kx.T @ ky, x.T @ ky, kx.T @ y, (x * x).T @ ky, kx.T @ (y * y), x.T @ y)
            for total, part in zip(sums, parts):
                total += part
            present = there.astype(np.float64)
            sums[6] += odd[:, rows_at].T @ present[:, columns_at] + known[:, rows_at].T @ odd[:, columns_at]
        if shift is None:
            return
        n, sx, sy, sxx, syy, sxy, unbounded = sums
        count = np.maximum(n, 1)
        moments = (
            n, shift[rows_at][:, None] + sx / count, shift[columns_at][None, :] + sy / count,
            _centred(sxx, sx, count), _centred(syy, sy, count), sxy - sx * sy / count, unbounded,
        )
        i, j = np.meshgrid(np.array(left, np.int32), np.array(right, np.int32), indexing="ij")
        once = i <= j
        part = np.full(int(once.sum()), TaskContext.get().partitionId() % MERGE_GROUPS, np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(i[once]), pa.array(j[once]), *[pa.array(m[once]) for m in moments]],
            ["part", "left_pos", "right_pos", *_MOMENTS],
        )

    schema = "part int, left_pos int, right_pos int, " + ", ".join(f"{s} double" for s in _MOMENTS)
    plain = df.select(*[numeric_value(names[i]).alias(f"c{i}") for i in wanted])
    return plain.mapInArrow(work, schema)


def _merged(states: Column) -> Column:
    """The moments of all states together, by the pairwise update."""
    def merge(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        share = F.when(n > 0, b["n"] / n).otherwise(0.0)
        dx, dy, weight = b["mx"] - a["mx"], b["my"] - a["my"], a["n"] * share

        def total(name: str, more: Column) -> Column:
            return (a[name] + b[name] + more * weight).alias(name)

        return F.struct(
            n.alias("n"), (a["mx"] + dx * share).alias("mx"), (a["my"] + dy * share).alias("my"),
            total("cxx", dx * dx), total("cyy", dy * dy), total("cxy", dx * dy),
            (a["unbounded"] + b["unbounded"]).alias("unbounded"),
        )

    zero = F.struct(*[F.lit(0.0).alias(m) for m in _MOMENTS])
    return F.aggregate(states, zero, merge).alias("moments")


def _tiled_pairs(df: DataFrame, names: list[str]) -> DataFrame:
    """(left_pos, right_pos, r) by matrix products, tile by tile."""
    edges = [range(a, min(a + TILE, len(names))) for a in range(0, len(names), TILE)]
    moments = None
    for k, left in enumerate(edges):
        for right in edges[k:]:
            part = pair_moments(df, names, left, right)
            moments = part if moments is None else moments.unionAll(part)
    keys = ["left_pos", "right_pos"]
    by_group = moments.groupBy(*keys, "part").agg(_merged(F.collect_list(F.struct(*_MOMENTS))))
    whole = by_group.groupBy(*keys).agg(_merged(F.collect_list("moments"))).select(*keys, "moments.*")

    def root(square: str, mean: str) -> Column:
        # Means of equal values differ in their last digits from task to task.
        noise = F.col("n") * F.pow(F.col(mean) * LAST_DIGITS, F.lit(2))
        return F.when(F.col(square) > noise, F.sqrt(square)).otherwise(0.0)

    spread = root("cxx", "mx") * root("cyy", "my")
    r = F.when((F.col("unbounded") == 0) & (spread > 0), F.col("cxy") / spread)
    return whole.select(*keys, r.alias("r"))


def correlation_pairs(df: DataFrame, names: list[str]) -> DataFrame:
    """(left_pos, right_pos, left_column, right_column, r) for each unordered pair and each column
    with itself.

    Null where the correlation is undefined: a column constant over the complete rows of the pair, an
    infinite value in them, or no such rows.
    """
    if len(names) < 2:
        raise ValueError("correlations need two columns")
    named = F.array(*[F.lit(n) for n in names])
    every = small_table(df.sparkSession, [(i,) for i in range(len(names))], "left_pos int").select(
        "left_pos", F.explode(F.sequence("left_pos", F.lit(len(names) - 1))).alias("right_pos")
    )
    found = (_native_pairs if len(names) <= NATIVE_COLUMNS else _tiled_pairs)(df, names)
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r")))
    return every.join(found, ["left_pos", "right_pos"], "left").select(
        "left_pos", "right_pos",
        F.get(named, F.col("left_pos")).alias("left_column"),
        F.get(named, F.col("right_pos")).alias("right_column"),
        F.when(F.col("r").isNotNull(),
               F.when(F.col("left_pos") == F.col("right_pos"), F.lit(1.0)).otherwise(bounded)).alias("r"),
    )


def correlation_matrix(df: DataFrame, names: list[str]) -> DataFrame:
    """The full matrix in long form; 1 on the diagonal, null where undefined, even with itself."""
    columns = ["left_pos", "right_pos", "left_column", "right_column", "r"]
    swapped = ["right_pos", "left_pos", "right_column", "left_column", "r"]
    upper = correlation_pairs(df, names)
    both = F.array(
        F.struct(*columns),
        F.struct(*[F.col(c).alias(name) for c, name in zip(swapped, columns)]),
    )
    mirrored = F.when(F.col("left_pos") < F.col("right_pos"), both).otherwise(F.slice(both, 1, 1))
    return upper.select(F.inline(mirrored))
