"""Largest inner products by randomly rotated one-bit codes, reranked within error bounds.

A vector is centred, rotated by a random orthogonal matrix and kept as one bit per dimension (the sign),
with two correction scalars: its length and the inner product of its direction with the code. From the
packed bits a query gets an unbiased estimate of every inner product and a bound of its error. The
exact inner product of the best estimates sets a bar; only vectors whose estimate plus error reaches it
are computed exactly.

The stated queries are held against all rows in blocks: a task gets one block of codes and vectors and
one block of queries, both of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors and queries in a block.
BLOCK_ROWS, BLOCK_QUERIES = 32_768, 2048
#: Queries whose estimates are held at once.
QUERY_CHUNK = 128
#: Rows from which the centre is taken (expected number).
CENTRE_ROWS = 20_000
#: Width of the error bound in standard deviations of the estimate.
ERROR_WIDTH = 2.5
#: For each neighbour asked for, best estimates that are computed exactly to set the bar.
BAR_FACTOR = 4
SEED = 5

_rotations: dict[int, np.ndarray] = {}


def rotation(dimension: int) -> np.ndarray:
    """The same random orthogonal matrix in every task."""
    if dimension not in _rotations:
        random = np.random.default_rng((SEED, dimension)).standard_normal((dimension, dimension))
        q, r = np.linalg.qr(random)
        _rotations[dimension] = (q * np.sign(np.diag(r))).astype(np.float32)
    return _rotations[dimension]


def encode(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, length of the centred vector, and inner product of direction and code."""
    centred = (vectors - centre).astype(np.float32)
    length = np.linalg.norm(centred, axis=1)
    turned = centred @ rotation(vectors.shape[1])
    fit = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])
    fit = np.divide(fit, length, out=np.ones_like(fit), where=length > 0)
    return np.packbits(turned > 0, axis=1), length, fit


def estimates(
    queries: np.ndarray, centre: np.ndarray, bits: np.ndarray, length: np.ndarray, fit: np.ndarray,
    width: float = ERROR_WIDTH,
) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner product of every query with every coded vector, and its error bound."""
    dimension = queries.shape[1]
    turned = (queries @ rotation(dimension)).astype(np.float32)
    signs = np.unpackbits(bits, axis=1, count=dimension).astype(np.float32)
    inner = 2.0 * (turned @ signs.T) - turned.sum(axis=1, keepdims=True)
    found = (queries @ centre)[:, None] + inner * (length / (fit * np.sqrt(dimension)))[None, :]
    spread = length * np.sqrt(np.maximum(0.0, 1.0 / fit**2 - 1.0) / max(1, dimension - 1))
    sizes = np.linalg.norm(queries, axis=1)
    return found, width * sizes[:, None] * spread[None, :]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equally long vectors as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(vector: Column) -> Column:
    """Not null, not all zero, and every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _centres(vectors: DataFrame, rows: dict[int, int]) -> dict[int, np.ndarray]:
    """Mean of a bounded sample for each dimension; one number per component reaches the driver."""
    chance = F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    share = F.create_map(
        *[F.lit(x) for d, n in rows.items() for x in (d, min(1.0, CENTRE_ROWS / n))]
    )
    some = vectors.where(chance < share[F.col("dimension")])
    means = (
        some.select("dimension", F.posexplode("embedding").alias("k", "x"))
        .groupBy("dimension", "k").agg(F.avg(F.col("x").cast("double")).alias("x")).collect()
    )
    centres = {d: np.zeros(d) for d in rows}
    for row in means:
        centres[row["dimension"]][row["k"]] = row["x"]
    return centres


def code_table(vectors: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``vec_id``, ``dimension``, ``bits`` (packed), ``length``, ``fit`` and the vector of every row."""
    schema = "vec_id long, dimension int, bits binary, length float, fit float, embedding array<double>"

    def work(batches):
        for batch in batches:
            dimensions = batch.column(1).to_numpy()
            for dimension in np.unique(dimensions):
                rows = pa.array(np.flatnonzero(dimensions == dimension))
                own = batch.column(2).take(rows)
                bits, length, fit = encode(_matrix(own), centres[int(dimension)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows), batch.column(1).take(rows),
                        pa.array([b.tobytes() for b in bits], pa.binary()),
                        pa.array(length.astype(np.float32)), pa.array(fit.astype(np.float32)), own,
                    ],
                    ["vec_id", "dimension", "bits", "length", "fit", "embedding"],
                )

    plain = vectors.select("vec_id", "dimension", F.col("embedding").cast("array<double>"))
    return plain.mapInArrow(work, schema)


def search_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, bits: np.ndarray,
    length: np.ndarray, fit: np.ndarray, centre: np.ndarray, k: int,
) -> list[tuple[int, int, float]]:
    """(query, neighbour, inner product) of the best ``k`` rows of a block for each query."""
    found = []
    for low in range(0, len(queries), QUERY_CHUNK):
        own = queries[low : low + QUERY_CHUNK]
        about, error = estimates(own, centre, bits, length, fit)
        for row in range(len(own)):
            about[row, ids == query_ids[low + row]] = -np.inf
        first = min(BAR_FACTOR * k, len(ids))
        leading = np.argpartition(-about, first - 1, axis=1)[:, :first]
        for row, query in enumerate(own):
            best = leading[row][np.isfinite(about[row, leading[row]])]
            if not len(best):
                continue
            exact = np.sort((vectors[best] * query).sum(axis=1))
            bar = exact[-min(k, len(exact))] if len(exact) >= k else -np.inf
            reach = about[row] + error[row] * (1 + 1e-5) + 1e-6 * np.abs(bar if np.isfinite(bar) else 0)
            chosen = np.union1d(np.flatnonzero((reach >= bar) & np.isfinite(about[row])), best)
            score = (vectors[chosen] * query).sum(axis=1)
            order = np.lexsort((ids[chosen], -score))[:k]
            found += [
                (int(query_ids[low + row]), int(ids[chosen[o]]), float(score[o])) for o in order
            ]
    return found


def nearest(
    table: DataFrame, queries: Column, k: int = 20, id_column: str = "vec_id", vector: str = "embedding",
    block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k`` nearest rows found.

    ``queries`` is a condition on ``id_column`` (given the name ``vec_id``) that marks the rows which are
    queries; each is held against every row with another id. Nearness is the inner product in double
    precision on the vectors as given; ties go to the smaller id. Vectors that are null, zero or hold a
    null or non-finite component, and rows with a null id, take no part. Vectors are compared to those
    of their own dimension. Of several rows with a query's id one (the smallest vector) asks; repeated
    rows are candidates each.
    """
    vectors = table.select(
        F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("embedding")
    ).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    vectors = vectors.withColumn("dimension", F.size("embedding"))
    spark = table.sparkSession
    # One row per dimension.
    sizes = vectors.groupBy("dimension").agg(
        F.count("*").alias("rows"), F.sum(queries.cast("int")).alias("asked")
    ).collect()
    result = "query_id long, vec_id long, score double"
    if not any(row["asked"] for row in sizes):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    centres = _centres(vectors, {row["dimension"]: row["rows"] for row in sizes})
    shape = {
        row["dimension"]: (-(-row["rows"] // block_rows), max(1, -(-(row["asked"] or 0) // block_queries)))
        for row in sizes
    }
    blocks, query_blocks = (
        F.create_map(*[F.lit(x) for d, s in shape.items() for x in (d, s[k])])[F.col("dimension")]
        for k in range(2)
    )
    coded = (
        code_table(vectors, centres)
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int"))
        .withColumn("asks", F.explode(F.sequence(F.lit(0), query_blocks - 1)))
    )
    asking = (
        vectors.where(queries).groupBy("vec_id", "dimension").agg(F.min("embedding").alias("embedding"))
        .withColumn("asks", F.pmod(F.xxhash64("vec_id", F.lit(SEED)), query_blocks).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("embedding", F.col("embedding").cast("array<double>"))
    )

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if rows.num_rows and asked.num_rows:
            own = _matrix(rows["embedding"])
            packed = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint8)
            found = search_block(
                asked["vec_id"].to_numpy(), _matrix(asked["embedding"]), rows["vec_id"].to_numpy(), own,
                packed.reshape(len(own), -1), rows["length"].to_numpy(), rows["fit"].to_numpy(),
                centres[own.shape[1]], k,
            )
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table(
            {
                "query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()),
                "score": pa.array(columns[2], pa.float64()),
            }
        )

    key = ["dimension", "block", "asks"]
    best = coded.groupBy(*key).cogroup(asking.groupBy(*key)).applyInArrow(search, result)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
