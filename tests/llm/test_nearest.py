import numpy as np
from pyspark.sql import functions as F

from rowlens.llm import nearest


def plain_nearest(ids, vectors, query, k):
    own = vectors[list(ids).index(query)]
    scores = [(-float((v * own).sum()), i) for i, v in zip(ids, vectors) if i != query]
    return [(i, -s) for s, i in sorted(scores)[:k]]


def test_recall_and_exact_scores(spark):
    random = np.random.default_rng(4)
    centres = random.standard_normal((8, 32))
    vectors = (centres[random.integers(0, 8, 900)] + random.standard_normal((900, 32))).astype(np.float32)
    vectors[100:140] = vectors[100]  # copies: ties
    table = spark.createDataFrame(
        [(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>"
    )
    found = nearest.nearest(table, F.col("vec_id") % 20 == 0, block_rows=200, block_queries=20)
    by_query = {}
    for r in found.collect():
        by_query.setdefault(r.query_id, []).append(r)
    exact = vectors.astype(np.float64)
    hits = 0
    for query, rows in by_query.items():
        rows.sort(key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, 21))
        expected = plain_nearest(range(900), exact, query, 20)
        hits += len({i for i, _ in expected} & {r.vec_id for r in rows})
        for r in rows:
            assert abs(r.score - float(exact[query] @ exact[r.vec_id])) < 1e-9
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
    assert len(by_query) == 45 and hits >= 0.97 * 45 * 20


def test_estimates_are_within_the_bound():
    random = np.random.default_rng(9)
    vectors, queries = random.standard_normal((400, 48)), random.standard_normal((20, 48))
    centre = vectors.mean(axis=0)
    bits, length, fit = nearest.encode(vectors, centre)
    assert bits.shape == (400, 6)
    about, error = nearest.estimates(queries, centre, bits, length, fit)
    off = np.abs(about - queries @ vectors.T)
    assert (off <= error).mean() > 0.97


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]),
        (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0, 2.0, 3.0]), (20, [-1.0, 0.0]), (None, [1.0, 1.0]),
        (9, []), (40, [1.0, 1.0, 1.0]),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    found = nearest.nearest(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in found]
    assert got == [
        (0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 20, -1.0), (20, 1, 1, -0.5), (20, 2, 2, -0.5),
        (20, 3, 0, -1.0), (40, 1, 8, 6.0),
    ]
    assert nearest.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest.nearest(table.where("vec_id = 1"), F.col("vec_id") % 20 == 0).count() == 0
