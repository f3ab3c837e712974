import heapq
import random
from collections import Counter

import numpy as np
import pytest
from awkward_tables import awkward, awkward_docs, empty_docs  # noqa: F401

from rowlens.llm import mixing


def plain_sainte_lague(weights, seats, most):
    given = [0] * len(weights)
    queue = [(-w, k) for k, w in enumerate(weights) if w > 0 and most[k] > 0]
    heapq.heapify(queue)
    for _ in range(seats):
        if not queue:
            break
        _, k = heapq.heappop(queue)
        given[k] += 1
        if given[k] < most[k]:
            heapq.heappush(queue, (-weights[k] / (2 * given[k] + 1), k))
    return given


def test_seats_go_to_the_highest_quotients():
    pick = random.Random(2)
    for _ in range(200):
        n = pick.randrange(1, 9)
        weights = [pick.choice([0.0, 1.0, 2.0, 5.0, pick.random() * 50]) for _ in range(n)]
        seats = pick.randrange(0, 60)
        most = [pick.choice([seats, pick.randrange(0, 12)]) for _ in range(n)]
        assert mixing.sainte_lague(weights, seats, most) == plain_sainte_lague(weights, seats, most)


def test_targets_stop_at_two_passes():
    targets = mixing.source_targets([100, 10, 1000, 0], [3, 1, 2, 3], 1665, 2)
    assert targets[0] == 200 and targets[1] == 20 and targets[3] == 0
    assert targets[2] == pytest.approx(1445)


def test_parts_cover_what_is_taken():
    pick = np.random.default_rng(1)
    for _ in range(60):
        sizes = pick.integers(0, 90, pick.integers(1, 12))
        quota, block = int(pick.integers(0, 40)), int(pick.integers(1, 30))
        taken = np.zeros(len(sizes), np.int64)
        for blocks in mixing.taken_parts(sizes, quota, block, 2, 5):
            doc, low, high = mixing._runs(sizes, blocks, block)
            assert (high > low).all() and (high <= sizes[doc]).all()
            np.add.at(taken, doc, high - low)
        assert (taken <= 2 * sizes).all()
        wanted = min(quota * block, 2 * int(sizes.sum()))
        assert abs(int(taken.sum()) - wanted) <= block


def sources(spark, rows=400):
    pick = random.Random(6)
    data = []
    for k in range(rows):
        # One source has a third of all rows.
        source = "hot" if k % 3 == 0 else pick.choice(["a", "b", "Ö", "", None])
        data.append((k, " ".join(f"w{k}x{j}" for j in range(pick.randrange(0, 120))), source))
    return data, spark.createDataFrame(data, "doc_id long, text string, source string")


def test_mix_of_sources(spark):
    data, docs = sources(spark)
    plan = mixing.plan_mix(docs, shard_docs=50).collect()
    sizes = {k: len(text.split()) for k, text, _ in data}
    by_source, words, targets = {k: s for k, _, s in data}, Counter(), {}
    for row in plan:
        assert row.size == sizes[row.own_id] and row.taken <= 2 * row.size
        assert row.taken == sum(p["end"] - p["first"] for p in row.parts)
        words[by_source[row.own_id]] += row.taken
        targets[by_source[row.own_id]] = row.target
    assert len(plan) == len(data)
    order = sorted(targets, key=lambda s: (s is None, (s or "").encode()))
    total = Counter()
    for k, _, s in data:
        total[s] += sizes[k]
    expected = mixing.source_targets(
        [total[s] for s in order], [[3, 1, 2][k % 3] for k in range(len(order))], 1.5 * sum(total.values()), 2
    )
    assert [targets[s] for s in order] == pytest.approx(expected)
    for s in order:
        assert words[s] == pytest.approx(targets[s], abs=16 * (2 + total[s] // 1000), rel=0.02)
    again = mixing.plan_mix(docs.repartition(7), shard_docs=50).collect()
    assert sorted((r.own_id, r.taken) for r in again) == sorted((r.own_id, r.taken) for r in plan)


def test_texts_hold_the_words_taken(spark):
    data, docs = sources(spark, 90)
    plan = {r.own_id: r for r in mixing.plan_mix(docs).collect()}
    mixed = mixing.mixed_texts(docs)
    assert mixed.columns == docs.columns
    got = {}
    for row in mixed.collect():
        got.setdefault(row.doc_id, []).append(row.text.split())
    for own, text, _ in data:
        parts = {}
        for p in plan[own].parts:
            parts.setdefault(p["pass"], []).extend(text.split()[p["first"] : p["end"]])
        assert sorted(got.get(own, [])) == sorted(parts.values())


def test_awkward_rows(awkward, awkward_docs, empty_docs):
    plan = mixing.plan_mix(awkward_docs).collect()
    assert len(plan) == len(awkward)
    assert sum(r.taken for r in plan if r.own_id in (5, 6, 7)) == 0
    mixed = mixing.mixed_texts(awkward_docs)
    assert mixed.columns == awkward_docs.columns
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(r.taken for r in plan)
    assert mixing.plan_mix(empty_docs).count() == 0 and mixing.mixed_texts(empty_docs).count() == 0
