"""Shards of a mix stay bounded whatever the ids are; nothing is broadcast by force."""

from collections import Counter

import pytest

from rowlens.llm import mixing


@pytest.fixture(scope="module")
def hot_ids(spark):
    """Rows without id, of one id, and equal in all; 250 of each in one source."""
    data = [(None, " ".join(f"n{k}x{j}" for j in range(k % 50)), "a") for k in range(250)]
    data += [(7, " ".join(f"s{k}x{j}" for j in range(k % 50)), "a") for k in range(250)]
    data += [(9, "the same words in each of them", "a")] * 250 + [(None, None, "a")] * 250
    return data, spark.createDataFrame(data, "doc_id long, text string, source string").cache()


def test_shards_stay_bounded(hot_ids, monkeypatch):
    data, docs = hot_ids
    parts = mixing.taken_parts

    def bounded(sizes, *rest):
        assert len(sizes) <= 120, f"{len(sizes)} rows in one shard"
        return parts(sizes, *rest)

    monkeypatch.setattr(mixing, "taken_parts", bounded)
    plan = mixing.plan_mix(docs, shard_docs=50).collect()
    expected = Counter((own, len((text or "").split())) for own, text, _ in data)
    assert Counter((r.own_id, r.size) for r in plan) == expected
    assert all(r.taken == sum(p["end"] - p["first"] for p in r.parts) <= 2 * r.size for r in plan)
    again = mixing.plan_mix(docs.repartition(5), shard_docs=50).collect()
    assert Counter(map(str, again)) == Counter(map(str, plan))


def test_texts_of_hot_ids_follow_the_plan(hot_ids):
    data, docs = hot_ids
    plan = mixing.plan_mix(docs, shard_docs=50).collect()
    mixed = mixing.mixed_texts(docs, shard_docs=50).collect()
    by_id = Counter()
    for row in mixed:
        by_id[row.doc_id] += len(row.text.split())
    taken = Counter()
    for row in plan:
        taken[row.own_id] += row.taken
    assert by_id == taken and sum(taken.values())


def test_large_ids_beside_rows_without_id(spark):
    ids = [2**60 + 1 + k for k in range(60)] + [None] * 20
    docs = spark.createDataFrame([(own, "some words here", "a") for own in ids], "doc_id long, text string, source string")
    assert Counter(r.own_id for r in mixing.plan_mix(docs).collect()) == Counter(ids)


def test_sources_are_not_broadcast_by_force(spark, hot_ids):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        shown = mixing.plan_mix(hot_ids[1])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "Join" in shown and "Broadcast" not in shown
