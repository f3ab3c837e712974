import random

import numpy as np
import xxhash
from pyspark.sql import functions as F
from awkward_tables import awkward, awkward_docs, empty_docs  # noqa: F401

from rowlens.llm import simhash
from rowlens.llm.components import connected_components


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w.decode() for w in lowered.encode().split()]
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, radius=4):
    """Smallest id reachable, for each row; nulls give none."""
    label = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for a in range(len(ids)):
            for b in range(len(ids)):
                if (prints[a] ^ prints[b]).bit_count() <= radius and label[a] != label[b]:
                    low = min(label[a], label[b])
                    label[a] = label[b] = low
                    changed = True
    least = {}
    for own, group in zip(ids, label):
        if own is not None:
            least[group] = min(own, least.get(group, own))
    return [least.get(group) for group in label]


def test_awkward_texts_against_brute_force(awkward, awkward_docs):
    found = simhash.near_duplicates(awkward_docs).collect()
    prints = [plain_fingerprint(r[1]) for r in awkward]
    expected = sorted(
        ((r[0], f"{p:016x}", c) for r, p, c in zip(awkward, prints, plain_components([r[0] for r in awkward], prints))),
        key=str,
    )
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found), key=str) == expected


def test_trees_find_every_link():
    pick = random.Random(3)
    values = {pick.getrandbits(64) for _ in range(200)}
    for base in list(values)[:80]:
        for _ in range(6):
            changed = base
            for bit in pick.sample(range(64), pick.randrange(1, 6)):
                changed ^= 1 << bit
            values.add(changed)
    values = sorted(values)
    array = np.array(values, dtype=np.uint64)
    a, b = simhash.shard_links(array, array, 4)
    place = {v: k for k, v in enumerate(values)}
    label = list(range(len(values)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for x, y in zip(a.tolist(), b.tolist()):
        assert x != y
        label[max(root(place[x]), root(place[y]))] = min(root(place[x]), root(place[y]))
    got = [root(k) for k in range(len(values))]
    assert got == plain_components(list(range(len(values))), values)


def test_shards_of_several_trees(spark):
    """A group of near copies larger than a tree is cut into blocks and still found whole."""
    pick = random.Random(8)
    base = pick.getrandbits(64)
    values = {base ^ sum(1 << bit for bit in pick.sample(range(64), 2)) for _ in range(300)}
    values |= {pick.getrandbits(64) for _ in range(50)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in sorted(values)]
    table = spark.createDataFrame(signed, "fingerprint long")
    found = connected_components(simhash.links(table, tree_size=40)).collect()
    groups = {r.node: r.root for r in found}
    plain = plain_components([s[0] for s in signed], sorted(values))
    assert [groups.get(s[0], s[0]) for s in signed] == plain


def test_components_of_a_long_path(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    table = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.root for r in connected_components(table).collect()}
    assert found == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_keep_first(awkward, awkward_docs):
    kept = simhash.keep_first(awkward_docs)
    assert kept.columns == awkward_docs.columns
    prints = [plain_fingerprint(r[1]) for r in awkward]
    least = plain_components([r[0] for r in awkward], prints)
    heads = {r[0] for r, c in zip(awkward, least) if r[0] is not None and r[0] == c}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(heads)
    assert ids.count(None) == 2


def test_empty_table(empty_docs):
    assert simhash.near_duplicates(empty_docs).count() == 0
    assert simhash.keep_first(empty_docs).count() == 0
    assert empty_docs.select(F.col("text")).count() == 0
