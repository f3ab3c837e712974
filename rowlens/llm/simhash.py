"""SimHash near-duplicates: 64-bit fingerprints of texts, linked through BK-trees of shards.

Two fingerprints at most ``radius`` bits apart agree in full on at least one of ``radius + 1`` bit
ranges. Each range and value is a shard: its distinct fingerprints form BK-trees (children keyed by the
integer Hamming distance to their parent), and each member searches the tree along the edges whose
distance can hold a neighbour. A shard above ``TREE_SIZE`` members becomes several trees, each of which
is sent to the tasks that hold the other members of that shard. All trees together grow with the
corpus, so they are not broadcast to everyone; the shuffle brings each tree to its searchers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.llm.components import connected_components
from rowlens.llm.tables import extended, frugal, numbered_columns
from rowlens.session import stage_table

BITS = 64
#: Differing bits up to which fingerprints are linked.
RADIUS = 4
SHINGLE_WORDS = 4
HASH_SEED = 42
#: Most fingerprints in one tree.
TREE_SIZE = 4096
#: Members below a node that are compared directly.
LEAF = 24
_HASHES_AT_ONCE = 65_536


def text_fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """Fingerprint of a UTF-8 text: bit i is set if it is in over half of the shingle hashes.

    A-Z are lower-cased; shingles are ``width`` words joined by a blank, repeats included. A text of
    fewer words is one shingle; without words the fingerprint is zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words)))
    # Word k begins after k blanks.
    begins = [0] + ends[: len(words) - width]
    shingles = (
        joined[begin + k : end + k + width - 1]
        for k, (begin, end) in enumerate(zip(begins, ends[width - 1 :]))
    )
    hashes = np.fromiter(
        map(xxhash.xxh64_intdigest, shingles, repeat(HASH_SEED)), np.uint64, len(words) - width + 1
    )
    counts = np.zeros(BITS, dtype=np.int64)
    for first in range(0, len(hashes), _HASHES_AT_ONCE):
        part = hashes[first : first + _HASHES_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """All columns but the text, and ``fingerprint`` (64 bits as a long) of every row.

    Null and empty texts have fingerprint 0.
    """
    others = [c for c in docs.columns if c not in (text, "fingerprint")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.large_binary())
            values = np.fromiter(
                (text_fingerprint(t.as_py() or b"", width) for t in texts), np.uint64, len(texts)
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(values.view(np.int64))], schema.names
            )

    plain = numbered_columns(docs.select(*[F.col(f"`{c}`") for c in [*others, text]]))
    schema = extended(plain.drop(plain.columns[-1]).schema, "fingerprint long")
    return plain.mapInArrow(frugal(work), schema).toDF(*others, "fingerprint")


class BKTree:
    """A BK-tree over distinct 64-bit values; small subtrees stay plain lists.

    ``nodes`` holds per node the member it was made of and its children by distance; a child is a node
    number or, as an array, the members of a leaf.
    """

    def __init__(self, values: np.ndarray):
        self.values = values
        self.nodes: list[tuple[int, dict[int, int | np.ndarray]]] = []
        self.root = self._build(np.arange(len(values)))

    def _build(self, members: np.ndarray) -> int | np.ndarray:
        if len(members) <= LEAF:
            return members
        waiting: list[tuple[np.ndarray, dict | None, int]] = [(members, None, 0)]
        while waiting:
            members, parent, distance = waiting.pop()
            if parent is not None:
                parent[distance] = members if len(members) <= LEAF else len(self.nodes)
                if len(members) <= LEAF:
                    continue
            children: dict[int, int | np.ndarray] = {}
            self.nodes.append((int(members[0]), children))
            apart = np.bitwise_count(self.values[members[1:]] ^ self.values[members[0]])
            order = np.argsort(apart, kind="stable")
            steps = np.flatnonzero(np.diff(apart[order])) + 1
            for part in np.split(order, steps):
                waiting.append((members[1:][part], children, int(apart[part[0]])))
        return 0

    def search(
        self, queries: np.ndarray, radius: int, settled=None
    ) -> Iterator[tuple[int, np.ndarray]]:
        """For tree members: the positions of the queries within the radius.

        ``settled`` may name a member and queries whose further links are of no interest.
        """
        if not len(self.values) or not len(queries):
            return
        waiting = [(self.root, np.arange(len(queries)))]
        while waiting:
            node, asked = waiting.pop()
            if isinstance(node, np.ndarray):
                if settled is not None and settled(node, asked):
                    continue
                near = np.bitwise_count(self.values[node][:, None] ^ queries[asked][None, :]) <= radius
                for k in np.flatnonzero(near.any(axis=1)):
                    yield int(node[k]), asked[near[k]]
                continue
            member, children = self.nodes[node]
            apart = np.bitwise_count(queries[asked] ^ self.values[member]).astype(np.int16)
            hits = asked[apart <= radius]
            if len(hits):
                yield member, hits
            for distance, child in children.items():
                rest = asked[np.abs(apart - distance) <= radius]
                if len(rest):
                    waiting.append((child, rest))


def shard_links(tree_values: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked within the radius, between a tree and its queries.

    At most one link per value is returned: members of one group all link to one of them.
    """
    values = np.concatenate([tree_values, queries])
    group = np.arange(len(values))
    shift = len(tree_values)

    def settled(members: np.ndarray, asked: np.ndarray) -> bool:
        first = group[members[0]]
        return bool((group[members] == first).all() and (group[shift + asked] == first).all())

    for member, hits in BKTree(tree_values).search(queries, radius, settled):
        joined = np.unique(np.append(group[shift + hits], group[member]))
        if len(joined) > 1:
            group[np.isin(group, joined)] = joined[0]
    linked = np.flatnonzero(group != np.arange(len(values)))
    a, b = values[linked], values[group[linked]]
    return a[a != b], b[a != b]


def links(
    distinct: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE, value: str = "fingerprint"
) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints that connect all within ``radius`` bits.

    Within a shard a spanning set of links is returned, not every pair, so the result has at most a few
    rows per fingerprint and shard; connected components are the same.
    """
    bounds = np.linspace(0, BITS, radius + 2).astype(int)
    shards = distinct.select(
        value,
        F.posexplode(
            F.array(
                *[
                    F.expr(f"(shiftrightunsigned({value}, {low}) & {(1 << (high - low)) - 1}L)")
                    for low, high in zip(bounds, bounds[1:])
                ]
            )
        ).alias("band", "bits"),
    )
    # Only shards of more than one tree are listed here.
    large = (
        shards.groupBy("band", "bits").count().where(F.col("count") > tree_size)
        .select("band", "bits", F.ceil(F.col("count") / tree_size).cast("int").alias("trees"))
    )
    own = F.pmod(F.xxhash64(value), F.col("trees")).cast("int")
    pairs = (
        shards.join(large, ["band", "bits"], "left")
        .withColumn("trees", F.coalesce("trees", F.lit(1))).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
        .withColumn("tree", F.least("own", "other")).withColumn("block", F.greatest("own", "other"))
    )
    # One row per tree and block of searchers, both of bounded size.
    blocks = pairs.groupBy("band", "bits", "tree", "block").agg(
        F.collect_list(F.when(F.col("own") == F.col("tree"), F.col(value))).alias("members"),
        F.collect_list(F.when((F.col("own") == F.col("block")) & (F.col("tree") != F.col("block")),
                              F.col(value))).alias("queries"),
    ).where(F.size("members") + F.size("queries") > 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members, queries in zip(batch.column(0), batch.column(1)):
                tree = members.values.to_numpy(zero_copy_only=False).view(np.uint64)
                asked = queries.values.to_numpy(zero_copy_only=False).view(np.uint64)
                a, b = shard_links(tree, asked if len(asked) else tree, radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"]
                    )

    return blocks.select("members", "queries").mapInArrow(work, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = RADIUS,
    tree_size: int = TREE_SIZE,
) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hexadecimal digits), ``component_id``.

    Documents are linked if their fingerprints differ in at most ``radius`` bits; ``component_id`` is
    the smallest id that can be reached over links, the own one included. Null and empty texts have
    fingerprint 0 and are linked like any other. Rows with a null id take part; a component without
    any id has a null ``component_id``. Repeated rows are returned as often as they come.
    """
    name = "`" + id_column.replace("`", "``") + "`"
    marked = fingerprints(docs.select(F.col(name).alias("own_id"), F.col(f"`{text}`").alias("text")))
    marked = stage_table(marked, "fingerprints")
    distinct = stage_table(
        marked.groupBy("fingerprint").agg(F.min("own_id").alias("first_id")), "distinct"
    )
    roots = connected_components(links(distinct, radius, tree_size))
    grouped = distinct.join(
        roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left"
    ).withColumn("root", F.coalesce("root", "fingerprint"))
    least = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    component = grouped.join(least, "root").select("fingerprint", "component_id")
    return marked.join(component, "fingerprint").select(
        F.col("own_id").alias(id_column),
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def keep_first(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The document with the smallest id of each group of near-duplicates, all columns as they were.

    Of several rows with that id the one with the smallest text is kept (ties: smallest hash of the
    other columns, so a rerun keeps the same). Rows without an id cannot be told apart and all stay.
    """
    names = docs.columns
    plain = numbered_columns(docs)
    own, body = f"c{names.index(id_column)}", f"c{names.index(text)}"
    head = F.col(own) == F.col("component_id")
    # Only ids that go or come more than once. Written, so that their size is known before rows meet them:
    # a small table is sent to the rows, and only a larger one makes the rows be shuffled.
    marked = stage_table(
        near_duplicates(plain, own, body).where(F.col(own).isNotNull()).groupBy(F.col(own).alias("marked"))
        .agg(F.max(head).alias("stays"), F.count("*").alias("copies")).where("copies > 1 OR NOT stays"),
        "marked_ids",
    )
    gone, repeated = marked.where("NOT stays").select("marked"), marked.where("stays").select("marked")
    kept = plain.where(F.col(own).isNotNull()).join(gone, F.col(own) == F.col("marked"), "left_anti")
    single = kept.join(repeated, F.col(own) == F.col("marked"), "left_anti")
    whole = F.struct(*plain.columns)
    one = kept.join(repeated, F.col(own) == F.col("marked"), "left_semi").groupBy(F.col(own).alias("head")).agg(
        F.min_by(whole, F.struct(F.col(body), F.xxhash64(F.to_json(whole)))).alias("row")
    )
    return single.unionAll(one.select("row.*")).unionAll(plain.where(F.col(own).isNull())).toDF(*names)
