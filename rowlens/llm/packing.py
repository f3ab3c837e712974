"""Packing of tokenised documents into sequences by best-two-fit.

A bin is filled greedily with the largest pieces that fit; then its smallest piece is replaced by two
unpacked ones that fill the gap more tightly, if there are such. What this does depends only on how many
pieces there are of each length, so it is run on these counts (at most ``capacity`` numbers): a bin
pattern that comes out is used as often as the counts allow, which is what filling bin after bin would
do. The pieces then take the places of the patterns by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowlens.llm.tables import extended, frugal, in_batches, numbered_columns, texts_of
from rowlens.llm.tokens import END_ID, VOCABULARY, encoded
from rowlens.session import stage_table

CAPACITY = 1024
#: Pieces of one length that are ranked in one task.
RANKED_TOGETHER = 200_000


def best_two_fit(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Bin patterns, each a list of (length, times), and how many bins have it.

    ``counts[n]`` is the number of pieces of length n; the capacity is the last index.
    """
    left = np.array(counts, dtype=np.int64)
    left[0] = 0
    capacity = len(left) - 1
    lengths = np.arange(capacity + 1)
    patterns = []
    while True:
        free, used, gap = left.copy(), {}, capacity
        while gap:
            fitting = np.flatnonzero(free[: gap + 1])
            if not len(fitting):
                break
            length = int(fitting[-1])
            times = int(min(gap // length, free[length]))
            used[length] = times
            free[length] -= times
            gap -= times * length
        if not used:
            return patterns
        if gap and sum(used.values()) > 1:
            smallest = min(used)
            pair = _tightest_pair(free, lengths, smallest, gap + smallest)
            if pair:
                used[smallest] -= 1
                for length in pair:
                    used[length] = used.get(length, 0) + 1
        pattern = sorted(((n, k) for n, k in used.items() if k), reverse=True)
        bins = min(int(left[n]) // k for n, k in pattern)
        for n, k in pattern:
            left[n] -= bins * k
        patterns.append((pattern, bins))


def _tightest_pair(free: np.ndarray, lengths: np.ndarray, above: int, room: int) -> tuple[int, int] | None:
    """The two free pieces of the largest sum over ``above`` that fit the room, if any."""
    known = np.maximum.accumulate(np.where(free > 0, lengths, 0))
    first = np.flatnonzero(free[:room])
    if not len(first):
        return None
    second = known[np.minimum(room - first, first)]
    twice = (second == first) & (free[first] < 2)
    second = np.where(twice, known[np.maximum(first - 1, 0)], second)
    total = np.where(second > 0, first + second, 0)
    best = int(np.argmax(total))
    return (int(first[best]), int(second[best])) if total[best] > above else None


def tokenised_pieces(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY, end: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """Pieces of every document: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``ids`` if asked.

    Null texts are empty and have the end id only. Documents of up to ``capacity`` ids stay whole; of
    longer ones the first piece is shorter, unless the length is a multiple.
    """
    plain = docs.select(F.col(f"`{id_column}`").alias("own_id"), F.col(f"`{text}`").alias("text"))
    more = "piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    schema = extended(plain.drop("text").schema, more)

    def rows(taken: list[int], found: list[tuple], ids: list[bytes], own: pa.Array):
        columns = {"own_id": own.take(pa.array(taken, pa.int64()))}
        for k, (name, kind) in enumerate(
            (("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()))
        ):
            columns[name] = pa.array([f[k] for f in found], kind)
        if with_ids:
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            edges = np.cumsum([0] + [f[2] for f in found]).astype(np.int32)
            columns["ids"] = pa.ListArray.from_arrays(edges, flat)
        return in_batches(pa.table(columns))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken, found, kept = [], [], []
            for row, ids in enumerate(encoded(texts_of(batch.column(1)), vocabulary, end)):
                total = len(ids) // 4
                low, high = 0, (total - 1) % capacity + 1
                piece = 0
                while low < total:
                    part = ids[4 * low : 4 * high]
                    taken.append(row)
                    found.append((piece, low, high - low, zlib.crc32(part)))
                    if with_ids:
                        kept.append(part)
                    piece, low, high = piece + 1, high, high + capacity
                if len(found) >= 20_000:
                    yield from rows(taken, found, kept, batch.column(0))
                    taken, found, kept = [], [], []
            if found:
                yield from rows(taken, found, kept, batch.column(0))

    return plain.mapInArrow(frugal(work), schema)


def _slots(patterns: list[tuple[list[tuple[int, int]], int]], capacity: int) -> dict[int, np.ndarray]:
    """Per length: first rank, pieces per bin, first sequence and offset of each pattern that uses it."""
    slots: dict[int, list] = {}
    ranks = [0] * (capacity + 1)
    sequence = 0
    for pattern, bins in patterns:
        offset = 0
        for length, times in pattern:
            slots.setdefault(length, []).append((ranks[length], times, sequence, offset))
            ranks[length] += bins * times
            offset += length * times
        sequence += bins
    return {length: np.array(rows, dtype=np.int64) for length, rows in slots.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """All columns, and ``sequence_id`` and ``offset`` of every piece (column ``length``).

    Sequences are filled without gaps from offset 0 and hold at most ``capacity`` tokens. ``pieces`` is
    read more than once, so it should be a written table. To the driver come the counts per length.
    Equally long pieces are ranked in salted groups, so a length that a third of all pieces has is
    spread; equal rows are interchangeable. An empty table stays empty. Columns named ``sequence_id`` or
    ``offset`` are replaced, any other name may be there.
    """
    names = [n for n in pieces.columns if n not in ("sequence_id", "offset")]
    plain = numbered_columns(pieces.select(*[F.col(f"`{n}`") for n in names]))
    length = f"c{names.index('length')}"
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for size, count in plain.groupBy(length).count().collect():
        counts[size] = count
    slots = _slots(best_two_fit(counts), capacity)
    salts = max(1, -(-int(counts.max()) // RANKED_TOGETHER))
    order = [F.xxhash64(*plain.columns), *[c for c, n in zip(plain.columns, names) if n != "ids"]]
    salted = plain.withColumn("salt", F.pmod(order[0], F.lit(salts)).cast("int"))
    before = salted.groupBy(length, "salt").count().select(
        F.col(length).alias("of_length"), F.col("salt").alias("of_salt"),
        (
            F.sum("count").over(Window.partitionBy(length).orderBy("salt")) - F.col("count")
        ).alias("before"),
    )
    ranked = (
        salted.withColumn("rank", F.row_number().over(Window.partitionBy(length, "salt").orderBy(*order)))
        .join(before, (F.col(length) == F.col("of_length")) & (F.col("salt") == F.col("of_salt")))
        .select(*plain.columns, (F.col("before") + F.col("rank") - 1).alias("rank"))
    )
    schema = extended(plain.schema, "sequence_id long, offset long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(names.index("length")).to_numpy()
            ranks = batch.column(len(names)).to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                table = slots[int(size)]
                use = table[np.searchsorted(table[:, 0], ranks[at], side="right") - 1]
                number = ranks[at] - use[:, 0]
                sequence[at] = use[:, 2] + number // use[:, 1]
                offset[at] = use[:, 3] + number % use[:, 1] * size
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], schema.names
            )

    return ranked.mapInArrow(work, schema).toDF(*names, "sequence_id", "offset")


def pack_documents(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY, end: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """Tokenise, cut and pack; one row per piece, see :func:`tokenised_pieces` and :func:`pack`.

    Every row of ``docs`` is a document of its own, also where ids are null or repeated. Each text is
    tokenised once; the pieces are written to the shared folder.
    """
    pieces = tokenised_pieces(docs, id_column, text, capacity, vocabulary, end, with_ids)
    return pack(stage_table(pieces, "pieces"), capacity).withColumnRenamed("own_id", id_column)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: ``sequence_id`` and ``ids``, from pieces that have their ids.

    A sequence has at most the capacity in tokens, so a group is small.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(parts["ids"]).alias("ids"))
