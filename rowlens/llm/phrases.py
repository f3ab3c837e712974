"""Phrase collocations by direct-address tiling of pairs of frequency-ranked ids.

Texts become blocks of word numbers. Words that are frequent enough get ids by rank, so that the most
frequent ones have small ids. Adjacent ids of a block form pairs, cut into square tiles by rank: a tile
with many of the block's pairs is counted by direct address (a dense ``bincount``), the others as a sorted
coordinate list. The counts of all blocks are added up in slices, which a hash of the pair deals out
evenly. Frequent pairs are ranked again and become the ids of the next round, in which two
overlapping pairs are a phrase of three words and two touching ones a phrase of four.

Every phrase that is frequent enough is made of frequent parts, so nothing is lost by leaving the rest
out. No list of words or pairs is sent to all tasks: what a block needs comes to it by joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlens.llm.tables import shuffle_partitions
from rowlens.llm.words import mixed
from rowlens.session import column, scratch_path, stage_table

#: Occurrences from which a phrase counts, and the share (percent) of a phrase that a longer one
#: around it must have to replace it.
LEAST, MOST_INSIDE = 30, 80
#: Phrases returned per language.
TOP = 2000
NO_LANGUAGE = "und"
#: Words of a block (more only if a piece without any break is longer), and bytes split at once.
BLOCK_WORDS = 1 << 20
CHUNK_BYTES = 1 << 20
#: Pairs that one slice gets on average.
SLICE_PAIRS = 1 << 20
#: Ids along the side of a tile; tiles of the first ``HEAD_TILES`` rows and columns may be dense.
TILE = 1024
HEAD_TILES = 4
#: A tile is counted by direct address from one pair for so many of its cells on.
CELLS_PER_PAIR = 8
#: Ids are packed by two into 64 bits.
MOST_ITEMS = (1 << 32) - 2

_WORD, _GAP, _BREAK = range(3)
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = _GAP
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as compressed bytes, sorted by significance."""
    narrow = values.astype(np.uint64 if len(values) and int(values.max()) >> 32 else np.uint32)
    planes = np.ascontiguousarray(narrow.view(np.uint8).reshape(-1, narrow.itemsize).T)
    return bytes([narrow.itemsize]) + zstandard.compress(planes.tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    size = raw[0]
    planes = np.frombuffer(zstandard.decompress(memoryview(raw)[1:]), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64 if size == 8 else np.uint32).ravel()


def split_words(data: np.ndarray) -> pa.Array:
    """The lower-cased words of a run of bytes; an empty word stands for a break between pieces.

    Breaks are kept where they stand, several in a row as one.
    """
    kind = _KIND[data]
    inside = kind == _WORD
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    breaks = np.concatenate([[0], np.cumsum(kind == _BREAK)])
    # A break before a word, and one after the last word.
    counted = np.concatenate([[0], breaks[starts], [breaks[-1]]])
    lengths = np.insert(ends - starts, np.flatnonzero(np.diff(counted) > 0), 0)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside]])]
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), buffers)


def _chunks(texts: pa.Array) -> Iterator[np.ndarray]:
    """Bytes of the texts, a line break after each, cut behind white space or breaks."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = pa.repeat(pa.scalar(b"\n", pa.large_binary()), len(texts))
    whole = pc.binary_join_element_wise(texts, ends, pa.scalar(b"", pa.large_binary()))
    _, offsets, raw = whole.buffers()
    edges = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(raw, np.uint8)[edges[0] : edges[-1]]
    first = 0
    while first < len(data):
        last = min(first + CHUNK_BYTES, len(data))
        while last < len(data):
            near = np.flatnonzero(_KIND[data[max(first, last - 65_536) : last]])
            if len(near):
                last = max(first, last - 65_536) + int(near[-1]) + 1
                break
            last = min(last + 65_536, len(data))
        yield data[first:last]
        first = last


class _Buffer:
    """Words of one language that wait for their block."""

    def __init__(self):
        self.parts: list[pa.Array] = []
        self.size = 0

    def add(self, words: pa.Array) -> None:
        self.parts.append(words)
        self.size += len(words)

    def take(self, last: bool) -> pa.Array:
        """All words up to the last break; the piece that has begun waits on."""
        whole = pa.concat_arrays(self.parts) if self.parts else pa.array([], pa.large_binary())
        cut = len(whole)
        if not last:
            breaks = np.flatnonzero(pc.binary_length(whole).to_numpy() == 0)
            cut = int(breaks[-1]) + 1 if len(breaks) else 0
        self.parts, self.size = [whole.slice(cut)] if cut < len(whole) else [], len(whole) - cut
        return whole.slice(0, cut)


_BLOCK_SCHEMA = pa.schema(
    [
        ("block", pa.int64()), ("lang", pa.string()), ("numbers", pa.binary()), ("n", pa.int64()),
        ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())),
    ]
)


def _block_row(block: int, lang: str, tokens: pa.Array) -> pa.RecordBatch | None:
    """One block: packed numbers (0 for a break, k for word k - 1 of its list), words and counts."""
    coded = tokens.dictionary_encode()
    words = coded.dictionary.cast(pa.binary())
    empty = np.flatnonzero(pc.binary_length(words).to_numpy() == 0)
    number = np.arange(1, len(words) + 1)
    if len(empty):
        number[empty[0] + 1 :] -= 1
        number[empty[0]] = 0
    numbers = number[coded.indices.to_numpy()]
    counts = np.bincount(numbers, minlength=1)[1:]
    if not len(counts):
        return None
    kept = words.take(pa.array(np.flatnonzero(number > 0)))
    columns = [
        pa.array([block]), pa.array([lang]), pa.array([pack(numbers)], pa.binary()), pa.array([int(counts.sum())]),
        pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept),
        pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts, pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_BLOCK_SCHEMA)


def _blocks(docs: DataFrame, lang: str, text: str, block_words: int) -> DataFrame:
    """Blocks of the words of one language each, written once."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, made, waiting = TaskContext.get().partitionId() << 32, 0, 0
        buffers: dict[str, _Buffer] = {}

        def flushed(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made, waiting
            for name, buffer in list(buffers.items()):
                row = _block_row(own + made, name, buffer.take(last))
                made += 1
                if row is not None:
                    yield row
                if not buffer.size:
                    del buffers[name]
            waiting = sum(buffer.size for buffer in buffers.values())

        for batch in batches:
            named = batch.column(0).fill_null(NO_LANGUAGE).dictionary_encode()
            numbers = named.indices.to_numpy()
            for k, name in enumerate(named.dictionary.to_pylist()):
                for data in _chunks(batch.column(1).take(pa.array(np.flatnonzero(numbers == k)))):
                    some = split_words(data)
                    buffers.setdefault(name, _Buffer()).add(some)
                    waiting += len(some)
                    if waiting >= block_words:
                        yield from flushed(last=False)
        yield from flushed(last=True)

    said = docs.select(column(lang).cast("string"), column(text).cast("string")).toDF("lang", "text")
    rows = said.mapInArrow(
        work, "block long, lang string, numbers binary, n long, words array<binary>, counts array<long>"
    )
    return _written(rows, "phrase_blocks")


def _written(rows: DataFrame, name: str) -> DataFrame:
    """A staged table of few, large rows in small row groups."""
    path = scratch_path(rows.sparkSession, f"{name}.parquet")
    rows.write.options(
        **{"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
    ).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with ``id``: 1, 2, ... in the given order, which has to be a total one.

    Range partitions are sorted by themselves and moved up by the rows of those before, so no task gets
    all rows.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    placed = stage_table(dealt.withColumn("mark", F.monotonically_increasing_id()), name)
    part = F.shiftright("mark", 33).alias("part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("size"))
    # One row for each partition.
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    within = F.col("mark").bitwiseAND((1 << 33) - 1)
    return (
        placed.withColumn("part", F.shiftright("mark", 33)).join(before, "part")
        .withColumn("id", F.col("before") + within + 1).drop("mark", "part", "before")
    )


def count_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs as ``left << 32 | right``, sorted, and how often each comes.

    Full tiles of the head are counted by direct address, the rest as a sorted coordinate list.
    """
    left, right = left.astype(np.uint64), right.astype(np.uint64)
    codes, counts = [], []
    at = np.flatnonzero((left < TILE * HEAD_TILES) & (right < TILE * HEAD_TILES))
    tile = ((left[at] // TILE) * HEAD_TILES + right[at] // TILE).astype(np.uint8)
    sizes = np.bincount(tile, minlength=HEAD_TILES**2)
    order = np.argsort(tile, kind="stable")
    edges = np.concatenate([[0], np.cumsum(sizes)])
    for k in np.flatnonzero(sizes * CELLS_PER_PAIR >= TILE * TILE):
        own = at[order[edges[k] : edges[k + 1]]]
        cells = np.bincount((left[own] % TILE * TILE + right[own] % TILE).astype(np.int64))
        full = np.flatnonzero(cells)
        row, col = full // TILE + k // HEAD_TILES * TILE, full % TILE + k % HEAD_TILES * TILE
        codes.append(row.astype(np.uint64) << np.uint64(32) | col.astype(np.uint64))
        counts.append(cells[full])
        left[own] = 0
    rest = left << np.uint64(32) | right
    rest = np.sort(rest[left > 0])
    first = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]])) if len(rest) else np.zeros(0, np.int64)
    codes.append(rest[first])
    counts.append(np.diff(np.append(first, len(rest))))
    codes, counts = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(codes)
    return codes[order], counts[order]


def add_up(codes: list[np.ndarray], counts: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of several sorted lists that come at least ``least`` times in all, sorted, and their totals."""
    if not codes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = np.concatenate(codes)
    order = np.argsort(whole, kind="stable")
    whole, numbers = whole[order], np.concatenate(counts).astype(np.int64)[order]
    first = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]])) if len(whole) else np.zeros(0, int)
    totals = np.add.reduceat(numbers, first) if len(first) else np.zeros(0, np.int64)
    return whole[first][totals >= least], totals[totals >= least]


def _sliced(codes: np.ndarray, counts: np.ndarray, slices: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Pairs and counts by slice, packed; the pairs of a slice as steps in their order."""
    number = mixed(codes) % np.uint64(slices)
    order = np.argsort(number, kind="stable")
    number = number[order]
    for own in np.split(np.arange(len(order)), np.flatnonzero(np.diff(number)) + 1) if len(order) else ():
        own, k = order[own], number[own[0]]
        yield int(k), pack(np.diff(codes[own], prepend=np.uint64(0))), pack(counts[own])


def _steps(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw).astype(np.uint64), dtype=np.uint64)


def _word_ids(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """Blocks of word ids, 0 for a break or a word that is not frequent."""
    spoken = blocks.select(F.col("block").alias("of"), "lang", F.posexplode("words").alias("number", "word"))
    found = spoken.withColumn("word", F.col("word").cast("string")).join(
        words.select("lang", "word", "id"), ["lang", "word"]
    ).select("of", "number", "id")

    def work(block: pa.Table, known: pa.Table) -> pa.Table:
        if not len(block) or not len(known):
            return _BLOCK_IDS.empty_table()
        numbers = unpack(block["numbers"][0].as_py())
        ids = np.zeros(int(numbers.max()) + 1, np.uint64)
        ids[known["number"].to_numpy() + 1] = known["id"].to_numpy()
        return pa.table([block["block"].combine_chunks(), pa.array([pack(ids[numbers])], pa.binary())], _BLOCK_IDS)

    rows = blocks.select("block", "numbers").groupBy("block").cogroup(found.groupBy("of")).applyInArrow(
        work, "block long, ids binary"
    )
    return _written(rows, "phrase_ids")


_BLOCK_IDS = pa.schema([("block", pa.int64()), ("ids", pa.binary())])


def _block_pairs(blocks: DataFrame, slices: int) -> DataFrame:
    """(slice, block, codes, counts): the pairs of adjacent ids of each block."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = unpack(raw.as_py())
                both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
                rows = list(_sliced(*count_pairs(ids[both], ids[both + 1]), slices))
                if rows:
                    number, codes, counts = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(number, pa.int64()), pa.array([block] * len(rows), pa.int64()),
                            pa.array(codes, pa.binary()), pa.array(counts, pa.binary()),
                        ],
                        ["slice", "block", "codes", "counts"],
                    )

    return blocks.mapInArrow(work, "slice long, block long, codes binary, counts binary")


_LISTS = "left array<long>, right array<long>, n array<long>"
_LIST_FIELDS = [(name, pa.list_(pa.int64())) for name in ("left", "right", "n")]


def _list_columns(codes: np.ndarray, totals: np.ndarray) -> list[pa.Array]:
    halves = (codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF), totals)
    return [
        pa.ListArray.from_arrays(pa.array([0, len(half)], pa.int32()), pa.array(half.astype(np.int64)))
        for half in halves
    ]


def _pair_slices(pairs: DataFrame, least: int) -> DataFrame:
    """Per slice one row with its frequent pairs, and per block of it one with their places there."""
    schema = pa.schema([("slice", pa.int64()), ("block", pa.int64()), ("at", pa.binary()), *_LIST_FIELDS])

    def work(table: pa.Table) -> pa.Table:
        own = [_steps(raw.as_py()) for raw in table["codes"]]
        codes, totals = add_up(own, [unpack(raw.as_py()) for raw in table["counts"]], least)
        if not len(codes):
            return schema.empty_table()
        blocks, places = [], []
        for block, some in zip(table["block"].to_pylist(), own):
            at = np.searchsorted(codes, some)
            at = at[codes[np.minimum(at, len(codes) - 1)] == some]
            if len(at):
                blocks.append(block)
                places.append(pack(np.diff(at, prepend=0)))
        rows = len(blocks)
        none = pa.nulls(rows, pa.list_(pa.int64()))
        return pa.table(
            [
                pa.array([table["slice"][0].as_py()] * (rows + 1), pa.int64()), pa.array([None, *blocks], pa.int64()),
                pa.array([None, *places], pa.binary()),
                *[pa.concat_arrays([c, none]) for c in _list_columns(codes, totals)],
            ],
            schema,
        )

    return _written(
        pairs.groupBy("slice").applyInArrow(work, f"slice long, block long, at binary, {_LISTS}"), "phrase_pairs"
    )


def _exploded(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per entry of the lists ``left``, ``right`` and ``n``, with its place ``at``."""
    zipped = F.posexplode(F.arrays_zip("left", "right", "n")).alias("at", "pair")
    return rows.select(*keys, zipped).select(*keys, "at", "pair.left", "pair.right", "pair.n")


def _known_pairs(slices: DataFrame, pairs: DataFrame) -> DataFrame:
    """(block, codes, ids): the frequent pairs of each block and slice."""
    schema = pa.schema([("block", pa.int64()), ("codes", pa.binary()), ("ids", pa.binary())])

    def work(blocks: pa.Table, known: pa.Table) -> pa.Table:
        if not len(blocks) or not len(known):
            return schema.empty_table()
        place = known["at"].to_numpy()
        codes = np.zeros(len(place), np.uint64)
        ids = np.zeros(len(place), np.int64)
        left, right = (known[name].to_numpy().astype(np.uint64) for name in ("left", "right"))
        codes[place], ids[place] = left << np.uint64(32) | right, known["id"].to_numpy()
        at = [np.cumsum(unpack(raw.as_py()).astype(np.int64)) for raw in blocks["at"]]
        return pa.table(
            [
                blocks["block"].combine_chunks(),
                pa.array([pack(np.diff(codes[k], prepend=np.uint64(0))) for k in at], pa.binary()),
                pa.array([pack(ids[k]) for k in at], pa.binary()),
            ],
            schema,
        )

    of_blocks = slices.where("block IS NOT NULL").select("slice", "block", "at")
    return of_blocks.groupBy("slice").cogroup(
        pairs.select("slice", "at", "left", "right", "id").groupBy("slice")
    ).applyInArrow(work, "block long, codes binary, ids binary")


def longer_pairs(pair_ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Size, and both pairs of each phrase of three and four words; ``pair_ids`` has one id (or 0) per word."""
    there = pair_ids > 0
    three = np.flatnonzero(there[:-1] & there[1:])
    yield 3, pair_ids[three], pair_ids[three + 1]
    four = np.flatnonzero(there[:-2] & there[1:-1] & there[2:])
    yield 4, pair_ids[four], pair_ids[four + 2]


def _longer(blocks: DataFrame, known: DataFrame, slices: int) -> DataFrame:
    """(size, slice, codes, counts): pairs of frequent pairs of each block."""
    schema = pa.schema(
        [("size", pa.int32()), ("slice", pa.int64()), ("codes", pa.binary()), ("counts", pa.binary())]
    )

    def work(block: pa.Table, pairs: pa.Table) -> pa.Table:
        if not len(block) or not len(pairs):
            return schema.empty_table()
        ids = unpack(block["ids"][0].as_py()).astype(np.uint64)
        codes = np.concatenate([_steps(raw.as_py()) for raw in pairs["codes"]])
        named = np.concatenate([unpack(raw.as_py()).astype(np.uint64) for raw in pairs["ids"]])
        order = np.argsort(codes)
        codes, named = codes[order], named[order]
        asked = ids[:-1] << np.uint64(32) | ids[1:]
        at = np.minimum(np.searchsorted(codes, asked), len(codes) - 1)
        pair_ids = np.where((codes[at] == asked) & (ids[:-1] > 0) & (ids[1:] > 0), named[at], 0)
        rows = [
            (size, *row)
            for size, left, right in longer_pairs(pair_ids)
            for row in _sliced(*count_pairs(left, right), slices)
        ]
        columns = list(zip(*rows)) or [()] * 4
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, schema.types)], schema)

    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        work, "size int, slice long, codes binary, counts binary"
    )


def _added_up(pairs: DataFrame, least: int) -> DataFrame:
    """(size, left, right, n) of the frequent ones."""
    schema = pa.schema([("size", pa.int32()), *_LIST_FIELDS])

    def work(table: pa.Table) -> pa.Table:
        codes, totals = add_up(
            [_steps(raw.as_py()) for raw in table["codes"]], [unpack(raw.as_py()) for raw in table["counts"]], least
        )
        if not len(codes):
            return schema.empty_table()
        return pa.table([pa.array([table["size"][0].as_py()], pa.int32()), *_list_columns(codes, totals)], schema)

    rows = pairs.groupBy("size", "slice").applyInArrow(work, f"size int, {_LISTS}")
    return _exploded(_written(rows, "phrase_longer"), "size")


def _check_items(count: int) -> None:
    if count > MOST_ITEMS:
        raise ValueError(f"{count} items are frequent, more than ids hold; ask for more occurrences (least)")


def phrase_counts(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, block_words: int = BLOCK_WORDS,
    slice_pairs: int = SLICE_PAIRS,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Words per language (lang, total), and frequent words, pairs and longer phrases.

    Words: (id, lang, word, n). Pairs: (id, left, right, n) of word ids. Longer ones: (size, left, right, n)
    of pair ids, which overlap by a word for three words and touch for four.
    """
    blocks = _blocks(docs, lang, text, block_words)
    totals = blocks.groupBy("lang").agg(F.sum("n").alias("total"))
    spoken = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    counted = (
        spoken.groupBy("lang", F.col("w.words").cast("string").alias("word"))
        .agg(F.sum("w.counts").alias("n")).where(F.col("n") >= least)
    )
    words = ranked(counted, [F.desc("n"), F.asc("lang"), F.asc("word")], "phrase_words")
    said = totals.agg(F.sum("total")).first()[0] or 0
    _check_items(words.count())
    slices = max(1, -(-said // slice_pairs))
    ids = _word_ids(blocks, words)
    by_slice = _pair_slices(_block_pairs(ids, slices), least)
    pairs = ranked(
        _exploded(by_slice.where("block IS NULL"), "slice"), [F.desc("n"), F.asc("left"), F.asc("right")], "phrase_ranks"
    )
    _check_items(pairs.count())
    longer = _added_up(_longer(ids, _known_pairs(by_slice, pairs), slices), least)
    return totals, words, pairs.select("id", "left", "right", "n"), longer


def _best_cut(cuts: list[tuple[str, str]]) -> Column:
    """(score, k, l, r) of the lowest-scoring cut, ties to the earliest; exact beyond 64 bits."""
    scored = [
        F.struct(
            F.expr(
                f"(2000000BD * CAST(n AS DECIMAL(20, 0))) DIV "
                f"(CAST({left} AS DECIMAL(20, 0)) + CAST({right} AS DECIMAL(20, 0)))"
            ).alias("score"),
            F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"),
        )
        for k, (left, right) in enumerate(cuts, 1)
    ]
    return F.array_min(F.array(*scored)).alias("cut")


def phrases(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, most_inside: int = MOST_INSIDE,
    top: int | None = TOP, block_words: int = BLOCK_WORDS, slice_pairs: int = SLICE_PAIRS,
) -> DataFrame:
    """The phrases of 2 to 4 words that hold together best, per language.

    Returns ``lang``, ``rank``, ``phrase``, ``a`` (occurrences), ``l`` and ``r`` (occurrences of both parts of
    the weakest cut), ``n`` (words of the language) and ``score``. A-Z are lower-cased; pieces end at
    ``. , ; : ! ?`` and line breaks, words at blanks and tabs. Phrases with a longer one around them that has
    ``most_inside`` percent of their occurrences are left out; ``top`` None returns all the others.

    Null texts are empty, a null language is ``und``. Repeated rows count again. Ties go by occurrences, then
    by the phrase's bytes. Further columns are not read, whatever their names; an empty table gives an
    empty one. Long texts are split into blocks between pieces.
    """
    totals, words, pairs, longer = phrase_counts(docs, lang, text, least, block_words, slice_pairs)
    first = words.select(F.col("id").alias("left"), "lang", F.col("n").alias("n_left"), F.col("word").alias("head"))
    last = words.select(F.col("id").alias("right"), F.col("n").alias("n_right"), F.col("word").alias("tail"))
    two = stage_table(
        pairs.join(first, "left").join(last, "right")
        .select("id", "left", "right", "lang", "n", "n_left", "n_right", "tail",
                F.concat_ws(" ", "head", "tail").alias("phrase")),
        "phrases_of_two",
    )
    p = two.select(
        F.col("id").alias("p"), "lang", F.col("right").alias("b"), F.col("n_left").alias("n_first"),
        F.col("n").alias("n_p"), F.col("phrase").alias("head"),
    )
    q = two.select(
        F.col("id").alias("q"), F.col("left").alias("c"), F.col("n_right").alias("n_last"), F.col("n").alias("n_q"),
        "tail", F.col("phrase").alias("end"),
    )
    met = longer.withColumnsRenamed({"left": "p", "right": "q"}).join(p, "p").join(q, "q")
    three = stage_table(
        met.where("size = 3").select(
            "p", "q", "lang", "n", "n_first", "n_p", "n_q", "n_last", F.concat_ws(" ", "head", "tail").alias("phrase")
        ),
        "phrases_of_three",
    )
    middle = pairs.select(F.col("left").alias("b"), F.col("right").alias("c"), F.col("id").alias("m"))
    four = stage_table(
        met.where("size = 4").join(middle, ["b", "c"])
        .join(three.select("p", F.col("q").alias("m"), F.col("n").alias("n_head")), ["p", "m"])
        .join(three.select(F.col("p").alias("m"), "q", F.col("n").alias("n_end")), ["m", "q"])
        .select("p", "m", "q", "lang", "n", "n_first", "n_end", "n_p", "n_q", "n_head", "n_last",
                F.concat_ws(" ", "head", "end").alias("phrase")),
        "phrases_of_four",
    )
    # A phrase around another one has no more occurrences than one in between, so the next size tells all.
    around_two = three.select(F.explode(F.array("p", "q")).alias("id"), F.col("n").alias("around"))
    around_three = four.select(
        F.inline(F.array(F.struct("p", F.col("m").alias("q")), F.struct(F.col("m").alias("p"), "q"))),
        F.col("n").alias("around"),
    )
    found = (
        two.join(around_two.groupBy("id").agg(F.max("around").alias("around")), "id", "left")
        .select("lang", "phrase", "n", "around", _best_cut([("n_left", "n_right")]))
        .unionByName(
            three.join(around_three.groupBy("p", "q").agg(F.max("around").alias("around")), ["p", "q"], "left")
            .select("lang", "phrase", "n", "around", _best_cut([("n_first", "n_q"), ("n_p", "n_last")]))
        )
        .unionByName(
            four.select(
                "lang", "phrase", "n", F.lit(None).cast("long").alias("around"),
                _best_cut([("n_first", "n_end"), ("n_p", "n_q"), ("n_head", "n_last")]),
            )
        )
        .where(F.coalesce(100 * F.col("around") < most_inside * F.col("n"), F.lit(True)))
        .select("lang", "phrase", F.col("n").alias("a"), "cut.l", "cut.r", "cut.score")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    placed = found.withColumn("rank", F.row_number().over(order))
    if top is not None:
        placed = placed.where(F.col("rank") <= top)
    return placed.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"
    )
