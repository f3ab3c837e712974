"""Words of whole texts inside a task: places, hashes and hashes of word sequences.

A word is a run of bytes other than blank and the control characters 9 to 13. All functions work on
the bytes of an Arrow string column, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text worked on at once; a single longer text is worked on alone.
BLOCK_BYTES = 1 << 20
#: Seed of the word hashes and of the factors of sequence hashes.
SEED = 20_240_501

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def text_blocks(
    column: pa.Array, block_bytes: int = BLOCK_BYTES
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of at most ``block_bytes`` bytes (one row at least).

    Yields the first row, the row offsets (one more than rows) and the bytes. Null texts are empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    rows = len(column)
    if not rows:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + rows + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + block_bytes, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]]
        first = last


def word_spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and row of each word of a block."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~_SPACE[data]
    row_starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[row_starts] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[row_starts[1:] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_counts(rows_of_words: np.ndarray, rows: int) -> np.ndarray:
    """Words of each of the ``rows`` rows."""
    return np.bincount(rows_of_words, minlength=rows).astype(np.int64)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits, one to one."""
    values = values.astype(np.uint64, copy=True)
    values ^= values >> np.uint64(33)
    values *= np.uint64(0xFF51AFD7ED558CCD)
    values ^= values >> np.uint64(33)
    values *= np.uint64(0xC4CEB9FE1A85EC53)
    values ^= values >> np.uint64(33)
    return values


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash (XXH3) of each word of a block; equal words have equal hashes wherever they are.

    The places are those of all words, as ``word_spans`` gives them. Every distinct word of the block is
    hashed once.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    kind, width = (pa.binary(), np.int32) if len(data) < 1 << 31 else (pa.large_binary(), np.int64)
    offsets = np.zeros(len(starts) + 1, width)
    np.cumsum(ends - starts, out=offsets[1:])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[~_SPACE[data]])]
    coded = pa.Array.from_buffers(kind, len(starts), buffers).dictionary_encode()
    _, edges, raw = coded.dictionary.buffers()
    count = len(coded.dictionary)
    edges = np.frombuffer(edges, width)[: count + 1].tolist()
    # Words are cut one by one from the bytes; a list of all of them would be far larger.
    distinct = map(raw.to_pybytes().__getitem__, map(slice, edges, edges[1:]))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct, repeat(SEED)), np.uint64, count)
    return hashes[coded.indices.to_numpy()]


def sequence_hashes(words: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hash of every ``length`` consecutive word hashes (fewer words: none), by a random factor per place.

    Runs across row borders too; the caller leaves those places out.
    """
    count = len(words) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    factors = np.random.default_rng((SEED, salt, length)).integers(
        0, 1 << 63, size=length, dtype=np.uint64
    )
    out = np.zeros(count, dtype=np.uint64)
    for k, factor in enumerate(factors):
        out += words[k : k + count] * (factor * np.uint64(2) + np.uint64(1))
    return mixed(out)
