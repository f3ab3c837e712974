"""Token ids of whole texts with the tokenizers library, at a bounded cost for repeated words.

The byte-level vocabulary used here splits a text before every blank that stands between two other
characters and around every line break between two other characters, whatever follows. So the distinct
words of a block of texts are encoded, those met before are remembered, and the ids are put together by
array operations. Texts with any other white space, or with an added token of the vocabulary such as
``<|endoftext|>``, are encoded whole by the library. Both ways give the same ids.
"""

from __future__ import annotations

import importlib
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rowlens.llm.words import mixed

#: Bytes of words and ids remembered per process; further words are encoded in each block that has them.
REMEMBERED_BYTES = 24 << 20
#: Odd factors of the key of a word, one for each place of a byte.
KEY_FACTORS = np.random.default_rng(20_240_503).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
#: Characters of texts encoded together.
BLOCK_CHARS = 1_500_000
#: Words given to the library as one text.
JOINED = 64
#: Id at the end of a document.
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"

#: White space other than blank and line feed, as Python and the library see it.
_OTHER_SPACE = re.compile(
    "[\\t\\x0b-\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
)
_DOUBLE = ("  ", "\n\n", " \n", "\n ")


def _splits_plainly(text: str) -> bool:
    """Whether all white space is single blanks and line feeds inside the text."""
    return not (
        text[:1] in ("", " ", "\n") or text[-1] in " \n" or any(pair in text for pair in _DOUBLE)
        or _OTHER_SPACE.search(text)
    )


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public vocabulary file is on this machine."""
    return importlib.import_module("public_tokenizers").path(name)


def _word_keys(words: pa.Array) -> np.ndarray:
    """A 64-bit key of each word (large strings without nulls); different words may share one."""
    _, edges, data = words.buffers()
    edges = np.frombuffer(edges, np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    place = np.arange(len(data)) - np.repeat(edges[:-1], np.diff(edges))
    # A zero at the end, so that an empty word there has a place to begin.
    terms = np.append((data + np.uint64(1)) * KEY_FACTORS[place % len(KEY_FACTORS)], np.uint64(0))
    sums = np.add.reduceat(terms, edges[:-1]) if len(words) else np.zeros(0, np.uint64)
    return mixed(np.where(np.diff(edges) > 0, sums, np.uint64(0)))


class Remembered:
    """Distinct words and their ids, as plain arrays, found by a sorted list of keys.

    A key only says where to look; the words themselves are compared.
    """

    def __init__(self):
        self.words = pa.array([], pa.large_string())
        self.ids = np.zeros(0, "<u4")
        self.first = np.zeros(1, np.int64)
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def _places_of(self, distinct: pa.Array, keys: np.ndarray) -> np.ndarray:
        """Place of each word, -1 if it is not remembered."""
        place = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return place
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        likely = np.flatnonzero(self.keys[at] == keys)
        where = self.places[at[likely]]
        same = pc.equal(distinct.take(pa.array(likely)), self.words.take(pa.array(where)))
        same = same.to_numpy(zero_copy_only=False).astype(bool)
        place[likely[same]] = where[same]
        return place

    def _remember(self, words: pa.Array, keys: np.ndarray) -> None:
        """Add words that are not there; of those with one key the first can be found."""
        fresh, which = np.unique(keys, return_index=True)
        at = np.searchsorted(self.keys, fresh)
        if len(self.keys):
            unknown = self.keys[np.minimum(at, len(self.keys) - 1)] != fresh
            fresh, which, at = fresh[unknown], which[unknown], at[unknown]
        self.places = np.insert(self.places, at, (len(self.words) + which).astype(np.int32))
        self.keys = np.insert(self.keys, at, fresh)
        self.words = pa.concat_arrays([self.words, words])

    def nbytes(self) -> int:
        parts = (self.words, self.ids, self.first, self.keys, self.places)
        return sum(part.nbytes for part in parts)

    def ids_of(self, distinct: pa.Array, learn, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and for each word its first place there and its number of ids."""
        keys = _word_keys(distinct)
        place = self._places_of(distinct, keys)
        new = np.flatnonzero(place < 0)
        ids, first = self.ids, self.first
        if len(new):
            words = distinct.take(pa.array(new))
            more, sizes = learn(words)
            ids = np.concatenate([ids, more])
            first = np.concatenate([first, first[-1] + np.cumsum(sizes)])
            place[new] = len(self.words) + np.arange(len(new))
            if self.nbytes() < most:
                self._remember(words, keys[new])
                self.ids, self.first = ids, first
        return ids, first[place], first[place + 1] - first[place]


class Encoder:
    """Encodes texts to the bytes of their ids (little-endian, 32 bits each)."""

    def __init__(self, name: str = VOCABULARY):
        # Spark runs one task per core; the library's own threads would only compete.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(name))
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added_tokens = [token.content for token in added if token.content]
        self.after_blank, self.at_start = Remembered(), Remembered()
        self.line_break = int(np.frombuffer(self._ids("\n"), "<u4")[0])

    def _ids(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _learn(self, words: pa.Array, blank: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without white space, each after ``blank``, and how many each has.

        Many words go to the library as one text, one in a line; no word has the id of a line break.
        """
        edges = np.append(np.arange(0, len(words), JOINED), len(words))
        grouped = pa.LargeListArray.from_arrays(pa.array(edges, pa.int64()), words)
        joined = pc.binary_join(grouped, pa.scalar("\n" + blank, pa.large_string()))
        lines = [blank + line for line in joined.to_pylist()]
        ids: list[int] = []
        for line in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False):
            ids += line.ids
            ids.append(self.line_break)
        found = np.array(ids, dtype="<u4")
        breaks = np.flatnonzero(found == self.line_break)
        return found[found != self.line_break], np.diff(breaks, prepend=-1) - 1

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts whose white space is single blanks and line feeds between words."""
        lines = pc.split_pattern(pa.array(texts, pa.large_string()), "\n")
        words = pc.split_pattern(lines.flatten(), " ")
        line_at = lines.offsets.to_numpy().astype(np.int64)
        word_at = words.offsets.to_numpy().astype(np.int64)
        flat = words.flatten()
        opening = word_at[:-1]
        coded = flat.dictionary_encode()
        ids, first_of, size_of = self.after_blank.ids_of(
            coded.dictionary, lambda new: self._learn(new, " "), REMEMBERED_BYTES
        )
        number = coded.indices.to_numpy()
        first, size = first_of[number], size_of[number]
        heads = flat.take(pa.array(opening)).dictionary_encode()
        head_ids, head_first, head_size = self.at_start.ids_of(
            heads.dictionary, lambda new: self._learn(new, ""), REMEMBERED_BYTES // 4
        )
        number = heads.indices.to_numpy()
        first[opening], size[opening] = len(ids) + head_first[number], head_size[number]
        pool = np.concatenate([ids, head_ids, np.array([self.line_break], "<u4")])
        # A line break before the first word of every line but the first of a text.
        breaks = np.delete(opening, line_at[:-1])
        first, size = np.insert(first, breaks, len(pool) - 1), np.insert(size, breaks, 1)
        ends = np.cumsum(size)
        raw = pool[np.repeat(first - (ends - size), size) + np.arange(ends[-1])].tobytes()
        edges = word_at[line_at]
        edges = np.concatenate([[0], ends])[edges + np.searchsorted(breaks, edges)].tolist()
        return [raw[4 * a : 4 * b] for a, b in zip(edges, edges[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, without an end id."""
        plain = [
            k for k, text in enumerate(texts)
            if _splits_plainly(text) and not any(token in text for token in self.added_tokens)
        ]
        out: list[bytes] = [b""] * len(texts)
        if plain:
            for k, ids in zip(plain, self._encode_plain([texts[k] for k in plain])):
                out[k] = ids
        for k in set(range(len(texts))).difference(plain):
            out[k] = self._ids(texts[k]) if texts[k] else b""
        return out


_encoders: dict[str, Encoder] = {}


def encoder(name: str = VOCABULARY) -> Encoder:
    """One per process, with what it remembers."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def encoded(texts: Iterable[str | None], name: str = VOCABULARY, end: int | None = END_ID) -> Iterator[bytes]:
    """Ids of each text with the end id; null texts are empty. Works on bounded blocks of texts."""
    tail = b"" if end is None else np.array([end], dtype="<u4").tobytes()
    worker, block, size = encoder(name), [], 0
    for text in texts:
        block.append(text or "")
        size += len(block[-1])
        if size >= BLOCK_CHARS:
            yield from (ids + tail for ids in worker.encode(block))
            block, size = [], 0
    yield from (ids + tail for ids in worker.encode(block))
