"""Phrase mining against counting every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from awkward_tables import awkward, awkward_docs, empty_docs, prose  # noqa: F401
from pyspark.sql import functions as F

from rowlens.llm import phrases as module
from rowlens.llm.phrases import add_up, count_pairs, pack, phrases, split_words, unpack

SCHEMA = "doc_id long, text string, lang string, source string"
UPPER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def plain_pieces(text):
    pieces = re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER))
    return [words for piece in pieces if (words := re.findall(r"[^\x20\x09]+", piece))]


def plain_phrases(rows, least, inside=80, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) by counting all phrases of up to four words."""
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for words in plain_pieces(text):
            totals[lang] += len(words)
            for size in range(1, 5):
                own.update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, own in counts.items():
        candidates = {p: n for p, n in own.items() if len(p) > 1 and n >= least}
        gone = set()
        for longer, n in candidates.items():
            for size in range(2, len(longer)):
                for k in range(len(longer) - size + 1):
                    part = longer[k : k + size]
                    if 100 * n >= inside * candidates[part]:
                        gone.add(part)
        found = []
        for phrase, a in candidates.items():
            cuts = [(2_000_000 * a // (own[phrase[:k]] + own[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            if phrase not in gone:
                found.append((-score, -a, " ".join(phrase).encode(), own[phrase[:k]], own[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(11)
    words = [f"W{k}" for k in range(12)] + ["é", "日本", "a.b", "x", " ", "|"]
    rows = []
    for k in range(300):
        said = [pick.choice(words[: pick.choice([4, 18])]) for _ in range(pick.randrange(60))]
        gaps = [pick.choice([" ", " ", "  ", "\t", "\n", ", ", "! ", "\x0b", "\r\n"]) for _ in said]
        rows.append(("".join(w + g for w, g in zip(said, gaps)), pick.choice(["en", "de", None, "und", ""])))
    rows += [(None, "en"), ("", None), (" \t ", "fr"), ("...", "de")] + [("of the people by the", "en")] * 50
    rows.append((" ".join(pick.choice(words) for _ in range(5000)), "en"))
    return rows


def found(frame):
    return sorted(map(tuple, frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize(("block_words", "slice_pairs"), [(1 << 20, 1 << 20), (64, 300)])
def test_against_all_phrases(spark, texts, block_words, slice_pairs):
    table = spark.createDataFrame(texts, "text string, lang string").repartition(5)
    mined = phrases(table, least=6, block_words=block_words, slice_pairs=slice_pairs)
    expected = plain_phrases(texts, 6)
    assert len({len(r[2].split(" ")) for r in expected}) == 3
    assert found(mined) == expected


def test_limit_and_shares(spark, texts):
    table = spark.createDataFrame(texts, "text string, lang string")
    assert found(phrases(table, least=4, most_inside=50, top=7)) == plain_phrases(texts, 4, 50, 7)
    assert found(phrases(table, least=4, top=None)) == plain_phrases(texts, 4, top=10**9)


def test_awkward_rows_clashing_names_and_empty_table(spark, awkward, awkward_docs, empty_docs):
    more = awkward_docs.select(
        "*", *[F.lit(1).alias(n) for n in ("block", "slice", "left", "right", "n", "id", "at", "p", "q", "words")]
    )
    assert found(phrases(more, least=2)) == plain_phrases([r[1:3] for r in awkward], 2)
    assert phrases(empty_docs).count() == 0
    assert phrases(awkward_docs, least=10**6).count() == 0


def test_words_of_chunks(monkeypatch):
    """Texts cut into chunks have the same words as whole ones."""
    monkeypatch.setattr(module, "CHUNK_BYTES", 100)
    import pyarrow as pa

    pick = random.Random(2)
    texts = [prose(k, pick.randrange(1, 80)) for k in range(40)] + [None, "", "ß" * 300_000 + " end", "a, b", "…A"]
    words = []
    for data in module._chunks(pa.array(texts)):
        words += [w.decode() for w in split_words(data).to_pylist()]
    pieces, now = [], []
    for word in words:
        if word:
            now.append(word)
        elif now:
            pieces.append(now)
            now = []
    assert pieces == [piece for text in texts for piece in plain_pieces(text)]


def test_dense_and_sparse_tiles_count_alike():
    """Full tiles, thin tiles, and ids beyond the head."""
    pick = np.random.default_rng(1)
    left = np.concatenate([pick.integers(1, 1024, 400_000), pick.integers(1, 9000, 50_000), [2**32 - 2] * 3])
    right = np.concatenate([pick.integers(1, 1024, 400_000), pick.integers(1, 9000, 50_000), [7, 7, 2**32 - 2]])
    codes, counts = count_pairs(left, right)
    expected = Counter(zip(left.tolist(), right.tolist()))
    got = {(int(c) >> 32, int(c) & 0xFFFFFFFF): int(n) for c, n in zip(codes, counts)}
    assert got == expected and (np.diff(codes.astype(object)) > 0).all()
    empty = np.zeros(0, np.int64)
    assert not len(count_pairs(empty, empty)[0])


def test_packed_numbers_and_sums():
    for values in ([], [0], [2**32 - 1, 0, 5], [2**63, 1], list(range(1000))):
        assert unpack(pack(np.array(values, np.uint64))).tolist() == values
    codes, totals = add_up([np.array([1, 5], np.uint64), np.array([5, 9], np.uint64)], [np.array([2, 20]), np.array([15, 30])], 30)
    assert codes.tolist() == [5, 9] and totals.tolist() == [35, 30]


def test_score_is_exact_beyond_64_bits(spark):
    n, left, right = 9 * 10**12, 10**13 + 1, 10**13 + 2
    row = spark.createDataFrame([(n, left, right)], "n long, a long, b long").select(module._best_cut([("a", "b"), ("b", "a")])).first()
    assert tuple(row["cut"]) == (2_000_000 * n // (left + right), 1, left, right)
