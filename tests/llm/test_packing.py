import random
import zlib

import numpy as np
import pytest
from awkward_tables import awkward, awkward_docs, empty_docs  # noqa: F401

from rowlens.llm import packing, token_files, tokens
from rowlens.session import scratch_path

pytest.importorskip("public_tokenizers")


def library_ids(text):
    coder = tokens.encoder().tokenizer
    return coder.encode(text or "", add_special_tokens=False).ids + [2]


def one_bin_at_a_time(lengths, capacity):
    """Best-two-fit as it is told: one bin, one swap, the next bin."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        own, gap = [], capacity
        for n in list(left):
            if n <= gap:
                own.append(n)
                left.remove(n)
                gap -= n
        if gap and len(own) > 1:
            small, best = min(own), None
            for a in range(len(left)):
                for b in range(a + 1, len(left)):
                    total = left[a] + left[b]
                    if small < total <= gap + small and (best is None or (total, left[b]) > best[0]):
                        best = ((total, left[b]), left[a], left[b])
            if best:
                own.remove(small)
                for n in best[1:]:
                    own.append(n)
                    left.remove(n)
                left.append(small)
                left.sort(reverse=True)
        bins.append(sorted(own, reverse=True))
    return bins


def test_patterns_are_what_bin_after_bin_gives():
    pick = random.Random(3)
    for _ in range(60):
        capacity = pick.randrange(5, 40)
        lengths = [pick.randrange(1, capacity + 1) for _ in range(pick.randrange(0, 120))]
        counts = np.bincount(lengths, minlength=capacity + 1) if lengths else np.zeros(capacity + 1, int)
        bins = [p for pattern, n in packing.best_two_fit(counts) for p in [pattern] * n]
        got = sorted(sum(([n] * k for n, k in p), []) for p in bins)
        assert sorted(sum(got, [])) == sorted(lengths)
        assert all(sum(b) <= capacity for b in got)
        assert len(got) == len(one_bin_at_a_time(lengths, capacity))


def test_swap_fills_a_gap():
    # 7 and 2 leave 1; 2 makes way for 2 + 1 as long as there are two that fit more tightly.
    counts = np.bincount([7, 2, 2, 1], minlength=11)
    assert packing.best_two_fit(counts)[0][0] == [(7, 1), (2, 1), (1, 1)]


def test_words_and_whole_texts_have_the_same_ids():
    pick, alphabet = random.Random(1), "ab's .\n,!1é日<|\t\u00a0\u3000\x1c"
    coder = tokens.encoder()
    texts = ["".join(pick.choice(alphabet) for _ in range(pick.randrange(25))) for _ in range(3000)]
    texts += ["<|endoftext|>", " x", "x ", "x\ny", "x\n\ny", "x \ny", "", "don't we'll"]
    for text, ids in zip(texts, coder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library_ids(text)[:-1], repr(text)


def check_pieces(rows, texts, capacity):
    by_row = {}
    for r in rows:
        by_row.setdefault(r.doc_id, []).append(r)
    for own, found in by_row.items():
        ids = library_ids(texts[own])
        found.sort(key=lambda r: r.start)
        assert [r.piece for r in found] == list(range(len(found)))
        assert sum(r.length for r in found) == len(ids)
        assert all(r.length == capacity for r in found[1:])
        for r in found:
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return sequences


def test_packing_against_the_library(spark, awkward):
    texts = {k: r[1] for k, r in enumerate(awkward)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    packed = packing.pack_documents(docs, capacity=64, with_ids=True)
    rows = packed.collect()
    sequences = check_pieces(rows, texts, 64)
    total = sum(r.length for r in rows)
    assert len(sequences) <= 1.1 * -(-total // 64) + 1
    whole = {r.sequence_id: r.ids for r in packing.packed_sequences(packed).collect()}
    for r in rows:
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids


def test_hot_lengths_are_ranked_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 10)
    docs = spark.range(100).selectExpr("id AS doc_id", "'same words in each' AS text")
    rows = packing.pack_documents(docs, capacity=16).collect()
    sequences = check_pieces(rows, {k: "same words in each" for k in range(100)}, 16)
    assert len(sequences) == 34 and len(rows) == 100


def test_awkward_documents(awkward, awkward_docs, empty_docs):
    rows = packing.pack_documents(awkward_docs).collect()
    assert sum(r.piece == 0 for r in rows) == len(awkward)
    assert packing.pack_documents(empty_docs).count() == 0


@pytest.mark.parametrize("delta", [False, True])
def test_token_files_round_trip(spark, awkward, awkward_docs, delta):
    path = token_files.write_token_files(awkward_docs, scratch_path(spark, "tokens"), files=3, delta=delta)
    found = token_files.read_checksums(spark, path).orderBy("start").collect()
    expected = sorted((r[0] is not None, r[0] or 0, str(library_ids(r[1])), library_ids(r[1])) for r in awkward)
    assert [r.doc_id for r in found] == [e[1] if e[0] else None for e in expected]
    before = 0
    left = {}
    for e in expected:
        crc = zlib.crc32(np.array(e[3], "<u4").tobytes())
        left.setdefault(e[1] if e[0] else None, []).append((len(e[3]), crc))
    for r in found:
        assert r.start == before
        left[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        before += r.n_tokens
    starts = token_files.read_starts(spark, path).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in starts] == [(r.doc_id, r.start, r.n_tokens) for r in found]
    (one,) = token_files.read_tokens(spark, path, [9]).collect()
    assert one.ids == library_ids(next(r[1] for r in awkward if r[0] == 9))


def test_token_files_of_an_empty_table(spark, empty_docs):
    path = token_files.write_token_files(empty_docs, scratch_path(spark, "tokens"))
    assert token_files.read_checksums(spark, path).count() == 0


def test_selective_reads(spark, awkward_docs):
    path = token_files.write_token_files(awkward_docs, scratch_path(spark, "tokens"))
    plan = token_files.read_tokens(spark, path, [9])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,9)]" in plan or "In(doc_id" in plan
    plan = token_files.read_starts(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids:array" not in plan
