import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from awkward_tables import awkward, awkward_docs, empty_docs  # noqa: F401

from rowlens.llm import substrings


def plain_kept(rows, window):
    """Kept words of each (id, text) row by comparing every window."""
    texts = [(own, [w.decode() for w in (text or "").encode().split()]) for own, text in rows]
    first = {}
    for own, words in texts:
        if own is not None:
            for k in range(len(words) - window + 1):
                gram = tuple(words[k : k + window])
                first[gram] = min(own, first.get(gram, own))
    out = []
    for own, words in texts:
        gone = set()
        for k in range(len(words) - window + 1):
            if own is not None and first[tuple(words[k : k + window])] < own:
                gone.update(range(k, k + window))
        out.append([w for k, w in enumerate(words) if k not in gone])
    return out


def shared_texts(seed, count=60):
    """Texts of few words, so that passages, copies and short cycles are common."""
    pick = random.Random(seed)
    passages = [[pick.choice("abcdefgh") for _ in range(pick.randrange(5, 60))] for _ in range(12)]
    rows = []
    for own in range(count):
        words = []
        for _ in range(pick.randrange(0, 5)):
            words += pick.choice(passages) if pick.random() < 0.7 else [
                f"w{pick.randrange(500)}" for _ in range(pick.randrange(30))
            ]
            if pick.random() < 0.2:
                words += ["x"] * pick.randrange(30)
        rows.append((own, pick.choice([" ", "\n", " \t "]).join(words)))
    return rows


@pytest.mark.parametrize("hot_least", [20, 3])
def test_random_passages(spark, monkeypatch, hot_least):
    """Against brute force; with a low bar most anchors take the way for hot keys."""
    monkeypatch.setattr(substrings, "HOT_LEAST", hot_least)
    rows = shared_texts(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in substrings.remove_repeats(docs, digest=True).collect()}
    for (own, text), kept in zip(rows, plain_kept(rows, 13)):
        row = found[own]
        assert row.n_words == len(text.split())
        assert row.n_removed == row.n_words - len(kept)
        assert row.kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()


def test_awkward_texts(awkward, awkward_docs):
    """Nulls, repeated ids and rows, clashing names; the text left has the kept words."""
    cut = substrings.remove_repeats(awkward_docs)
    left = sorted(
        ((r.doc_id, (r.text or "").split(), r["with.dot"]) for r in cut.collect()), key=str
    )
    rows = [(r[0], r[1]) for r in awkward]
    expected = sorted(((r[0], kept, "w.x") for r, kept in zip(rows, plain_kept(rows, 13))), key=str)
    assert left == expected
    # A text that loses nothing stays as it is, a null stays null.
    whole = {r.doc_id: r.text for r in cut.where("n_removed = 0").collect()}
    assert whole[7] == "  \n\t " and whole[5] is None and whole[9] == "Éa Ñu ßx 日本 word"


def test_paths_of_one_text_cover_every_window():
    text = " ".join(random.Random(1).choices("abc", k=300)).encode()
    data = np.frombuffer(text, np.uint8)
    found = substrings.text_paths(np.array([0, len(data)]), data, 13, 6)
    covered = np.concatenate([s + np.arange(n) for s, n in zip(found["start"], found["windows"])])
    assert sorted(covered.tolist()) == list(range(288))


def test_long_runs_are_cut(spark, monkeypatch):
    monkeypatch.setattr(substrings, "MOST_WINDOWS", 7)
    rows = [(1, "z " * 100), (2, "z " * 50 + "end"), (3, "y " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs).collect()}
    assert found == {1: 0, 2: 50, 3: 0}


def test_empty_table(empty_docs):
    assert substrings.remove_repeats(empty_docs).count() == 0
    assert substrings.remove_repeats(empty_docs, digest=True).count() == 0


def test_regular_words_and_sequences_do_not_cancel(spark):
    """The Thue-Morse sequence and its complement are equal to any polynomial hash modulo 2^64."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    same = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"{one} {same}"), (2, f"{other} {same}")], "doc_id long, text string")
    assert [r.n_removed for r in substrings.remove_repeats(docs).collect()] == [0, 0]
    spaced = [" ".join(t) for t in (one, other)]
    rows = [(1, f"{spaced[0]} {same}"), (2, f"{spaced[1]} {same}"), (3, f"x {spaced[1][:3000]}")]
    found = {r.doc_id: r.n_removed for r in substrings.remove_repeats(spark.createDataFrame(rows, docs.schema)).collect()}
    kept = plain_kept(rows, 13)
    assert [found[k] for k in (1, 2, 3)] == [len(t.split()) - len(k) for (_, t), k in zip(rows, kept)]


def test_hashes_of_paths_tell_order_and_length():
    words = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    begins = np.array([0, 1, 0, 100, 0, 5])
    ends = np.array([18, 18, 76, 176, 18, 5])
    found = substrings.path_bodies(words, begins, ends)
    assert found[0] == found[4] and len(set(found.tolist())) == 5
    shifted = np.concatenate([words[100:176], words])
    assert substrings.path_bodies(shifted, np.array([0, 176]), np.array([76, 252]))[0] == found[3]


def test_columns_named_like_the_added_ones(spark, awkward, awkward_docs):
    rows = substrings.remove_repeats(awkward_docs.withColumn("n_removed", F.lit("old")), digest=True).collect()
    plain = substrings.remove_repeats(awkward_docs.select("doc_id", "text"), digest=True).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_sha256"])
    assert sorted(map(key, rows)) == sorted(map(key, plain))
    assert rows[0].__fields__.count("n_words") == rows[0].__fields__.count("n_removed") == 1
