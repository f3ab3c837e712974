"""Words that the token encoder remembers, where keys of different words are the same."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from rowlens.llm import tokens
from rowlens.llm.tables import texts_of

TEXTS = ["a b\nc", "b a é\nß b", "c d", None, "", "a\nb a\nb a", "d c b a", "aé éa"]


@pytest.mark.parametrize("keys", [None, lambda words: np.zeros(len(words), np.uint64)], ids=["usual", "all equal"])
def test_words_with_one_key_keep_their_ids(monkeypatch, keys):
    if keys:
        monkeypatch.setattr(tokens, "_word_keys", keys)
    worker = tokens.Encoder()
    wanted = [worker._ids(text or "") for text in TEXTS]
    assert [worker.encode([text or ""])[0] for text in TEXTS] == wanted
    assert worker.encode([text or "" for text in TEXTS]) == wanted


def test_remembered_words_are_found_without_indexing_all_of_them_again(monkeypatch):
    worker = tokens.Encoder()
    worker.encode(["one two three"])
    indexed = []
    original = tokens.pc.index_in
    monkeypatch.setattr(tokens.pc, "index_in", lambda *a, **b: indexed.append(a) or original(*a, **b))
    learned = []
    monkeypatch.setattr(worker, "_learn", lambda *a, own=worker._learn: learned.append(list(a[0])) or own(*a))
    worker.encode(["one two three two"])
    assert indexed == learned == []


def test_keys_depend_on_the_places_of_bytes():
    words = pa.array(["ab", "ba", "", "ab", "a" * 300, "a" * 301, ""], pa.large_string())
    keys = tokens._word_keys(words)
    assert keys[0] == keys[3] and keys[2] == keys[6] and len(set(keys.tolist())) == 5
    assert (tokens._word_keys(words.slice(1)) == keys[1:]).all()


def test_texts_one_after_the_other():
    assert list(texts_of(pa.array(["a", None, "é"]))) == ["a", None, "é"]
