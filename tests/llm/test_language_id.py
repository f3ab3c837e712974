import random
from collections import Counter

import numpy as np
import pytest
from awkward_tables import awkward, awkward_docs, empty_docs  # noqa: F401

from rowlens.llm import language_id


def plain_grams(text):
    letters = "".join(c if c.isalpha() else "\0" for c in text.lower())
    line = "\0" + "\0".join(w for w in letters.split("\0") if w) + "\0"
    if line.strip("\0") == "":
        return Counter()
    counts = Counter()
    for n in (1, 2, 3):
        for k in range(len(line) - n + 1):
            gram = line[k : k + n]
            if (n == 1 and gram == "\0") or (n == 3 and gram[1] == "\0"):
                continue
            code = 0
            for place, c in enumerate(gram):
                code |= ord(c) << (21 * (n - 1 - place))
            counts[code] += 1
    return counts


@pytest.mark.parametrize("part", [3, 7, 1 << 20])
def test_grams_of_whole_texts(monkeypatch, part):
    """Counting in parts gives what counting at once gives."""
    monkeypatch.setattr(language_id, "PART", part)
    pick = random.Random(part)
    for _ in range(80):
        text = "".join(pick.choice("abÉñ  .\n1日") for _ in range(pick.randrange(40)))
        codes, counts = language_id.gram_counts(text)
        assert dict(zip(codes.tolist(), counts.tolist())) == dict(plain_grams(text))


def plain_judge(profiles, size, text):
    own = sorted(plain_grams(text or "").items(), key=lambda e: (-e[1], e[0]))[:size]
    if not own:
        return "und", 0.0
    best = None
    for lang in sorted(profiles):
        place = {g: k for k, g in enumerate(profiles[lang])}
        cost = sum(abs(place[g] - k) if g in place else size for k, (g, _) in enumerate(own))
        if best is None or cost < best[0]:
            best = (cost, lang)
    return best[1], 1 - best[0] / (size * len(own))


def test_awkward_texts_against_brute_force(awkward, awkward_docs):
    profiles = language_id.learn_profiles(awkward_docs, size=50)
    assert sorted(profiles) == ["de", "en", "fr"]
    totals = {}
    for _, text, lang, _ in awkward:
        if lang is not None and text is not None:
            totals.setdefault(lang, Counter()).update(plain_grams(text))
    for lang, grams in profiles.items():
        expected = sorted(totals[lang].items(), key=lambda e: (-e[1], e[0]))[:50]
        assert grams.tolist() == [g for g, _ in expected]
    found = language_id.identify(awkward_docs, profiles, size=50)
    assert found.columns == [c for c in awkward_docs.columns if c != "score"] + ["lang_pred", "score"]
    got = sorted((str(r.doc_id), str(r.text), r.lang_pred, round(r.score, 9)) for r in found.collect())
    expected = []
    for own, text, _, _ in awkward:
        lang, score = plain_judge(profiles, 50, text)
        expected.append((str(own), str(text), lang, round(score, 9)))
    assert got == sorted(expected)


def test_ties_go_to_the_first_language():
    same = np.array([ord("a"), ord("b")])
    judge = language_id.Judge({"aa": same, "bb": same}, 10)
    assert judge.judge("ab")[0] == "aa"


def test_keep_identified(awkward, awkward_docs):
    kept = language_id.keep_identified(awkward_docs, awkward_docs)
    assert kept.columns == awkward_docs.columns
    ids = sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect())
    assert ids == [1, 2, 3, 4, 9, 10, 11, 12, 12, 12, 13, 14]


def test_nothing_to_learn_or_judge(awkward_docs, empty_docs):
    profiles = language_id.learn_profiles(empty_docs)
    assert profiles == {}
    assert {r.lang_pred for r in language_id.identify(awkward_docs, profiles).collect()} == {"und"}
    assert language_id.identify(empty_docs, profiles).count() == 0
    assert language_id.keep_identified(awkward_docs, empty_docs).where("doc_id < 9").count() == 4
