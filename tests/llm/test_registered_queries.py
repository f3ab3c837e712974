"""The registered queries without SQL, on a small written folder, against the plain versions of the operator tests."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from awkward_tables import awkward, prose  # noqa: F401
from test_language_id import plain_grams, plain_judge
from test_nearest import plain_nearest
from test_packing import check_pieces, library_ids
from test_simhash import plain_components, plain_fingerprint
from test_toxicity import texts

from rowlens.llm import language_id, mixing, toxicity
from rowlens.llm.queries import QUERIES

pytest.importorskip("public_tokenizers")


def plain_held_out(own):
    return own is not None and zlib.crc32(str(own).encode()) % 5 == 0


@pytest.fixture(scope="module")
def docs(awkward):
    """Each id once, one row without id."""
    rows = [r for r in awkward if r[0] is not None and r[0] != 12] + [(None, prose(1), "en", "a")]
    pick = random.Random(4)
    for k, text, _ in texts(240):
        rows.append((100 + k, text, pick.choice(["en", "de", None]), pick.choice(["a", "b", None])))
    return rows


@pytest.fixture(scope="module")
def vectors():
    return np.random.default_rng(3).standard_normal((200, 16)).astype(np.float32)


@pytest.fixture(scope="module")
def folder(spark, docs, vectors, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(
        f"{path}/documents.parquet"
    )
    labels = [(100 + k, toxic) for k, _, toxic in texts(240) if k % 3]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    data = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_language_id(spark, docs, folder):
    totals = {}
    for own, text, lang, _ in docs:
        if own is not None and not plain_held_out(own) and None not in (text, lang):
            totals.setdefault(lang, Counter()).update(plain_grams(text))
    size = language_id.PROFILE
    profiles = {
        lang: [g for g, _ in sorted(grams.items(), key=lambda e: (-e[1], e[0]))[:size]] for lang, grams in totals.items()
    }
    found = QUERIES["op1_language_id"](spark, folder)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = sorted(((r[0], r[1], r[2], round(r[3], 9)) for r in found.collect()), key=str)
    expected = []
    for own, text, _, _ in docs:
        lang, score = plain_judge(profiles, size, text)
        expected.append((own, plain_held_out(own), lang, round(score, 9)))
    assert got == sorted(expected, key=str)


def test_source_mixing(spark, docs, folder):
    found = QUERIES["op2_source_mixing"](spark, folder)
    assert found.columns == ["doc_id", "size", "source_size", "target", "taken"]
    rows = {r.doc_id: r for r in found.collect()}
    sizes = {own: len((text or "").encode().split()) for own, text, _, _ in docs}
    assert {own: r.size for own, r in rows.items()} == sizes
    of = {own: source for own, _, _, source in docs}
    order = sorted(set(of.values()), key=lambda s: (s is None, (s or "").encode()))
    total = [sum(n for own, n in sizes.items() if of[own] == s) for s in order]
    weights = [mixing.WEIGHTS[k % 3] for k in range(len(order))]
    targets = mixing.source_targets(total, weights, 1.5 * sum(total), 2)
    for source, words, target in zip(order, total, targets):
        own = [rows[k] for k in of if of[k] == source]
        assert all(r.source_size == words and r.target == pytest.approx(target) for r in own)
        assert all(0 <= r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 2 * mixing.BLOCK_WORDS


def test_one_bit_nearest(spark, vectors, folder):
    exact, by_query = vectors.astype(np.float64), {}
    for r in QUERIES["op3_one_bit_nearest"](spark, folder).collect():
        assert r.score == pytest.approx(float(exact[r.query_id] @ exact[r.vec_id]))
        by_query.setdefault(r.query_id, {})[r.rank] = r.vec_id
    assert sorted(by_query) == list(range(0, 200, 20))
    hits = 0
    for query, found in by_query.items():
        assert sorted(found) == list(range(1, 21))
        hits += len({k for k, _ in plain_nearest(range(200), exact, query, 20)} & set(found.values()))
    assert hits >= 0.97 * 10 * 20


def test_pu_toxicity(spark, docs, folder):
    learning = [r[:2] for r in docs if r[0] is not None and not plain_held_out(r[0])]
    marks = [(100 + k, t) for k, _, t in texts(240) if k % 3 and not plain_held_out(100 + k)]
    model = toxicity.learn(
        spark.createDataFrame(learning, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    )
    table = spark.createDataFrame([r[:2] for r in docs], "doc_id long, text string")
    expected = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    found = QUERIES["op5_pu_toxicity"](spark, folder)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.collect()
    assert {r.doc_id: r.score for r in rows} == pytest.approx(expected) and len(rows) == len(docs)
    assert all(r.held_out == plain_held_out(r.doc_id) and r.predicted == (r.score >= 0.5) for r in rows)


def test_best_two_fit_packing(spark, docs, folder):
    rows = QUERIES["op6_best_two_fit_packing"](spark, folder).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in docs}
    sequences = check_pieces(rows, {r[0]: r[1] for r in docs}, 1024)
    assert len(sequences) <= sum(r.length for r in rows) / 1024 * 1.1 + 1


def test_token_files(spark, docs, folder):
    found = QUERIES["op8_token_files"](spark, folder).orderBy("start").collect()
    before, expected = 0, []
    for own, text in sorted((r[:2] for r in docs), key=lambda r: (r[0] is not None, r[0])):
        ids = library_ids(text)
        expected.append((own, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        before += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found] == expected


def test_simhash(spark, docs, folder):
    prints = [plain_fingerprint(r[1]) for r in docs]
    least = plain_components([r[0] for r in docs], prints)
    found = QUERIES["op10_simhash_bk_trees"](spark, folder).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found), key=str) == sorted(
        ((r[0], f"{p:016x}", c) for r, p, c in zip(docs, prints, least)), key=str
    )
