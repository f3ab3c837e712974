"""The whole pipeline on a small table against plain versions of its stages."""

import zlib

import numpy as np
import pytest
from awkward_tables import awkward, prose  # noqa: F401
from test_packing import library_ids
from test_simhash import plain_components, plain_fingerprint
from test_substrings import plain_kept

import corpus_pipeline
from rowlens.llm import mixing

pytest.importorskip("public_tokenizers")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def raw(awkward):
    passage = prose("shared", 60)
    rows = [(r[0], r[1], r[2], r[3], len(r[1] or "")) for r in awkward]
    for k in range(100, 150):
        text = prose(k, 70 + k) + ("\n" + passage if k % 5 == 0 else "")
        rows.append((k, text, "en", f"s{k % 3}", len(text)))
    return rows


@pytest.fixture(scope="module")
def folder(spark, raw, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(raw, COLUMNS).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages_against_plain_versions(spark, raw, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "simhash_near_dedup", "substring_dedup", "source_mixing", "best_two_fit_packing"
    ]
    table, outputs = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, table, folder)
        if name != "best_two_fit_packing":
            assert result.columns == table.columns and result.dtypes == table.dtypes
        result.write.parquet(f"{folder}/{name}.parquet")
        table = spark.read.parquet(f"{folder}/{name}.parquet")
        outputs.append([tuple(r) for r in table.collect()])
    known, single, cut, mixed, packed = outputs

    assert sorted(known, key=str) == sorted(
        (r for r in raw if any(c.isalpha() for c in r[1] or "")), key=str
    )
    prints = [plain_fingerprint(r[1]) for r in known]
    least = plain_components([r[0] for r in known], prints)
    heads = {r[0] for r, c in zip(known, least) if r[0] is not None and r[0] == c}
    assert {r[0] for r in single} - {None} == heads
    assert len([r for r in single if r[0] is not None]) == len(heads)
    assert set(single) <= set(known)

    words = {}
    for r, kept in zip(single, plain_kept([r[:2] for r in single], 13)):
        if kept:
            words[r[0]] = kept
    assert {r[0]: r[1].split() for r in cut} == words
    assert all(r[4] == len(r[1]) for r in cut)

    plan = {r.own_id: r for r in mixing.plan_mix(spark.read.parquet(f"{folder}/substring_dedup.parquet")).collect()}
    taken = {}
    for r in mixed:
        taken[r[0]] = taken.get(r[0], 0) + len(r[1].split())
    assert taken == {k: r.taken for k, r in plan.items() if r.taken}
    source = {r[0]: r[3] for r in cut}
    for name in set(source.values()):
        own = [r for k, r in plan.items() if source[k] == name]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * mixing.BLOCK_WORDS

    expected = []
    for r in mixed:
        ids = np.array(library_ids(r[1]), "<u4")
        first = (len(ids) - 1) % 1024 + 1
        edges = [0, *range(first, len(ids) + 1, 1024)]
        for piece, (low, high) in enumerate(zip(edges, edges[1:])):
            expected.append((r[0], piece, low, high - low, zlib.crc32(ids[low:high].tobytes())))
    assert sorted((r[:5] for r in packed), key=str) == sorted(expected, key=str)
    places = {}
    for r in packed:
        places.setdefault(r[5], []).append((r[6], r[3]))
    for found in places.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(r[3] for r in packed)
    assert len(places) <= total / 1024 * 1.1 + 1


def test_run_agrees_with_itself(spark, folder):
    first = sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "piece", "start", "length", "ids_crc32").collect()), key=str)
    again = sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "piece", "start", "length", "ids_crc32").collect()), key=str)
    assert first == again and first


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
