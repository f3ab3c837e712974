"""Further columns may have any name that an operator uses itself, and stay as they are."""

import pytest
from awkward_tables import awkward, awkward_docs, empty_docs, prose  # noqa: F401
from pyspark.sql import functions as F

from rowlens.llm import packing, substrings, url_filter
from rowlens.llm.queries import URL_RULES

INNER = (
    "best", "digest", "short", "suffix", "prefix", "parts", "rule_digest", "weight", "rank", "before", "salt",
    "of_length", "of_salt", "key", "copy", "runs", "start", "windows", "place", "asks", "c0", "c1", "out", "label",
)


def with_names(table, names):
    return table.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])


def same_beside(found, plain, names):
    """The columns kept, and what the operator adds as it is without them."""
    assert set(names) <= set(found.columns) and len(set(found.columns)) == len(found.columns)
    assert all(r[n] == k for r in found.select(*names).collect() for k, n in enumerate(names))
    assert sorted(map(str, found.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_urls(spark):
    urls = ["http://www.example.com/en/x", "http://a.net/fr/", None, "x", "http://example.com/en/"] * 2
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    plain = url_filter.judge_urls(pages, rules)
    same_beside(url_filter.judge_urls(with_names(pages, INNER), rules), plain, INNER)
    assert url_filter.judge_urls(with_names(pages, INNER), rules.limit(0)).columns == [
        "page_id", "url", *INNER, "host", "path", "rule", "verdict"
    ]
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_packing(spark):
    pieces = spark.createDataFrame([(k, k % 90 + 1) for k in range(500)], "piece long, length long")
    found = packing.pack(with_names(pieces, INNER).withColumn("offset", F.lit("old")))
    assert found.columns == ["piece", "length", *INNER, "sequence_id", "offset"]
    ends = {}
    for row in sorted(found.collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        assert row["offset"] == ends.get(row["sequence_id"], 0)
        ends[row["sequence_id"]] = row["offset"] + row["length"]
        assert [row[n] for n in INNER] == list(range(len(INNER)))
    assert max(ends.values()) <= packing.CAPACITY
    assert packing.pack(with_names(pieces, INNER).limit(0)).count() == 0


@pytest.mark.parametrize("digest", [True, False])
def test_repeats(spark, awkward_docs, digest):
    docs = awkward_docs.select("doc_id", "text")
    plain = substrings.remove_repeats(docs, digest=digest)
    same_beside(substrings.remove_repeats(with_names(docs, INNER), digest=digest), plain, INNER)
