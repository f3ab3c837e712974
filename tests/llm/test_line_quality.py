import random

from awkward_tables import awkward, awkward_docs, empty_docs  # noqa: F401
from rowlens.llm import quality


def plain_counts(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    windows = {}
    for k in range(len(words) - 4):
        windows.setdefault(tuple(words[k : k + 5]), []).append(k)
    covered = {p for places in windows.values() if len(places) > 1 for k in places for p in range(k, k + 5)}
    lines = [line for line in text.split("\n") if line.encode().split()]
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (
        len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed
    )


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_counts_against_brute_force(spark, awkward, awkward_docs):
    found = quality.judge_lines(awkward_docs)
    got = sorted(
        ((str(r.doc_id), str(r.text), *[r[n] for n in NAMES]) for r in found.collect()), key=str
    )
    assert got == sorted(((str(r[0]), str(r[1]), *plain_counts(r[1])) for r in awkward), key=str)
    pick = random.Random(4)
    texts = []
    for k in range(60):
        words = [pick.choice("abcde日É#") for _ in range(pick.randrange(60))]
        texts.append((k, "".join(w + pick.choice([" ", "\n", "\t", "  ", "\x0b", "\u00a0"]) for w in words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for row in quality.judge_lines(docs).collect():
        assert tuple(row[n] for n in NAMES) == plain_counts(dict(texts)[row.doc_id])


def test_lines(spark):
    good = "The river runs past the old stone bridge."
    bad = ["Home | News | Sport | Shop", "All rights reserved.", "a### b### c### d###.", "Read more"]
    lines = [(k, line) for k, line in enumerate([good, *bad, "Eleven words can pass without a mark at the very end"])]
    docs = spark.createDataFrame(lines, "doc_id long, line string")
    from pyspark.sql import functions as F

    words = F.size(F.split("line", " "))
    passed = {r[0] for r in docs.where(quality.line_passes(F.col("line"), words)).select("doc_id").collect()}
    assert passed == {0, 5}


def test_documents_that_lose_too_much(spark):
    good = "The river runs past the old stone bridge every day."
    menu = "Home | News | Sport | Shop | Help | More | Jobs"
    texts = [
        (1, good + "\n" + menu), (2, "\n".join([good, menu, menu.lower()])), (3, good + "\n\n" + good + " Yes."),
        (4, None), (5, ""),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.doc_id: r for r in quality.judge_lines(docs).collect()}
    assert [found[k].kept for k in range(1, 6)] == [False, False, False, False, False]
    longer = [(1, "\n".join([good, "Rain fell on the garden until late.", menu])), (2, good)]
    found = {r.doc_id: r for r in quality.judge_lines(spark.createDataFrame(longer, docs.schema)).collect()}
    assert found[1].kept and found[2].kept
    assert found[1].clean_text == good + "\nRain fell on the garden until late."


def test_only_column_expressions(awkward_docs, empty_docs):
    plan = quality.judge_lines(awkward_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert quality.judge_lines(empty_docs).count() == 0
