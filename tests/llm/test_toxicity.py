import random

import numpy as np
from pyspark.sql import functions as F
from awkward_tables import WORDS, awkward, awkward_docs, empty_docs  # noqa: F401

from rowlens.llm import toxicity

INSULTS = ["dunderhead", "blockbrain", "numbskull"]


def texts(rows=700):
    pick = random.Random(12)
    data = []
    for k in range(rows):
        words = [pick.choice(WORDS) for _ in range(pick.randrange(5, 60))]
        toxic = int(k % 5 == 0)
        if toxic:
            for _ in range(pick.randrange(1, 4)):
                words.insert(pick.randrange(len(words)), pick.choice(INSULTS))
        data.append((k, " ".join(words), toxic))
    return data


def test_held_out_texts(spark):
    """Only some toxic texts are confirmed; the others are found all the same."""
    data = texts()
    docs = spark.createDataFrame([r[:2] for r in data], "doc_id long, text string")
    learning = F.col("doc_id") % 7 != 0
    labels = spark.createDataFrame([(k, t) for k, _, t in data if k % 3], "doc_id long, toxic int")
    model = toxicity.learn(docs.where(learning), labels.where(learning))
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(found[k].score, t) for k, _, t in data if k % 7 == 0]
    toxic, clean = ([s for s, t in held if t == want] for want in (1, 0))
    wins = np.mean([a > b for a in toxic for b in clean])
    assert wins > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    again = toxicity.learn(docs.where(learning).repartition(3), labels.where(learning))
    assert np.allclose(again.weights, model.weights)


def test_risk_is_pushed_back_from_below_zero():
    """Without the bound the clean part of the risk would fall without end on separable data."""
    positive, unlabelled = np.eye(2)[[0] * 50], np.eye(2)[[0] * 30 + [1] * 70]
    weights, bias = toxicity.train_nnpu(positive, unlabelled, 0.3, epochs=200)
    assert weights[0] + bias > 0 > weights[1] + bias
    clean = 0.3 * np.logaddexp(0, weights[0] + bias) + 0.7 * np.logaddexp(0, weights[1] + bias)
    assert clean - 0.3 * np.logaddexp(0, weights[0] + bias) > -0.1


def test_grams_stay_inside_their_text():
    data = np.frombuffer(b"ABcdEFGHIJ", np.uint8)
    (places, joined), *_ = toxicity.gram_classes(data, np.array([0, 4, 4, 10]))
    assert places.tolist() == [0, 4, 5, 6]
    (_, alone), *_ = toxicity.gram_classes(np.frombuffer(b"abcd", np.uint8), np.array([0, 4]))
    assert joined[0] == alone[0]


def test_awkward_texts(spark, awkward, awkward_docs, empty_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (99, 1), (1, 1)], "doc_id long, toxic int")
    model = toxicity.learn(awkward_docs, labels)
    found = toxicity.score(awkward_docs, model)
    assert found.columns == [c for c in awkward_docs.columns if c != "score"] + ["score", "predicted"]
    rows = found.collect()
    assert len(rows) == len(awkward) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) <= 2
    nothing = toxicity.learn(awkward_docs, labels.limit(0))
    assert len(nothing.classes) == 0 and toxicity.score(awkward_docs, nothing).count() == len(awkward)
    assert toxicity.score(empty_docs, toxicity.learn(empty_docs, labels)).count() == 0
