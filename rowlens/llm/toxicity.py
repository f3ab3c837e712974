"""Toxicity scores by non-negative positive-unlabelled learning.

A text is the set of its byte n-grams. A linear model is trained in numpy from confirmed toxic texts and
unlabelled ones: the risk of the unlabelled texts counted as clean is corrected by the share of toxic
ones among them (the class prior), and a part of the estimate that falls below zero is pushed back
instead of followed, so the model does not learn the unlabelled toxic texts as clean ones.

Training uses bounded samples; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.llm.tables import extended, numbered_columns
from rowlens.llm.words import text_blocks
from rowlens.session import stage_table

#: Bytes of the n-grams.
SIZES = (4, 5, 6, 7, 8)
#: n-grams are counted in 2 to this power classes.
CLASS_BITS = 19
#: Classes that the model has a weight for.
FEATURES = 1500
#: Expected number of toxic and of unlabelled texts in training.
POSITIVE_ROWS, UNLABELLED_ROWS = 5000, 10_000
#: Tasks over which the samples are spread; each sends its counts to the driver once.
SAMPLE_TASKS = 8
EPOCHS, BATCH, STEP, DECAY = 40, 1024, 0.005, 1e-3
SEED = 11

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32


def gram_classes(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: first bytes and classes of the n-grams that lie in one text.

    A-Z count as a-z, and the control characters 9 to 13 as a blank.
    """
    plain = _LOWER[data].astype(np.uint64)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    code = plain.copy()
    for size in range(2, max(SIZES) + 1):
        code = code[:-1] << np.uint64(8) | plain[size - 1 :] if len(code) > 1 else code[:0]
        if size not in SIZES:
            continue
        spread = (code ^ np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
        spread ^= spread >> np.uint64(29)
        spread *= np.uint64(0xBF58476D1CE4E5B9)
        inside = left[: len(code)] >= size
        places = np.flatnonzero(inside)
        yield places, (spread >> np.uint64(64 - CLASS_BITS))[places].astype(np.int64)


@dataclass
class Model:
    """Weight of each chosen class, and the constant."""

    classes: np.ndarray
    weights: np.ndarray
    bias: float


def _present(column: pa.Array, number: np.ndarray, features: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per block of texts: first row, and rows and features that are present, each once.

    ``number`` gives the feature of a class, or -1.
    """
    for first, offsets, data in text_blocks(column):
        rows_all = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        found = [np.zeros(0, np.int64)]
        for places, classes in gram_classes(data, offsets):
            own = number[classes]
            hit = np.flatnonzero(own >= 0)
            found.append(rows_all[places[hit]] * features + own[hit])
        pairs = np.unique(np.concatenate(found))
        yield first, pairs // features, pairs % features


def training_sample(
    docs: DataFrame, toxic_ids: DataFrame, positive_rows: int = POSITIVE_ROWS,
    unlabelled_rows: int = UNLABELLED_ROWS,
) -> DataFrame:
    """``positive``, ``unlabelled`` (booleans) and ``text`` of the texts used in training.

    ``docs`` has ``own_id`` and ``text``, ``toxic_ids`` the ids of confirmed toxic texts. Both samples
    are drawn by a hash of the id and have about the given numbers of rows, all if there are fewer. Only
    the chosen toxic ids, a bounded number, are broadcast.
    """
    toxic = toxic_ids.select("own_id").dropna().distinct()
    known, total = toxic.count(), docs.count()
    chance = F.pmod(F.xxhash64("own_id", F.lit(SEED)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    chosen = toxic.where(chance < min(1.0, positive_rows / max(known, 1)))
    marked = docs.join(F.broadcast(chosen.withColumn("positive", F.lit(True))), "own_id", "left").select(
        F.coalesce("positive", F.lit(False)).alias("positive"),
        (F.pmod(F.xxhash64("own_id", F.lit(SEED + 1)), F.lit(1_000_003)) / F.lit(1_000_003.0)
         < min(1.0, unlabelled_rows / max(total, 1))).alias("unlabelled"),
        "text",
    )
    some = marked.where(F.col("positive") | F.col("unlabelled")).where(F.col("text").isNotNull())
    return stage_table(some.repartition(SAMPLE_TASKS), "training_sample")


def choose_features(sample: DataFrame, features: int = FEATURES) -> np.ndarray:
    """Classes that speak most for or against the toxic texts, by how many texts have them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << CLASS_BITS), dtype=np.int64)
        totals = np.zeros(2, dtype=np.int64)
        for batch in batches:
            sides = [np.asarray(batch.column(k)) for k in range(2)]
            for first, offsets, data in text_blocks(batch.column(2)):
                rows = len(offsets) - 1
                owner = np.repeat(np.arange(rows), np.diff(offsets))
                keys = [owner[places] << CLASS_BITS | classes for places, classes in gram_classes(data, offsets)]
                keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
                row, classes = keys >> CLASS_BITS, keys & ((1 << CLASS_BITS) - 1)
                for k in range(2):
                    mine = sides[k][first : first + rows]
                    totals[k] += int(mine.sum())
                    counts[k] += np.bincount(classes[mine[row]], minlength=1 << CLASS_BITS)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([totals.tobytes()], pa.binary()),
                pa.array([counts.astype(np.uint32).tobytes()], pa.binary()),
            ],
            ["totals", "counts"],
        )

    totals, counts = np.zeros(2), np.zeros((2, 1 << CLASS_BITS))
    # One row per task of the sample, which has a fixed number of tasks.
    for row in sample.select("positive", "unlabelled", "text").mapInArrow(
        work, "totals binary, counts binary"
    ).toArrow().to_pylist():
        totals += np.frombuffer(row["totals"], np.int64)
        counts += np.frombuffer(row["counts"], np.uint32).reshape(2, -1)
    if not totals.all():
        return np.zeros(0, np.int64)
    rate = (counts + 0.5) / (totals[:, None] + 1.0)
    # How much the presence of a class separates the two, weighed by how often it is there.
    gain = np.abs(rate[0] - rate[1]) * np.abs(np.log(rate[0] / rate[1]))
    gain[counts[0] < max(3, 0.003 * totals[0])] = 0
    best = np.argsort(-gain, kind="stable")[:features]
    return np.sort(best[gain[best] > 0])


def _feature_number(classes: np.ndarray) -> np.ndarray:
    number = np.full(1 << CLASS_BITS, -1, dtype=np.int16)
    number[classes] = np.arange(len(classes))
    return number


def _vectors(sample: DataFrame, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Presence of the chosen classes in every sampled text, and its two marks."""
    features, number = len(classes), _feature_number(classes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = np.zeros((batch.num_rows, features), dtype=bool)
            for first, rows, own in _present(batch.column(2), number, features):
                seen[first + rows, own] = True
            packed = np.packbits(seen, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([p.tobytes() for p in packed], pa.binary())],
                ["positive", "unlabelled", "bits"],
            )

    table = sample.select("positive", "unlabelled", "text").mapInArrow(
        work, "positive boolean, unlabelled boolean, bits binary"
    ).toArrow()
    bits = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
    # In a fixed order, so that reruns train alike.
    order = np.lexsort([*bits.T[:32], np.asarray(table["positive"])])
    seen = np.unpackbits(bits[order], axis=1, count=features)
    return seen, np.asarray(table["positive"])[order], np.asarray(table["unlabelled"])[order]


def train_nnpu(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = SEED
) -> tuple[np.ndarray, float]:
    """Weights and constant of a linear model by the non-negative risk with logistic loss.

    The risk is ``prior * loss(positive as toxic) + max(0, loss(unlabelled as clean) - prior *
    loss(positive as clean))``, estimated on mini-batches. Where the second part is below zero the step
    raises it instead. Adam is used, with weight decay.
    """
    random = np.random.default_rng(seed)
    features = positive.shape[1]
    theta = np.zeros(features + 1)
    theta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    batches = max(1, -(-len(unlabelled) // BATCH))
    step = 0

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))

    def gradient(x: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.append(slope @ x, slope.sum()) / len(x)

    for _ in range(epochs):
        order_u = random.permutation(len(unlabelled))
        order_p = random.permutation(len(positive))
        for k in range(batches):
            u = unlabelled[order_u[k::batches]].astype(np.float64)
            p = positive[order_p[k::batches] if len(positive) >= batches else order_p].astype(np.float64)
            zu, zp = u @ theta[:-1] + theta[-1], p @ theta[:-1] + theta[-1]
            clean_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            clean = gradient(u, sigmoid(zu)) - prior * gradient(p, sigmoid(zp))
            toxic = prior * gradient(p, sigmoid(zp) - 1.0)
            slope = toxic + clean if clean_risk >= 0 else -clean
            slope[:-1] += DECAY * theta[:-1]
            step += 1
            first = 0.9 * first + 0.1 * slope
            second = 0.999 * second + 0.001 * slope**2
            theta -= STEP * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def learn(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic",
    prior: float | None = None, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS,
    features: int = FEATURES,
) -> Model:
    """Train on the toxic rows of ``labels`` and on unlabelled texts of ``docs``.

    ``prior`` is the share of toxic texts; by default that among the labelled rows. Null labels and ids
    are left out. Without toxic or without other texts the model gives every text the prior.
    """
    plain = docs.select(F.col(f"`{id_column}`").alias("own_id"), F.col(f"`{text}`").alias("text"))
    marks = labels.select(F.col(f"`{id_column}`").alias("own_id"), F.col(f"`{label}`").alias("label"))
    if prior is None:
        prior = marks.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0]
    prior = min(max(prior if prior is not None else 0.0, 1e-3), 0.9)
    none = Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    sample = training_sample(plain, marks.where(F.col("label") == 1), positive_rows, unlabelled_rows)
    classes = choose_features(sample, features)
    if not len(classes):
        return none
    seen, positive, unlabelled = _vectors(sample, classes)
    weights, bias = train_nnpu(seen[positive], seen[unlabelled], prior)
    return Model(classes, weights, bias)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns, and ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of every whole text.

    Null and empty texts have no n-gram and get the score of the constant. Columns of these names are
    replaced. There is no shuffle; every task holds the model, whose size is fixed.
    """
    others = [c for c in docs.columns if c not in ("score", "predicted")]
    at = others.index(text)
    plain = numbered_columns(docs.select(*[F.col(f"`{c}`") for c in others]))
    schema = extended(plain.schema, "score double, predicted int")
    features, number = max(1, len(model.classes)), _feature_number(model.classes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logit = np.full(batch.num_rows, model.bias)
            if len(model.classes):
                for first, rows, own in _present(batch.column(at), number, features):
                    np.add.at(logit, first + rows, model.weights[own])
            found = 1.0 / (1.0 + np.exp(-np.clip(logit, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found), pa.array((found >= 0.5).astype(np.int32))], schema.names
            )

    return plain.mapInArrow(work, schema).toDF(*others, "score", "predicted")
