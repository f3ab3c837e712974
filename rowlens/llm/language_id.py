"""Language identification by rank-order n-gram profiles and out-of-place distance.

A profile lists the most frequent n-grams of one, two and three characters of the lower-cased letters,
words set apart by one border mark, in order of frequency. A text is compared to each language: every
n-gram of its own profile costs the difference of the two ranks, or the profile size where the language
does not list it. The smallest sum wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowlens.llm.tables import extended, frugal, in_batches, numbered_columns

#: n-grams in a profile, of a language and of a text.
PROFILE = 400
#: Labelled rows per language from which the profiles are learned (expected number).
LEARN_ROWS = 3000
UNDETERMINED = "und"
#: Characters counted at once; longer texts are counted in parts.
PART = 1 << 20

_letter: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letter
    if _letter is None:
        points = np.frombuffer(np.arange(0x110000, dtype="<u4").tobytes(), "<u4")
        _letter = np.fromiter(
            (not 0xD800 <= p < 0xE000 and chr(p).isalpha() for p in points), bool, len(points)
        )
    return _letter


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of a whole text as numbers (21 bits per character), ascending, and how often they come.

    Without a letter both are empty. A border mark (0) stands before and after each run of letters;
    the mark alone is not counted.
    """
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    carried = np.zeros(1, np.int64)
    lowered = text.lower()
    for first in range(0, len(lowered), PART):
        points = np.frombuffer(lowered[first : first + PART].encode("utf-32-le", "replace"), "<u4")
        letters = np.where(_is_letter()[points], points, 0).astype(np.int64)
        line = np.concatenate([carried, letters, [0] if first + PART >= len(lowered) else []])
        line = line.astype(np.int64)
        # One border mark between words, however much stands there.
        line = line[np.concatenate([[True], (line[1:] != 0) | (line[:-1] != 0)])]
        # The last two characters begin the next part; n-grams inside them are counted there.
        if first + PART < len(lowered) and len(line) > 2:
            carried, ends = line[-2:], len(line) - 2
        elif first + PART < len(lowered):
            carried = line
            continue
        else:
            ends = len(line)
        one = line[:ends]
        two = (line[:-1] << 21 | line[1:])[:ends][(one[: len(line) - 1] != 0) | (line[1:][: len(one)] != 0)]
        three = (line[:-2] << 42 | line[1:-1] << 21 | line[2:])[:ends]
        three = three[(line[1:-1] != 0)[: len(three)]]
        found, often = np.unique(np.concatenate([one[one != 0], two, three]), return_counts=True)
        if len(codes):
            merged, where = np.unique(np.concatenate([codes, found]), return_inverse=True)
            total = np.zeros(len(merged), np.int64)
            np.add.at(total, where, np.concatenate([counts, often]))
            codes, counts = merged, total
        else:
            codes, counts = found, often
    return codes, counts


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams first, ties by the smaller number."""
    if len(counts) > size:
        # Only what can be among the first ``size`` is sorted.
        bar = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= bar], counts[counts >= bar]
    return codes[np.lexsort((codes, -counts))][:size]


def _learning_rows(docs: DataFrame, lang: str, bound: int) -> DataFrame:
    """About ``bound`` rows of each language, chosen by a hash of the row, all if there are fewer."""
    known = docs.where(F.col(lang).isNotNull())
    # One number per language.
    sizes = {row[lang]: row["count"] for row in known.groupBy(lang).count().collect()}
    if not sizes:
        return known.limit(0)
    share = F.create_map(*[F.lit(v) for k, n in sorted(sizes.items()) for v in (k, min(1.0, bound / n))])
    chance = F.pmod(F.xxhash64("own_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return known.where(chance < share[F.col(lang)])


def learn_profiles(
    docs: DataFrame, size: int = PROFILE, bound: int = LEARN_ROWS, id_column: str = "doc_id",
    text: str = "text", lang: str = "lang",
) -> dict[str, np.ndarray]:
    """Profile of every language of the labelled rows; rows without text or language teach nothing.

    About ``bound`` rows per language are used. Counts are combined in the tasks, so per task and
    language only distinct n-grams are shuffled; the result has ``size`` numbers per language.
    """
    plain = docs.select(
        F.col(f"`{id_column}`").alias("own_id"), F.col(f"`{lang}`").alias("lang"),
        F.col(f"`{text}`").alias("text"),
    )
    some = _learning_rows(plain, "lang", bound).select("lang", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            found: dict[str, list] = {}
            for lang, text in zip(langs, batch.column(1)):
                if text.is_valid:
                    found.setdefault(lang, []).append(gram_counts(text.as_py()))
            for lang, parts in found.items():
                codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                total = np.zeros(len(codes), np.int64)
                np.add.at(total, where, np.concatenate([p[1] for p in parts]))
                yield from in_batches(
                    pa.table({"lang": pa.array([lang] * len(codes), pa.string()), "gram": codes, "n": total})
                )

    total = some.mapInArrow(frugal(work), "lang string, gram long, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    profiles: dict[str, list] = {}
    for row in best.orderBy("lang", "rank").collect():
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return {lang: np.array(grams, dtype=np.int64) for lang, grams in sorted(profiles.items())}


class Judge:
    """Compares texts to all profiles; every listed n-gram has its rank in each language."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.size = size
        self.langs = list(profiles)
        self.grams = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)])).astype(np.int64)
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, dtype=np.int64)
        for k, grams in enumerate(profiles.values()):
            self.ranks[np.searchsorted(self.grams, grams), k] = np.arange(len(grams))

    def judge(self, text: str | None) -> tuple[str, float]:
        """Language and score of one text; the score is 1 without any distance, 0 at the largest."""
        own = ranked(*gram_counts(text), self.size) if text else np.zeros(0, np.int64)
        if not len(own) or not self.langs:
            return UNDETERMINED, 0.0
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == own, at, len(self.grams)) if len(self.grams) else at
        ranks = self.ranks[at]
        apart = np.abs(ranks - np.arange(len(own))[:, None])
        apart = np.where(ranks < 0, self.size, apart).sum(axis=0)
        best = int(np.argmin(apart))
        return self.langs[best], float(1.0 - apart[best] / (self.size * len(own)))


def identify(
    docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE, text: str = "text"
) -> DataFrame:
    """All columns, and ``lang_pred`` and ``score`` (0 to 1) of every row.

    ``und`` with score 0 is given to null texts and texts without a letter (and to all, if no profile
    was learned). Ties go to the language first in code point order. Columns that are already called
    ``lang_pred`` or ``score`` are replaced.
    """
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = others.index(text)
    plain = numbered_columns(docs.select(*[F.col(f"`{c}`") for c in others]))
    schema = extended(plain.schema, "lang_pred string, score double")
    judge = Judge(profiles, size)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge.judge(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                schema.names,
            )

    return plain.mapInArrow(frugal(work), schema).toDF(*others, "lang_pred", "score")


#: Below this score a text is like none of the languages; for :func:`keep_identified`.
LEAST_SCORE = 0.1


def keep_identified(
    docs: DataFrame, learn_from: DataFrame, least_score: float = LEAST_SCORE, text: str = "text"
) -> DataFrame:
    """The rows with a recognised language, all columns as they were.

    Rejected are texts that are null or without a letter and those below ``least_score``. Without any
    labelled row there is nothing to judge by and only the former go.
    """
    names = docs.columns
    plain = numbered_columns(docs)
    profiles = learn_profiles(learn_from)
    body = f"c{names.index(text)}"
    found = identify(plain, profiles, text=body)
    if not profiles:
        return plain.where(F.col(body).rlike(r"\p{L}")).toDF(*names)
    return found.where(
        (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score)
    ).drop("lang_pred", "score").toDF(*names)
