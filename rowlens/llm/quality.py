"""Line-first cleaning with column expressions only.

Every line is judged by itself: does it read as a sentence, is it navigation, is it boilerplate. Lines
that fail are removed, and a document that loses too much of its text is rejected. Beside that, counts
over the whole text (words, symbols, repeated lines and 5-word windows) give a first verdict.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Any run of other characters than blank and the control characters 9 to 13 is a word.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Least words of a document, and most words in repeated windows in percent.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Most words in removed lines, in percent, that a kept document may lose.
MOST_LOST = 50
#: Most symbols in a line, in percent of its characters.
MOST_SYMBOLS = 10
#: A line without a sentence mark at its end passes from this many words on.
LONG_LINE = 10
SENTENCE_END = "[.!?…:;。！？؟।][\"'”’»)\\]]*[\\x20\\x09-\\x0D]*\\z"
#: Items set apart by bars, arrows or bullets: so many marks at least, and one for every five words.
NAVIGATION_MARK = "[|»›•·→]|(?<= )>(?= )"
LEAST_MARKS, WORDS_PER_MARK = 2, 5
BOILERPLATE = (
    r"(?i)^\W*(licen[sc]ed under|released under|this (work|file|software) is licensed|all rights reserved"
    r"|copyright (\(c\)|©|\d{4})|© ?\d{4}|(we|this (web)?site) uses? cookies|accept (all )?cookies"
    r"|privacy policy\W*\z|terms (of|and) (use|service|conditions)\W*\z|lorem ipsum|please enable javascript"
    r"|click here|subscribe (to|now)|sign up (for|now)|log ?in\W*\z|skip to (main )?content)"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def n_symbols_of(text: Column) -> Column:
    """Symbols in ``text``. Only they are made objects; ``translate`` makes one of every character."""
    return F.regexp_count(text, F.lit(f"[{SYMBOLS}]"))


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words that lie in a window of ``size`` words that comes at least twice, the first included.

    Windows are compared by 64-bit hashes, sorted with their places; texts without a repeated window
    need no sort. The work grows with n log n for a text of n words.
    """
    last = F.size(words) - size
    hashes = F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), last), lambda k: F.xxhash64(*[F.get(words, k + j) for j in range(size)])
        ),
    ).otherwise(F.array().cast("array<bigint>"))

    def places(own: Column) -> Column:
        placed = F.sort_array(F.transform(own, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
        met = let(
            placed,
            lambda p: F.filter(
                p,
                lambda e, k: (e["h"] == F.get(p, k - 1)["h"]) | (e["h"] == F.get(p, k + 1)["h"]),
            ),
        )
        return F.sort_array(F.transform(met, lambda e: e["k"]))

    def covered(own: Column) -> Column:
        # Each place covers its window, up to the next place.
        steps = F.transform(
            own, lambda place, k: F.least(F.lit(size), F.coalesce(F.get(own, k + 1) - place, F.lit(size)))
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    return let(
        hashes,
        lambda own: F.when(F.size(F.array_distinct(own)) == F.size(own), F.lit(0).cast("long")).otherwise(
            let(places(own), covered)
        ),
    )


def line_passes(line: Column, words: Column) -> Column:
    """Whether a line with ``words`` words stays: a sentence, neither navigation nor boilerplate."""
    marks = F.regexp_count(line, F.lit(NAVIGATION_MARK))
    navigation = (marks >= LEAST_MARKS) & (marks * WORDS_PER_MARK >= words)
    sentence = (line.rlike(SENTENCE_END) | (words >= LONG_LINE)) & (
        100 * n_symbols_of(line) <= MOST_SYMBOLS * F.length(line)
    )
    return sentence & ~navigation & ~line.rlike(BOILERPLATE)


def judge_lines(docs: DataFrame, text: str = "text", with_text: bool = True) -> DataFrame:
    """All columns, and counts, verdict and cleaned text of every row.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``: counts of the whole
    text. ``base_failed``: fewer than ten words, or more than 20 % of them in repeated windows.
    ``n_lost``: words of the lines that fail. ``kept``: false if ``base_failed`` or if more than half of
    the words are lost. ``clean_text``: the lines that pass, blank lines in between left as they are.

    Null and empty texts have all counts 0 and fail; the cleaned text of a null text is null. Columns of
    these names are replaced. There is no shuffle.
    """
    made = [
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost",
        "kept", "clean_text",
    ]
    others = [c for c in docs.columns if c not in made or c == text]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.filter(F.split(whole, SPACES), lambda w: w != "")
    lines = F.transform(
        F.split(whole, "\n"),
        lambda line: let(
            F.regexp_count(line, F.lit(WORD)),
            lambda n: F.struct(
                line.alias("line"), n.alias("n"), F.when(n > 0, line_passes(line, n)).alias("passes")
            ),
        ),
    )

    def of_lines(all_lines: Column) -> Column:
        full = F.transform(F.filter(all_lines, lambda e: e["n"] > 0), lambda e: e["line"])
        lost = F.aggregate(
            all_lines, F.lit(0).cast("long"),
            lambda total, e: total + F.when(~e["passes"], e["n"]).otherwise(0),
        )
        fields = [
            let(full, lambda f: F.size(f) - F.size(F.array_distinct(f))).cast("long").alias("n_dup_lines"),
            lost.alias("n_lost"),
        ]
        if with_text:
            left = F.filter(all_lines, lambda e: F.coalesce(e["passes"], F.lit(True)))
            fields.append(F.array_join(F.transform(left, lambda e: e["line"]), "\n").alias("clean_text"))
        return F.struct(*fields)

    counted = docs.select(
        *[F.col(f"`{c}`") for c in others],
        let(
            words,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            ),
        ).alias("of_words"),
        let(lines, of_lines).alias("of_lines"),
        n_symbols_of(whole).cast("long").alias("n_symbols"),
    )
    n_words, n_repeat = F.col("of_words.n_words"), F.col("of_words.n_repeat_words")
    failed = (n_words < LEAST_WORDS) | (100 * n_repeat > MOST_REPEATED * n_words)
    lost = F.col("of_lines.n_lost")
    result = counted.select(
        *[F.col(f"`{c}`") for c in others], n_words.alias("n_words"),
        F.col("of_words.word_chars").alias("word_chars"), "n_symbols",
        F.col("of_lines.n_dup_lines").alias("n_dup_lines"), n_repeat.alias("n_repeat_words"),
        failed.alias("base_failed"), lost.alias("n_lost"),
        (~failed & (100 * lost <= MOST_LOST * n_words)).alias("kept"),
        *([F.when(F.col(f"`{text}`").isNotNull(), F.col("of_lines.clean_text")).alias("clean_text")]
          if with_text else []),
    )
    return result
