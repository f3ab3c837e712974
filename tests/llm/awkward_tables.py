"""Small tables with the cases every operator has to stand."""

import random

import pytest

WORDS = (
    "river stone garden winter letter market bridge window candle forest signal harbour copper velvet "
    "marble thunder meadow lantern orchard compass feather pepper cotton basket hammer ribbon saddle tunnel"
).split()


def prose(seed, words=60, per_line=20):
    """Invented prose: sentences of known words, some lines."""
    pick = random.Random(seed)
    out = [pick.choice(WORDS) + str(pick.randrange(40)) for _ in range(words)]
    lines = [" ".join(out[k : k + per_line]).capitalize() + "." for k in range(0, words, per_line)]
    return "\n".join(lines)


@pytest.fixture(scope="session")
def awkward():
    """(doc_id, text, lang, source) with nulls, empty and long texts, ties and repeated rows."""
    passage = prose("passage", 60)
    return [
        (1, prose(1), "en", "a"), (2, prose(2) + "\n" + passage, "en", "b"),
        (3, prose(3) + "\n" + passage, "de", None), (4, prose(1), "en", "a"),
        (5, None, "en", "a"), (6, "", None, ""), (7, "  \n\t ", "de", "b"),
        (8, "1234 5678 !!", "en", "c"), (9, "Éa Ñu ßx 日本 word", "fr", "c"),
        (10, " ".join(["spam"] * 400), "en", "a"), (11, "\n".join(prose(k, 500) for k in range(9)), "en", "b"),
        (12, prose(2), "de", "b"), (12, prose(2), "de", "b"), (12, "other text of the same id", "de", "b"),
        (None, prose(1), "en", "a"), (None, None, None, None),
        (13, "one two three", "en", "c"), (14, "One TWO three", "en", "c"),
    ]


@pytest.fixture(scope="session")
def awkward_docs(spark, awkward):
    """The same as a table, with further columns whose names operators use themselves."""
    schema = "doc_id long, text string, lang string, source string"
    from pyspark.sql import functions as F

    return spark.createDataFrame(awkward, schema).select(
        "*", F.lit("x").alias("key"), F.lit(0.5).alias("score"), F.lit(7).alias("size"),
        F.lit("p").alias("piece"), F.lit(1).alias("n_words"), F.lit("r").alias("rule"),
        F.lit("u").alias("own_id"), F.lit("w.x").alias("with.dot"),
    )


@pytest.fixture(scope="session")
def empty_docs(awkward_docs):
    return awkward_docs.limit(0)
