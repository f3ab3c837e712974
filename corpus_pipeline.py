"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that the one before kept and returns a table; all but the last return the
columns of documents. Between stages tables are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlens.llm import language_id, mixing, packing, simhash, substrings
from rowlens.llm.tables import held_out, numbered_columns, read_table
from rowlens.session import stage_table

#: SQL can express neither the fingerprints nor the token ids; tests compare with a plain version.
ORACLE_SQL = None


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents in their order, the length fitting the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; null texts and texts without a letter go."""
    learning = docs.where(~held_out() & F.col("doc_id").isNotNull())
    return language_id.keep_identified(docs, learning)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return simhash.keep_first(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that an earlier one has in a window of 13; none left: they go."""
    # Numbered names cannot clash with the counts that are added.
    plain = numbered_columns(docs)
    own, text = (f"c{docs.columns.index(name)}" for name in ("doc_id", "text"))
    cut = substrings.remove_repeats(plain, own, text)
    left = cut.where((F.col("n_words") == 0) | (F.col("n_removed") < F.col("n_words")))
    return _with_length(left.select(*plain.columns).toDF(*docs.columns), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; a document that is taken twice comes twice."""
    return _with_length(mixing.mixed_texts(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("source_mixing", mix_sources),
    ("best_two_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    table = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        table = stage_table(stage(spark, table, sf_dir), name)
    return STAGES[-1][1](spark, table, sf_dir)
