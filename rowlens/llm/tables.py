"""Small helpers for tables of texts: bounded batches, held-out rows, partitions."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of the Arrow batches handed back.
OUT_ROWS = 65_536


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(id_column: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder by ``folds``; false for a null id."""
    remainder = F.crc32(F.col(id_column).cast("string").cast("binary")) % folds
    return F.coalesce(remainder == 0, F.lit(False))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def extended(schema: StructType, more: str) -> StructType:
    """The schema with further fields."""
    return StructType(schema.fields + StructType.fromDDL(more).fields)


def numbered_columns(df: DataFrame) -> DataFrame:
    """The same table with columns ``c0``, ``c1``, ...: names can neither clash nor hold dots."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def in_batches(table: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from table.combine_chunks().to_batches(max_chunksize=OUT_ROWS)


def texts_of(column: pa.Array) -> Iterator[str | None]:
    """The texts one after the other, so that they are not all Python objects at once."""
    return (text.as_py() for text in column)


def _give_back() -> None:
    """Return freed memory to the system; both allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work`` for ``mapInArrow`` that returns its memory after every batch.

    Spark keeps Python workers for later tasks, so what they hold on to adds up beside the next stages.
    """

    def returning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            _give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(returning(batches))
        _give_back()

    return run
