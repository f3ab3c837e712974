"""Token ids in Parquet list columns, in id order, for selective reads.

A file holds the documents of one range of ids in ascending order: id, file number, ids of the file
before the document, number of ids, and the ids as a list column with dictionary (or delta) encoding.
Row groups and pages are kept small and have page indexes, so a reader fetches the metadata columns
without the tokens, or the tokens of a few documents without the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowlens.llm.tables import extended, frugal, in_batches, shuffle_partitions, texts_of
from rowlens.llm.tokens import END_ID, VOCABULARY, encoded

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 1 << 20
PAGE_ROWS = 1000
#: Ids handed back from Python at once.
_BATCH_IDS = 1 << 20


def write_token_files(
    docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text",
    vocabulary: str = VOCABULARY, end: int = END_ID, files: int | None = None, delta: bool = False,
) -> str:
    """Encode every text (null: empty) with the end id and write the files; returns the path.

    Ids ascend over the files, null ids first; rows of one id follow a hash of their text, so a
    repeated or null id may be spread over several files. ``delta`` chooses delta encoding in place of
    a dictionary of ids.
    """
    plain = docs.select(F.col(f"`{id_column}`").alias("own_id"), F.col(f"`{text}`").alias("text"))
    keys = [F.col("own_id"), F.xxhash64("text")]
    sorted_rows = (
        plain.repartitionByRange(files or shuffle_partitions(docs.sparkSession), *keys)
        .sortWithinPartitions(*keys)
        .select("own_id", F.spark_partition_id().alias("file"), "text")
    )
    schema = extended(sorted_rows.drop("text").schema, "before long, n_tokens long, ids array<int>")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            first, lengths, parts, held = 0, [], [], 0

            def ready() -> Iterator[pa.RecordBatch]:
                edges = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                ids = pa.array(np.frombuffer(b"".join(parts), "<u4").view(np.int32))
                yield from in_batches(
                    pa.table(
                        {
                            "own_id": batch.column(0).slice(first, len(lengths)),
                            "file": batch.column(1).slice(first, len(lengths)),
                            "before": before - edges[-1] + edges[:-1], "n_tokens": np.diff(edges),
                            "ids": pa.ListArray.from_arrays(edges.astype(np.int32), ids),
                        }
                    )
                )

            for ids in encoded(texts_of(batch.column(2)), vocabulary, end):
                parts.append(ids)
                lengths.append(len(ids) // 4)
                held += lengths[-1]
                before += lengths[-1]
                if held >= _BATCH_IDS:
                    yield from ready()
                    first, lengths, parts, held = first + len(lengths), [], [], 0
            if lengths:
                yield from ready()

    options = {
        "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES,
        "parquet.page.row.count.limit": PAGE_ROWS, "parquet.enable.dictionary": str(not delta).lower(),
        "parquet.writer.version": "v2" if delta else "v1", "compression": "zstd",
    }
    sorted_rows.mapInArrow(frugal(work), schema).withColumnRenamed("own_id", id_column).write.options(
        **options
    ).parquet(path)
    return path


def read_starts(spark: SparkSession, path: str, id_column: str = "doc_id") -> DataFrame:
    """Id, ``file``, ``before``, ``n_tokens`` and ``start`` (ids of all documents before) without the ids.

    ``start`` adds the totals of the files before; there is one total per file.
    """
    meta = spark.read.parquet(path).select(id_column, "file", "before", "n_tokens")
    return meta.join(_file_starts(meta), "file").withColumn("start", F.col("before") + F.col("file_start"))


def _file_starts(meta: DataFrame) -> DataFrame:
    totals = meta.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    return totals.select(
        "file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("file_start")
    )


def read_checksums(spark: SparkSession, path: str, id_column: str = "doc_id") -> DataFrame:
    """Id, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, from the files.

    The checksum covers the ids as unsigned little-endian 32-bit numbers.
    """
    table = spark.read.parquet(path)
    schema = extended(table.select(id_column, "file", "before").schema, "n_tokens long, ids_crc32 long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            edges = lists.offsets.to_numpy()
            flat = lists.values.to_numpy().astype("<u4")
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.diff(edges).astype(np.int64)), pa.array(sums, pa.int64())],
                schema.names,
            )

    found = table.select(id_column, "file", "before", "ids").mapInArrow(work, schema)
    return found.join(_file_starts(table), "file").select(
        id_column, (F.col("before") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_tokens(spark: SparkSession, path: str, ids: list, id_column: str = "doc_id") -> DataFrame:
    """Id and token ids of the listed documents; the filter reaches row groups and pages."""
    return spark.read.parquet(path).where(F.col(id_column).isin(ids)).select(id_column, "ids")
