"""Spark session settings, shared scratch space and small-result helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Result tables (one row per column, pair or category) up to this many rows are held as local data;
# larger ones are written.
SMALL_RESULT_ROWS = 10_000
JOBS_TOGETHER = 8

_local_folders: dict[str, str] = {}


def build_session(app: str = "rowlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    On a cluster the master and the sizes come from spark-submit; adaptive execution then
    sizes shuffle partitions from the measured volume.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Recording a call site for every column expression makes wide plans slow to build.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="rowlens-")
    return _local_folders[context.applicationId]


def _scratch_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/rowlens/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's part of the shared folder."""
    return f"{_scratch_folder(spark)}/{uuid.uuid4().hex}/{name}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all tables this application has staged; results that still read them fail afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage_table(df: DataFrame, name: str = "staged") -> DataFrame:
    """Cut the lineage of ``df`` by writing it to the shared folder and reading it back.

    Unlike a checkpointed or persisted frame, the written table survives lost executors and
    still lets later passes read only the columns they need.
    """
    path = scratch_path(df.sparkSession, f"{name}.parquet")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pin(df: DataFrame, max_rows: int = SMALL_RESULT_ROWS) -> DataFrame:
    """Compute a result table once, so that what builds on it does not run it again.

    Up to ``max_rows`` rows are held as local data, more are written to the shared folder.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return stage_table(df, "result")
    return df.sparkSession.createDataFrame(rows, df.schema)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A result of a few driver-side rows as local data."""
    fields = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    arrays = [pa.array(values, type=f.type) for values, f in zip(columns, fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=fields))


def run_together(spark: SparkSession, tasks: dict[Any, Callable[[], Any]]) -> dict[Any, Any]:
    """Run independent driver-side steps at the same time, so that their jobs share the cluster."""
    if len(tasks) < 2:
        return {key: task() for key, task in tasks.items()}
    with ThreadPoolExecutor(min(JOBS_TOGETHER, len(tasks))) as pool:
        running = {
            key: pool.submit(inheritable_thread_target(spark)(task)) for key, task in tasks.items()
        }
        return {key: future.result() for key, future in running.items()}


def beside(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Put one-row frames with different columns side by side in one row.

    A union followed by one ``max`` per column; nulls lose against the frame that has the column.
    """
    stacked = first
    for other in others:
        stacked = stacked.unionByName(other, allowMissingColumns=True)
    return stacked.agg(*[F.max(quoted(name)).alias(name) for name in stacked.columns])


def quoted(name: str) -> str:
    """Column name as an identifier, safe for blanks, dots and backticks."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str):
    return F.col(quoted(name))
