"""Writing cleaned tables and result tables."""

from __future__ import annotations

import re
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_cleaned(df: DataFrame, path: str, form: str = "csv") -> str:
    """The cleaned table as a folder of CSV files with headers, or as Parquet.

    Every task writes its own file, so the table never passes through one task.
    """
    if form == "csv":
        df.write.option("header", True).option("escape", '"').csv(path)
    elif form == "parquet":
        df.write.parquet(path)
    else:
        raise ValueError(f"unknown form {form}")
    return path


def write_results(results: dict[str, DataFrame], folder: str, run_id: str) -> dict[str, str]:
    """One Parquet table per kind of result, partitioned by run; the run counts from its commit on.

    All tables are written beside the visible ones first. Then one empty file commits the run, and the tables
    are moved to their places. A failure before the commit leaves what the run had written earlier; after
    it, ``read_results`` already sees the new tables. Other runs stay, and writing the same run again
    replaces its tables, so a repeated job is safe.
    """
    attempt = uuid.uuid4().hex
    for name, frame in results.items():
        frame.write.parquet(f"{folder}/{name}/{_ATTEMPT}{attempt}")
    spark = next(iter(results.values())).sparkSession if results else None
    paths = {name: f"{folder}/{name}" for name in results}
    if spark is None:
        return paths
    files, path = _files(spark, folder)
    commit = path(f"{folder}/{_RUNS}/{_escaped(run_id)}/{time.time_ns():020d}-{attempt}")
    files.create(commit, False).close()
    for name in results:
        _publish(files, path, f"{folder}/{name}", run_id, attempt)
    return paths


def _publish(files, path, table: str, run_id: str, attempt: str) -> None:
    """Move a committed table to the place where plain readers look."""
    target = path(f"{table}/run_id={_escaped(run_id)}")
    files.delete(target, True)
    if not files.rename(path(f"{table}/{_ATTEMPT}{attempt}"), target):
        raise OSError(f"cannot move the results of run {run_id} to {target}")


def read_results(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The committed results of one kind, with ``run_id``; a run that failed before its commit is not seen."""
    files, path = _files(spark, folder)
    parts = []
    runs = path(f"{folder}/{_RUNS}")
    for run in files.listStatus(runs) if files.exists(runs) else ():
        last = max(status.getPath().getName() for status in files.listStatus(run.getPath()))
        escaped, attempt = run.getPath().getName(), last.split("-")[1]
        places = (f"{folder}/{name}/{_ATTEMPT}{attempt}", f"{folder}/{name}/run_id={escaped}")
        found = next((p for p in places if files.exists(path(p))), None)
        if found:
            parts.append(spark.read.parquet(found).withColumn("run_id", F.lit(_unescaped(escaped))))
    if not parts:
        raise FileNotFoundError(f"no committed results of {name} in {folder}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# Names that Spark's readers pass over.
_ATTEMPT, _RUNS = "_attempt-", "_runs"
_SPECIAL = re.compile(r"[\x00-\x1f\"#%'*/:=?\\\x7f{\[\]^]")


def _escaped(run_id: str) -> str:
    """A run as part of a folder's name, as Spark writes values of a partition."""
    return _SPECIAL.sub(lambda m: f"%{ord(m.group()):02X}", run_id)


def _unescaped(name: str) -> str:
    return re.sub("%([0-9A-F]{2})", lambda m: chr(int(m.group(1), 16)), name)


def _files(spark: SparkSession, folder: str):
    """The file system of a folder, and its class of paths."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path
