"""Named queries on the test tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlens.session import column, run_together


class Tables:
    """The test tables of one scale, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, sql: str, *names: str) -> DataFrame:
        """A SELECT over test tables, written so that both engines understand it."""
        for name in names:
            sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
        return self.spark.sql(sql, **{name: self[name] for name in names})


@dataclass(frozen=True)
class Query:
    """A query, the columns it returns and the check.

    ``columns`` names each output column with its kind: ``i`` whole number, ``s`` text, ``b``
    boolean, or a digit for a double rounded to that many decimals. Both sides are brought into
    this form, since sums of doubles differ in the last bits between engines.
    """

    name: str
    columns: str
    build: Callable[[Tables], DataFrame]
    sql: str | None = None

    def _kinds(self) -> list[tuple[str, str]]:
        return [tuple(part.rsplit(":", 1)) for part in self.columns.split()]

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        types = {"i": "bigint", "s": "string", "b": "boolean"}
        frame = self.build(Tables(spark, folder))
        return frame.select(
            *[
                (
                    column(n).cast(types[k]) if k in types
                    else F.round(column(n).cast("double"), int(k))
                ).alias(n)
                for n, k in self._kinds()
            ]
        )

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        types = {"i": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN"}
        shown = [
            f'CAST("{n}" AS {types[k]}) AS "{n}"' if k in types
            # Adding zero turns a negative zero into zero.
            else f'round(CAST("{n}" AS DOUBLE), {k}) + CAST(0 AS DOUBLE) AS "{n}"'
            for n, k in self._kinds()
        ]
        return f"SELECT {', '.join(shown)} FROM ({self.sql}) AS checked"


def union_all(parts) -> str:
    return "\nUNION ALL\n".join(f"SELECT * FROM ({p})" for p in parts)


def stacked(
    parts: dict[str, DataFrame | Callable[[], DataFrame]], name: str = "table_name"
) -> DataFrame:
    """Union of frames of one shape, each marked with its key.

    Frames that take a job to build are given as functions and built at the same time.
    """
    to_build = {key: part for key, part in parts.items() if callable(part)}
    if to_build:
        built = run_together(SparkSession.active(), to_build)
        parts = {key: built.get(key, part) for key, part in parts.items()}
    result = None
    for key, frame in parts.items():
        frame = frame.select(F.lit(key).alias(name), "*")
        result = frame if result is None else result.unionByName(frame)
    return result
