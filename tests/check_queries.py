"""Compare registered queries with their SQL: names, types and every value."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')"
        )
    return connection


def ordered(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: [(v is None, type(v).__name__, repr(v)) for v in r])


def differences(frame, relation) -> list[str]:
    """What differs between a Spark result and a relation; empty if nothing does."""
    problems = []
    names = sorted(frame.columns)
    if names != sorted(relation.columns):
        return [f"columns {names} / {sorted(relation.columns)}"]
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    for name, kind in frame.dtypes:
        if TYPES.get(kind) != kinds[name]:
            problems.append(f"type of {name}: {kind} / {kinds[name]}")
    left = ordered([tuple(r[n] for n in names) for r in frame.collect()])
    place = [relation.columns.index(n) for n in names]
    right = ordered([tuple(r[i] for i in place) for r in relation.fetchall()])
    if len(left) != len(right):
        problems.append(f"rows {len(left)} / {len(right)}")
    wrong = [(a, b) for a, b in zip(left, right) if repr(a) != repr(b)]
    if any(isinstance(v, float) and math.isnan(v) for r in left for v in r):
        problems.append("NaN in the result")
    if wrong:
        problems.append(f"{len(wrong)} rows differ, first {wrong[0]}")
    return problems


if __name__ == "__main__":
    from rowlens.catalog import QUERIES
    from rowlens.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    chosen = sys.argv[1:] or list(QUERIES)
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(folder)
    failed = 0
    for name in chosen:
        query, start = QUERIES[name], time.time()
        try:
            found = query.run(spark, folder)
            problems = differences(found, connection.sql(query.oracle()))
            count = connection.sql(query.oracle()).count("*").fetchall()[0][0]
        except Exception as error:  # the check goes on with the next query
            problems, count = [f"{type(error).__name__}: {str(error)[:900]}"], -1
        failed += bool(problems)
        state = "FAIL" if problems else "ok"
        print(f"{state:4} {name:30} {time.time() - start:6.2f}s rows={count}", *problems, flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} agree")
