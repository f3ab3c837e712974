"""The profile of a table as text against its SQL, on figures that end at the edge of a rounding."""

from __future__ import annotations

import duckdb
import pytest
from check_queries import differences

from rowlens.catalog import QUERIES

CASES = {
    # The third quartile lies three quarters between two prices an odd number of cents apart; a share of 1/6.
    "quartile": [0.0, 5.0, 9.0, 130417.65, 130417.68, 200000.0],
    # The mean is 10.00046 and the skewness just below zero.
    "mean": [10.00046 - 3.00001, 10.00046, 10.00046 + 3.00001] * 20 + [9.96046, 10.04046 - 1e-4, 10.00046 + 1e-4],
}


@pytest.mark.parametrize("case", CASES)
def test_dataset_profile_equals_sql_at_rounding_edges(spark, tmp_path, case):
    prices = CASES[case]
    connection = duckdb.connect()
    connection.execute(
        f"""CREATE TABLE orders AS SELECT row_number() OVER () AS o_orderkey, 7 AS o_custkey, '5' AS o_orderstatus,
        unnest({prices}::DOUBLE[]) AS o_totalprice, TIMESTAMP '1995-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority"""
    )
    connection.execute(f"COPY orders TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    query = QUERIES["dataset_profile"]
    assert differences(query.run(spark, str(tmp_path)), connection.sql(query.oracle())) == []
