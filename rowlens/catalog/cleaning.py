"""Queries of the cleaning operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.catalog import sql
from rowlens.catalog.registry import Query, Tables
from rowlens.catalog.views import DIRTY
from rowlens.functions.numbers import is_formatted_number, to_number
from rowlens.operators import cleaning as c


def _dirty(t: Tables) -> DataFrame:
    return t.view(DIRTY, "orders")


_ROWS = (
    "o_orderkey:i price_txt:s status:s price:2 odate:s near_num:s signed_num:s empty_col:2 "
    "const_col:s"
)
CLEAN_COLUMNS = (
    "o_orderkey:i price_txt:4 status:s price:4 odate:s near_num:4 signed_num:4 empty_col:2 "
    "const_col:s"
)
_DISTINCT = f"SELECT DISTINCT * FROM ({DIRTY})"
_NUMBERS = f"""SELECT o_orderkey, {sql.from_formatted('price_txt')} AS price_txt, status, price,
    odate, {sql.from_formatted('near_num')} AS near_num, {sql.to_number('signed_num')} AS signed_num,
    empty_col, const_col, signed_num AS signed_txt FROM ({_DISTINCT})"""
_FILL = "coalesce({c}, (SELECT coalesce(median({c}), 0) FROM {rel})) AS {c}"
CLEAN_SQL = f"""WITH numbers AS ({_NUMBERS})
    SELECT o_orderkey, {', '.join(_FILL.format(c=n, rel='numbers') for n in
                                  ('price_txt', 'price', 'near_num', 'signed_num', 'empty_col'))},
    coalesce(status, 'Unknown') AS status, odate, const_col FROM numbers"""


def _action(column: str, action: str, strategy: str, fill: str, n: str) -> str:
    return f"""SELECT {column} AS "column", '{action}' AS action, {strategy} AS strategy,
        {fill} AS fill_value, {n} AS n_affected FROM numbers"""


_REPORT = f"""WITH numbers AS ({_NUMBERS}), raw AS ({DIRTY})
    SELECT NULL AS "column", 'rows_before' AS action, NULL AS strategy, NULL AS fill_value,
        count(*) AS n_affected FROM raw
    UNION ALL SELECT NULL, 'rows_after', NULL, NULL, count(*) FROM numbers
    UNION ALL SELECT NULL, 'duplicates_removed', NULL, NULL,
        (SELECT count(*) FROM raw) - (SELECT count(*) FROM numbers)
    UNION ALL """ + " UNION ALL ".join(
    [
        _action(f"'{n}'", "conversion", f"'{how}'", "NULL", f"count({n})")
        for n, how in (
            ("price_txt", "formatted_string_to_numeric"),
            ("near_num", "formatted_string_to_numeric"),
            ("signed_num", "object_to_numeric"),
        )
    ]
    + [
        _action(
            f"'{n}'", "missing", "'median_fill'",
            f"CAST(coalesce(median({n}), 0) AS DOUBLE)::VARCHAR", f"count_if({n} IS NULL)",
        )
        for n in ("price_txt", "price", "near_num", "empty_col")
    ]
    + [
        _action("'signed_num'", "missing", "'constant_fill'", "'Unknown'",
                "count_if(signed_txt IS NULL)"),
        _action("'status'", "missing", "'constant_fill'", "'Unknown'", "count_if(status IS NULL)"),
        _action("'odate'", "missing", "'retained_nat'", "'NaT'", "count_if(odate IS NULL)"),
    ]
)

QUERIES = [
    Query("drop_duplicates", _ROWS, lambda t: c.drop_duplicates(_dirty(t)), _DISTINCT),
    Query(
        "is_formatted_number", "o_orderkey:i price_txt:b near_num:b signed_num:b status:b",
        lambda t: _dirty(t).select(
            "o_orderkey",
            *[is_formatted_number(F.col(n)).alias(n)
              for n in ("price_txt", "near_num", "signed_num", "status")],
        ),
        "SELECT o_orderkey, " + ", ".join(
            f"regexp_full_match(trim({n}), '{sql.FORMATTED}') AS {n}"
            for n in ("price_txt", "near_num", "signed_num", "status")
        ) + f" FROM ({DIRTY})",
    ),
    Query(
        "formatted_text_to_number", "o_orderkey:i price_txt:2 near_num:2 signed_num:s status:s",
        lambda t: c.formatted_text_to_numbers(_dirty(t)),
        f"""SELECT o_orderkey, {sql.from_formatted('price_txt')} AS price_txt,
            {sql.from_formatted('near_num')} AS near_num, signed_num, status FROM ({DIRTY})""",
    ),
    Query(
        "fill_numeric_median", "o_orderkey:i price:4 empty_col:4",
        lambda t: c.fill_numeric_median(_dirty(t), ["price", "empty_col"]),
        f"""WITH d AS ({DIRTY}) SELECT o_orderkey, {_FILL.format(c='price', rel='d')},
            {_FILL.format(c='empty_col', rel='d')} FROM d""",
    ),
    Query(
        "fill_text_unknown", "o_orderkey:i price_txt:s status:s near_num:s signed_num:s const_col:s",
        lambda t: c.fill_text_unknown(_dirty(t)),
        "SELECT o_orderkey, " + ", ".join(
            f"coalesce({n}, 'Unknown') AS {n}"
            for n in ("price_txt", "status", "near_num", "signed_num", "const_col")
        ) + f" FROM ({DIRTY})",
    ),
    Query(
        "keep_null_dates", "column:s n_missing:i", lambda t: c.missing_dates(_dirty(t)),
        f"""SELECT 'odate' AS "column", count_if(odate IS NULL) AS n_missing FROM ({DIRTY})""",
    ),
    Query(
        "near_numeric_text_to_number", "o_orderkey:i signed_num:4 near_num:s status:s",
        lambda t: c.near_numeric_text_to_numbers(_dirty(t)),
        f"""WITH d AS (SELECT o_orderkey, near_num, status,
            {sql.to_number('signed_num')} AS signed_num FROM ({DIRTY}))
            SELECT o_orderkey, near_num, status, {_FILL.format(c='signed_num', rel='d')} FROM d""",
    ),
    Query(
        "cleaning_report", "column:s action:s strategy:s fill_value:s n_affected:i",
        lambda t: c.cleaning_report(_dirty(t)), _REPORT,
    ),
    Query("clean", CLEAN_COLUMNS, lambda t: c.clean(_dirty(t)), CLEAN_SQL),
    Query(
        "drop_null_rows_on", _ROWS, lambda t: c.drop_null_rows_on(_dirty(t), ["odate", "price"]),
        f"SELECT * FROM ({DIRTY}) WHERE odate IS NOT NULL AND price IS NOT NULL",
    ),
    Query(
        "to_number_lenient", "o_orderkey:i near_num:2 signed_num:2 price_txt:2 suffixed:2 spaced:2",
        lambda t: _dirty(t).select(
            "o_orderkey",
            *[to_number(F.col(n)).alias(n) for n in ("near_num", "signed_num", "price_txt")],
            to_number(F.concat("near_num", F.lit("d"))).alias("suffixed"),
            to_number(F.concat(F.lit(" "), "near_num", F.lit("e1 "))).alias("spaced"),
        ),
        f"""SELECT o_orderkey, {sql.to_number('near_num')} AS near_num,
            {sql.to_number('signed_num')} AS signed_num, {sql.to_number('price_txt')} AS price_txt,
            {sql.to_number("concat(near_num, 'd')")} AS suffixed,
            {sql.to_number("concat(' ', near_num, 'e1 ')")} AS spaced FROM ({DIRTY})""",
    ),
]
