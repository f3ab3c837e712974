"""Column expressions for text that holds numbers, and for numbers shown as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of a missing value in text files.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Number syntax.
INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"
NUMBER_TEXT = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
BOOLEAN_TEXTS = ("True", "TRUE", "true", "False", "FALSE", "false")
# Optional currency sign, optional minus, digits plain or in groups of three, decimals, percent.
FORMATTED_NUMBER_TEXT = r"^[$€£¥]?\s*-?(\d{1,3}(,\d{3})*|\d+)(\.\d+)?%?$"
NUMBER_DECORATION = "$€£¥,%"


def null_token_to_null(col: Column) -> Column:
    return F.when(~col.isin(*NULL_TOKENS), col)


def is_formatted_number(col: Column) -> Column:
    return F.trim(col).rlike(FORMATTED_NUMBER_TEXT)


def is_number(col: Column) -> Column:
    return col.rlike(NUMBER_TEXT)


def to_number(col: Column) -> Column:
    """Text to double, null where the text is not a plain number.

    The pattern guard is needed: a bare cast also takes ``5d`` and ``NaN``, and is slow to refuse.
    """
    return F.when(is_number(col), F.trim(col).try_cast("double"))


def strip_number_decoration(col: Column) -> Column:
    return F.trim(F.translate(col, NUMBER_DECORATION, ""))


def formatted_text_to_number(col: Column) -> Column:
    """``$1,234`` to 1234 and ``12%`` to 12."""
    return to_number(strip_number_decoration(col))


def finite_or_null(col: Column) -> Column:
    """NaN and the infinities become null."""
    return F.when(~F.isnan(col) & (F.abs(col) != float("inf")), col)


def fixed(col: Column, digits: int, grouped: bool = True) -> Column:
    """Fixed-point text, rounded on the exact binary value."""
    text = F.format_number(col.cast("double"), digits)
    return text if grouped else F.regexp_replace(text, ",", "")


def compact_number(col: Column) -> Column:
    """Short form for chart labels: 1.23B, 4.56M, 7.8K, 999 or 0.25."""
    value, size = col.cast("double"), F.abs(col.cast("double"))
    return (
        F.when(size >= 1e9, F.concat(fixed(value / 1e9, 2, False), F.lit("B")))
        .when(size >= 1e6, F.concat(fixed(value / 1e6, 2, False), F.lit("M")))
        .when(size >= 1e3, F.concat(fixed(value / 1e3, 1, False), F.lit("K")))
        .when(value == F.floor(value), fixed(value, 0))
        .otherwise(fixed(value, 2))
    )


def display_number(col: Column) -> Column:
    """Table form: below ten up to three decimals, whole numbers grouped, else two decimals."""
    value = col.cast("double")
    return (
        F.when(F.abs(value) < 10, F.regexp_replace(fixed(value, 3), r"\.?0+$", ""))
        .when(value == F.floor(value), fixed(value, 0))
        .otherwise(fixed(value, 2))
    )


def title_label(col: Column) -> Column:
    """``unit_price`` to ``Unit Price``; every run of letters starts with a capital."""
    runs = F.regexp_extract_all(F.replace(col, F.lit("_"), F.lit(" ")), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def sanitized(col: Column, dtype: str) -> Column:
    """Value as the profile shows it: finite, four decimals, times as text."""
    if dtype in ("double", "float") or dtype.startswith("decimal"):
        return F.round(finite_or_null(col.cast("double")), 4)
    if dtype in ("tinyint", "smallint", "int", "bigint"):
        return col.cast("bigint")
    return col.cast("string")
