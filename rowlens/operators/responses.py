"""Bringing JSON responses of varying form into one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Defaults and the length of a title made from a plain text.
TITLE_LENGTH = 60
NOT_SPECIFIED = "Not specified."
NONE_IDENTIFIED = "None identified."
UNKNOWN_COLUMN = "Unknown"
DEFAULT_LEVEL = "Medium"
FENCE = "```"


def strip_code_fence(text: Column) -> Column:
    """The content of a fenced block, without the language mark; other text only trimmed."""
    trimmed = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    fenced = F.regexp_replace(F.get(F.split(trimmed, FENCE), F.lit(1)), "^json", "")
    inner = F.when(trimmed.startswith(FENCE), fenced).otherwise(trimmed)
    return F.regexp_replace(inner, r"^\s+|\s+$", "")


def _items(document: Column, field: str) -> Column:
    found = F.try_variant_get(document, f"$.{field}", "array<variant>")
    return F.coalesce(found, F.array().cast("array<variant>"))


def _is_text(item: Column) -> Column:
    return F.schema_of_variant(item) == "STRING"


def _is_record(item: Column) -> Column:
    return F.schema_of_variant(item).startswith("OBJECT")


def _field(item: Column, name: str) -> Column:
    return F.try_variant_get(item, f"$.{name}", "string")


def _given(item: Column, name: str) -> Column:
    """A field's text, null if absent, empty, zero or false."""
    text = _field(item, name)
    return F.when(~text.isin("", "0", "0.0", "false"), text)


def _records(document: Column, field: str, from_text: dict[str, object]) -> Column:
    """Items as records: plain texts are wrapped, records keep their fields, others are dropped."""
    def record(item: Column) -> Column:
        text = F.try_variant_get(item, "$", "string")
        return F.struct(
            *[
                F.when(_is_text(item), default(text) if callable(default) else F.lit(default))
                .otherwise(_field(item, name))
                .alias(name)
                for name, default in from_text.items()
            ]
        )

    kept = F.filter(_items(document, field), lambda i: _is_text(i) | _is_record(i))
    return F.transform(kept, record)


def _column_notes(document: Column) -> Column:
    def note(item: Column) -> Column:
        return F.struct(
            F.coalesce(_field(item, "column"), F.lit(UNKNOWN_COLUMN)).alias("column"),
            F.coalesce(
                _given(item, "purpose"), _given(item, "importance"), F.lit(NOT_SPECIFIED)
            ).alias("purpose"),
            F.coalesce(
                _given(item, "business_interpretation"), _given(item, "confidence"),
                F.lit(NOT_SPECIFIED),
            ).alias("business_interpretation"),
            F.coalesce(
                _given(item, "risk_note"), _given(item, "correlation"), F.lit(NONE_IDENTIFIED)
            ).alias("risk_note"),
        )

    return F.transform(F.filter(_items(document, "column_intelligence"), _is_record), note)


def _complete(records: Column, names: list[str]) -> Column:
    return F.forall(records, lambda r: ~F.array_contains(F.array(*[r[n].isNull() for n in names]), True))


def normalize_json_responses(df: DataFrame, text: str = "text") -> DataFrame:
    """Add story, column notes, opportunities and risks in one schema, and whether all is there.

    Text that is no JSON object gives nulls and ``valid = false``.
    """
    def head(value: Column) -> Column:
        return F.substring(value, 1, TITLE_LENGTH)

    def same(value: Column) -> Column:
        return value

    parsed = df.withColumn("__document", F.try_parse_json(strip_code_fence(F.col(text))))
    document = F.col("__document")
    is_object = F.coalesce(_is_record(document), F.lit(False))
    opportunity = {
        "title": head, "recommendation": same, "expected_impact": NOT_SPECIFIED,
        "confidence": DEFAULT_LEVEL,
    }
    risk = {"title": head, "description": same, "priority": DEFAULT_LEVEL}
    out = parsed.select(
        "*",
        F.when(is_object, _field(document, "business_story")).alias("business_story"),
        F.when(is_object, _column_notes(document)).alias("column_intelligence"),
        F.when(is_object, _records(document, "opportunities", opportunity)).alias("opportunities"),
        F.when(is_object, _records(document, "risks", risk)).alias("risks"),
    ).drop("__document")
    valid = (
        F.col("business_story").isNotNull()
        & _complete(F.col("opportunities"), list(opportunity))
        & _complete(F.col("risks"), list(risk))
    )
    return out.withColumn("valid", F.coalesce(valid, F.lit(False)))
