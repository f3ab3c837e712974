"""Aggregate expressions that Spark does not offer in the wanted form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(col: Column) -> Column:
    """Bias-corrected skewness; 0 for constant data and for fewer than three values."""
    n = F.count(col).cast("double")
    corrected = F.skewness(col) * F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when(F.count(col) > 2, F.coalesce(corrected, F.lit(0.0))).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part, whole) * 100.0, F.lit(0.0))


def health_score(missing_pct: Column, duplicate_pct: Column, empty_pct: Column, constant_pct: Column) -> Column:
    """100 minus four capped penalties, kept within 0 and 100."""
    penalty = (
        F.least(F.lit(35.0), missing_pct * 0.7)
        + F.least(F.lit(25.0), duplicate_pct * 0.5)
        + F.least(F.lit(25.0), empty_pct)
        + F.least(F.lit(15.0), constant_pct * 0.5)
    )
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - penalty)), 2)


def health_grade(score: Column) -> Column:
    grade = F.lit("F")
    for letter, floor in (("D", 40), ("C", 60), ("B", 75), ("A", 90)):
        grade = F.when(score >= floor, letter).otherwise(grade)
    return grade


def correlation_strength(r: Column) -> Column:
    size = F.abs(r)
    return F.when(size >= 0.7, "Strong").when(size >= 0.4, "Medium").otherwise("Weak")


def confidence_band(r: Column) -> Column:
    size = F.abs(r)
    return F.when(size > 0.7, "High").when(size >= 0.4, "Medium").otherwise("Low")
