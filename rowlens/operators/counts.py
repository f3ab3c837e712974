"""Counting values of many columns in one pass."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlens.session import column, small_table

# Characters of a text that are kept beside its hash; shorter texts need not be fetched again.
HEAD_LENGTH = 40


def _value_kind(dtype: T.DataType) -> str:
    """Common type for grouping values of several columns without losing any."""
    if isinstance(dtype, T.IntegralType):
        return "bigint"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "double"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "timestamp_ntz"
    return "string"


def present(df: DataFrame, name: str) -> Column:
    """The value, with NaN counted as missing."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.nanvl(column(name), F.lit(None).cast(df.schema[name].dataType))
    return column(name)


def unpivoted(df: DataFrame, names: list[str], kind: str) -> DataFrame:
    """Rows (place, value) with values of one type; ``place`` is the column's place in ``names``.

    A number instead of the name keeps the rows that are shuffled small.
    """
    pairs = [
        F.struct(F.lit(i).alias("place"), present(df, n).cast(kind).alias("value"))
        for i, n in enumerate(names)
    ]
    return df.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull())


def _name_of(names: list[str]) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), F.col("place")).alias("column")


def _hashes(value: Column) -> list[Column]:
    return [F.xxhash64(value), F.xxhash64(F.lit(1), value)]


def value_key(value: Column, names: tuple[str, str] = ("key", "key_too")) -> list[Column]:
    """Two independent 64-bit hashes that stand for a text when values are counted."""
    return [h.alias(name) for h, name in zip(_hashes(value), names)]


_KEY = ["place", "key", "key_too"]


def value_frequencies(df: DataFrame, names: list[str]) -> DataFrame:
    """(place, key, key_too, n, head, whole) for every distinct non-null value.

    Values are counted by hash, so no text is shuffled but its first characters; ``whole`` says
    whether these are all of it. Counts are combined before the shuffle, so a value that fills a
    third of the table costs one row per task.
    """
    value = F.col("value")
    return (
        unpivoted(df, names, "string")
        .select(
            "place", *value_key(value), F.substring(value, 1, HEAD_LENGTH).alias("head"),
            (F.length(value) <= HEAD_LENGTH).alias("whole"),
        )
        .groupBy(*_KEY)
        .agg(F.count("*").alias("n"), F.min("head").alias("head"), F.min("whole").alias("whole"))
    )


@dataclass
class _Tie:
    """Values of one column that all come ``n`` times and begin alike, of which ``needed`` are wanted.

    ``length`` characters are known to be the same in all; ``keys`` are hashes of these.
    """

    place: int
    n: int
    needed: int
    length: int
    keys: tuple[int, int]


def _leading(
    rows: DataFrame, limits: dict[int, int], order: list[Column], totals: bool = False
) -> tuple[dict[int, list[Row]], dict[int, Row]]:
    """The first rows of each place, one more than its limit; with ``totals`` also the number of values
    (``distinct``) and of rows (``n``) of each place, from the same counting.

    The limit is applied before the shuffle too, so at most that many rows of each task travel.
    """
    by_place = W.partitionBy("place").orderBy(*order, "key", "key_too")
    ranked = rows.withColumn("rank", F.row_number().over(by_place)).where(F.col("rank") <= max(limits.values()) + 1)
    if totals:
        # Reads the same columns, so that the counted values are shuffled once for both.
        whole = rows.groupBy("place").agg(
            F.count("*").alias("key"), F.min("key_too").alias("key_too"), F.sum("n").alias("n"),
            F.min("head").alias("head"), F.min("whole").alias("whole"), F.lit(0).alias("rank"),
        )
        ranked = ranked.unionByName(whole)
    found, summed = {place: [] for place in limits}, {}
    for row in sorted(ranked.collect(), key=lambda r: r["rank"]):
        if not row["rank"]:
            summed[row["place"]] = Row(distinct=row["key"], n=row["n"])
        elif row["rank"] <= limits[row["place"]] + 1:
            found[row["place"]].append(row)
    return found, summed


def _decided(rows: list[Row], limit: int, group) -> tuple[list[Row], list[Row]]:
    """The rows that are among the first ``limit`` for sure, and those that tie with one left out."""
    if len(rows) <= limit:
        return rows, []
    last = group(rows[limit])
    if group(rows[limit - 1]) != last:
        return rows[:limit], []
    return [r for r in rows if group(r) != last], [r for r in rows if group(r) == last]


def _beginning(value: Column, length: Column | int) -> Column:
    return F.substring(value, F.lit(1), F.lit(length) if isinstance(length, int) else length)


def _common_length(least: Column, most: Column) -> Column:
    """How many characters two texts have in common at their beginning, by halving."""
    both = F.least(F.length(least), F.length(most))

    def longer(length: Column, bit: Column) -> Column:
        more = length + F.call_function("shiftleft", F.lit(1), bit)
        same = F.substring(least, F.lit(1), more) == F.substring(most, F.lit(1), more)
        return F.when((more <= both) & same, more).otherwise(length)

    return F.aggregate(F.sequence(F.lit(29), F.lit(0), F.lit(-1)), F.lit(0), longer)


def _tied_rows(df: DataFrame, names: list[str], ties: list[_Tie]) -> DataFrame:
    """(place, value) of the values that begin as a tie does and go on."""
    rows = unpivoted(df.select(*[column(n) for n in names]), names, "string")
    value = F.col("value")
    begins = F.lit(False)
    for tie in ties:
        keys = zip(_hashes(_beginning(value, tie.length)), tie.keys)
        same = (F.col("place") == tie.place) & (F.length(value) > tie.length)
        begins = begins | reduce(and_, [key == F.lit(known) for key, known in keys], same)
    return rows.where(begins)


def _settled_ties(df: DataFrame, names: list[str], ties: list[_Tie]) -> list[Row]:
    """The wanted rows (place, key, key_too, n) of the ties, the smallest values of each.

    Each round finds how far all values of a tie are the same, then tells them apart by the characters
    that follow. What is shuffled are hashes and few characters, whatever the texts hold before.
    """
    found: list[Row] = []
    while ties:
        rows = _tied_rows(df, names, ties)
        ends = rows.groupBy("place").agg(F.min("value").alias("least"), F.max("value").alias("most"))
        alike = ends.select("place", "least", _common_length(F.col("least"), F.col("most")).alias("length"))
        beginning = _beginning(F.col("least"), F.col("length"))
        for place, length, *keys in alike.select("place", "length", *value_key(beginning)).collect():
            tie = next(t for t in ties if t.place == place)
            tie.length, tie.keys = length, tuple(keys)
        known = F.get(_at_places(names, {t.place: t.length for t in ties}), F.col("place"))
        wanted = F.get(_at_places(names, {t.place: t.n for t in ties}), F.col("place"))
        value = F.col("value")
        counted = (
            rows.select(
                "place", *value_key(value), F.substring(value, known + 1, F.lit(HEAD_LENGTH)).alias("head"),
                (F.length(value) <= known + HEAD_LENGTH).alias("whole"),
                *value_key(_beginning(value, known + HEAD_LENGTH), ("begins", "begins_too")),
            )
            .groupBy(*_KEY)
            .agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("head", "whole", "begins", "begins_too")])
            .where(F.col("n") == wanted)
        )
        first, _ = _leading(counted, {t.place: t.needed for t in ties}, [F.asc("head"), F.desc("whole")])
        open_ties = []
        for tie in ties:
            sure, tied = _decided(first[tie.place], tie.needed, lambda r: (r["head"], r["whole"]))
            found += sure
            if tied:
                tie.needed -= len(sure)
                tie.length += HEAD_LENGTH
                tie.keys = (tied[0]["begins"], tied[0]["begins_too"])
                open_ties.append(tie)
        ties = open_ties
    return found


def _at_places(names: list[str], values: dict[int, int]) -> Column:
    return F.array(*[F.lit(values.get(i, -1)) for i in range(len(names))])


def most_frequent(df: DataFrame, names: list[str], k: int) -> DataFrame:
    """(column, rank, value, n): the k most frequent values of each column, ties by value."""
    return frequent_and_totals(df, names, k, totals=False)[0]


def frequent_and_totals(
    df: DataFrame, names: list[str], k: int, totals: bool = True
) -> tuple[DataFrame, dict[str, Row]]:
    """The k most frequent values of each column, and per column with values ``distinct`` and ``n``.

    The heads of the texts decide which values are among them. Where more values than wanted have equal
    counts and heads, the characters after what they all share decide, round by round. Whole texts
    are fetched for at most k values of a column, and only if their head is not all of them.
    """
    limits = dict.fromkeys(range(len(names)), k)
    first, summed = _leading(
        value_frequencies(df, names), limits, [F.desc("n"), F.asc("head"), F.desc("whole")], totals
    )
    by_name = {names[place]: row for place, row in summed.items()}
    chosen, ties = [], []
    for place, rows in first.items():
        sure, tied = _decided(rows, k, lambda r: (r["n"], r["head"], r["whole"]))
        chosen += sure
        if tied:
            keys = df.sparkSession.range(1).select(*value_key(F.lit(tied[0]["head"]))).first()
            ties.append(_Tie(place, tied[0]["n"], k - len(sure), HEAD_LENGTH, tuple(keys)))
    long = [r for r in chosen if not r["whole"]] + _settled_ties(df, names, ties)
    short = [(r["place"], r["n"], r["head"]) for r in chosen if r["whole"]]
    if not long:
        rows, places = [], dict.fromkeys(range(len(names)), 0)
        for place, n, value in sorted(short, key=lambda r: (r[0], -r[1], r[2].encode())):
            places[place] += 1
            rows.append((names[place], places[place], value, n))
        return small_table(df.sparkSession, rows, "column string, rank int, value string, n bigint"), by_name
    wanted = small_table(
        df.sparkSession, [(r["place"], r["key"], r["key_too"], r["n"]) for r in long],
        "place int, key bigint, key_too bigint, n bigint",
    )
    fetched = (
        unpivoted(df, names, "string")
        .select("place", *value_key(F.col("value")), "value")
        .join(wanted, _KEY).groupBy(*_KEY, "n").agg(F.min("value").alias("value"))
        .select("place", "n", "value")
    )
    order = W.partitionBy("place").orderBy(F.desc("n"), F.asc("value"))
    top = (
        small_table(df.sparkSession, short, "place int, n bigint, value string").unionAll(fetched)
        .select(_name_of(names), F.row_number().over(order).alias("rank"), "value", "n")
    )
    return top, by_name


def distinct_counts(df: DataFrame, names: list[str], approx: bool = False) -> DataFrame:
    """(column, distinct_count) of the non-null values; texts are told apart by 128-bit hashes."""
    if approx:
        pairs = df.agg(
            *[F.approx_count_distinct(present(df, n), 0.01).alias(f"c{i}") for i, n in enumerate(names)]
        )
        return pairs.select(
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(n).alias("column"), F.col(f"c{i}").alias("distinct_count"))
                        for i, n in enumerate(names)
                    ]
                )
            )
        )
    by_kind: dict[str, list[str]] = {}
    for name in names:
        by_kind.setdefault(_value_kind(df.schema[name].dataType), []).append(name)
    counted = None
    for kind, members in by_kind.items():
        counted_by = value_key(F.col("value")) if kind == "string" else [F.col("value")]
        part = (
            unpivoted(df, members, kind)
            .groupBy("place")
            .agg(F.countDistinct(*counted_by).alias("distinct_count"))
            .select(_name_of(members), "distinct_count")
        )
        counted = part if counted is None else counted.unionByName(part)
    names_frame = small_table(df.sparkSession, [(n,) for n in names], "column string")
    # Columns without any value produce no group.
    return names_frame.join(counted, "column", "left").select(
        "column", F.coalesce("distinct_count", F.lit(0)).cast("bigint").alias("distinct_count")
    )
