"""Reading dates from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.operators.roles import text_names
from rowlens.session import column

# Name parts that mark a possible date column.
DATE_HINTS = ("date", "time", "day", "month", "year", "dt", "timestamp", "period", "quarter")
# Names of months and days.
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
    "november", "december",
)
SHORT_MONTHS = {name[:3]: k for k, name in enumerate(MONTHS, 1)} | {"sept": 9}
WEEKDAY = r"^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,? +"
# A clock after the day: hours, minutes, seconds with a fraction, and the half of the day; or digits only.
CLOCK = r"[ t]+(\d{1,2}):(\d{2})(?::(\d{2}(?:[.,]\d{1,6})?)\d*)? ?([ap]m)?$"
DIGIT_CLOCK = r"(?<=^\d{8})t?(\d{2})(\d{2})(\d{2})$"
# Two or three parts with marks between them.
DAY_SHAPE = r"^[a-z0-9]+([-/.]|,? )[a-z0-9]+(([-/.]|,? )[a-z0-9]+)?$"
DAY_MARKS = r"[-/., ]+"
PLAIN_DAY = r"^(\d{1,2}[-/.]\d{1,2}[-/.](\d{2}|\d{4})|[1-9]\d{3}[-/.]\d{1,2}[-/.]\d{1,2})$"
DIGIT_DAY = r"^(19|20)\d{6}$"
QUARTER = r"^(\d{4})-?q([1-4])$"
# Two-digit years from here on belong to the last century.
SHORT_YEAR_BEFORE_2000 = 69
PARSED_SHARE = 0.8


# The expressions below are SQL text: they name many intermediate values, and text is parsed far faster than
# that many nodes are made one by one.
_MONTHS = "map({})".format(
    ", ".join(f"'{n}', {k}" for n, k in ({n: k for k, n in enumerate(MONTHS, 1)} | SHORT_MONTHS).items())
)


def _let(name: str, value: str, body: str) -> str:
    """``body``, in which ``name`` stands for ``value``, computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _applied(text: Column, name: str, body: str) -> Column:
    return F.get(F.call_function("transform", F.array(text), F.expr(f"{name} -> {body}")), 0)


def _number(part: str, pattern: str) -> str:
    return f"CASE WHEN rlike({part}, r'{pattern}') THEN try_cast({part} AS INT) END"


def _month(part: str) -> str:
    return f"try_element_at({_MONTHS}, {part})"


def _century(short: str) -> str:
    return f"({short} + CASE WHEN {short} >= {SHORT_YEAR_BEFORE_2000} THEN 1900 ELSE 2000 END)"


def _year(part: str) -> str:
    """Four digits, or two."""
    number = f"try_cast({part} AS INT)"
    return (
        f"CASE WHEN rlike({part}, r'^\\d{{4}}$') THEN {number} "
        f"WHEN rlike({part}, r'^\\d{{2}}$') THEN {_century(number)} END"
    )


def _small(part: str) -> str:
    """One or two digits."""
    return _number(part, r"^\d{1,2}$")


def _plain_numbers(parts: str) -> str:
    """Whether the day is written as two small numbers and a year."""
    first, second, third = (f"get({parts}, {k})" for k in range(3))
    small = r"r'^\d{1,2}$'"
    year = r"r'^(\d{2}|\d{4})$'"
    return f"(size({parts}) = 3 AND rlike({first}, {small}) AND rlike({second}, {small}) AND rlike({third}, {year}))"


def _day(year: str, month: str, day: str) -> str:
    return f"named_struct('year', {year}, 'month', {month}, 'day', {day})"


def _of_parts(parts: str, day_first: bool) -> str:
    """(year, month, day) of a day written in two or three parts; nulls if it is none."""
    first, second, third = (f"get({parts}, {k})" for k in range(3))
    # A number above 12 can only be the day.
    leads = "b <= 12" if day_first else "a > 12"
    four = r"r'^\d{4}$'"
    three = f"""CASE
        WHEN {_plain_numbers(parts)} AND {leads} THEN {_day(_year(third), 'b', 'a')}
        WHEN {_plain_numbers(parts)} THEN {_day(_year(third), 'a', 'b')}
        WHEN rlike({first}, {four}) THEN {_day(_year(first), f'coalesce(b, {_month(second)})', _small(third))}
        WHEN {_month(second)} IS NOT NULL THEN {_day(_year(third), _month(second), 'a')}
        WHEN {_month(first)} IS NOT NULL THEN {_day(_year(third), _month(first), 'b')} END"""
    two = f"""CASE
        WHEN rlike({second}, {four}) THEN {_day(_year(second), f'coalesce(a, {_month(first)})', '1')}
        WHEN rlike({first}, {four}) THEN {_day(_year(first), f'coalesce(b, {_month(second)})', '1')} END"""
    body = f"CASE WHEN size({parts}) = 3 THEN {three} WHEN size({parts}) = 2 THEN {two} END"
    return _let("a", _small(first), _let("b", _small(second), body))


def _day_text(lowered: str) -> str:
    """The text without its clock, weekday and the endings of numbers."""
    day = f"regexp_replace({lowered}, r'{CLOCK}|{DIGIT_CLOCK}', '')"
    return rf"regexp_replace(regexp_replace({day}, r'{WEEKDAY}', ''), r'(?<=\d)(st|nd|rd|th)(?=[ ,])', '')"


def _day_parts(day: str) -> str:
    return f"CASE WHEN rlike({day}, r'{DAY_SHAPE}') THEN split({day}, r'{DAY_MARKS}') END"


def _time_of(lowered: str, day: str) -> str:
    """Hour, minute and second; midnight without a clock, null where the clock is wrong."""
    hour, minute, second, half = (f"nullif(regexp_extract({lowered}, r'{CLOCK}', {k}), '')" for k in range(1, 5))
    digits = [f"try_cast(regexp_extract({lowered}, r'{DIGIT_CLOCK}', {k}) AS INT)" for k in (1, 2, 3)]

    def whole(hour: str, minute: str, second: str) -> str:
        return f"named_struct('hour', {hour}, 'minute', {minute}, 'second', CAST({second} AS DECIMAL(16, 6)))"

    in_half = f"CASE WHEN h BETWEEN 1 AND 12 THEN h % 12 + CASE WHEN {half} = 'pm' THEN 12 ELSE 0 END END"
    clock = whole(
        f"CASE WHEN {half} IS NULL THEN h ELSE {in_half} END", f"try_cast({minute} AS INT)",
        f"coalesce(try_cast(replace({second}, ',', '.') AS DECIMAL(16, 6)), 0)",
    )
    return f"""CASE WHEN {lowered} = {day} THEN {whole('0', '0', '0')}
        WHEN rlike({lowered}, r'{CLOCK}') THEN {_let('h', f'try_cast({hour} AS INT)', clock)}
        WHEN rlike({lowered}, r'{DIGIT_CLOCK}') THEN {whole(*digits)}
        ELSE {whole('0', '0', '0')} END"""


def _plain_day(text: str, day_first: bool) -> str:
    """A day of three numbers without anything else, the usual case, at the cost of one split."""
    leads = "n[1] <= 12" if day_first else "n[0] > 12"
    year = f"CASE WHEN n[2] < 100 THEN {_century('n[2]')} ELSE n[2] END"
    body = f"""CASE WHEN n[0] > 31 THEN try_make_timestamp_ntz(n[0], n[1], n[2], 0, 0, 0)
        WHEN {leads} THEN try_make_timestamp_ntz({year}, n[1], n[0], 0, 0, 0)
        ELSE try_make_timestamp_ntz({year}, n[0], n[1], 0, 0, 0) END"""
    return _let("n", f"transform(split({text}, '[-/.]'), part -> try_cast(part AS INT))", body)


def _written_time(lowered: str, day_first: bool) -> str:
    """A day in any known spelling, perhaps with a clock."""
    digits = _day(*[f"try_cast(substring(day, {first}, {size}) AS INT)" for first, size in ((1, 4), (5, 2), (7, 2))])
    quarter = _day(
        f"try_cast(regexp_extract(day, r'{QUARTER}', 1) AS INT)",
        f"try_cast(regexp_extract(day, r'{QUARTER}', 2) AS INT) * 3 - 2", "1",
    )
    found = f"""CASE WHEN rlike(day, r'{DIGIT_DAY}') THEN {digits} WHEN rlike(day, r'{QUARTER}') THEN {quarter}
        ELSE {_let('parts', _day_parts('day'), _of_parts('parts', day_first))} END"""
    moment = "try_make_timestamp_ntz(d.year, d.month, d.day, t.hour, t.minute, t.second)"
    at = _let("d", found, _let("t", _time_of(lowered, "day"), moment))
    return _let("day", _day_text(lowered), at)


_ISO = "try_cast(text AS TIMESTAMP_NTZ)"
_READABLE = "rlike(text, '[0-9]{2}') AND length(text) <= 64"


def parse_date(text: Column, day_first: bool = False) -> Column:
    """Text to a time without zone, null if no known form fits.

    ISO dates and times are read as such. Else the clock is taken off, and the rest has to be a day: numbers or
    month names in two or three parts, eight digits, or a quarter. Where day and month could be either,
    ``day_first`` decides.
    """
    written = f"""CASE WHEN rlike(text, r'{PLAIN_DAY}') THEN {_plain_day('text', day_first)} WHEN {_READABLE}
        THEN {_let('lowered', 'lower(text)', _written_time('lowered', day_first))} END"""
    return _applied(F.trim(text), "text", f"coalesce({_ISO}, {written})")


def date_kind(text: Column) -> Column:
    """0 for no date, 1 for a date, 2 and 3 for one whose first or second number can only be the day."""
    def kind(a: str, b: str) -> str:
        return f"CASE WHEN {a} BETWEEN 13 AND 31 AND {b} <= 12 THEN 2 WHEN {b} > 12 AND {a} <= 12 THEN 3 ELSE 1 END"

    plain = _let(
        "n", "transform(split(text, '[-/.]'), part -> try_cast(part AS INT))",
        f"CASE WHEN {_plain_day('text', False)} IS NULL THEN 0 ELSE {kind('n[0]', 'n[1]')} END",
    )
    parts = _let("day", _day_text("lowered"), _day_parts("day"))
    numbers = _let("a", _small("get(parts, 0)"), _let("b", _small("get(parts, 1)"), kind("a", "b")))
    order = _let("parts", parts, f"CASE WHEN {_plain_numbers('parts')} THEN {numbers} ELSE 1 END")
    written = _let(
        "lowered", "lower(text)", f"CASE WHEN {_written_time('lowered', False)} IS NULL THEN 0 ELSE {order} END"
    )
    return _applied(
        F.trim(text), "text",
        f"""CASE WHEN {_ISO} IS NOT NULL THEN 1 WHEN rlike(text, r'{PLAIN_DAY}') THEN {plain}
            WHEN {_READABLE} THEN {written} ELSE 0 END""",
    )


def date_evidence(text: Column, kind: Column) -> Column:
    """What the values of a column tell about their form, as counts that add up over any split of the rows.

    ``n`` values, ``parsed`` of them dates; in ``day_leads`` of them the first number is above 12 and so
    the day, in ``month_leads`` the second one. ``kind`` is the ``date_kind`` of the text.
    """
    return F.struct(
        F.count(text).alias("n"), F.count_if(kind > 0).alias("parsed"),
        F.count_if(kind == 2).alias("day_leads"), F.count_if(kind == 3).alias("month_leads"),
    )


def day_comes_first(evidence) -> bool | None:
    """None if the column is not one of dates, else whether ambiguous values begin with the day.

    Values that can only begin with the day settle it, unless others can only begin with the month.
    """
    if not evidence["n"] or evidence["parsed"] / evidence["n"] < PARSED_SHARE:
        return None
    return evidence["day_leads"] > 0 and evidence["month_leads"] == 0


def date_candidates(df: DataFrame) -> list[str]:
    return [n for n in text_names(df) if any(hint in n.lower() for hint in DATE_HINTS)]


def parse_date_columns(df: DataFrame, evidence: dict | None = None) -> DataFrame:
    """Text columns named like a date become dates where at least 80 % of the values parse.

    One aggregate decides for all candidates, and for each column as a whole whether the day or the month
    comes first. ``evidence`` (``date_evidence`` by column) may be given where it is known already.
    """
    names = date_candidates(df)
    if not names:
        return df
    if evidence is None:
        kinds = df.select(
            *[column(n).alias(f"t{i}") for i, n in enumerate(names)],
            *[date_kind(column(n)).alias(f"k{i}") for i, n in enumerate(names)],
        )
        row = kinds.agg(
            *[date_evidence(F.col(f"t{i}"), F.col(f"k{i}")).alias(f"c{i}") for i in range(len(names))]
        ).first()
        evidence = dict(zip(names, row))
    order = {n: day_comes_first(evidence[n]) for n in names}
    return df.select(
        *[
            (parse_date(column(n), order[n]) if order.get(n) is not None else column(n)).alias(n)
            for n in df.columns
        ]
    )
