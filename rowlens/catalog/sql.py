"""SQL building blocks of the checks, for DuckDB."""

from __future__ import annotations

from rowlens.catalog.registry import union_all

NUMBER = r"\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*"
FORMATTED = r"[$€£¥]?\s*-?(\d{1,3}(,\d{3})*|\d+)(\.\d+)?%?"


def to_number(c: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, '{NUMBER}') THEN try_cast(trim({c}) AS DOUBLE) END"


def from_formatted(c: str) -> str:
    return to_number(f"trim(regexp_replace({c}, '[$€£¥,%]', '', 'g'))")


def title(c: str) -> str:
    runs = f"regexp_extract_all(replace({c}, '_', ' '), '([a-zA-Z]+|[^a-zA-Z]+)')"
    return f"array_to_string(list_transform({runs}, lambda x: upper(x[1]) || lower(x[2:])), '')"


def fixed(c: str, digits: int, grouped: bool = True) -> str:
    # Minima from Parquet statistics come as negative zero; adding zero removes the sign.
    return f"format('{{:{',' if grouped else ''}.{digits}f}}', CAST({c} AS DOUBLE) + CAST(0 AS DOUBLE))"


def score_text(c: str) -> str:
    return f"regexp_replace({fixed(c, 2)}, '(\\.\\d)0$', '\\1')"


def compact(c: str) -> str:
    return f"""CASE WHEN abs({c}) >= 1e9 THEN {fixed(f'({c}) / 1e9', 2, False)} || 'B'
        WHEN abs({c}) >= 1e6 THEN {fixed(f'({c}) / 1e6', 2, False)} || 'M'
        WHEN abs({c}) >= 1e3 THEN {fixed(f'({c}) / 1e3', 1, False)} || 'K'
        WHEN {c} = floor({c}) THEN {fixed(c, 0)} ELSE {fixed(c, 2)} END"""


def display(c: str) -> str:
    return f"""CASE WHEN abs({c}) < 10 THEN regexp_replace({fixed(c, 3)}, '\\.?0+$', '')
        WHEN {c} = floor({c}) THEN {fixed(c, 0)} ELSE {fixed(c, 2)} END"""


def no_nan(c: str) -> str:
    return f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END"


def text_list(items) -> str:
    return ", ".join(f"'{i}'" for i in items)


def validation(rel: str, columns) -> str:
    """One row with all quality figures; lists as text."""
    def names(condition: str) -> str:
        flags = ", ".join(
            f"CASE WHEN {condition.format(c=c)} THEN '{c}' END" for c in columns
        )
        return f"list_filter([{flags}], lambda x: x IS NOT NULL)"

    missing = " + ".join(f'count_if("{c}" IS NULL)' for c in columns)
    width = len(columns)
    return f"""
    WITH counted AS (SELECT count(*) AS row_count, ({missing}) AS missing_cells,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({rel}))) AS duplicate_rows,
        {names('count("{c}") = 0')} AS empties,
        {names('count("{c}") > 0 AND min("{c}") = max("{c}")')} AS constants FROM ({rel})),
    rates AS (SELECT *, missing_cells / (row_count * {width}) * 100.0 AS missing,
        duplicate_rows / row_count * 100.0 AS duplicate FROM counted),
    scored AS (SELECT *, round(CAST(greatest(0, least(100, 100 - least(35, missing * 0.7)
        - least(25, duplicate * 0.5) - least(25, len(empties) / {width} * 100)
        - least(15, len(constants) / {width} * 100 * 0.5))) AS DOUBLE), 2) AS health_score FROM rates)
    SELECT row_count, {width} AS column_count, missing_cells, round(missing, 2) AS missing_percent,
        duplicate_rows, round(duplicate, 2) AS duplicate_percent,
        array_to_string(empties, ',') AS empty_columns,
        array_to_string(constants, ',') AS constant_columns, health_score,
        CASE WHEN health_score >= 90 THEN 'A' WHEN health_score >= 75 THEN 'B'
             WHEN health_score >= 60 THEN 'C' WHEN health_score >= 40 THEN 'D' ELSE 'F' END
        AS health_grade,
        list_filter([
          CASE WHEN missing > 10 THEN 'Cells without a value: ' || {fixed('missing', 1)} || '%' END,
          CASE WHEN duplicate > 5 THEN 'Rows that repeat another: ' || {fixed('duplicate', 1)} || '%' END,
          CASE WHEN len(empties) > 0
            THEN 'Columns without any value: ' || array_to_string(empties, ', ') END,
          CASE WHEN len(constants) > 0
            THEN 'Columns with one value only: ' || array_to_string(constants, ', ') END,
          CASE WHEN row_count < 10 THEN 'Too few rows for statistics: ' || row_count END
        ], lambda x: x IS NOT NULL) AS warnings FROM scored"""


def descriptive(rel: str, columns) -> str:
    return union_all(
        f"""SELECT {i} AS position, '{c}' AS "column", count("{c}") AS "count", avg("{c}") AS mean,
        coalesce(stddev_samp("{c}"), 0) AS std, min("{c}") AS min,
        quantile_cont("{c}", 0.25) AS p25, quantile_cont("{c}", 0.5) AS p50,
        quantile_cont("{c}", 0.75) AS p75, max("{c}") AS max, sum("{c}") AS sum FROM ({rel})"""
        for i, c in enumerate(columns)
    )


def correlations(rel: str, columns) -> str:
    """All ordered pairs, one scan; the diagonal is 1 unless the column is constant."""
    cells, rows = [], []
    for i, a in enumerate(columns):
        cells.append(f'CASE WHEN min("{a}") < max("{a}") THEN 1.0 END AS r{i}_{i}')
        rows.append(f"SELECT {i} AS left_pos, {i} AS right_pos, '{a}' AS left_column, "
                    f"'{a}' AS right_column, r{i}_{i} AS r FROM wide")
        for j, b in enumerate(columns):
            if i < j:
                cells.append(f'corr("{a}", "{b}") AS r{i}_{j}')
            if i != j:
                value = no_nan(f"r{min(i, j)}_{max(i, j)}")
                rows.append(f"SELECT {i} AS left_pos, {j} AS right_pos, '{a}' AS left_column, "
                            f"'{b}' AS right_column, {value} AS r FROM wide")
    body = "\nUNION ALL\n".join(rows)
    return f"WITH wide AS (SELECT {', '.join(cells)} FROM ({rel}))\n{body}"


def trend(rel: str, date: str, columns, ties) -> str:
    def one(i: int, c: str) -> str:
        order = ", ".join(f'k{n} := "{k}"' for n, k in enumerate((date, *ties, c)))
        return f"""SELECT {i} AS position, '{c}' AS "column", '{date}' AS date_column, first_value,
            last_value, CASE WHEN first_value = 0 THEN 0
            ELSE (last_value - first_value) / first_value * 100 END AS percent_change
            FROM (SELECT arg_min("{c}", struct_pack({order})) AS first_value,
                         arg_max("{c}", struct_pack({order})) AS last_value FROM ({rel})
                  WHERE "{c}" IS NOT NULL AND "{date}" IS NOT NULL)"""

    return union_all(one(i, c) for i, c in enumerate(columns))


def fences(rel: str, c: str) -> str:
    return f"""SELECT q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound
        FROM (SELECT quantile_cont("{c}", 0.25) AS q1, quantile_cont("{c}", 0.75) AS q3
              FROM ({rel}))"""


def outliers(rel: str, columns) -> str:
    return union_all(
        f"""SELECT {i} AS position, '{c}' AS "column",
            count_if("{c}" < lower_bound OR "{c}" > upper_bound) AS outlier_count,
            any_value(lower_bound) AS lower_bound, any_value(upper_bound) AS upper_bound
            FROM ({rel}), ({fences(rel, c)}) HAVING count("{c}") >= 4"""
        for i, c in enumerate(columns)
    )


def value_counts(rel: str, columns, k: int = 10, missing: str | None = "nan") -> str:
    def one(c: str) -> str:
        value = f'CAST("{c}" AS VARCHAR)'
        value = f"coalesce({value}, '{missing}')" if missing else value
        return f"""SELECT '{c}' AS "column", row_number() OVER (ORDER BY n DESC, value) AS rank,
            value, n FROM (SELECT {value} AS value, count(*) AS n FROM ({rel})
            {'' if missing else f'WHERE "{c}" IS NOT NULL'} GROUP BY 1)
            QUALIFY rank <= {k}"""

    return union_all(one(c) for c in columns)


def grouped(rel: str, category: str, measure: str) -> str:
    return f"""SELECT *, dense_rank() OVER (ORDER BY total DESC) AS rank FROM (
        SELECT "{category}" AS "group", coalesce(sum("{measure}"), 0) AS total,
        avg("{measure}") AS average, count("{measure}") AS "count",
        stddev_samp("{measure}") AS std_dev FROM ({rel}) WHERE "{category}" IS NOT NULL
        GROUP BY 1 ORDER BY total DESC, "group" LIMIT 10)"""


_MELTED = {
    "descriptive_stats": ("column", ("count", "mean", "std", "min", "p25", "p50", "p75", "max", "sum")),
    "trend_analysis": ("column", ("first_value", "last_value", "percent_change")),
    "outlier_detection": ("column", ("outlier_count", "lower_bound", "upper_bound")),
    "grouped_summary_analysis": ("group", ("total", "average", "count", "std_dev", "rank")),
}


def melted(name: str, sql: str) -> str:
    """An analysis result as (analysis, column, metric, value)."""
    if name == "correlation_analysis":
        return f"""SELECT '{name}' AS analysis, left_column AS "column", right_column AS metric,
            r AS value FROM ({sql})"""
    if name == "value_counts_analysis":
        return f"""SELECT '{name}' AS analysis, "column", value AS metric, CAST(n AS DOUBLE) AS value
            FROM ({sql})"""
    key, metrics = _MELTED[name]
    return "\nUNION ALL\n".join(
        f"""SELECT '{name}' AS analysis, "{key}" AS "column", '{m}' AS metric,
        CAST("{m}" AS DOUBLE) AS value FROM ({sql})"""
        for m in metrics
    )
