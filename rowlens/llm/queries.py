"""The named queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlens.llm import (
    chat,
    chat_repair,
    language_id,
    mixing,
    nearest,
    packing,
    phrases,
    quality,
    simhash,
    substrings,
    token_files,
    toxicity,
    url_filter,
)
from rowlens.llm.tables import held_out, read_table
from rowlens.session import scratch_path


def _language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    profiles = language_id.learn_profiles(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    texts = docs.select("doc_id", held_out().alias("held_out"), "text")
    return language_id.identify(texts, profiles).drop("text")


def _mixing(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.plan_mix(read_table(spark, folder, "documents"))
    return plan.withColumnRenamed("own_id", "doc_id").drop("parts")


def _nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.nearest(read_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def _quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return quality.judge_lines(docs, with_text=False).drop("text", "n_lost")


def _toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    learning = ~held_out() & F.col("doc_id").isNotNull()
    model = toxicity.learn(docs.where(learning), read_table(spark, folder, "labels").where(learning))
    return toxicity.score(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def _packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, folder, "documents"))


def _token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    path = token_files.write_token_files(docs, scratch_path(spark, "tokens"))
    return token_files.read_checksums(spark, path)


#: Host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def _url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = read_table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, rules).drop("url")


def _simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, folder, "documents"))


def _substrings(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs, digest=True)


#: What conversation -7 says, twice: all that the template has to escape.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def _chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    chats = chat.format_chats(said.unionByName(more)).select(
        "*", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("segments")).alias("learned"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid", "broken_at",
    )


def _phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.phrases(read_table(spark, folder, "documents"))


def _chat_repair(spark: SparkSession, folder: str) -> DataFrame:
    hurt = chat_repair.damaged_turns(read_table(spark, folder, "conversations"))
    return chat_repair.repair_chats(hurt).withColumnRenamed("conv", "conv_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": _language_id,
    "op2_source_mixing": _mixing,
    "op3_one_bit_nearest": _nearest,
    "op4_line_quality": _quality,
    "op5_pu_toxicity": _toxicity,
    "op6_best_two_fit_packing": _packing,
    "op7_substring_dedup": _substrings,
    "op8_token_files": _token_files,
    "op9_url_filter": _url_filter,
    "op10_simhash_bk_trees": _simhash,
    "op11_chat_format": _chat_format,
    "op12_phrase_tiles": _phrases,
    "op13_chat_repair": _chat_repair,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_SUBSTRINGS_SQL = f"""
WITH texts AS (SELECT doc_id, {_WORDS} AS words FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS start FROM texts),
windows AS (SELECT doc_id, start, array_to_string(words[start:start + 12], ' ') AS gram FROM places),
firsts AS (SELECT gram, min(doc_id) AS first_id FROM windows GROUP BY gram),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(start, start + 13)) AS place
    FROM windows JOIN firsts USING (gram) WHERE first_id < doc_id
),
singles AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM texts),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS line, count(*) AS n
    FROM singles ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(line, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""

_URL_SQL = """
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
parts AS (
    SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['host', 'path']) AS part
    FROM pages
),
places AS (
    SELECT page_id, part.path AS path, row_number() OVER () AS row,
        translate(part.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
    FROM parts
),
fitting AS (
    SELECT row, rule_host || rule_path AS rule, rule_verdict,
        row_number() OVER (PARTITION BY row ORDER BY length(rule_host || rule_path) DESC) AS place
    FROM places JOIN rules ON starts_with(path, rule_path)
        AND (host = rule_host OR ends_with(host, '.' || rule_host))
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM places LEFT JOIN (SELECT * FROM fitting WHERE place = 1) USING (row)
""".format(rules=", ".join(str(rule) for rule in URL_RULES))

_QUALITY_SQL = f"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words,
        string_split(coalesce(text, ''), chr(10)) AS lines
    FROM documents
),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS start FROM texts),
windows AS (SELECT doc_id, start, array_to_string(words[start:start + 4], ' ') AS gram FROM places),
repeated AS (
    SELECT doc_id, unnest(list(start)) AS start FROM windows GROUP BY doc_id, gram HAVING count(*) > 1
),
covered AS (
    SELECT doc_id, count(DISTINCT place) AS n
    FROM (SELECT doc_id, unnest(range(start, start + 5)) AS place FROM repeated) GROUP BY doc_id
),
single AS (SELECT doc_id, unnest(lines) AS line FROM texts),
counted AS (
    SELECT doc_id, line, len(regexp_extract_all(line, '{quality.WORD}')) AS n,
        length(line) - length(translate(line, '{quality.SYMBOLS}', '')) AS symbols,
        len(regexp_extract_all(line, '[|»›•·→]')) + len(regexp_extract_all(replace(line, ' > ', ' >  '), ' > '))
            AS marks
    FROM single
),
by_line AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines,
        sum(n) FILTER (NOT (
            (regexp_matches(line, '{quality.SENTENCE_END.replace("'", "''")}') OR n >= {quality.LONG_LINE})
            AND 100 * symbols <= {quality.MOST_SYMBOLS} * length(line)
            AND NOT (marks >= {quality.LEAST_MARKS} AND marks * {quality.WORDS_PER_MARK} >= n)
            AND NOT regexp_matches(line, '{quality.BOILERPLATE}')
        )) AS lost
    FROM counted WHERE n > 0 GROUP BY doc_id
),
base AS (
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
        CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lost, 0) AS lost
    FROM texts LEFT JOIN covered USING (doc_id) LEFT JOIN by_line USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
        AND 100 * lost <= {quality.MOST_LOST} * n_words AS kept
FROM base
"""

_CHAT_SQL = f"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, n, ['user', 'assistant'][n + 1], '{CONTROL_TEXT}' FROM range(2) AS numbers(n)
),
placed AS (
    SELECT *, row_number() OVER turns - 1 AS place,
        coalesce(lag(role) OVER turns, 'start') AS before
    FROM said WINDOW turns AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
),
judged AS (
    SELECT *, (before || ' ' || role) IN (
            'start system', 'start user', 'system user', 'user assistant', 'assistant user'
        ) AS follows,
        replace(replace(replace(replace(replace(replace(text, '\\', '\\a'), '### Assistant:', '\\b'),
            '### System:', '\\c'), '### User:', '\\d'), '</turn>', '\\e'), '### (', '\\f') AS body,
        CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role) + 6
            ELSE 8 + length(replace(replace(replace(replace(replace(replace(replace(role, '\\', '\\a'),
                '### Assistant:', '\\b'), '### System:', '\\c'), '### User:', '\\d'), '</turn>', '\\e'),
                '### (', '\\f'), '):', '\\g')) END AS opening
    FROM placed
),
whole AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS lines,
        coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS learned,
        CAST(sum(opening + length(body) + 8) AS BIGINT) AS formatted_chars,
        min(place) FILTER (NOT follows) AS refused, arg_max(role, place) AS last_role
    FROM judged GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars,
    sha256(learned) AS loss_sha256, formatted_chars, refused IS NULL AND last_role = 'assistant' AS valid,
    CASE WHEN refused IS NOT NULL OR last_role <> 'assistant' THEN coalesce(refused, n_turns) END AS broken_at
FROM whole
"""

_PHRASE_SQL = r"""
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
spoken AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM spoken GROUP BY lang),
sized AS (SELECT lang, words, unnest(range(1, least(4, len(words)) + 1)) AS size FROM spoken),
places AS (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS start FROM sized),
counted AS (
    SELECT lang, size, words[start:start + size - 1] AS part, count(*) AS n FROM places GROUP BY ALL
),
candidates AS (SELECT * FROM counted WHERE size > 1 AND n >= {least}),
cuts AS (
    SELECT c.lang, c.part, c.n AS a, k, f.n AS l, r.n AS r,
        (2000000::HUGEINT * c.n) // (f.n::HUGEINT + r.n) AS score
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
    JOIN counted f ON f.lang = c.lang AND f.part = c.part[1:k]
    JOIN counted r ON r.lang = c.lang AND r.part = c.part[k + 1:]
),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, part ORDER BY score, k) = 1),
inner_parts AS (
    SELECT lang, n, size, part, own, unnest(range(1, size - own + 2)) AS start
    FROM (SELECT *, unnest(range(2, size)) AS own FROM candidates)
),
around AS (
    SELECT lang, part[start:start + own - 1] AS part, max(n) AS most FROM inner_parts GROUP BY ALL
),
left_over AS (
    SELECT w.*, array_to_string(w.part, ' ') AS phrase FROM weakest w LEFT JOIN around USING (lang, part)
    WHERE most IS NULL OR 100 * most < {inside} * a
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM placed JOIN totals USING (lang) WHERE rank <= {top}
""".format(least=phrases.LEAST, inside=phrases.MOST_INSIDE, top=phrases.TOP)

ORACLES: dict[str, str] = {
    "op4_line_quality": _QUALITY_SQL,
    "op9_url_filter": _URL_SQL,
    "op7_substring_dedup": _SUBSTRINGS_SQL,
    "op11_chat_format": _CHAT_SQL,
    "op12_phrase_tiles": _PHRASE_SQL,
}
