"""URL rules by expressions of host suffix and path prefix, matched on short hash prefixes.

Each URL is expanded into the pairs of its host suffixes and path prefixes that a rule of the list can
have, and joined with the rules on the first four bytes of a SHA-256 digest; the full digests confirm
the match. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.llm.tables import numbered_columns
from rowlens.session import stage_table

ALLOW, BLOCK = "allow", "block"
#: Hexadecimal digits of the digest on which URLs and rules are joined.
PREFIX_DIGITS = 8
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, _PARTS, 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # A host has no slash, so the text can be read in one way only.
    return F.sha2(F.concat(host, F.lit("/"), path).cast("binary"), 256)


def _expressions(places: DataFrame, labels: int, lengths: list[int]) -> DataFrame:
    """One row per host suffix of up to ``labels`` labels and path prefix of one of the ``lengths``."""
    count = F.size("parts")
    suffixes = F.transform(
        F.sequence(F.greatest(F.lit(1), count - labels + 1), count),
        lambda k: F.array_join(F.slice("parts", k, count - k + 1), "."),
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n),
    )
    return (
        places.withColumn("parts", F.split("host", r"\."))
        .select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW
) -> DataFrame:
    """All columns, and ``host``, ``path``, ``rule`` and ``verdict`` of every row's URL.

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block). A rule fits its host and all
    subdomains if the URL's path starts with the rule's. The longest rule (host and path together) wins;
    of equally long ones that with the longer host, then a blocking one. Without a fitting rule ``rule``
    is null and the verdict is ``default``. URLs that are null, empty or without ``://`` have an empty
    host and path; rules with a null are ignored, repeated ones count once. Columns of these four names
    in ``pages`` are replaced, any other name may be there. Repeated rows are returned as often as they
    come; an empty table stays empty.

    Distinct host and path are judged once and joined back; a very common URL is split by adaptive
    execution. From the rules only the distinct path lengths and the most labels come to the driver.
    """
    every = numbered_columns(pages)
    address = F.col(f"c{pages.columns.index(url)}")
    named = {f"c{k}": n for k, n in enumerate(pages.columns) if n not in ("host", "path", "rule", "verdict")}
    names = [*named.values(), "host", "path", "rule", "verdict"]
    judged = every.select(*named, host_of(address).alias("host"), path_of(address).alias("path"))
    listed = (
        rules.select("host", "path", "verdict").dropna()
        .withColumn("host", F.translate("host", _UPPER, _LOWER)).distinct()
    )
    shape = listed.agg(
        F.max(F.size(F.split("host", r"\."))), F.sort_array(F.collect_set(F.length("path")))
    ).first()
    if shape[0] is None:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)}).toDF(*names)
    digest = _digest(F.col("host"), F.col("path"))
    listed = listed.select(
        F.concat("host", "path").alias("rule"), "verdict", digest.alias("rule_digest"),
        F.substring(digest, 1, PREFIX_DIGITS).alias("short"),
        F.struct(
            F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"),
            (F.col("verdict") == BLOCK).alias("blocks"),
        ).alias("weight"),
    )
    asked = (
        _expressions(judged.select("host", "path").distinct(), shape[0], list(shape[1]))
        .withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))
        .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    )
    fitting = (
        asked.join(listed, "short").where(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), "weight").alias("best"))
    )
    # Written once, so that both sides of the join back are plain shuffles that can be split.
    fitting = stage_table(fitting, "fitting_rules")
    return judged.join(fitting, ["host", "path"], "left").select(
        *judged.columns, F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    ).toDF(*names)
