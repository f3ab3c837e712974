"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.session import stage_table


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node of its component) of every node that has a link.

    ``links`` has two columns ``a`` and ``b`` of one ordered type; links with a null, to the node
    itself and repeated ones change nothing. An empty table gives an empty table.

    Each round hangs the larger neighbours of every node on the smallest one, then the smaller ones;
    the number of rounds grows with the logarithm of the longest path. A node of very many links is
    combined before the shuffle when its minimum is sought, and split by adaptive execution when the
    minimum is joined back. Each round is written to the shared folder, so a lost executor does not
    bring back earlier rounds.
    """
    # The smaller node is ``b``; at the end each ``a`` has one ``b``, its root.
    edges = stage_table(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    before = None
    while (state := _state(edges)) != before:
        before = state
        edges = stage_table(_small_star(_large_star(edges)), "links")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _state(edges: DataFrame) -> tuple:
    """Equal for equal link sets."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.join(least, "u").where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return (
        edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(least.select("a", F.col("m").alias("b")))
        .where(F.col("a") != F.col("b")).distinct()
    )
