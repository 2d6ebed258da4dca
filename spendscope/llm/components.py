"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.session import cut_lineage


def _stars(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest one (or to the node itself)."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    moved = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return moved.where("a <> b").distinct()


def _tidy(links: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, move to the smallest of them; a > b in all rows."""
    least = links.groupBy("a").agg(F.min("b").alias("root"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return moved.unionAll(least.select("a", F.col("root").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of undirected links (a, b); root is the smallest node reachable.

    Alternates stars towards the smallest neighbour until each node points at its root.
    Rounds grow with the logarithm of the longest path; each keeps at most as many rows as
    there are links, and partial minima meet a hub with one row per task. Links with a null
    end or with equal ends say nothing and are left out; no links give no rows.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = cut_lineage(links.distinct())
    before = None
    while True:
        links = cut_lineage(_tidy(_stars(links)))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
