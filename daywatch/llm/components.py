"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daywatch.llm.text import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges`` (columns ``a, b``); root is the smallest node reachable.

    Alternates two star steps until nothing changes: each node's larger neighbours are linked
    to its smallest neighbour, then its smaller ones are. A path of n nodes takes about log n
    rounds. Each round is a written table; only a count and a checksum reach the driver.
    """
    links = stored(_distinct(edges.select("a", "b")), "links")
    before = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        links = stored(_small_star(_large_star(links)), "links")
    # Every link now leads from a node (b) to its root (a).
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        links.select("a", "a").distinct()
    )


def _distinct(edges: DataFrame) -> DataFrame:
    """Each link once, the smaller end first; loops go."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _distinct(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    joined = links.join(least, "b")
    return _distinct(
        joined.select("a", F.col("m").alias("b")).union(least.select(F.col("b").alias("a"), F.col("m").alias("b")))
    )
