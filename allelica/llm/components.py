"""Connected components of an edge table, by alternating star steps, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelica.llm.common import written


def _toward_min(links: DataFrame, own: bool) -> DataFrame:
    """links (u, v): connect each v to the least of u and its v's. own: u itself is connected too.

    The minimum is a partial aggregate and the join back on u can be split where a u is hot.
    """
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = links.join(least, "u")
    out = joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if own:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b; same type, not null) but the roots themselves.

    The root is the least node that can be reached. A large-star step joins each node's greater
    neighbours to its least neighbour, a small-star step its lesser ones; when a round changes nothing,
    all components are stars around their least node. The rounds grow with the logarithm of the longest path.
    Each is written to the shared folder.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        now = written(_toward_min(down, own=True).distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen
