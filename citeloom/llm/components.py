"""Connected components of a table of links by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import stage


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least of the node and its neighbours."""
    near = _both_ways(links)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a != b")


def _small_star(links: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, are tied to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return tied.unionByName(least.select("a", F.col("low").alias("b"))).where("a != b").distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether each larger end has one link only, and is no smaller end."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of links (a, b) between 64-bit ids: the root is the least node that can
    be reached. Nodes without links do not occur.

    Rounds grow with the logarithm of the longest path. Each is written to the shared
    folder, so a lost executor costs one round. The stars of a node with very many links
    are aggregates and joins against one row per node, which adaptive execution splits.
    """
    now = stage(_small_star(links.where("a != b")), "links")
    while not _are_stars(now):
        now = stage(_small_star(_large_star(now)), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def tie(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) of some links, as ``components`` gives them, with more links (a, b):
    what it would give for all. Only the links between different components go through rounds."""
    if links.isEmpty():
        return roots
    low, high = (roots.select(F.col("node").alias(end), F.col("root").alias(f"_{end}")) for end in ("a", "b"))
    ends = links.join(low, "a", "left").join(high, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    moved = stage(components(stage(ends.where("a != b"), "between")), "moved")
    kept = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    return stage(kept.unionByName(moved.join(roots, "node", "left_anti").select("node", "root")), "roots")
