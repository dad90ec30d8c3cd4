"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.sources.scratch import drop_staged, stage


def _flat(edges: DataFrame) -> bool:
    """Whether every node has one parent at most, and none that has one is a parent."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("child")).unionAll(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("child")))
    seen = ends.groupBy("x").agg(F.sum("child").alias("up"), F.count(F.lit(1)).alias("all"))
    return seen.where("up > 1 OR up = 1 AND all > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable, for every node of links (columns a, b).

    Each round first points the larger neighbours of a node at its smallest
    neighbour, then does the same among the smaller ones.  The forest flattens in a
    logarithmic number of rounds; each is written to the shared folder.  Neighbours
    are never gathered: only minima are, which are combined before the shuffle.
    What is returned reads one staged table, the last round's.
    """
    # u > v throughout
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stage(edges, "links")
    while not _flat(edges):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = stage(large.where("u <> v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(hung.select("u", F.col("m").alias("v")))
        edges, old = stage(small.where("u <> v").distinct(), "small-star"), edges
        drop_staged(old, large)
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(roots)
