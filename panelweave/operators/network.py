"""Asset networks: edges (day, i, j) with i < j, their statistics and rolling means."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import symmetric


def edges(prec: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Non-zero off-diagonal cells."""
    return prec.filter((F.col("i") < F.col("j")) & (F.abs("v") > eps)).select("day", "i", "j")


def _ends(e: DataFrame) -> DataFrame:
    """Each edge seen from both ends, in one pass: (day, node, other)."""
    both = F.array(F.struct(F.col("i").alias("node"), F.col("j").alias("other")),
                   F.struct(F.col("j").alias("node"), F.col("i").alias("other")))
    return e.select("day", F.inline(both))


def density(e: DataFrame, days: DataFrame, k: int) -> DataFrame:
    """Share of the possible pairs; days without edges give 0."""
    per_day = e.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return days.select("day").distinct().join(per_day, "day", "left").select(
        "day", (F.coalesce("n", F.lit(0)) / F.lit(k * (k - 1) / 2)).alias("density"))


def degree(e: DataFrame) -> DataFrame:
    """(day, node, degree) for nodes with edges."""
    return _ends(e).groupBy("day", "node").agg(F.count(F.lit(1)).alias("degree"))


def degree_summary(e: DataFrame, days: DataFrame, k: int) -> DataFrame:
    """Mean and population sd of the degree per day over all k nodes, from power sums."""
    sums = degree(e).groupBy("day").agg(F.sum("degree").alias("s1"),
                                        F.sum(F.col("degree") * F.col("degree")).alias("s2"))
    mean = F.coalesce("s1", F.lit(0)) / F.lit(float(k))
    square = F.coalesce("s2", F.lit(0)) / F.lit(float(k))
    return days.select("day").distinct().join(sums, "day", "left").select(
        "day", mean.alias("mean_degree"),
        F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("sd_degree"))


def pagerank(e: DataFrame, iters: int = 20, damping: float = 0.85) -> DataFrame:
    """(day, node, rank) over the nodes that have edges.

    One row per day holds its neighbour lists (at most K^2 numbers), and the
    iterations run over that row with array functions: two shuffles in all
    instead of two per iteration, no growing lineage, nothing in Python.
    """
    lists = _ends(e).groupBy("day", "node").agg(F.collect_list("other").alias("others"))
    per_day = (lists.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("node", "others"))).alias("g"))
               .select("day", F.col("g.node").alias("nodes"), F.col("g.others").alias("others"))
               .withColumn("place", F.map_from_arrays(
                   "nodes", F.sequence(F.lit(0), F.size("nodes") - 1)))
               .withColumn("links", F.transform(
                   "others", lambda o: F.transform(o, lambda x: F.col("place")[x])))
               .withColumn("out", F.transform("links", lambda x: F.size(x).cast("double")))
               .select("day", "nodes", "links", "out"))
    n = F.size("nodes").cast("double")

    def step(sent, _):  # sent: what a node hands to each neighbour, rank / out
        return F.zip_with("links", "out", lambda l, d: (
            (1 - damping) / n + damping * F.aggregate(
                l, F.lit(0.0), lambda acc, x: acc + F.get(sent, x))) / d)

    sent = F.aggregate(F.sequence(F.lit(1), F.lit(iters)),
                       F.transform("out", lambda d: 1.0 / n / d), step)
    rank = F.zip_with(sent, "out", lambda x, d: x * d)
    return (per_day.select("day", "nodes", rank.alias("rank"))
            .select("day", F.inline(F.arrays_zip("nodes", "rank"))).toDF("day", "node", "rank"))


def clustering(e: DataFrame) -> DataFrame:
    """2T / (d(d-1)) per node and day, 0 where fewer than two neighbours.

    A day's network is one group of at most K(K-1)/2 edges. Counting its
    triangles as one adjacency product is far cheaper than joining edges to
    edges, which would emit every open wedge of a dense network.
    """
    def triangles(pdf: pd.DataFrame) -> pd.DataFrame:
        names, a = symmetric(pdf["i"].to_numpy(dtype=str), pdf["j"].to_numpy(dtype=str), np.ones(len(pdf)))
        deg = a.sum(axis=1)
        twice = ((a @ a) * a).sum(axis=1)
        return pd.DataFrame({"day": pdf["day"].iloc[0], "node": names,
                             "clustering": twice / np.maximum(deg * (deg - 1), 1.0)})

    return e.select("day", "i", "j").groupBy("day").applyInPandas(
        triangles, "day date, node string, clustering double")


def rolling_network_mean(e: DataFrame, solved_days: DataFrame, window: int = 20) -> DataFrame:
    """C11: share of the last `window` solved days on which a pair was linked.

    Sparse form: an edge counts +1 from its day on and -1 `window` days later; a
    running sum per pair turns the events into spans of constant level, and the
    spans are unfolded over the days they cover. Pairs never linked cost
    nothing. Returns (t, day, i, j, p, n_linked, n_window), p = n_linked / n_window > 0,
    for t >= window - 1.
    """
    days = solved_days.select("day").distinct().withColumn(
        "t", F.row_number().over(Window.orderBy("day")) - 1)  # calendar only
    last = days.agg(F.max("t")).scalar()
    change = F.array(F.struct(F.col("t").alias("at"), F.lit(1).alias("by")),
                     F.struct((F.col("t") + window).alias("at"), F.lit(-1).alias("by")))
    events = e.join(days, "day").select("i", "j", F.inline(change)).groupBy("i", "j", "at").agg(
        F.sum("by").alias("by"))
    pair = Window.partitionBy("i", "j").orderBy("at")
    spans = (events.withColumn("level", F.sum("by").over(pair))
             .withColumn("until", F.lead("at").over(pair) - 1)
             .withColumn("last", last)
             .withColumn("from", F.greatest("at", F.lit(window - 1)))
             .withColumn("until", F.least("until", "last"))
             .filter((F.col("level") > 0) & (F.col("from") <= F.col("until"))))
    return (spans.select("i", "j", F.explode(F.sequence("from", "until")).alias("t"),
                         (F.col("level") / F.lit(float(window))).alias("p"),
                         F.col("level").alias("n_linked"), F.lit(window).alias("n_window"))
            .join(days, "t").select("t", "day", "i", "j", "p", "n_linked", "n_window"))


def network_mask(abar: DataFrame, tau: float = 0.7, use_last_day: bool = False,
                 before: int | None = None, calendar: DataFrame | None = None) -> DataFrame:
    """Pairs (i, j, p) with p >= tau, p from the last day or averaged over all days.

    `calendar` holds a row `t` for every day with a network mean.  abar has rows for
    linked pairs only, so a day without any link is known from the calendar alone; it
    counts with p = 0 in the average, and as last day it leaves no pair.  Without a
    calendar the days of abar are taken.  `before` keeps only days t < before, so
    that a fold sees no later network.  The average is one division of whole numbers, since a
    sum of shares may fall on either side of tau by the order of its terms."""
    days = abar if calendar is None else calendar
    if before is not None:
        abar, days = abar.filter(F.col("t") < before), days.filter(F.col("t") < before)
    if use_last_day:
        last = days.agg(F.max("t")).scalar()
        pairs = abar.withColumn("last", last).filter(F.col("t") == F.col("last")).select("i", "j", "p")
    else:
        n = days.agg(F.count_distinct("t")).scalar()
        pairs = abar.groupBy("i", "j").agg(F.sum("n_linked").alias("links"), F.max("n_window").alias("width")).select(
            "i", "j", (F.col("links") / (F.col("width") * n)).alias("p"))
    return pairs.filter(F.col("p") >= tau)
