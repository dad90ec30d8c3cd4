"""Approximate nearest neighbours by stable projections, kd-trees and a chi-square stop.

Vectors are normalised and projected to a few dimensions with a Gaussian (2-stable)
matrix: for two vectors at distance d, their squared projected distance is d^2 times a
chi-square variable.  The projections of a block of vectors are indexed by a kd-tree.
A query takes the leaves in order of projected distance and verifies true distances,
until with probability `confidence` no vector further out in the projection is nearer
than the ones held (the chi-square test), or no leaf is left.

Blocks are the leaves of a coarse kd-tree whose cuts come from a bounded sample of
projections (`sample_rows`); every vector is put into its block, blocks that come out
large are split by vec_id.  A query first searches its own block, then only those
blocks whose bounding box passes the same test against the distance found so far.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.text import small_batches
from panelweave.sources.scratch import stage

DIMENSIONS = 8
#: Quantile of the chi-square distribution with DIMENSIONS degrees of freedom at the default confidence of 0.99.
CHI_SQUARE = {0.9: 13.362, 0.95: 15.507, 0.99: 20.090, 0.999: 26.124}
BLOCK_ROWS = 4096
LEAF_ROWS = 64
MOST_BLOCKS = 4096
#: Boxes that the driver holds, twice that at most; beyond, blocks grow.
MOST_BOXES = 65_536


def projection(length: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((length, dimensions))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), "f8")


def _project(length: int):
    def run(frames):
        matrix = projection(length)
        for pdf in frames:
            if len(pdf):
                x = _matrix(pdf["v"])
                unit = x / np.sqrt((x * x).sum(1))[:, None]
                yield pdf.assign(p=list(unit @ matrix))[["vec_id", "v", "p"]]
    return run


def coarse_cuts(sample: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Dimension and value of each inner node of a full binary tree, in breadth-first order."""
    cuts, parts = [], [sample]
    for _ in range(depth):
        after = []
        for part in parts:
            if len(part) == 0:
                cuts.append((0, 0.0))
                after += [part, part]
                continue
            d = int(np.argmax(part.max(0) - part.min(0)))
            value = float(np.median(part[:, d]))
            cuts.append((d, value))
            after += [part[part[:, d] <= value], part[part[:, d] > value]]
        parts = after
    return cuts


def _leaf(points: np.ndarray, cuts: list[tuple[int, float]], depth: int) -> np.ndarray:
    node = np.zeros(len(points), "i8")
    dims, values = np.array([c[0] for c in cuts], "i8"), np.array([c[1] for c in cuts])
    for _ in range(depth):
        right = points[np.arange(len(points)), dims[node]] > values[node]
        node = 2 * node + 1 + right
    return node - (2**depth - 1)


def _place(cuts: list[tuple[int, float]], depth: int):
    def run(frames):
        for pdf in frames:
            if len(pdf):
                yield pdf.assign(leaf=_leaf(_matrix(pdf["p"]), cuts, depth) if depth else np.zeros(len(pdf), "i8"))
    return run


class Tree:
    """A kd-tree over the projections of one block: balanced leaves with their bounding boxes."""

    def __init__(self, points: np.ndarray):
        order, leaves = np.arange(len(points)), []

        def split(rows: np.ndarray) -> None:
            if len(rows) <= LEAF_ROWS:
                leaves.append(rows)
                return
            part = points[rows]
            d = int(np.argmax(part.max(0) - part.min(0)))
            half = len(rows) // 2
            by = np.argpartition(part[:, d], half)
            split(rows[by[:half]])
            split(rows[by[half:]])

        split(order)
        self.leaves = leaves
        self.low = np.array([points[r].min(0) for r in leaves])
        self.high = np.array([points[r].max(0) for r in leaves])


def box_distance(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distance of a point to boxes."""
    out = np.maximum(np.maximum(low - point, point - high), 0)
    return (out * out).sum(1)


def cosines(rows: np.ndarray, norms: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Row by row, so that equal vectors get equal values wherever they stand."""
    return (rows * query).sum(1) / (norms * np.sqrt((query * query).sum()))


def search_block(ids, vectors, points, query_ids, queries, query_points, bound, k: int, limit: float) -> list[tuple]:
    """(query, vec_id, cosine) of up to k neighbours of each query in one block.

    bound: the squared distance of the k-th neighbour each query holds already.
    """
    tree, norms, out = Tree(points), np.sqrt((vectors * vectors).sum(1)), []
    for q in range(len(query_ids)):
        gap = box_distance(tree.low, tree.high, query_points[q])
        order = np.argsort(gap, kind="stable")
        best_id, best = np.empty(0, "i8"), np.empty(0)
        worst, at = bound[q], 0
        while at < len(order):
            # several leaves at a time; the test is made for the nearest leaf not yet seen
            if gap[order[at]] > limit * worst:
                break
            rows = np.concatenate([tree.leaves[j] for j in order[at:at + 8]])
            at += 8
            rows = rows[ids[rows] != query_ids[q]]
            if not len(rows):
                continue
            near = cosines(vectors[rows], norms[rows], queries[q])
            best_id, best = np.r_[best_id, ids[rows]], np.r_[best, near]
            top = np.lexsort((best_id, -best))[:k]
            best_id, best = best_id[top], best[top]
            if len(best) == k:
                worst = min(worst, 2 - 2 * best[-1])
        out += [(int(query_ids[q]), int(i), float(s)) for i, s in zip(best_id, best)]
    return out


def _cogroup(k: int, limit: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series([], dtype="i8"), "vec_id": pd.Series([], dtype="i8"), "score": pd.Series([], dtype="f8")})
        found = search_block(left["vec_id"].to_numpy(), _matrix(left["v"]), _matrix(left["p"]), right["vec_id"].to_numpy(),
                             _matrix(right["v"]), _matrix(right["p"]), right["bound"].to_numpy("f8"), k, limit)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "i8", "vec_id": "i8", "score": "f8"})
    return run


def _reach(low: np.ndarray, high: np.ndarray, blocks: np.ndarray, limit: float):
    """One row per query and block that the test cannot rule out."""
    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                gap = box_distance(low, high, np.array(r.p))
                for j in np.flatnonzero(gap <= limit * r.bound):
                    if blocks[j] != r.home:
                        rows.append((r.vec_id, r.v, r.p, r.bound, int(blocks[j])))
            yield pd.DataFrame(rows, columns=["vec_id", "v", "p", "bound", "block"])
    return run


def neighbours(vectors: DataFrame, is_query, k: int = 5, confidence: float = 0.99, sample_rows: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query, by cosine, ties to the smaller vec_id.

    vectors: vec_id, embedding; `is_query` is a condition on vec_id.  Vectors that are
    null, zero or hold a null or non-finite component take no part, nor do those of
    another length than the most common one (ties: the shorter).  A vector is no
    neighbour of the query with its own vec_id; repeated rows of one id count as one
    candidate row each.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2048)
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select("vec_id", v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(fine)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    length, total = sizes[0]["n"], sizes[0]["count"]
    limit = CHI_SQUARE[confidence]
    projected = stage(rows.where(F.size("v") == length).mapInPandas(
        _project(length), "vec_id long, v array<double>, p array<double>"), "ann-projected")

    depth = max(0, min(MOST_BLOCKS, -(-total // BLOCK_ROWS)) - 1).bit_length()
    share = int(1_000_000 * min(1.0, sample_rows / total)) + 1
    sample = projected.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < share).select("vec_id", "p").toPandas()
    sample = sample.sort_values("vec_id", kind="stable")
    cuts = coarse_cuts(_matrix(sample["p"]).reshape(-1, DIMENSIONS), depth)
    placed = projected.mapInPandas(_place(cuts, depth), "vec_id long, v array<double>, p array<double>, leaf long")
    placed = stage(placed, "ann-placed")
    piece = max(2 * BLOCK_ROWS, total // MOST_BOXES)
    counts = {r["leaf"]: -(-r["count"] // piece) for r in placed.groupBy("leaf").count().collect()}
    pieces = F.element_at(F.create_map(*[F.lit(x) for leaf, n in sorted(counts.items()) for x in (leaf, n)]), F.col("leaf"))
    block = (F.col("leaf") * (1 << 20) + F.pmod(F.xxhash64("vec_id"), pieces)).alias("block")
    data = placed.select("vec_id", "v", "p", block)

    edges = data.select("block", F.posexplode("p")).groupBy("block", "pos").agg(F.min("col").alias("a"), F.max("col").alias("b"))
    boxes = edges.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b"))).alias("box")).orderBy("block").collect()
    low = np.array([[x["a"] for x in r["box"]] for r in boxes])
    high = np.array([[x["b"] for x in r["box"]] for r in boxes])
    names = np.array([r["block"] for r in boxes], "i8")

    asked = data.where(is_query).withColumnRenamed("block", "home")
    first = asked.withColumn("bound", F.lit(float("inf"))).withColumn("block", F.col("home"))
    out = "query_id long, vec_id long, score double"
    home = stage(data.groupBy("block").cogroup(first.drop("home").groupBy("block")).applyInPandas(_cogroup(k, limit), out), "ann-home")
    held = home.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    bound = F.when(F.col("n") >= k, 2 - 2 * F.col("least")).otherwise(float("inf"))
    wide = asked.join(held, asked["vec_id"] == held["query_id"], "left").select(
        "vec_id", "v", "p", "home", F.coalesce(bound, F.lit(float("inf"))).alias("bound"))
    further = wide.mapInPandas(_reach(low, high, names, limit), "vec_id long, v array<double>, p array<double>, bound double, block long")
    # many queries of one block go to it in portions
    portion = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, total // (200 * BLOCK_ROWS)))).alias("portion")
    further = further.select("*", portion)
    many = data.select("*", F.explode(F.sequence(F.lit(0), F.lit(max(1, total // (200 * BLOCK_ROWS)) - 1))).alias("portion"))
    rest = many.withColumn("portion", F.col("portion").cast("long")).groupBy("block", "portion").cogroup(
        further.groupBy("block", "portion")).applyInPandas(_cogroup(k, limit), out)
    every = home.unionByName(rest)
    nearest = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))), 1, k)
    return every.groupBy("query_id").agg(nearest.alias("best")).select("query_id", F.posexplode("best").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
