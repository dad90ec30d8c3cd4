"""Daily covariances, sparse precision matrices and the choice of their penalty.

Covariances are tables of upper-triangle cells (day, i, j, v) with i <= j.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import GAP, sparse_precision, symmetric
from .panel import spread


def realized_cov(returns: DataFrame, ridge: float = 0.0, bar_block: int = 512, tiles: int = 1) -> DataFrame:
    """Sum over the bars of r_i * r_j per day, plus ridge on the diagonal.

    A day is cut into blocks of `bar_block` bars; each block is one matrix
    product, and Spark adds the blocks up with map-side combining.  A group is
    at most bar_block x K returns, so one huge day spreads over many tasks.
    With `tiles` > 1 the assets are hashed into tiles and every pair of tiles is
    its own group, which also bounds K.
    """
    rows = returns.select("day", F.floor(F.col("bar") / bar_block).alias("block"), "bar", "asset", "ret")
    if tiles > 1:
        own = F.pmod(F.xxhash64("asset"), F.lit(tiles)).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)),
                            lambda o: F.struct(F.least(o, own).alias("a"), F.greatest(o, own).alias("b")))
        rows = rows.withColumn("own", own).select("*", F.inline(pairs))
    else:
        rows = rows.select("*", *[F.lit(0).alias(c) for c in ("own", "a", "b")])

    def products(group: pa.Table) -> pa.Table:
        coded = group["asset"].combine_chunks().dictionary_encode()
        names = coded.dictionary.take(pc.sort_indices(coded.dictionary))
        who = pc.index_in(coded.dictionary, names).to_numpy()[coded.indices.to_numpy()]
        x = np.zeros((len(names), bar_block))
        np.add.at(x, (who, group["bar"].to_numpy() % bar_block), group["ret"].to_numpy())
        g = x @ x.T
        a, b = np.triu_indices(len(names))
        if group["a"][0] != group["b"][0]:  # two tiles: only the pairs across them
            tile = np.zeros(len(names), dtype=int)
            tile[who] = group["own"].to_numpy()
            keep = tile[a] != tile[b]
            a, b = a[keep], b[keep]
        day = pa.repeat(group["day"][0], len(a))
        return pa.table({"day": day, "i": names.take(pa.array(a)), "j": names.take(pa.array(b)), "v": g[a, b]})

    parts = rows.groupBy("day", "block", "a", "b").applyInArrow(
        products, "day date, i string, j string, v double")
    total = F.sum("v") + F.when(F.col("i") == F.col("j"), F.lit(ridge)).otherwise(F.lit(0.0))
    return parts.groupBy("day", "i", "j").agg(total.alias("v"))


def pooled_cov(cov: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Mean of the daily matrices over the given days."""
    if days is not None:
        cov = cov.join(days.select("day").distinct(), "day", "left_semi")
    return cov.groupBy("i", "j").agg(F.avg("v").alias("v"))


def rolling_cov(cov: DataFrame, window: int = 40, full: bool = True) -> DataFrame:
    """Mean of the `window` preceding daily matrices, the day itself left out."""
    w = Window.partitionBy("i", "j").orderBy("day").rowsBetween(-window, -1)
    out = cov.select("day", "i", "j", F.avg("v").over(w).alias("v"), F.count("v").over(w).alias("n_days"))
    return out.filter(F.col("n_days") == window) if full else out.filter(F.col("n_days") > 0)


SOLVED = ("day date, lambda double, status string, ridge_used double, iterations int, gap double, "
          "log_det double, trace double, n_edges int, seconds double, "
          "i array<string>, j array<string>, v array<double>")


def glasso(cov: DataFrame, lambdas: Sequence[float], ridges: Sequence[float] = (0.0,),
           max_iter: int = 2000, tol: float = 1e-9, n_factors: int = 0) -> DataFrame:
    """C5 with the retry chain C4: one row per (day, lambda), precision cells as arrays.

    Each day is one group of K(K+1)/2 cells.  Penalties run from large to
    small inside the group so that each solve starts from the previous one.
    A ridge is added only while the matrix is not positive definite or its solve
    does not converge (gap above GAP); a day that none of the ridges repairs gets
    status 'failed' and no cells, with the iterations and the gap of its last solve.  n_factors
    principal components can be taken out first (C15).
    """
    ordered = sorted(lambdas, reverse=True)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names, s = symmetric(pdf["i"].to_numpy(dtype=str), pdf["j"].to_numpy(dtype=str), pdf["v"].to_numpy())
        if n_factors:
            val, vec = np.linalg.eigh(s)
            s = (vec[:, :-n_factors] * val[:-n_factors]) @ vec[:, :-n_factors].T
        a, b = np.triu_indices(len(names))
        out, start = [], None
        for lam in ordered:
            began, row, tried = time.perf_counter(), None, (0, None)
            for ridge in ridges:
                m = s + ridge * np.eye(len(s))
                if not np.isfinite(m).all() or np.linalg.eigvalsh(m)[0] <= 1e-12 * np.trace(m) / len(m):
                    continue
                omega, used, gap = sparse_precision(m, lam, start, max_iter, tol)
                if not gap <= GAP:
                    tried = (used, gap if np.isfinite(gap) else None)
                    continue
                start, cells = omega, omega[a, b]
                keep = np.abs(cells) > 1e-12
                row = ("ok", ridge, used, gap, np.linalg.slogdet(omega)[1], float((m * omega).sum()),
                       int((keep & (a < b)).sum()), time.perf_counter() - began,
                       names[a[keep]].tolist(), names[b[keep]].tolist(), cells[keep].tolist())
                break
            if row is None:
                row = ("failed", None, *tried, None, None, 0, time.perf_counter() - began, [], [], [])
            out.append((pdf["day"].iloc[0], lam, *row))
        return pd.DataFrame(out, columns=[f.split()[0] for f in SOLVED.split(", ")])

    return spread(cov.select("day", "i", "j", "v"), "day").groupBy("day").applyInPandas(solve, SOLVED)


def precision_cells(solved: DataFrame) -> DataFrame:
    """Long form (day, lambda, i, j, v) of the solved matrices, non-zero cells only."""
    return solved.filter("status = 'ok'").select(
        "day", "lambda", F.inline(F.arrays_zip("i", "j", "v")))


def solve_status(solved: DataFrame) -> DataFrame:
    """Per (day, lambda): status and solver figures without the cells (not read from a staged table)."""
    return solved.drop("i", "j", "v")


def solve_report(status: DataFrame) -> DataFrame:
    """Days, failed days and share solved per month."""
    failed = F.count_if(F.col("status") != "ok")
    return status.groupBy(F.to_date(F.date_trunc("month", "day")).alias("month")).agg(
        F.count(F.lit(1)).alias("n_days"), failed.alias("n_failed"),
        (1 - failed / F.count(F.lit(1))).alias("solved_share"))
