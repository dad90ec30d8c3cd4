"""Portfolio weights: minimum variance, benchmarks, constraints, decision-focused step."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import min_variance, symmetric
from .panel import spread


def w_from_prec(prec: DataFrame, *keys: str) -> DataFrame:
    """Row sums of the precision matrix over their total, per day (and extra keys)."""
    keys = keys or ("day",)
    mirrored = F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("asset")))).otherwise(
        F.array(F.struct(F.col("i").alias("asset")), F.struct(F.col("j").alias("asset"))))
    rows = prec.select(*keys, "v", F.inline(mirrored)).groupBy(*keys, "asset").agg(F.sum("v").alias("s"))
    return rows.select(*keys, "asset", F.try_divide("s", F.sum("s").over(Window.partitionBy(*keys))).alias("w"))


def gmvp(cov: DataFrame) -> DataFrame:
    """D2, last step: minimum-variance weights of each day's matrix, one K x K solve per group."""
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names, s = symmetric(pdf["i"].to_numpy(dtype=str), pdf["j"].to_numpy(dtype=str), pdf["v"].to_numpy())
        try:
            w = min_variance(s)
        except np.linalg.LinAlgError:
            w = np.full(len(s), np.nan)
        return pd.DataFrame({"day": pdf["day"].iloc[0], "asset": names, "w": w})

    return spread(cov.select("day", "i", "j", "v"), "day").groupBy("day").applyInPandas(
        solve, "day date, asset string, w double")


def gmvp_sample(cov: DataFrame, window: int = 40) -> DataFrame:
    """Minimum variance under the rolling mean of the preceding daily matrices."""
    from .covariance import rolling_cov

    return gmvp(rolling_cov(cov, window))


def shrunk_cov(returns: DataFrame, cov: DataFrame, window: int = 40) -> DataFrame:
    """D3, first step: rolling covariance per bar, shrunk towards a scaled identity.

    The Ledoit-Wolf intensity of zero-mean bars needs, besides the matrix, only
    the fourth power of each bar's length: sum |x|^4. Both add up over days, so
    everything is windows and sums; no task ever holds a window of bars.
    Returns (day, i, j, v, shrinkage).
    """
    lengths = (returns.groupBy("day", "bar").agg(F.sum(F.col("ret") * F.col("ret")).alias("q"))
               .groupBy("day").agg(F.sum(F.col("q") * F.col("q")).alias("q4"),
                                   F.count(F.lit(1)).alias("m")))
    days = Window.orderBy("day").rowsBetween(-window, -1)  # one row per day
    past = lengths.select("day", F.sum("q4").over(days).alias("q4"), F.sum("m").over(days).alias("m"),
                          F.count("q4").over(days).alias("seen")).filter(F.col("seen") == window)
    cells = Window.partitionBy("i", "j").orderBy("day").rowsBetween(-window, -1)
    rolled = (cov.select("day", "i", "j", F.sum("v").over(cells).alias("total"))
              .join(past.select("day", "q4", "m"), "day")
              .withColumn("v", F.col("total") / F.col("m")))
    on = F.col("i") == F.col("j")
    sums = rolled.groupBy("day").agg(
        F.sum(F.when(on, F.col("v"))).alias("tr"), F.count_if(on).alias("k"),
        F.sum(F.when(on, 1.0).otherwise(2.0) * F.col("v") * F.col("v")).alias("norm2"))
    mu = F.col("tr") / F.col("k")
    far = F.col("norm2") - F.col("k") * mu * mu
    noise = (F.col("q4") / F.col("m") - F.col("norm2")) / F.col("m")
    share = F.when(far > 0, F.least(F.greatest(noise, F.lit(0.0)), far) / far).otherwise(1.0)
    return (rolled.join(sums, "day").withColumn("shrinkage", share)
            .select("day", "i", "j", ((1 - F.col("shrinkage")) * F.col("v")
                                      + F.when(on, F.col("shrinkage") * mu).otherwise(0.0)).alias("v"),
                    "shrinkage"))


def gmvp_shrink(returns: DataFrame, cov: DataFrame, window: int = 40) -> DataFrame:
    """D3: minimum variance under the shrunk rolling covariance."""
    return gmvp(shrunk_cov(returns, cov, window))


def gmvp_glasso(cov: DataFrame, lam: float, window: int = 40, ridges: Sequence[float] = (0.0,), **solver) -> DataFrame:
    """Minimum variance through the sparse precision of the rolling covariance, with the retry chain C4."""
    from .covariance import glasso, precision_cells, rolling_cov

    return w_from_prec(precision_cells(glasso(rolling_cov(cov, window), [lam], ridges=ridges, **solver)))


def equal_weights(panel: DataFrame) -> DataFrame:
    """1 / number of assets of the day."""
    return panel.select("day", "asset").distinct().withColumn(
        "w", 1 / F.count(F.lit(1)).over(Window.partitionBy("day")))


def renormalise(pred: DataFrame, *keys: str, floor: float = 1e-10) -> DataFrame:
    """Divide by the day's total; a total within +-floor counts as 1."""
    total = F.sum("w_hat").over(Window.partitionBy(*(keys or ("model", "day"))))
    return pred.withColumn("w_hat", F.col("w_hat") / F.when(F.abs(total) < floor, 1.0).otherwise(total))


def box(pred: DataFrame, lim: float = 0.05, rounds: int = 10, keys: tuple[str, ...] = ("model", "day")) -> DataFrame:
    """Clip to +-lim and hand the missing total to the assets still inside, `rounds` times.

    Every round sums over the same partition (one day of one model, K rows), so
    the whole chain needs one shuffle.  A day whose assets cannot add up to 1 within
    the limits stops the job."""
    day = Window.partitionBy(*keys)
    room = F.count(F.lit(1)).over(day) * lim
    pred = pred.withColumn("w_hat", F.when(room >= 1 - 1e-9, F.col("w_hat")).otherwise(
        F.raise_error(F.lit(f"assets within +-{lim} cannot add up to 1")).cast("double")))

    def clip(x):
        return F.greatest(F.lit(-lim), F.least(F.lit(lim), x))

    out = pred.select(*keys, "asset", clip(F.col("w_hat")).alias("w_hat"))
    for _ in range(rounds):
        free = F.abs("w_hat") < lim
        share = (1 - F.sum("w_hat").over(day)) / F.count_if(free).over(day)
        out = out.select(*keys, "asset", clip(F.when(free, F.col("w_hat") + share)
                                              .otherwise(F.col("w_hat"))).alias("w_hat"))
    return out


def decision_focused(pred: DataFrame, cov: DataFrame, before: DataFrame, eta: float, rho: float,
                     lim: float | None = None, rounds: int = 10) -> DataFrame:
    """(S + (eta + rho) I) w = eta w_before + rho w_hat, with sum w = 1, then the box.

    `cov` is a covariance known before the day, `before` the weights held
    (day, asset, w_before, and optionally eta per asset). Days are independent:
    one K x K solve per day serves all models of that day.
    """
    own_eta = "eta" in before.columns
    left = pred.join(before, ["day", "asset"]).select(
        "model", "day", "asset", "w_hat", "w_before", (F.col("eta") if own_eta else F.lit(eta)).alias("eta"))

    def solve(_, p: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if p.empty or c.empty:
            return pd.DataFrame(columns=["model", "day", "asset", "w_hat"], dtype=object)
        names, s = symmetric(c["i"].to_numpy(dtype=str), c["j"].to_numpy(dtype=str), c["v"].to_numpy())
        out = []
        for model, g in p.groupby("model"):
            g = g.set_index("asset").reindex(names)
            e = g["eta"].to_numpy()
            a = s + np.diag(e + rho)
            both = np.linalg.solve(a, np.column_stack([e * g["w_before"] + rho * g["w_hat"], np.ones(len(s))]))
            w = both[:, 0] + both[:, 1] * (1 - both[:, 0].sum()) / both[:, 1].sum()
            out.append(pd.DataFrame({"model": model, "day": p["day"].iloc[0], "asset": names, "w_hat": w}))
        return pd.concat(out)

    solved = spread(left, "day").groupBy("day").cogroup(spread(cov.select("day", "i", "j", "v"), "day").groupBy("day")).applyInPandas(
        solve, "model string, day date, asset string, w_hat double")
    return solved if lim is None else box(solved, lim, rounds)


def held_before(weights: DataFrame) -> DataFrame:
    """(day, asset, w_before): the realised weights of the previous day."""
    w = Window.partitionBy("asset").orderBy("day")
    return weights.select("day", "asset", F.lag("w").over(w).alias("w_before")).filter(
        F.col("w_before").isNotNull())


def decision_focused_own(pred: DataFrame, cov: DataFrame, eta: float, rho: float, lim: float,
                         rounds: int = 10) -> DataFrame:
    """F7 with the model's own previous decision as w_before, clipped to the box each day.

    The decision is affine in the previous one, w = M w_before + b. M and b are
    computed for all days in parallel; only the recursion over days is
    sequential. It streams: the partition of a model is sorted by day and read
    batch by batch, holding one K-vector per model. The first day starts from
    the forecast itself.
    """
    def affine(_, p: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        cols = ["model", "day", "assets", "m", "b", "first"]
        if p.empty or c.empty:
            return pd.DataFrame(columns=cols, dtype=object)
        names, s = symmetric(c["i"].to_numpy(dtype=str), c["j"].to_numpy(dtype=str), c["v"].to_numpy())
        k = len(s)
        inv = np.linalg.inv(s + (eta + rho) * np.eye(k))
        u = inv.sum(axis=1) / inv.sum()
        keep = np.eye(k) - np.outer(u, np.ones(k))  # takes a solution to the plane sum w = 1
        m = eta * keep @ inv
        out = []
        for model, g in p.groupby("model"):
            stat = g.set_index("asset").reindex(names)["w_hat"].to_numpy()
            out.append((model, p["day"].iloc[0], names.tolist(), m.ravel().tolist(),
                        (rho * keep @ inv @ stat + u).tolist(), stat.tolist()))
        return pd.DataFrame(out, columns=cols)

    def clip_rounds(w):
        for _ in range(rounds):
            w = np.clip(w, -lim, lim)
            free = np.abs(w) < lim
            if free.any():
                w = np.where(free, w + (1 - w.sum()) / free.sum(), w)
        return np.clip(w, -lim, lim)

    def recurse(batches):
        last: dict[str, np.ndarray] = {}
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                before = last.get(row.model, np.asarray(row.first))
                w = clip_rounds(np.asarray(row.m).reshape(len(before), -1) @ before + row.b)
                last[row.model] = w
                out.append(pd.DataFrame({"model": row.model, "day": row.day, "asset": row.assets, "w_hat": w}))
            if out:
                yield pd.concat(out)

    steps = (spread(pred.select("model", "day", "asset", "w_hat"), "day").groupBy("day")
             .cogroup(spread(cov.select("day", "i", "j", "v"), "day").groupBy("day"))
             .applyInPandas(affine, "model string, day date, assets array<string>, m array<double>, "
                                    "b array<double>, first array<double>"))
    return (steps.repartition("model").sortWithinPartitions("model", "day")
            .mapInPandas(recurse, "model string, day date, asset string, w_hat double"))
