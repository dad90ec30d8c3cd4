"""Vector autoregressions fitted from moments, grid search and model selection.

All equations share one design, so a fold is reduced once, by a distributed
sum, to the moments of [1, x, y] (and of the changes of x).  The fits then are
many independent small problems: a group is one fold, one penalty path and one
block of equations.  It receives p^2 moments, never data rows.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import least_squares, solve_lasso
from .evaluate import accuracy, fold_dispersion, turnover_econ, turnover_seq
from .panel import spread


@dataclass(frozen=True)
class Layout:
    """Positions of the design: `lags` blocks of `n_assets`, then `n_exog` columns."""

    n_assets: int
    lags: int
    n_exog: int

    @property
    def p(self) -> int:
        return self.lags * self.n_assets + self.n_exog

    @property
    def n_lagged(self) -> int:
        return self.lags * self.n_assets


@dataclass(frozen=True)
class Config:
    """One model specification.

    kind 'ols' or 'lasso'; lam on lags, lam_exog on exogenous columns (None: the
    columns are left out), lam_net added for unconnected pairs, tau the
    threshold of the network mean, lam_smooth the penalty on forecast changes.  With
    use_last_day the network is that of the last training day instead of the mean over training.
    """

    model: str
    config_id: int
    lam: float = 0.0
    lam_exog: float | None = None
    lam_net: float = 0.0
    tau: float | None = None
    lam_smooth: float = 0.0
    self_free: bool = False
    kind: str = "lasso"
    use_last_day: bool = False


def design(features: DataFrame, targets: DataFrame) -> DataFrame:
    """(t, day, x, dx, y): assembled features next to the target array of the day."""
    return features.join(targets, "t").select("t", "day", "x", "dx", "y")


def moments(rows: DataFrame, cuts: Sequence[int]) -> DataFrame:
    """(fold, kind, i, j, v), sums of products over the training rows t < cut of each fold.

    kind 'z' is the vector [1, x, y], kind 'd' the change of x; i <= j.  Each
    row belongs to one segment between two cuts and is multiplied out once;
    a fold adds up the segments before its cut.  Partitions send one partial
    matrix per segment, so the shuffle does not grow with the number of rows.
    """
    n_folds = len(cuts)
    cuts_col = F.array(*[F.lit(int(c)) for c in sorted(cuts)])
    seg = F.size(F.filter(cuts_col, lambda c: c <= F.col("t")))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple[int, str], np.ndarray] = {}
        for pdf in batches:
            for s, g in pdf.groupby("seg"):
                x, y = np.stack(g["x"]), np.stack(g["y"])
                z = np.column_stack([np.ones(len(g)), x, y])
                d = np.stack(g["dx"]).astype(float)
                d = d[~np.isnan(d).any(axis=1)]
                for kind, m in (("z", z.T @ z), ("d", d.T @ d)):
                    acc[s, kind] = acc.get((s, kind), 0.0) + m
        for (s, kind), m in acc.items():
            yield pd.DataFrame({"seg": s, "kind": kind, "i": range(len(m)),
                                "vals": [m[i, i:].tolist() for i in range(len(m))]})

    parts = (rows.select(seg.alias("seg"), "x", "dx", "y").filter(F.col("seg") < n_folds)
             .mapInPandas(partial, "seg int, kind string, i int, vals array<double>"))
    cells = parts.select("kind", "i", "seg", F.posexplode("vals").alias("off", "v")).select(
        F.explode(F.sequence("seg", F.lit(n_folds - 1))).alias("fold"), "kind", "i",
        (F.col("i") + F.col("off")).alias("j"), "v")
    return cells.groupBy("fold", "kind", "i", "j").agg(F.sum("v").alias("v"))


#: Sweeps of a block before its open equations are ended by exact steps.
SWEEPS = 200
#: Groups (blocks times bundles of paths) of a fold that keep a cluster's tasks busy.
BUSY = 32
#: Arrow types of the columns of keys
ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "date": pa.date32(), "double": pa.float64()}
MOMENT, CHANGE, LINK, LAST = 0, 1, 2, 3
FITTED = ("model string, config_id int, fold int, equation int, intercept double, "
          "pos array<int>, beta array<double>, density double, seconds double, converged boolean")


def fit(mom: DataFrame, configs: Sequence[Config], layout: Layout, links: DataFrame | None = None,
        block: int = 32, path_length: int = 16) -> DataFrame:
    """One row per (config, fold, equation), non-zero coefficients as arrays.

    `links` is (fold, i, j, p): network means between assets numbered from 0,
    either direction once; a config connects the pairs with p >= tau.  A column `variant` may tell the
    mean over training ('mean') from the last training day ('last'); each config takes its own.  The
    configs of one model form paths of at most `path_length`, solved from the
    largest penalty down with warm starts; paths and blocks run in parallel.
    `converged` is false where neither sweeps nor exact steps met the conditions of a block.
    """
    p, k = layout.p, layout.n_assets
    plain = [c for c in configs if c.kind == "ols"]
    if plain and block < k:  # one factorisation of a fold serves all its equations
        rest = [c for c in configs if c.kind != "ols"]
        whole = fit(mom, plain, layout, links, k, path_length)
        return whole.unionAll(fit(mom, rest, layout, links, block, path_length)) if rest else whole
    n_blocks = -(-k // block)
    if links is None or "variant" not in links.columns:
        wrong = [c.config_id for c in configs if c.use_last_day and c.tau is not None]
        if wrong:
            raise ValueError(f"configs {wrong} use the last day's network, which links do not hold")
    ordered = sorted(configs, key=lambda c: (c.model, c.use_last_day, -c.lam_net, c.tau or 0.0, -(c.lam_exog or 0.0), -c.lam,
                                             -c.lam_smooth))
    paths: list[list[Config]] = []
    for _, group in groupby(ordered, key=lambda c: c.model):
        run = list(group)
        paths += [run[start:start + path_length] for start in range(0, len(run), path_length)]
    smooth = any(c.lam_smooth for c in configs)
    # a group takes several paths once the blocks alone keep many tasks busy, so that matrices are not sent per path
    bundles = min(len(paths), -(-BUSY // n_blocks))

    # rows of the matrices travel as arrays: p of them per matrix instead of p^2 cells
    used = mom.filter((F.col("i") <= p) & ((F.col("kind") == "z") | F.lit(smooth)))
    target = F.when((F.col("kind") == "d") | (F.col("j") <= p), -1).otherwise(F.floor((F.col("j") - p - 1) / block))
    cells = used.select("fold", F.when(F.col("kind") == "z", MOMENT).otherwise(CHANGE).alias("kind"), "i", "j", "v",
                        target.cast("int").alias("target"))
    if links is not None:
        both = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
        variant = F.when(F.col("variant") == "last", LAST).otherwise(LINK) if "variant" in links.columns else F.lit(LINK)
        pairs = links.select("fold", variant.alias("kind"), F.inline(both), F.col("p").alias("v"))
        cells = cells.unionByName(pairs.withColumn("target", F.floor(F.col("j") / block).cast("int")))
    everywhere = F.sequence(F.lit(0), F.lit(n_blocks - 1))
    rows = (cells.groupBy("fold", "kind", "i", "target").agg(F.collect_list(F.struct("j", "v")).alias("c"))
            .select("fold", "kind", "i", F.col("c.j").alias("js"), F.col("c.v").alias("vs"),
                    F.explode(F.when(F.col("target") < 0, everywhere).otherwise(F.array("target"))).alias("block"))
            .select("*", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("path")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        fold, path, b = (pdf[c].iloc[0] for c in ("fold", "path", "block"))
        lo, m = b * block, min(block, k - b * block)
        g0, c0 = np.zeros((p + 1, p + 1)), np.zeros((p + 1, m))
        dd, network = np.zeros((p, p)), {LINK: np.zeros((k, m)), LAST: np.zeros((k, m))}
        for kind, i, js, vs in zip(pdf["kind"], pdf["i"], pdf["js"], pdf["vs"]):
            if kind in network:
                network[kind][i, js - lo] = vs
            elif kind == CHANGE:
                dd[i, js] = dd[js, i] = vs
            elif js[0] <= p:
                g0[i, js] = g0[js, i] = vs
            else:
                c0[i, js - p - 1 - lo] = vs

        n = g0[0, 0]
        mean, y_mean = g0[0, 1:] / n, c0[0] / n
        cov = g0[1:, 1:] / n - np.outer(mean, mean)
        sd = np.maximum(np.sqrt(np.maximum(np.diag(cov), 0.0)), 1e-8)
        gram, change = cov / np.outer(sd, sd), dd / n / np.outer(sd, sd)
        cross = (c0[1:] / n - np.outer(mean, y_mean)) / sd[:, None]
        asset = np.arange(layout.n_lagged) % k
        own = asset[:, None] == np.arange(lo, lo + m)[None, :]
        other = np.arange(k)[:, None] != np.arange(lo, lo + m)[None, :]

        out, beta = [], np.zeros((p, m))
        for first, c in ((n == 0, c) for run in paths[path::bundles] for n, c in enumerate(run)):
            began = time.perf_counter()
            if first:
                beta, before = np.zeros((p, m)), None
            link = network[LAST if c.use_last_day else LINK]
            near = own | (link[asset] >= c.tau) if c.tau is not None else np.ones_like(own)
            keep = np.arange(p) < (p if c.lam_exog is not None else layout.n_lagged)
            pen = np.full((p, m), c.lam_exog or 0.0)
            pen[: layout.n_lagged] = np.where(near, c.lam, c.lam + c.lam_net)
            if c.self_free:
                pen[: layout.n_lagged][own] = 0.0
            g = (gram + c.lam_smooth * change)[np.ix_(keep, keep)]
            if c.kind == "ols":
                beta[keep], converged = least_squares(g, cross[keep]), True
            else:
                # the strong rule needs the same Gram matrix and columns as the step before
                same = before is not None and before[1:] == (c.lam_smooth, keep.sum())
                start, converged = solve_lasso(g, cross[keep], pen[keep], beta[keep], max_sweeps=SWEEPS,
                                               before=before[0][keep] if same else None)
                beta[keep], before = start, (pen, c.lam_smooth, keep.sum())
            beta[~keep] = 0.0
            raw = beta / sd[:, None]
            icept = y_mean - mean @ raw
            took = (time.perf_counter() - began) / m
            linked = (link >= c.tau)[other].mean() if c.tau is not None and k > 1 else None
            for e in range(m):
                pos = np.flatnonzero(raw[:, e])
                out.append((c.model, c.config_id, fold, lo + e, icept[e], (pos + 1).tolist(),
                            raw[pos, e].tolist(), linked, took, converged))
        return pd.DataFrame(out, columns=[f.split()[0] for f in FITTED.split(", ")])

    return spread(rows, "fold", "path", "block").groupBy("fold", "path", "block").applyInPandas(solve, FITTED)


def coefficients(fitted: DataFrame, assets: DataFrame) -> DataFrame:
    """Long coefficients (model, config_id, fold, asset, pos, beta), intercept at pos 0.

    `assets` is (equation, asset)."""
    pos = F.concat(F.array(F.lit(0)), "pos").alias("pos")
    beta = F.concat(F.array("intercept"), "beta").alias("beta")
    return (fitted.join(assets, "equation")
            .select("model", "config_id", "fold", "asset", pos, beta)
            .select("model", "config_id", "fold", "asset", F.inline(F.arrays_zip("pos", "beta"))))


#: Design rows of a block (by t), and bundles over which the runs of a fold are spread, of a forecast's product.
ROW_BLOCK, BUNDLES = 512, 8
FORECAST = "model string, config_id int, fold int, t int, day date, asset string, w_hat double"


def predict(long: DataFrame, coefs: DataFrame, normalise: bool = True) -> DataFrame:
    """F8: (model, config_id, fold, t, day, asset, w_hat), a blocked product of design rows and sparse coefficients.

    `long` is (fold, t, day, pos, v).  A row of the design travels as one array, a column of
    coefficients as its non-zero positions and values.  A group is one block of rows and the runs of one
    bundle: rows are sent BUNDLES times and coefficients once per block of rows, whatever their
    number, and the product of a group is one matrix product.  A run keeps all assets in its group, so forecasts
    are normalised there (D6).  Days that lack a position, or have a null there, get no forecast, as they take no part in fits.
    """
    types = {f.name: f.dataType.simpleString() for f in (*long.schema, *coefs.schema)}
    schema = ", ".join(f"{name} {types.get(name, kind)}" for name, kind in (f.split() for f in FORECAST.split(", ")))
    width = long.agg(F.max("pos")).scalar()
    whole = (long.groupBy("fold", "t", "day")
             .agg(F.count("v").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("c"))
             .filter(F.col("n") == width))
    rows = whole.select("fold", F.floor(F.col("t") / ROW_BLOCK).alias("part"), "t", "day", F.col("c.v").alias("x"),
                        F.explode(F.sequence(F.lit(0), F.lit(BUNDLES - 1))).alias("bundle"))
    columns = coefs.groupBy("model", "config_id", "fold", "asset").agg(F.collect_list(F.struct("pos", "beta")).alias("c")).select(
        "*", F.col("c.pos").alias("pos"), F.col("c.beta").alias("beta"),
        F.pmod(F.xxhash64("model", "config_id"), F.lit(BUNDLES)).cast("int").alias("bundle")).drop("c")
    parts = rows.select(F.col("fold").alias("of"), F.col("part").alias("rows_of")).distinct()
    columns = columns.join(parts, columns["fold"] == parts["of"]).drop("of")

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        n, m = left.num_rows, right.num_rows
        if not n or not m:
            return pa.table({f.split()[0]: [] for f in FORECAST.split(", ")}).cast(out_schema)
        x = np.concatenate([np.ones((n, 1)), left["x"].combine_chunks().flatten().to_numpy().reshape(n, -1)], axis=1)
        pos, beta = right["pos"].combine_chunks(), right["beta"].combine_chunks()
        dense = np.zeros((x.shape[1], m))
        dense[pos.flatten().to_numpy(), np.repeat(np.arange(m), pc.list_value_length(pos).to_numpy())] = beta.flatten().to_numpy()
        out = x @ dense
        if normalise:
            _, run = np.unique([f"{c}|{name}" for name, c in zip(right["model"].to_pylist(), right["config_id"].to_pylist())],
                               return_inverse=True)
            total = np.zeros((n, run.max() + 1))
            np.add.at(total.T, run, out.T)
            total[np.abs(total) < 1e-10] = 1.0
            out = out / total[:, run]
        a, b = pa.array(np.repeat(np.arange(n), m)), pa.array(np.tile(np.arange(m), n))
        made = {c: right[c].take(b) for c in ("model", "config_id", "fold", "asset")} | {c: left[c].take(a) for c in ("t", "day")}
        return pa.table(made | {"w_hat": out.ravel()}).select([f.split()[0] for f in FORECAST.split(", ")]).cast(out_schema)

    out_schema = pa.schema([(name, ARROW[types.get(name, kind)]) for name, kind in (f.split() for f in FORECAST.split(", "))])
    return rows.groupBy("fold", "part", "bundle").cogroup(columns.groupBy("fold", "rows_of", "bundle")).applyInArrow(product, schema)


def validation_rows(long: DataFrame, cuts: Sequence[int], horizon: int) -> DataFrame:
    """Design rows of each fold's validation window, (fold, t, day, pos, v)."""
    folds = F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(int(c)).alias("cut"))
                      for f, c in enumerate(sorted(cuts))])
    return (long.select("*", F.inline(folds))
            .filter((F.col("t") >= F.col("cut")) & (F.col("t") < F.col("cut") + horizon)).drop("cut"))


RUN = ("model", "config_id", "fold")


def fold_metrics(pred: DataFrame, fitted: DataFrame, weights: DataFrame, layout: Layout,
                 configs: Sequence[Config] = ()) -> DataFrame:
    """F10, first level: accuracy, turnovers, sparsity and seconds per config and fold.

    Models without exogenous columns have fewer coefficients to be zero."""
    narrow = [f"{c.model}|{c.config_id}" for c in configs if c.lam_exog is None]
    width = F.when(F.concat_ws("|", "model", "config_id").isin(narrow), layout.n_lagged).otherwise(layout.p)
    size = fitted.groupBy(*RUN).agg(
        F.sum(F.size("pos")).cast("double").alias("n_alive"), F.avg("density").alias("density"),
        F.sum("seconds").alias("fit_time_s"),
        (1 - F.sum(F.size("pos")) / (layout.n_assets * F.first(width)).cast("double")).alias("sparsity"))
    return (accuracy(pred, weights, RUN).withColumnRenamed("mse", "val_mse")
            .join(turnover_econ(pred, weights, RUN), list(RUN))
            .join(turnover_seq(pred, RUN), list(RUN))
            .join(size, list(RUN)))


METRICS = ["val_mse", "turnover_econ", "turnover_seq", "sparsity", "n_alive", "density", "fit_time_s"]


def grid_results(per_fold: DataFrame, configs: Sequence[Config], metrics: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """F10, second level: mean and sd over folds, next to the parameters of each config."""
    spark = per_fold.sparkSession
    params = spark.createDataFrame(
        [(c.model, c.config_id, c.lam, c.lam_exog, c.lam_net, c.tau, c.lam_smooth, c.self_free,
          c.use_last_day if c.tau is not None else None) for c in configs],
        "model string, config_id int, LAMBDA_LASSO double, LAMBDA_EXOG double, LAMBDA_NETWORK double, "
        "NETWORK_THRESHOLD double, LAMBDA_TURNOVER double, self_free boolean, USE_LAST_DAY boolean")
    means = fold_dispersion(per_fold, ["model", "config_id"], list(metrics))
    keep = [f"mean_{m}" for m in metrics]
    return params.join(means, ["model", "config_id"]).select(*params.columns, "std_val_mse", *keep)


def backtest(rows: DataFrame, long: DataFrame, weights: DataFrame, assets: DataFrame, configs: Sequence[Config],
             layout: Layout, cuts: Sequence[int], horizon: int, links: DataFrame | None = None,
             stage=lambda df, name: df) -> DataFrame:
    """fit every config on every expanding fold, forecast the days after it, score; one row each.

    One chain of jobs for all folds and configs, no loop over folds. `stage` (a
    function of table and name) writes the fits and the forecasts once, since
    both are read twice.
    """
    fitted = stage(fit(moments(rows, cuts), configs, layout, links), "fits")
    pred = stage(predict(validation_rows(long, cuts, horizon), coefficients(fitted, assets)), "forecasts")
    return fold_metrics(pred, fitted, weights, layout, configs)


def grid_search(rows: DataFrame, long: DataFrame, weights: DataFrame, assets: DataFrame, configs: Sequence[Config],
                layout: Layout, cuts: Sequence[int], horizon: int, links: DataFrame | None = None,
                stage=lambda df, name: df) -> DataFrame:
    """the backtest of every config, summarised over the folds."""
    return grid_results(backtest(rows, long, weights, assets, configs, layout, cuts, horizon, links, stage), configs)


def select_models(grid: DataFrame, chain: Sequence[tuple[str, str]] = (("M4", "M3a"),),
                  smooth: str = "M5", max_turnover: float | None = None, max_mse: float | None = None) -> DataFrame:
    """the chosen config of each model, with the reason.

    A model of `chain` is kept only where it beats its predecessor's best MSE.
    `smooth` takes the lowest-turnover config within the bounds, or the lowest
    MSE where none meets them.
    """
    best = grid.groupBy("model").agg(
        F.min_by(F.struct("config_id", "mean_val_mse", "mean_turnover_seq"),
                 F.struct("mean_val_mse", "config_id")).alias("b")).select("model", "b.*")
    best = best.withColumn("reason", F.lit("lowest MSE"))
    for model, rival in chain:
        mark = best.filter(F.col("model") == rival).select("mean_val_mse").scalar()
        best = best.withColumn("rival", mark).withColumn("reason", F.when(
            F.col("model") != model, F.col("reason")).when(
            F.col("mean_val_mse") < F.col("rival"), F.lit(f"beats {rival}")).otherwise(
            F.lit(f"dropped: does not beat {rival}"))).drop("rival")
    if max_turnover is None and max_mse is None:
        return best
    within = F.lit(True)
    if max_turnover is not None:
        within = within & (F.col("mean_turnover_seq") <= max_turnover)
    if max_mse is not None:
        within = within & (F.col("mean_val_mse") <= max_mse)
    bounded = grid.filter((F.col("model") == smooth) & within).groupBy("model").agg(
        F.min_by(F.struct("config_id", "mean_val_mse", "mean_turnover_seq"),
                 F.struct("mean_turnover_seq", "mean_val_mse", "config_id")).alias("c"))
    return best.join(bounded, "model", "left").select(
        "model", *[F.coalesce(f"c.{n}", n).alias(n) for n in ("config_id", "mean_val_mse", "mean_turnover_seq")],
        F.when(F.col("c").isNotNull(), "within bounds")
        .when(F.col("model") == smooth, "no config within bounds; lowest MSE")
        .otherwise(F.col("reason")).alias("reason"))


def check_interior(grid: DataFrame, parameters: Sequence[str]) -> DataFrame:
    """does the best value of each parameter lie strictly inside the values tried?"""
    rows = grid.select("model", "config_id", "mean_val_mse", F.inline(F.array(*[
        F.struct(F.lit(p).alias("parameter"), F.col(p).alias("value")) for p in parameters]))).filter(
        F.col("value").isNotNull())
    out = rows.groupBy("model", "parameter").agg(
        F.min("value").alias("lowest"), F.max("value").alias("highest"),
        F.min_by("value", F.struct("mean_val_mse", "config_id")).alias("chosen"))
    return out.withColumn("interior", (F.col("chosen") > F.col("lowest")) & (F.col("chosen") < F.col("highest")))
