"""Group F: moments, fits, forecasts, grid search and selection.

The daily share panel is the target. Queries ending in `_single` use one
regressor (orders of the day before), where lasso and least squares have closed
forms in SQL; the others use three lags of all assets and eight order-flow
columns and are checked by properties in tests/.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import fit as fm
from ..operators import network as nw
from ..operators.portfolio import renormalise
from ..operators.recurrent import score_sequences
from ..sources import bindings as b
from ..sources.scratch import stage
from .covariance import months, r
from .sqltext import weights_cte

LAGS = 3
CUTS, HORIZON = [1200, 1450, 1690], 240
#: months before each cut (the cuts are days), for the network of each fold
MONTH_CUTS = [39, 47, 55]
TAU = 0.3
SINGLE_LAMS = [0.0, 0.0005, 0.001, 0.002]
SINGLE = [fm.Config("ols", 0, lam_exog=0.0, kind="ols")] + [
    fm.Config("lasso", n + 1, lam_exog=lam) for n, lam in enumerate(SINGLE_LAMS)] + [
    fm.Config("smooth", 9, lam_exog=SINGLE_LAMS[1], lam_smooth=0.5)]

FULL = [
    fm.Config("M1", 0, kind="ols"),
    fm.Config("M2", 1, lam=5e-4), fm.Config("M2", 2, lam=2e-3),
    fm.Config("M3", 3, lam=3e-4, lam_exog=5e-4), fm.Config("M3", 4, lam=2e-3, lam_exog=5e-4),
    fm.Config("M3a", 5, lam=4.5e-4, lam_exog=5e-4, self_free=True),
    fm.Config("M4", 6, lam=3e-4, lam_exog=5e-4, lam_net=1e-3, tau=TAU, self_free=True),
    fm.Config("M4", 7, lam=3e-4, lam_exog=5e-4, lam_net=1e-3, tau=0.7, self_free=True),
    fm.Config("M4", 8, lam=2e-3, lam_exog=5e-4, lam_net=1e-3, tau=TAU, self_free=True),
    fm.Config("M5", 9, lam=3e-4, lam_exog=5e-4, lam_net=1e-3, tau=TAU, self_free=True, lam_smooth=1e-3),
    fm.Config("M5", 10, lam=3e-4, lam_exog=5e-4, lam_net=1e-3, tau=TAU, self_free=True, lam_smooth=1.0),
    fm.Config("M4", 11, lam=3e-4, lam_exog=5e-4, lam_net=1e-3, tau=TAU, self_free=True, use_last_day=True),
    fm.Config("M4", 12, lam=3e-4, lam_exog=5e-4, lam_net=1e-3, tau=0.5, self_free=True),
    fm.Config("M4", 13, lam=3e-4, lam_exog=5e-4, lam_net=1e-3, tau=0.7, self_free=True, use_last_day=True),
    fm.Config("M4", 14, lam=3e-4, lam_exog=5e-4, lam_net=1e-3, tau=0.9, self_free=True),
]


def equations(panel):
    """(equation, asset): assets numbered from 0 in name order; K rows."""
    return panel.select("asset").distinct().withColumn(
        "equation", F.row_number().over(Window.orderBy("asset")) - 1)


def full_design(spark, sf, asset="p_type", p=LAGS):
    """weights, long design (t, day, pos, v), assembled rows, names."""
    w = b.weights(spark, sf, "day", asset)
    lags = ft.lag_features(w, p)
    ex = ft.exog_columns(ft.join_exog(w, b.exog(spark, sf)))
    names = ft.feature_names(lags, ex)
    long = stage(ft.positioned(lags, ex, names), "design")
    return w, long, names


def rows_of(w, long, p, width):
    targets = ft.target_arrays(ft.align_targets(long.select("t"), w, p))
    return stage(fm.design(ft.assemble(long, width), targets), "rows")


def layout_of(k, p=LAGS, n_exog=8):
    return fm.Layout(k, p, n_exog)


def fold_links(abar, eq, month_cuts):
    """(fold, i, j, p, variant): network means over the months before each cut and those of the last one, assets numbered."""
    folds = F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(c).alias("cut")) for f, c in enumerate(month_cuts)])
    # one pass for both: pairs not linked on a day have no row there
    sums = (abar.select("t", "i", "j", "p", F.inline(folds)).filter(F.col("t") < F.col("cut"))
            .groupBy("fold", "i", "j", "cut").agg(
                F.sum("p").alias("all"), F.sum(F.when(F.col("t") == F.col("cut") - 1, F.col("p"))).alias("last")))
    means = sums.select("fold", "i", "j", F.inline(F.array(
        F.struct(F.lit("mean").alias("variant"), (F.col("all") / (F.col("cut") - 19)).alias("p")),
        F.struct(F.lit("last").alias("variant"), F.col("last").alias("p"))))).filter("p IS NOT NULL")
    ei = eq.select(F.col("asset").alias("i"), F.col("equation").alias("a"))
    ej = eq.select(F.col("asset").alias("j"), F.col("equation").alias("c"))
    return means.join(ei, "i").join(ej, "j").select("fold", F.col("a").alias("i"), F.col("c").alias("j"), "p", "variant")


def asset_links(spark, sf, asset, eq, month_cuts=MONTH_CUTS, threshold=0.1):
    edges = stage(b.correlated_pairs(b.trade_returns(spark, sf, asset), threshold), "edges")
    return stage(fold_links(nw.rolling_network_mean(edges, months(spark, sf)), eq, month_cuts), "links")


def single_design(spark, sf):
    w = b.weights(spark, sf, "day", "p_type")
    days = ft.index_days(w).select("t", "day").distinct()
    orders = b.exog(spark, sf).filter("name = 'n_orders'")
    long = (ft.join_exog(days, orders).join(days, "day").filter("x is not null")
            .select("t", "day", F.lit(1).alias("pos"), F.col("x").alias("v")))
    return w, stage(long, "design")


def _moments(spark, sf):
    w = b.weights(spark, sf, "day", "p_type")
    lags = ft.lag_features(w, 1)
    names = ft.feature_names(lags, b.exog(spark, sf).limit(0))
    order = lags.withColumn("kind", F.lit("lag")).join(names, ["kind", "lag", "name"]).select("t", "day", "pos", "v")
    rows = rows_of(w, stage(order, "design"), 1, 6)
    return fm.moments(rows, CUTS).select("fold", "kind", "i", "j", *r("v", digits=6))


def _moments_full(spark, sf):
    """Three lags and eight exogenous columns, as the fits take them."""
    w, long, _ = full_design(spark, sf)
    mom = fm.moments(rows_of(w, long, LAGS, layout_of(6).p), CUTS)
    return mom.select("fold", "kind", "i", "j", *r("v", digits=6))


def single_fit(spark, sf):
    w, long = single_design(spark, sf)
    fitted = fm.fit(fm.moments(rows_of(w, long, 0, 1), CUTS), SINGLE, fm.Layout(6, 0, 1))
    return w, long, stage(fitted, "fits")


def _ols_single(spark, sf):
    w, _, fitted = single_fit(spark, sf)
    coefs = fm.coefficients(fitted.filter("model = 'ols'"), equations(w))
    return coefs.groupBy("fold", "asset").agg(
        F.round(F.max(F.when(F.col("pos") == 0, F.col("beta"))), 7).alias("intercept"),
        F.round(F.max(F.when(F.col("pos") == 1, F.col("beta"))), 9).alias("slope"))


def _lasso_single(spark, sf, model="lasso"):
    w, _, fitted = single_fit(spark, sf)
    coefs = fm.coefficients(fitted.filter(F.col("model") == model), equations(w))
    return coefs.groupBy("config_id", "fold", "asset").agg(
        F.round(F.max(F.when(F.col("pos") == 0, F.col("beta"))), 7).alias("intercept"),
        F.round(F.coalesce(F.max(F.when(F.col("pos") == 1, F.col("beta"))), F.lit(0.0)), 9).alias("slope"))


def _predict_single(spark, sf):
    w, long, fitted = single_fit(spark, sf)
    pred = fm.predict(fm.validation_rows(long, CUTS, HORIZON), fm.coefficients(fitted, equations(w)))
    return pred.select("model", "config_id", "fold", "t", "day", "asset", *r("w_hat", digits=8))


def _grid_single(spark, sf):
    w, long = single_design(spark, sf)
    grid = fm.grid_search(rows_of(w, long, 0, 1), long, w, equations(w), SINGLE, fm.Layout(6, 0, 1), CUTS, HORIZON,
                          stage=stage)
    return grid.select("model", "config_id", "LAMBDA_EXOG", *r("mean_val_mse", "std_val_mse", digits=9),
                       *r("mean_turnover_econ", "mean_turnover_seq", "mean_sparsity", "mean_n_alive"))


def full_fit(spark, sf, configs=None):
    w, long, _ = full_design(spark, sf)
    eq = stage(equations(w), "assets")
    links = asset_links(spark, sf, "p_type", eq)
    mom = fm.moments(rows_of(w, long, LAGS, layout_of(6).p), CUTS)
    return fm.fit(mom, configs or FULL, layout_of(6), links), eq


def _fit_of(*models):
    def query(spark, sf):
        fitted, eq = full_fit(spark, sf, [c for c in FULL if c.model in models])
        return fm.coefficients(fitted, eq).select("model", "config_id", "fold", "asset", "pos", *r("beta", digits=8))
    return query


def full_grid(spark, sf):
    w, long, _ = full_design(spark, sf)
    eq = stage(equations(w), "assets")
    links = asset_links(spark, sf, "p_type", eq)
    return fm.grid_search(rows_of(w, long, LAGS, layout_of(6).p), long, w, eq, FULL, layout_of(6), CUTS, HORIZON,
                          links, stage)


def _grid(spark, sf):
    return full_grid(spark, sf).drop("mean_fit_time_s")


def _backtest(spark, sf):
    w, long, _ = full_design(spark, sf)
    eq = stage(equations(w), "assets")
    links = asset_links(spark, sf, "p_type", eq)
    scores = fm.backtest(rows_of(w, long, LAGS, layout_of(6).p), long, w, eq, FULL, layout_of(6), CUTS, HORIZON,
                         links, stage)
    return scores.drop("fit_time_s")


def _backtest_single(spark, sf):
    w, long = single_design(spark, sf)
    scores = fm.backtest(rows_of(w, long, 0, 1), long, w, equations(w), SINGLE, fm.Layout(6, 0, 1), CUTS, HORIZON,
                         stage=stage)
    return scores.select("model", "config_id", "fold", *r("val_mse", "mae", digits=9),
                         *r("turnover_econ", "turnover_seq", "n_alive"))


@lru_cache
def recurrent_parameters(n_features: int, hidden: int, k: int) -> dict:
    """A fixed set of network parameters, given by a rule: smooth, bounded, no randomness.
    Stands for the parameters of a trained network."""
    def wave(rows, cols, phase):
        a, c = np.meshgrid(np.arange(rows), np.arange(cols), indexing="ij")
        return np.sin(0.7 * a + 1.3 * c + phase) / np.sqrt(cols)

    gates = {g: (wave(hidden, n_features + hidden, n), np.full(hidden, 1.0 if g == "f" else 0.0))
             for n, g in enumerate("fioc")}
    return {"gates": gates, "out": (wave(k, hidden, 9.0), np.zeros(k))}


def _sequences(spark, sf, seq_len=30):
    w = b.weights(spark, sf)
    lags = ft.lag_features(w, 1)
    scaled = ft.apply_scaler(lags.withColumn("pos", F.col("name")),
                             ft.fit_scaler(lags.withColumn("pos", F.col("name")).filter("t < 240")))
    x = stage(ft.assemble(scaled), "design")
    return w, ft.make_sequences(x, x.select("t", "day"), seq_len)


def _recurrent(spark, sf):
    """Score, fill the first 29 test days with the moving mean, renormalise."""
    w, seqs = _sequences(spark, sf)
    assets = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    scored = score_sequences(seqs, recurrent_parameters(6, 16, 6), assets)
    test = scored.withColumn("t", F.col("t") - 1)  # days of the test window from 0
    mean5 = b.naive_predictions(w).filter("model = 'mean5'").select("day", "asset", "w_hat")
    days = ft.index_days(w).select((F.col("t") - 1).alias("t"), "day", "asset")
    pad = days.join(mean5, ["day", "asset"]).select("t", "day", "asset", "w_hat")
    both = ft.pad_left(test.select("t", "day", "asset", "w_hat"), pad, 29)
    return renormalise(both, "day").select("day", "asset", "padded", *r("w_hat", digits=8))


QUERIES = {
    "f00_moments": _moments,
    "f00_moments_full": _moments_full,
    "f01_ols_single": _ols_single,
    "f01_var_ols": _fit_of("M1"),
    "f02_lasso_single": _lasso_single,
    "f02_sparse_var": _fit_of("M2"),
    "f03_sparse_varx": _fit_of("M3"),
    "f04_self_free": _fit_of("M3a"),
    "f05_network_varx": _fit_of("M4"),
    "f06_smoothed_single": lambda spark, sf: _lasso_single(spark, sf, "smooth"),
    "f06_smoothed_varx": _fit_of("M5"),
    "f08_predict_single": _predict_single,
    "f09_recurrent_scoring": _recurrent,
    "f10_grid_search_single": _grid_single,
    "f10_grid_search": _grid,
    "f13_backtest": _backtest,
    "f13_backtest_single": _backtest_single,
}

_SINGLE = f"""{weights_cte('day')},
od AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*)::DOUBLE AS x FROM orders GROUP BY 1),
z AS (SELECT w.t, w.day, w.asset, w.w AS y, o.x FROM idx w
      ASOF JOIN (SELECT CAST(day + INTERVAL 1 DAY AS DATE) AS day, x FROM od) o ON w.day >= o.day),
f(fold, cut) AS (VALUES {', '.join(f'({n}, {c})' for n, c in enumerate(CUTS))}),
zd AS (SELECT *, x - lag(x) OVER (PARTITION BY asset ORDER BY t) AS dx FROM z),
mo AS (SELECT fold, cut, asset, sum(dx * dx) / count(*) / var_pop(x) AS rough, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, covar_pop(x, y) AS cxy,
              regr_slope(y, x) AS slope FROM zd JOIN f ON zd.t < f.cut GROUP BY 1, 2, 3),
lam(model, config_id, l, ls) AS (VALUES ('ols', 0, 0.0::DOUBLE, 0.0::DOUBLE),
  ('smooth', 9, {SINGLE_LAMS[1]}::DOUBLE, 0.5::DOUBLE),
  {', '.join(f"('lasso', {n + 1}, {l}::DOUBLE, 0.0::DOUBLE)" for n, l in enumerate(SINGLE_LAMS))}),
co AS (SELECT model, config_id, l, fold, cut, asset, mx, my,
              sign(cxy) * greatest(abs(cxy) / sx - l, 0) / sx / (1 + ls * rough) + 0.0 AS slope FROM mo CROSS JOIN lam),
coef AS (SELECT *, my - mx * slope AS intercept FROM co),
raw AS (SELECT model, config_id, l, fold, z.t, z.day, z.asset, intercept + slope * x AS p
        FROM coef JOIN z ON z.asset = coef.asset AND z.t >= cut AND z.t < cut + {HORIZON}),
pred AS (SELECT *, p / sum(p) OVER (PARTITION BY model, config_id, fold, day) AS w_hat FROM raw)"""

_SCORED = """
b AS (SELECT day, asset, w, lag(w) OVER (PARTITION BY asset ORDER BY day) AS w_before FROM weights),
e AS (SELECT p.*, b.w, b.w_before, lag(w_hat) OVER (PARTITION BY model, config_id, fold, p.asset ORDER BY p.day) AS before
      FROM pred p JOIN b USING (day, asset)),
dd AS (SELECT model, config_id, l, fold, day, sum(abs(w_hat - w_before)) AS te, sum(abs(w_hat - before)) AS ts,
              avg((w_hat - w) * (w_hat - w)) AS se,
              avg(abs(w_hat - w)) AS ae FROM e GROUP BY ALL),
ff AS (SELECT model, config_id, l, fold, avg(se) AS val_mse, avg(ae) AS mae, avg(te) AS te, avg(ts) AS ts FROM dd GROUP BY ALL),
nz AS (SELECT model, config_id, fold, count(*) FILTER (slope <> 0)::DOUBLE AS n FROM coef GROUP BY ALL)"""

ORACLES = {
    "f00_moments": f"""
WITH {weights_cte('day')},
a AS (SELECT asset, CAST(row_number() OVER (ORDER BY asset) AS INT) AS k FROM assets),
x AS (SELECT t, asset, w AS y, lag(w) OVER p AS v, lag(w) OVER p - lag(w, 2) OVER p AS dv
      FROM idx WINDOW p AS (PARTITION BY asset ORDER BY t)),
z AS (SELECT t, 0 AS i, 1.0::DOUBLE AS v FROM idx WHERE t >= 1 GROUP BY t
      UNION ALL SELECT t, k, v FROM x JOIN a USING (asset) WHERE t >= 1
      UNION ALL SELECT t, k + 6, y FROM x JOIN a USING (asset) WHERE t >= 1),
d AS (SELECT t, k - 1 AS i, dv AS v FROM x JOIN a USING (asset) WHERE t >= 2),
f(fold, cut) AS (VALUES {', '.join(f'({n}, {c})' for n, c in enumerate(CUTS))}),
s AS (SELECT fold, 'z' AS kind, p.i, q.i AS j, sum(p.v * q.v) AS v FROM z p JOIN z q ON p.t = q.t AND p.i <= q.i
      JOIN f ON p.t < cut GROUP BY ALL
      UNION ALL SELECT fold, 'd', p.i, q.i, sum(p.v * q.v) FROM d p JOIN d q ON p.t = q.t AND p.i <= q.i
      JOIN f ON p.t < cut GROUP BY ALL)
SELECT fold, kind, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(v, 6) AS v FROM s""",
    "f01_ols_single": f"""
WITH {_SINGLE} SELECT fold, asset, round(my - mx * slope, 7) AS intercept, round(slope, 9) AS slope FROM mo""",
    "f02_lasso_single": f"""
WITH {_SINGLE} SELECT config_id, fold, asset, round(intercept, 7) AS intercept, round(slope, 9) AS slope
FROM coef WHERE model = 'lasso'""",
    "f06_smoothed_single": f"""
WITH {_SINGLE} SELECT config_id, fold, asset, round(intercept, 7) AS intercept, round(slope, 9) AS slope
FROM coef WHERE model = 'smooth'""",
    "f13_backtest_single": f"""
WITH {_SINGLE}, {_SCORED}
SELECT model, config_id, fold, round(val_mse, 9) AS val_mse, round(mae, 9) AS mae, round(te, 7) AS turnover_econ,
       round(ts, 7) AS turnover_seq, round(n, 7) AS n_alive FROM ff JOIN nz USING (model, config_id, fold)""",
    "f08_predict_single": f"""
WITH {_SINGLE} SELECT model, config_id, fold, CAST(t AS INT) AS t, day, asset, round(w_hat, 8) AS w_hat FROM pred""",
    "f10_grid_search_single": f"""
WITH {_SINGLE},
{_SCORED}
SELECT model, config_id, l AS "LAMBDA_EXOG", round(avg(val_mse), 9) AS mean_val_mse,
       round(stddev_pop(val_mse), 9) AS std_val_mse, round(avg(te), 7) AS mean_turnover_econ,
       round(avg(ts), 7) AS mean_turnover_seq, round(avg(1 - n / 6), 7) AS mean_sparsity, round(avg(n), 7) AS mean_n_alive
FROM ff JOIN nz USING (model, config_id, fold) GROUP BY ALL""",
}
