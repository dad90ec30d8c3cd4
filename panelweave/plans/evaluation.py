"""Group G: accuracy, tests, portfolio performance, tables.

Accuracy runs on weekly shares of the part types; portfolio measures on months
of the part types, where the daily bars inside a month give returns and
covariances.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import fit as fm
from ..operators import network as nw
from ..operators import quality as q
from ..operators.confidence_set import bootstrap_means, mcs
from ..operators.features import index_days
from ..sources import bindings as b
from ..sources.scratch import stage
from .covariance import _EDGES, brand_edges, months, r, type_cov
from .models import _SINGLE, CUTS, equations, single_fit
from .sqltext import cov_cte, predictions_cte, trade_returns_cte, weights_cte

ETA, REPS, BLOCK, SEED = 1e-2, 2000, 5, 1
GRID_CUTS, GRID_H = [120, 200, 280], 40
WINDOWS, TAUS = [4, 8, 16], [0.0, 0.25, 0.5]


def weekly(spark, sf):
    w = b.weights(spark, sf)
    return w, stage(b.naive_predictions(w), "predictions")


def monthly(spark, sf):
    """Weights, forecasts and day returns (summed bars) of the months."""
    w = b.weights(spark, sf, "month", "p_type")
    rets = b.trade_returns(spark, sf).groupBy("day", "asset").agg(F.sum("ret").alias("ret"))
    return w, stage(b.naive_predictions(w), "predictions"), rets


def _losses(spark, sf):
    w, pred = weekly(spark, sf)
    return stage(ev.daily_loss(pred, w), "losses")


def _mse(spark, sf):
    w, pred = weekly(spark, sf)
    return ev.mse(pred, w).select("model", *r("mse", digits=9))


def _mae(spark, sf):
    w, pred = weekly(spark, sf)
    return ev.mae(pred, w).select("model", *r("mae", digits=9))


def _coefs(spark, sf):
    w, _, fitted = single_fit(spark, sf)
    return fm.coefficients(fitted, equations(w))


KEYS = ("model", "config_id", "fold")


def _sparsity(spark, sf):
    return ev.sparsity(_coefs(spark, sf), 6, 1, KEYS).select(*KEYS, "n_alive", *r("sparsity"))


def _effective(spark, sf):
    return ev.effective_ratio(_coefs(spark, sf), F.get(F.array(*map(F.lit, CUTS)), F.col("fold")), KEYS).select(*KEYS, *r("per_equation", "t_over_p"))


def _turn_seq(spark, sf):
    _, pred = weekly(spark, sf)
    return ev.turnover_seq(pred).select("model", *r("turnover_seq", digits=9))


def _turn_econ(spark, sf):
    w, pred = weekly(spark, sf)
    return ev.turnover_econ(pred, w).select("model", *r("turnover_econ", digits=9))


def _dm(spark, sf, lags=0):
    out = ev.dm_test(_losses(spark, sf), "lag1", lags)
    return out.select("model", "n_days", *r("dm_stat", "dm_log10_p", digits=6))


def _boot(spark, sf):
    return bootstrap_means(_losses(spark, sf), REPS, BLOCK, SEED).select("rep", "model", *r("mean_loss", digits=9))


def _mcs(spark, sf):
    return mcs(_losses(spark, sf), 2000, BLOCK, SEED)


def _port(spark, sf):
    _, pred, rets = monthly(spark, sf)
    return pred, ev.portfolio_return(pred, rets)


def _returns(spark, sf):
    return _port(spark, sf)[1].select("model", "day", *r("ret", digits=8))


def _vol(spark, sf):
    return ev.volatility(_port(spark, sf)[1]).select("model", *r("volatility"))


def _variance(spark, sf):
    _, pred, _ = monthly(spark, sf)
    return ev.portfolio_variance(pred, type_cov(spark, sf)).select("model", "day", *r("variance"))


def _rpv(spark, sf):
    _, pred, _ = monthly(spark, sf)
    return ev.annual_rpv(ev.portfolio_variance(pred, type_cov(spark, sf))).select("model", *r("annual_rpv", digits=6))


def _sharpe(spark, sf):
    pred, port = _port(spark, sf)
    return ev.sharpe(port, ev.turnover_by_day(pred), ETA).select("model", *r("sharpe", "net_sharpe", digits=6))


def _drawdown(spark, sf):
    return ev.max_drawdown(_port(spark, sf)[1]).select("model", *r("max_drawdown"))


def _cumulative(spark, sf):
    return ev.cumulative(_port(spark, sf)[1]).select("model", "day", *r("cum"))


def _dfl_loss(spark, sf):
    w, pred, _ = monthly(spark, sf)
    loss = ev.dfl_loss(ev.portfolio_variance(pred, type_cov(spark, sf)), ev.economic_turnover_by_day(pred, w), ETA)
    return loss.select("model", "day", *r("loss"))


def _performance(spark, sf):
    """All portfolio measures of each model in one table."""
    w, pred, rets = monthly(spark, sf)
    port = stage(ev.portfolio_return(pred, rets), "returns")
    variance = ev.portfolio_variance(pred, type_cov(spark, sf))
    out = ev.compare(ev.sharpe(port, ev.turnover_by_day(pred), ETA), ev.volatility(port), ev.annual_rpv(variance),
                     ev.max_drawdown(port), ev.turnover_seq(pred), rank_by="net_sharpe")
    return out.select("model", "net_sharpe_rank", *r("sharpe", "net_sharpe", "volatility", "annual_rpv",
                                                     "max_drawdown", "turnover_seq", digits=6))


def _ablation(spark, sf):
    pred, port = _port(spark, sf)
    metrics = stage(ev.sharpe(port, ev.turnover_by_day(pred), ETA), "metrics")
    return ev.ablation(metrics, "mean20").select("model", *r("net_sharpe", "delta", digits=6))


def _describe(spark, sf):
    return ev.describe_weights(b.weights(spark, sf)).select("statistic", *r("value", digits=7))


def _daily(spark, sf):
    w = b.weights(spark, sf, "month", "p_brand")
    dens = nw.density(brand_edges(spark, sf), months(spark, sf), 25)
    return ev.daily_stats(w, dens).select("day", *r("gross", "short", "max_abs", "turnover", "density"))


def naive_grid(spark, sf):
    """Fold metrics of moving means (window) pulled to equal weight (tau): a grid SQL can rebuild.

    M3a is one mean of sixteen weeks, slightly pulled; M4 the grid of windows and
    pulls; M5 the same with longer windows only.  (model, config_id, fold, parameters, metrics)
    """
    w = b.weights(spark, sf)
    panel = index_days(w)
    order = Window.partitionBy("asset").orderBy("day")
    equal = 1 / F.count(F.lit(1)).over(Window.partitionBy("day"))
    means = panel.select("t", "day", "asset", equal.alias("equal"), *[
        F.avg("w").over(order.rowsBetween(-n, -1)).alias(f"m{n}") for n in WINDOWS])
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("config_id"), F.lit(float(n)).alias("LAMBDA_LASSO"),
                               F.lit(t).alias("NETWORK_THRESHOLD"),
                               ((1 - t) * F.col(f"m{n}") + t * F.col("equal")).alias("w_hat"))
                      for k, (m, n, t) in enumerate(naive_configs())])
    folds = F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(c).alias("cut")) for f, c in enumerate(GRID_CUTS)])
    pred = (means.select("t", "day", "asset", F.inline(cells)).select("*", F.inline(folds))
            .filter((F.col("t") >= F.col("cut")) & (F.col("t") < F.col("cut") + GRID_H)))
    pred = stage(pred, "forecasts")
    run = ("model", "config_id", "LAMBDA_LASSO", "NETWORK_THRESHOLD", "fold")
    return (ev.accuracy(pred, w, run).withColumnRenamed("mse", "val_mse")
            .join(ev.turnover_econ(pred, w, run), list(run)).join(ev.turnover_seq(pred, run), list(run)))


def naive_configs():
    return ([("M3a", WINDOWS[-1], 0.1)] + [("M4", n, t) for n in WINDOWS for t in TAUS]
            + [("M5", n, t) for n in WINDOWS[1:] for t in TAUS])


def naive_results(spark, sf):
    keys = ["model", "config_id", "LAMBDA_LASSO", "NETWORK_THRESHOLD"]
    per_fold = naive_grid(spark, sf)
    out = ev.fold_dispersion(per_fold, keys, ["val_mse", "turnover_econ", "turnover_seq"])
    return stage(out.withColumn("LAMBDA_NETWORK", F.lit(0.001)), "grid")


def _dispersion(spark, sf):
    return naive_results(spark, sf).select(
        "model", "config_id", "LAMBDA_LASSO", "NETWORK_THRESHOLD",
        *r("mean_val_mse", "std_val_mse", "mean_turnover_econ", "mean_turnover_seq", digits=9))


def _select(spark, sf):
    return fm.select_models(naive_results(spark, sf), max_turnover=0.05).select(
        "model", "config_id", *r("mean_val_mse", "mean_turnover_seq", digits=9), "reason")


def _interior(spark, sf):
    return fm.check_interior(naive_results(spark, sf), ["LAMBDA_LASSO", "NETWORK_THRESHOLD"]).select(
        "model", "parameter", "lowest", "highest", "chosen", "interior")


def _sensitivity(spark, sf):
    grid = naive_results(spark, sf)
    base = grid.filter("model = 'M3a'").agg(F.min("mean_val_mse"))
    return ev.sensitivity(grid.filter("model = 'M4'"), "LAMBDA_LASSO", base).select(
        "LAMBDA_LASSO", "n_configs", "n_better", *r("min_mse", "max_mse", digits=9))


def _slice(spark, sf):
    cols = ["model", "config_id", "LAMBDA_LASSO", "NETWORK_THRESHOLD", "mean_val_mse"]
    return ev.grid_slice(naive_results(spark, sf), "M4", cols).withColumn("mean_val_mse", F.round("mean_val_mse", 9))


def _improvement(spark, sf):
    w, pred = weekly(spark, sf)
    return ev.improvement(stage(ev.mse(pred, w), "mse"), "lag1").select("model", *r("mse", digits=9), *r("improvement_pct", digits=6))


QUERIES = {
    "g01_mse": _mse,
    "g02_mae": _mae,
    "g03_sparsity": _sparsity,
    "g04_effective_ratio": _effective,
    "g05_turnover_sequential": _turn_seq,
    "g06_turnover_economic": _turn_econ,
    "g07_diebold_mariano": _dm,
    "g07_diebold_mariano_hac": lambda spark, sf: _dm(spark, sf, 4),
    "g08_bootstrap_means": _boot,
    "g08_confidence_set": _mcs,
    "g09_portfolio_return": _returns,
    "g10_volatility": _vol,
    "g11_portfolio_variance": _variance,
    "g11_annual_rpv": _rpv,
    "g12_sharpe": _sharpe,
    "g13_max_drawdown": _drawdown,
    "g14_cumulative": _cumulative,
    "g15_decision_loss": _dfl_loss,
    "g16_performance": _performance,
    "g17_ablation": _ablation,
    "g18_describe_weights": _describe,
    "g19_daily_stats": _daily,
    "g20_sensitivity": _sensitivity,
    "g21_grid_slice": _slice,
    "g22_fold_dispersion": _dispersion,
    "g23_improvement": _improvement,
    "f11_model_selection": _select,
    "f12_interior_check": _interior,
}

WEEKLY = f"""{weights_cte()}, {predictions_cte()},
e AS (SELECT p.model, day, asset, p.w_hat, w, w_hat - w AS err,
             lag(p.w_hat) OVER (PARTITION BY p.model, asset ORDER BY day) AS before
      FROM predictions p JOIN weights USING (day, asset)),
held AS (SELECT day, asset, lag(w) OVER (PARTITION BY asset ORDER BY day) AS w_before FROM weights),
losses AS (SELECT model, day, avg(err * err) AS loss FROM e GROUP BY 1, 2),
moves AS (SELECT model, day, sum(abs(w_hat - before)) AS turnover FROM e WHERE before IS NOT NULL GROUP BY 1, 2)"""
MONTHLY = f"""{weights_cte('month')}, {predictions_cte()}, {trade_returns_cte()}, {cov_cte()},
dr AS (SELECT day, asset, sum(ret) AS ret FROM rets GROUP BY 1, 2),
port AS (SELECT model, day, sum(w_hat * ret) AS ret FROM predictions JOIN dr USING (day, asset) GROUP BY 1, 2),
e AS (SELECT *, lag(w_hat) OVER (PARTITION BY model, asset ORDER BY day) AS before FROM predictions),
moves AS (SELECT model, day, sum(abs(w_hat - before)) AS turnover FROM e WHERE before IS NOT NULL GROUP BY 1, 2),
held AS (SELECT day, asset, lag(w) OVER (PARTITION BY asset ORDER BY day) AS w_before FROM weights),
econ AS (SELECT model, day, sum(abs(w_hat - w_before)) AS turnover FROM predictions JOIN held USING (day, asset)
         WHERE w_before IS NOT NULL GROUP BY 1, 2),
var AS (SELECT p.model, p.day, sum(CASE WHEN i = j THEN 1 ELSE 2 END * v * p.w_hat * q.w_hat) AS variance
        FROM cov JOIN predictions p ON p.day = cov.day AND p.asset = i
        JOIN predictions q ON q.day = cov.day AND q.asset = j AND q.model = p.model GROUP BY 1, 2),
curve AS (SELECT model, day, ret, sum(ret) OVER (PARTITION BY model ORDER BY day) AS cum FROM port),
peaks AS (SELECT *, greatest(max(cum) OVER (PARTITION BY model ORDER BY day), 0) AS peak FROM curve),
sh AS (SELECT model, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe,
              avg(net) / stddev_samp(net) * sqrt(252) AS net_sharpe, stddev_samp(ret) * sqrt(252) AS volatility
       FROM (SELECT model, ret, ret - {ETA} * coalesce(turnover, 0) AS net FROM port LEFT JOIN moves USING (model, day))
       GROUP BY model),
dd AS (SELECT model, min(cum - peak) AS max_drawdown FROM peaks GROUP BY model),
rpv AS (SELECT model, avg(variance) * 252 AS annual_rpv FROM var GROUP BY model),
ts AS (SELECT model, avg(turnover) AS turnover_seq FROM moves GROUP BY model)"""


def _dm_sql(lags: int) -> str:
    extra = "".join(
        f" + 2 * {1 - l / (lags + 1)!r}::DOUBLE * coalesce(sum(c * c{l}), 0)" for l in range(1, lags + 1))
    cols = "".join(f", lag(c, {l}) OVER (PARTITION BY model ORDER BY day) AS c{l}" for l in range(1, lags + 1))
    mills = "a"
    for k in range(80, 0, -1):
        mills = f"(a + {k} / {mills})"
    series = ("list_sum(list_transform(range(0, 80), lambda k: exp((2 * k + 1) * ln(a) "
              "- (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1)))))")
    return f"""
WITH {WEEKLY},
d AS (SELECT l.model, l.day, l.loss - b.loss AS d FROM losses l JOIN losses b ON b.day = l.day AND b.model = 'lag1'
      WHERE l.model <> 'lag1'),
c0 AS (SELECT *, avg(d) OVER (PARTITION BY model) AS m, d - avg(d) OVER (PARTITION BY model) AS c FROM d),
c1 AS (SELECT * {cols} FROM c0),
s AS (SELECT model, count(*) AS n_days, any_value(m) / sqrt((sum(c * c){extra}) / count(*) / count(*)) AS z
      FROM c1 GROUP BY model),
p AS (SELECT *, abs(z) AS a FROM s)
SELECT model, n_days, round(z, 6) AS dm_stat, round(CASE WHEN a > 3
    THEN ln(2 / {mills}) - a * a / 2 - ln(sqrt(2 * pi()))
    ELSE ln(1 - 2 * exp(-a * a / 2) / sqrt(2 * pi()) * {series}) END / ln(10), 6) AS dm_log10_p FROM p"""


def _boot_sql(reps: int) -> str:
    return f"""
l AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY day) - 1 AS t,
             count(*) OVER (PARTITION BY model) AS n FROM losses),
nn AS (SELECT max(n) AS n, CAST(ceil(max(n) / {BLOCK}.0) AS BIGINT) AS nb FROM l),
d0 AS (SELECT r.rep, k.nth, n, nb, ((r.rep * nb + k.nth + 1) * 48271 + {SEED}) % 2147483647 AS u
       FROM nn CROSS JOIN (SELECT unnest(range({reps})) AS rep) r
       CROSS JOIN LATERAL (SELECT unnest(range(nb)) AS nth) k),
d1 AS (SELECT *, (u * u + u) % 2147483647 AS u2 FROM d0),
d2 AS (SELECT *, ((u2 * 69621 + 12345) % 2147483647) % n AS start FROM d1),
dr AS (SELECT rep, (start + off) % n AS t FROM d2 CROSS JOIN (SELECT unnest(range({BLOCK})) AS off)
       WHERE nth * {BLOCK} + off < n),
boot AS MATERIALIZED (SELECT rep, model, avg(loss) AS mean_loss FROM dr JOIN l USING (t) GROUP BY 1, 2)"""


def _mcs_sql(reps: int, models: int) -> str:
    """Elimination, one round per CTE group: statistic, p-value, model that leaves."""
    steps = ["s1 AS (SELECT model, avg(loss) AS m FROM losses GROUP BY model)"]
    for k in range(1, models):
        steps.append(f"""
c{k} AS (SELECT model, m - avg(m) OVER () AS d FROM s{k}),
x{k} AS (SELECT rep, b.model, mean_loss - avg(mean_loss) OVER (PARTITION BY rep) - d AS e
         FROM boot b JOIN c{k} c ON c.model = b.model),
v{k} AS (SELECT model, sqrt(avg(e * e)) AS sd FROM x{k} GROUP BY model),
t{k} AS (SELECT model, d / sd AS t FROM c{k} JOIN v{k} USING (model)),
q{k} AS (SELECT avg(CASE WHEN top >= (SELECT max(t) FROM t{k}) THEN 1.0::DOUBLE ELSE 0 END) AS p
         FROM (SELECT rep, max(e / sd) AS top FROM x{k} JOIN v{k} USING (model) GROUP BY rep)),
o{k} AS (SELECT arg_max(model, t) AS model, (SELECT p FROM q{k}) AS p FROM t{k}),
s{k + 1} AS (SELECT * FROM s{k} WHERE model <> (SELECT model FROM o{k}))""")
    out = " UNION ALL ".join(f"SELECT {k} AS k, model, p FROM o{k}" for k in range(1, models))
    return f"""
WITH {WEEKLY}, {_boot_sql(reps)}, {', '.join(steps)},
z AS ({out} UNION ALL SELECT {models}, model, 1.0 FROM s{models}),
y AS (SELECT model, max(p) OVER (ORDER BY k) AS mcs_p FROM z)
SELECT model, mcs_p, mcs_p >= 0.1 AS in_set FROM y"""


_NAIVE = f"""{weights_cte()},
mm AS (SELECT t, day, asset, w, lag(w) OVER a AS w_before, 1.0::DOUBLE / count(*) OVER (PARTITION BY day) AS equal,
       {', '.join(f'avg(w) OVER (a ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS m{n}' for n in WINDOWS)}
       FROM idx WINDOW a AS (PARTITION BY asset ORDER BY day)),
cfg(model, config_id, n, tau) AS (VALUES {', '.join(f"('{m}', {k}, {n}::DOUBLE, {t}::DOUBLE)" for k, (m, n, t) in enumerate(naive_configs()))}),
f(fold, cut) AS (VALUES {', '.join(f'({n}, {c})' for n, c in enumerate(GRID_CUTS))}),
p AS (SELECT model, config_id, n, tau, fold, day, asset, w, w_before,
             (1 - tau) * CASE n {' '.join(f'WHEN {n} THEN m{n}' for n in WINDOWS)} END + tau * equal AS w_hat
      FROM mm CROSS JOIN cfg JOIN f ON t >= cut AND t < cut + {GRID_H}),
e AS (SELECT *, lag(w_hat) OVER (PARTITION BY config_id, fold, asset ORDER BY day) AS before FROM p),
dd AS (SELECT model, config_id, n, tau, fold, day, avg((w_hat - w) * (w_hat - w)) AS se,
              sum(abs(w_hat - w_before)) AS te, sum(abs(w_hat - before)) AS ts FROM e GROUP BY ALL),
ff AS (SELECT model, config_id, n, tau, fold, avg(se) AS val_mse, avg(te) AS te, avg(ts) AS ts FROM dd GROUP BY ALL),
grid AS (SELECT model, config_id, n AS "LAMBDA_LASSO", tau AS "NETWORK_THRESHOLD", avg(val_mse) AS mean_val_mse,
                stddev_pop(val_mse) AS std_val_mse, avg(te) AS mean_turnover_econ, avg(ts) AS mean_turnover_seq
         FROM ff GROUP BY ALL)"""

ORACLES = {
    "g01_mse": f"WITH {WEEKLY} SELECT model, round(avg(err * err), 9) AS mse FROM e GROUP BY model",
    "g02_mae": f"WITH {WEEKLY} SELECT model, round(avg(abs(err)), 9) AS mae FROM e GROUP BY model",
    "g03_sparsity": f"""
WITH {_SINGLE} SELECT model, config_id, fold, count(*) FILTER (slope <> 0) AS n_alive,
       round(1 - count(*) FILTER (slope <> 0) / 6.0::DOUBLE, 7) AS sparsity FROM coef GROUP BY ALL""",
    "g04_effective_ratio": f"""
WITH {_SINGLE}, n AS (SELECT model, config_id, fold, count(*) FILTER (slope <> 0) / 6.0::DOUBLE AS per FROM coef GROUP BY ALL)
SELECT model, config_id, fold, round(per, 7) AS per_equation,
       round([{", ".join(map(str, CUTS))}][fold + 1] / CASE WHEN per > 0 THEN per END, 7) AS t_over_p FROM n""",
    "g05_turnover_sequential": f"""
WITH {WEEKLY} SELECT model, round(avg(turnover), 9) AS turnover_seq FROM moves GROUP BY model""",
    "g06_turnover_economic": f"""
WITH {WEEKLY}, x AS (SELECT model, day, sum(abs(w_hat - w_before)) AS t FROM e JOIN held USING (day, asset)
                     WHERE w_before IS NOT NULL GROUP BY 1, 2)
SELECT model, round(avg(t), 9) AS turnover_econ FROM x GROUP BY model""",
    "g07_diebold_mariano": _dm_sql(0),
    "g07_diebold_mariano_hac": _dm_sql(4),
    "g08_bootstrap_means": f"""
WITH {WEEKLY}, {_boot_sql(REPS)} SELECT CAST(rep AS INT) AS rep, model, round(mean_loss, 9) AS mean_loss FROM boot""",
    "g08_confidence_set": _mcs_sql(2000, 4),
    "g09_portfolio_return": f"WITH {MONTHLY} SELECT model, day, round(ret, 8) AS ret FROM port",
    "g10_volatility": f"WITH {MONTHLY} SELECT model, round(volatility, 7) AS volatility FROM sh",
    "g11_portfolio_variance": f"WITH {MONTHLY} SELECT model, day, round(variance, 7) AS variance FROM var",
    "g11_annual_rpv": f"WITH {MONTHLY} SELECT model, round(annual_rpv, 6) AS annual_rpv FROM rpv",
    "g12_sharpe": f"""
WITH {MONTHLY} SELECT model, round(sharpe, 6) AS sharpe, round(net_sharpe, 6) AS net_sharpe FROM sh""",
    "g13_max_drawdown": f"WITH {MONTHLY} SELECT model, round(max_drawdown, 7) AS max_drawdown FROM dd",
    "g14_cumulative": f"WITH {MONTHLY} SELECT model, day, round(cum, 7) AS cum FROM curve",
    "g15_decision_loss": f"""
WITH {MONTHLY} SELECT model, day, round(variance + {ETA} * turnover, 7) AS loss FROM var JOIN econ USING (model, day)""",
    "g16_performance": f"""
WITH {MONTHLY} SELECT model, CAST(rank() OVER (ORDER BY net_sharpe) AS INT) AS net_sharpe_rank,
       round(sh.sharpe, 6) AS sharpe, round(sh.net_sharpe, 6) AS net_sharpe, round(sh.volatility, 6) AS volatility,
       round(rpv.annual_rpv, 6) AS annual_rpv, round(dd.max_drawdown, 6) AS max_drawdown,
       round(ts.turnover_seq, 6) AS turnover_seq
FROM sh JOIN dd USING (model) JOIN rpv USING (model) JOIN ts USING (model)""",
    "g17_ablation": f"""
WITH {MONTHLY} SELECT model, round(net_sharpe, 6) AS net_sharpe,
       round(sh.net_sharpe - (SELECT net_sharpe FROM sh WHERE model = 'mean20'), 6) AS delta FROM sh""",
    "g18_describe_weights": f"""
WITH {weights_cte()},
m AS (SELECT avg(w) AS m1, avg(w * w) AS m2, avg(w ** 3) AS m3, avg(w ** 4) AS m4, count(*) AS n,
             stddev_samp(w) AS sd, min(w) AS lo, max(w) AS hi, quantile_cont(w, 0.25) AS p25,
             quantile_cont(w, 0.5) AS p50, quantile_cont(w, 0.75) AS p75 FROM weights),
s AS (SELECT m1 AS mean, n::DOUBLE AS n, sd, lo AS min, hi AS max, p25, p50, p75,
             (m3 - 3 * m1 * m2 + 2 * m1 ** 3) / (m2 - m1 * m1) ** 1.5 AS skewness,
             (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 ** 4) / (m2 - m1 * m1) ** 2 AS kurtosis FROM m)
SELECT statistic, round(value, 7) AS value
FROM (UNPIVOT s ON mean, n, sd, min, max, p25, p50, p75, skewness, kurtosis INTO NAME statistic VALUE value)""",
    "g19_daily_stats": f"""
WITH {_EDGES}, {weights_cte('month', 'p_brand')},
b AS (SELECT *, lag(w) OVER (PARTITION BY asset ORDER BY day) AS before FROM weights),
s AS (SELECT day, sum(abs(w)) AS gross, sum(greatest(-w, 0)) AS short, max(abs(w)) AS max_abs,
             sum(abs(w - before)) AS turnover FROM b GROUP BY day),
n AS (SELECT mon.day, count(i) / 300.0::DOUBLE AS density FROM mon LEFT JOIN edges USING (day) GROUP BY 1)
SELECT day, round(gross, 7) AS gross, round(short, 7) AS short, round(max_abs, 7) AS max_abs,
       round(turnover, 7) AS turnover, round(density, 7) AS density FROM s LEFT JOIN n USING (day)""",
    "g20_sensitivity": f"""
WITH {_NAIVE} SELECT "LAMBDA_LASSO", count(*) AS n_configs,
       count(*) FILTER (mean_val_mse < (SELECT min(mean_val_mse) FROM grid WHERE model = 'M3a')) AS n_better,
       round(min(mean_val_mse), 9) AS min_mse, round(max(mean_val_mse), 9) AS max_mse
FROM grid WHERE model = 'M4' GROUP BY 1""",
    "g21_grid_slice": f"""
WITH {_NAIVE} SELECT model, config_id, "LAMBDA_LASSO", "NETWORK_THRESHOLD", round(mean_val_mse, 9) AS mean_val_mse
FROM grid WHERE model = 'M4'""",
    "g22_fold_dispersion": f"""
WITH {_NAIVE} SELECT model, config_id, "LAMBDA_LASSO", "NETWORK_THRESHOLD", round(mean_val_mse, 9) AS mean_val_mse,
       round(std_val_mse, 9) AS std_val_mse, round(mean_turnover_econ, 9) AS mean_turnover_econ,
       round(mean_turnover_seq, 9) AS mean_turnover_seq FROM grid""",
    "g23_improvement": f"""
WITH {WEEKLY}, m AS (SELECT model, avg(err * err) AS mse FROM e GROUP BY model)
SELECT model, round(mse, 9) AS mse, round(100 * (1 - m.mse / (SELECT mse FROM m WHERE model = 'lag1')), 6)
       AS improvement_pct FROM m""",
    "f11_model_selection": f"""
WITH {_NAIVE},
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY mean_val_mse, config_id) AS k FROM grid)
         WHERE k = 1),
low AS (SELECT * FROM grid WHERE model = 'M5' AND mean_turnover_seq <= 0.05
        ORDER BY mean_turnover_seq, mean_val_mse, config_id LIMIT 1)
SELECT best.model, coalesce(low.config_id, best.config_id) AS config_id,
       round(coalesce(low.mean_val_mse, best.mean_val_mse), 9) AS mean_val_mse,
       round(coalesce(low.mean_turnover_seq, best.mean_turnover_seq), 9) AS mean_turnover_seq,
       CASE WHEN low.model IS NOT NULL THEN 'within bounds'
            WHEN best.model = 'M5' THEN 'no config within bounds; lowest MSE'
            WHEN best.model <> 'M4' THEN 'lowest MSE'
            WHEN best.mean_val_mse < (SELECT mean_val_mse FROM best WHERE model = 'M3a') THEN 'beats M3a'
            ELSE 'dropped: does not beat M3a' END AS reason
FROM best LEFT JOIN low ON low.model = best.model""",
    "f12_interior_check": f"""
WITH {_NAIVE},
u AS (SELECT model, config_id, mean_val_mse, 'LAMBDA_LASSO' AS parameter, "LAMBDA_LASSO" AS value FROM grid
      UNION ALL SELECT model, config_id, mean_val_mse, 'NETWORK_THRESHOLD', "NETWORK_THRESHOLD" FROM grid),
x AS (SELECT model, parameter, value, min(value) OVER g AS lowest, max(value) OVER g AS highest,
             row_number() OVER (PARTITION BY model, parameter ORDER BY mean_val_mse, config_id) AS k
      FROM u WINDOW g AS (PARTITION BY model, parameter))
SELECT model, parameter, lowest, highest, value AS chosen, value > lowest AND value < highest AS interior
FROM x WHERE k = 1""",
}
