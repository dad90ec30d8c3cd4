"""Group H: tables behind the figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import covariance as cv
from ..operators import evaluate as ev
from ..operators import network as nw
from ..operators import portfolio as pf
from ..operators import report as rp
from ..sources import bindings as b
from .covariance import _EDGES, PAIR_PREC, brand_edges, months, pair_cov, pair_solved, r
from .evaluation import _NAIVE, MONTHLY, TAUS, monthly, naive_results
from .sqltext import weights_cte


def _curve(spark, sf):
    """Score of a lambda: variance of its weights under the unpenalised matrix of the same month."""
    w = pf.w_from_prec(cv.precision_cells(pair_solved(spark, sf)), "day", "lambda")
    pred = w.select(F.col("lambda").alias("model"), "day", "asset", F.col("w").alias("w_hat"))
    scores = ev.portfolio_variance(pred, pair_cov(spark, sf)).select(
        F.col("model").alias("lambda"), F.col("variance").alias("score"))
    return rp.lambda_curve(scores).select("lambda", *r("score", digits=6), "rank")


def _heatmap(spark, sf):
    return rp.weight_heatmap(b.weights(spark, sf, "week", "p_brand")).select(
        "period", "asset_bucket", *r("mean_w", digits=8), "n")


def _dual(spark, sf):
    w = b.weights(spark, sf, "month", "p_brand").select(F.lit("w").alias("model"), "day", "asset", F.col("w").alias("w_hat"))
    dens = nw.density(brand_edges(spark, sf), months(spark, sf), 25)
    return rp.density_turnover(dens, ev.turnover_by_day(w)).select("day", *r("density", "turnover"))


def _cumulative(spark, sf):
    _, pred, rets = monthly(spark, sf)
    return rp.cumulative_all(ev.portfolio_return(pred, rets)).select("model", "day", *r("cum"))


def _grid_map(spark, sf):
    out = rp.grid_heatmap(naive_results(spark, sf), "M4", 0.001, TAUS)
    return out.select("LAMBDA_LASSO", *[F.round(F.col(f"`{t}`"), 9).alias(f"tau_{int(100 * t)}") for t in TAUS])


def ranking(spark, sf, models=None):
    """Places of the configurations of `models`, or of all; scores equal to 12 digits tie."""
    results = naive_results(spark, sf).withColumn("mean_val_mse", F.round("mean_val_mse", 12))
    if models is not None:
        results = results.filter(F.col("model").isin(list(models)))
    return rp.grid_ranking(results).select("place", "model", "config_id", *r("mean_val_mse", digits=9))


QUERIES = {
    "h01_lambda_curve": _curve,
    "h02_weight_heatmap": _heatmap,
    "h03_density_turnover": _dual,
    "h04_cumulative_curves": _cumulative,
    "h05_grid_heatmap": _grid_map,
    "h05_grid_ranking": ranking,
    "h05_grid_ranking_all": ranking,
}

ORACLES = {
    "h01_lambda_curve": f"""
WITH {PAIR_PREC},
w AS (SELECT s.day, s."lambda" AS l, (s.b - s.c) / (s.a + s.b - 2 * s.c) AS f, m.a, m.b, m.c
      FROM s JOIN m ON m.day = s.day),
x AS (SELECT l, avg(f * f * a + (1 - f) * (1 - f) * b + 2 * f * (1 - f) * c) AS score FROM w GROUP BY l)
SELECT l AS "lambda", round(score, 6) AS score, CAST(rank() OVER (ORDER BY x.score) AS INT) AS rank FROM x""",
    "h02_weight_heatmap": f"""
WITH {weights_cte('week', 'p_brand')},
k AS (SELECT asset, CAST(ntile(3) OVER (ORDER BY avg(w), asset) AS INT) AS asset_bucket FROM weights GROUP BY asset)
SELECT CAST(date_trunc('quarter', day) AS DATE) AS period, asset_bucket, round(avg(w), 8) AS mean_w, count(*) AS n
FROM weights JOIN k USING (asset) GROUP BY 1, 2""",
    "h03_density_turnover": f"""
WITH {_EDGES}, {weights_cte('month', 'p_brand')},
b AS (SELECT *, lag(w) OVER (PARTITION BY asset ORDER BY day) AS before FROM weights),
s AS (SELECT day, sum(abs(w - before)) AS turnover FROM b WHERE before IS NOT NULL GROUP BY day),
n AS (SELECT mon.day, count(i) / 300.0::DOUBLE AS density FROM mon LEFT JOIN edges USING (day) GROUP BY 1)
SELECT day, round(density, 7) AS density, round(turnover, 7) AS turnover FROM n FULL JOIN s USING (day)""",
    "h04_cumulative_curves": f"WITH {MONTHLY} SELECT model, day, round(cum, 7) AS cum FROM curve",
    "h05_grid_heatmap": f"""
WITH {_NAIVE} SELECT "LAMBDA_LASSO",
{', '.join(f'round(min(mean_val_mse) FILTER ("NETWORK_THRESHOLD" = {t}), 9) AS tau_{int(100 * t)}' for t in TAUS)}
FROM grid WHERE model = 'M4' GROUP BY 1""",
    **dict.fromkeys(("h05_grid_ranking", "h05_grid_ranking_all"), f"""
WITH {_NAIVE} SELECT CAST(row_number() OVER (ORDER BY round(g.mean_val_mse, 12), model, config_id) AS INT) AS place, model, config_id,
       round(mean_val_mse, 9) AS mean_val_mse FROM grid g"""),
}
