"""Group A: every store is written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import covariance as cv
from ..operators import evaluate as ev
from ..operators import features as ft
from ..operators import fit as fm
from ..sources import bindings as b
from ..sources import files
from ..sources.scratch import scratch_path
from .covariance import (_EDGES, _TWINS, SELECTED_SQL, _twin_cov, brand_edges, chosen_lambda, r)
from .models import _SINGLE, equations, single_fit
from .sqltext import event_returns_cte, predictions_cte, trade_returns_cte, weights_cte


def _write_return_files(returns, path):
    """The layout `read_returns` expects: per day one line per asset, its returns in bar order."""
    line = F.concat_ws(",", F.col("asset"), F.concat_ws(",", F.transform(
        F.array_sort(F.collect_list(F.struct("bar", "ret"))), lambda c: c["ret"].cast("string"))))
    stamp = F.concat(F.date_format("day", "yyyy MM dd"), F.lit("_1min_log_return"))
    (returns.groupBy("day", "asset").agg(line.alias("value")).select(stamp.alias("file"), "value")
     .hint("rebalance", "file").write.partitionBy("file").text(path))


def _returns(spark, sf):
    path = scratch_path(spark, "return-files")
    _write_return_files(b.event_returns(spark, sf), path)
    return files.read_returns(spark, path).select("day", "bar", "asset", *r("ret", digits=8))


def _cache(spark, sf):
    path = scratch_path(spark, "return-cache")
    files.cache_returns(b.trade_returns(spark, sf), path)
    return files.read_cached_returns(spark, path).select(
        "day", "bar", "asset", *r("ret", digits=8))


def _exog(spark, sf):
    series = b.exog(spark, sf)
    paths = {}
    for name in ("n_orders", "avg_price", "sum_price", "urgent_share"):
        paths[name] = scratch_path(spark, name)
        series.filter(F.col("name") == name).select("day", "x").write.option("header", True).csv(paths[name])
    return files.read_exog(spark, paths).select("day", "name", *r("x", digits=6))


def _edge_store(spark, sf):
    path = scratch_path(spark, "edges")
    files.write_edges(brand_edges(spark, sf), path)
    return files.read_edges(spark, path).select("day", "i", "j")


def _params(spark, sf):
    """A parameter set whose per-model maps hold measured errors and turnovers."""
    w = b.weights(spark, sf)
    pred = b.naive_predictions(w)
    scores = ev.accuracy(pred, w).join(ev.turnover_econ(pred, w), "model")
    one = scores.agg(
        F.map_from_entries(F.collect_list(F.struct("model", "mse"))).alias("mean_val_mse"),
        F.map_from_entries(F.collect_list(F.struct("model", "turnover_econ"))).alias("mean_turnover_econ"))
    path = scratch_path(spark, "params")
    files.write_params(one.select(F.lit(3).alias("P_LAGS"), F.lit(0.7).alias("NETWORK_THRESHOLD"), "*"), path)
    back = files.read_params(spark, path)
    return files.params_long(back.select("P_LAGS", "mean_val_mse", "mean_turnover_econ")).select(
        "metric", "model", *r("value", digits=9))


def _table(spark, sf):
    w = b.weights(spark, sf)
    metrics = ev.accuracy(b.naive_predictions(w), w)
    path = scratch_path(spark, "table")
    files.write_table(metrics, path)
    return files.read_table(spark, path, metrics.schema).select("model", *r("mse", "mae", digits=9))


def _failed(spark, sf):
    solved = cv.solve_status(cv.glasso(_twin_cov(spark, sf), [0.5]))
    path = scratch_path(spark, "days")
    for name, part in zip(("ok", "failed"), files.split_failed(solved.select("day", "status"))):
        part.write.parquet(f"{path}/{name}")
    return spark.read.parquet(f"{path}/failed").select("day", "status")


def _predictions(spark, sf):
    path = scratch_path(spark, "predictions")
    files.write_predictions(b.naive_predictions(b.weights(spark, sf)), path)
    return files.read_predictions(spark, path).select("model", "day", "asset", *r("w_hat", digits=9))


def _model(spark, sf):
    w, long, fitted = single_fit(spark, sf)
    path = scratch_path(spark, "model")
    names = long.select("pos").distinct().withColumn("name", F.lit("n_orders"))
    files.write_model(fm.coefficients(fitted, equations(w)), ft.fit_scaler(long), names, path)
    coefs, scalers, names = files.read_model(spark, path)
    stored = coefs.join(scalers, "pos", "left").join(names, "pos", "left")
    beta = F.when(F.col("pos") == 0, F.round("beta", 7)).otherwise(F.round("beta", 9))
    return stored.select("model", "config_id", "fold", "asset", "pos", beta.alias("beta"), "name", *r("mean", "sd", digits=6))


def _lambda(spark, sf):
    path = scratch_path(spark, "lambda")
    files.publish_lambda(chosen_lambda(spark, sf), path)
    return files.read_lambda(spark, path).select("lambda", *r("score"))


QUERIES = {
    "a01_read_returns": _returns,
    "a02_return_cache": _cache,
    "a03_read_exog": _exog,
    "a05_edge_store": _edge_store,
    "a06_parameter_set": _params,
    "a07_result_table": _table,
    "a08_failed_days": _failed,
    "a09_prediction_store": _predictions,
    "a10_model_store": _model,
    "a11_published_lambda": _lambda,
}

ORACLES = {
    "a01_read_returns": f"""
WITH {event_returns_cte()} SELECT day, CAST(bar - 1 AS INT) AS bar, asset, round(ret, 8) AS ret FROM rets""",
    "a02_return_cache": f"""
WITH {trade_returns_cte()} SELECT day, CAST(bar AS INT) AS bar, asset, round(ret, 8) AS ret FROM rets""",
    "a03_read_exog": """
WITH od AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*)::DOUBLE AS n_orders, avg(o_totalprice) AS avg_price,
                   sum(o_totalprice) AS sum_price,
                   avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0 END) AS urgent_share
            FROM orders GROUP BY 1)
SELECT day, name, round(x, 6) AS x
FROM (UNPIVOT od ON n_orders, avg_price, sum_price, urgent_share INTO NAME name VALUE x)""",
    "a05_edge_store": f"WITH {_EDGES} SELECT day, i, j FROM edges",
    "a06_parameter_set": f"""
WITH {weights_cte()}, {predictions_cte()},
h AS (SELECT day, asset, w, lag(w) OVER (PARTITION BY asset ORDER BY day) AS w_before FROM weights),
e AS (SELECT model, day, avg((w_hat - w) * (w_hat - w)) AS se, sum(abs(w_hat - w_before)) AS te
      FROM predictions JOIN h USING (day, asset) GROUP BY 1, 2)
SELECT 'mean_val_mse' AS metric, model, round(avg(se), 9) AS value FROM e GROUP BY model
UNION ALL SELECT 'mean_turnover_econ', model, round(avg(te), 9) FROM e GROUP BY model""",
    "a07_result_table": f"""
WITH {weights_cte()}, {predictions_cte()}
SELECT model, round(avg((w_hat - w) * (w_hat - w)), 9) AS mse, round(avg(abs(w_hat - w)), 9) AS mae
FROM predictions JOIN weights USING (day, asset) GROUP BY model""",
    "a08_failed_days": f"WITH {_TWINS} SELECT day, 'failed' AS status FROM mon WHERE twin",
    "a09_prediction_store": f"""
WITH {weights_cte()}, {predictions_cte()}
SELECT model, day, asset, round(w_hat, 9) AS w_hat FROM predictions""",
    "a10_model_store": f"""
WITH {_SINGLE}, sc AS (SELECT stddev_pop(x) AS sd, avg(x) AS mean FROM (SELECT DISTINCT t, x FROM z))
SELECT model, config_id, fold, asset, 0 AS pos, round(intercept, 7) AS beta, NULL::VARCHAR AS name, NULL::DOUBLE AS mean, NULL::DOUBLE AS sd FROM coef
UNION ALL SELECT model, config_id, fold, asset, 1, round(slope, 9), 'n_orders', round(mean, 6), round(sd, 6) FROM coef CROSS JOIN sc WHERE slope <> 0""",
    "a11_published_lambda": SELECTED_SQL,
}
