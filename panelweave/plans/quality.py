"""Group B: checks, day selection, splits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import features as ft
from ..operators import quality as q
from ..sources import bindings as b
from .sqltext import event_returns_cte, trade_returns_cte, weights_cte

PANEL = T.StructType([T.StructField("day", T.DateType()), T.StructField("bar", T.IntegerType()),
                      T.StructField("asset", T.StringType()), T.StructField("ret", T.DoubleType())])
SEED, CUTS, HORIZON = 7, [120, 200, 280], 40


def _ship_days(spark, sf):
    return b.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()


def _order_days(spark, sf):
    return b.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"))


def _missing_days(spark, sf):
    return q.check_days(_order_days(spark, sf))


def _day_count(spark, sf):
    return q.day_count(_order_days(spark, sf), 2436)


def _shape(spark, sf):
    return q.check_shape(b.event_returns(spark, sf), 5, 23)


def _missing(spark, sf):
    # returns into the second of a month are blanked to give the check something to count
    panel = b.trade_returns(spark, sf).withColumn("ret", F.when(F.col("bar") != 2, F.col("ret")))
    return q.check_missing(panel, "ret", "asset")


def _range(spark, sf):
    return q.check_range(b.event_returns(spark, sf), "ret", 0.1, "asset").select(
        "asset", F.round("lowest", 8).alias("lowest"), F.round("highest", 8).alias("highest"), "n_outside")


def _types(spark, sf):
    panel = b.event_returns(spark, sf)
    q.check_types(panel, PANEL)
    return q.type_report(panel, PANEL)


def _valid(spark, sf):
    # days that also have orders stand for the days with a solved network
    return q.valid_days(_ship_days(spark, sf), _order_days(spark, sf), 3, 20)


def _sample(spark, sf):
    return q.sample_days(_ship_days(spark, sf), 20, SEED)


def _split(spark, sf):
    return q.split_time(b.weights(spark, sf))


def _folds(spark, sf):
    return q.expanding_folds(b.weights(spark, sf), CUTS, HORIZON)


def _fixed(spark, sf):
    return q.fixed_window(b.weights(spark, sf))


def _window(spark, sf):
    shipped = b.table(spark, sf, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    kept = q.eval_window(shipped, "1998-12-19", "1999-10-08")
    return kept.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def _scale(spark, sf):
    lags = ft.lag_features(b.weights(spark, sf), 2).withColumn("pos", F.concat_ws(":", "lag", "name"))
    scaler = ft.fit_scaler(lags.filter(F.col("t") < 240))
    scaled = ft.apply_scaler(lags, scaler)
    return scaled.select("t", "lag", "name", F.round("v", 7).alias("v"))


def _select(spark, sf):
    lags = ft.lag_features(b.weights(spark, sf), 3)
    keyed = lags.withColumn("pos", F.concat_ws(":", "lag", "name"))
    # stands for another model's subset: the columns that vary more than the median column
    spread = keyed.groupBy("pos").agg(F.stddev_pop("v").alias("sd"))
    kept = spread.withColumn("middle", spread.agg(F.median("sd")).scalar()).filter("sd >= middle")
    return ft.select_features(keyed, kept).groupBy("pos").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 9).alias("mean"))


QUERIES = {
    "b01_missing_days": _missing_days,
    "b01_day_count": _day_count,
    "b02_shape": _shape,
    "b03_missing_values": _missing,
    "b04_range": _range,
    "b05_types": _types,
    "b06_valid_days": _valid,
    "b07_sample_days": _sample,
    "b08_time_split": _split,
    "b09_expanding_folds": _folds,
    "b10_fixed_window": _fixed,
    "b11_evaluation_window": _window,
    "b12_standardise": _scale,
    "b13_feature_subset": _select,
}

_T = "days_t AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS t FROM (SELECT DISTINCT day FROM weights))"
_LAGS = """lags AS (
  SELECT x.t, y.lag, x.asset AS name, z.w AS v
  FROM idx x CROSS JOIN (SELECT unnest(range(1, {p} + 1)) AS lag) y
  JOIN idx z ON z.asset = x.asset AND z.t = x.t - y.lag WHERE x.t >= {p})"""

ORACLES = {
    "b01_missing_days": """
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
cal AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d)
SELECT day FROM cal WHERE day NOT IN (SELECT day FROM d)""",
    "b01_day_count": """
SELECT count(DISTINCT CAST(o_orderdate AS DATE)) AS n_days, CAST(2436 AS BIGINT) AS expected,
       CAST(2436 - count(DISTINCT CAST(o_orderdate AS DATE)) AS BIGINT) AS missing FROM orders""",
    "b02_shape": f"""
WITH {event_returns_cte()}
SELECT day, count(DISTINCT asset) AS n_assets, count(DISTINCT bar) AS n_bars, count(*) AS n_cells,
       count(DISTINCT asset) = 5 AND count(DISTINCT bar) = 23 AND count(*) = 115 AS ok
FROM rets GROUP BY day""",
    "b03_missing_values": f"""
WITH {trade_returns_cte()}, p AS (SELECT asset, CASE WHEN bar <> 2 THEN ret END AS ret FROM rets)
SELECT asset, count(*) AS n, count(*) - count(ret) AS n_null,
       count(*) FILTER (isnan(ret)) AS n_nan, count(*) FILTER (isinf(ret)) AS n_inf
FROM p GROUP BY asset""",
    "b04_range": f"""
WITH {event_returns_cte()}
SELECT asset, round(min(ret), 8) AS lowest, round(max(ret), 8) AS highest,
       count(*) FILTER (abs(ret) > 0.1) AS n_outside FROM rets GROUP BY asset""",
    "b05_types": f"""
WITH {event_returns_cte()}
SELECT c AS "column", t AS type, true AS ok, n AS n_values FROM (SELECT count(*) AS n FROM rets),
(VALUES ('day', 'date'), ('bar', 'int'), ('asset', 'string'), ('ret', 'double')) AS v(c, t)""",
    "b06_valid_days": """
WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem
           WHERE CAST(l_shipdate AS DATE) IN (SELECT CAST(o_orderdate AS DATE) FROM orders)),
n AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS t FROM d)
SELECT day, CAST(t - 20 AS INT) AS t FROM n WHERE t >= 20""",
    "b07_sample_days": f"""
SELECT day FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem)
ORDER BY md5(strftime(day, '%Y-%m-%d') || ':{SEED}') LIMIT 20""",
    "b08_time_split": f"""
WITH {weights_cte()}, {_T}, c AS (SELECT *, count(*) OVER () AS n FROM days_t)
SELECT day, CAST(t AS INT) AS t, CASE WHEN t < floor(n * 0.70) THEN 'train'
       WHEN t < floor(n * 0.85) THEN 'validation' ELSE 'test' END AS part FROM c""",
    "b09_expanding_folds": f"""
WITH {weights_cte()}, {_T},
f(fold, cut) AS (VALUES (0, {CUTS[0]}), (1, {CUTS[1]}), (2, {CUTS[2]}))
SELECT fold, CASE WHEN t < cut THEN 'train' ELSE 'validation' END AS part, CAST(t AS INT) AS t, day
FROM days_t JOIN f ON t < cut + {HORIZON}""",
    "b10_fixed_window": f"""
WITH {weights_cte()}, {_T}
SELECT day, CAST(t AS INT) AS t, CASE WHEN t < 44 THEN 'train' WHEN t < 49 THEN 'validation' ELSE 'test' END AS part
FROM days_t WHERE t < 71""",
    "b11_evaluation_window": """
SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem
WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1998-12-19' AND DATE '1999-10-08' GROUP BY 1""",
    "b12_standardise": f"""
WITH {weights_cte()}, {_LAGS.format(p=2)},
s AS (SELECT lag, name, avg(v) AS m, greatest(stddev_pop(v), 1e-8) AS sd FROM lags WHERE t < 240 GROUP BY 1, 2)
SELECT CAST(t AS INT) AS t, CAST(lag AS INT) AS lag, name, round((v - m) / sd, 7) AS v
FROM lags JOIN s USING (lag, name)""",
    "b13_feature_subset": f"""
WITH {weights_cte()}, {_LAGS.format(p=3)},
k AS (SELECT lag || ':' || name AS pos, v FROM lags),
s AS (SELECT pos, stddev_pop(v) AS sd FROM k GROUP BY pos)
SELECT pos, count(*) AS n, round(avg(v), 9) AS mean FROM k
WHERE pos IN (SELECT pos FROM s WHERE sd >= (SELECT median(sd) FROM s)) GROUP BY pos""",
}
