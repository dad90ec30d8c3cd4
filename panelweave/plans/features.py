"""Group E and A4: features, targets, sequences, wide and long weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import network as nw
from ..sources import bindings as b
from ..sources import files
from .covariance import _EDGES, brand_edges, months, r
from .sqltext import predictions_cte, weights_cte

SEQ, PAD, P = 30, 29, 3
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _lags(spark, sf):
    return ft.lag_features(b.weights(spark, sf), P).select("t", "day", "lag", "name", *r("v", digits=9))


def _exog(spark, sf):
    days = b.weights(spark, sf, "day", "l_linestatus")
    return ft.join_exog(days, b.exog(spark, sf)).select("day", "name", *r("x", digits=6))


def nine_columns(spark, sf):
    """Level and change of four order-flow series, and the density of the last complete month's network."""
    days = b.weights(spark, sf, "day", "l_linestatus").select("day").distinct()
    joined = ft.join_exog(days, b.exog(spark, sf))
    dens = nw.density(brand_edges(spark, sf), months(spark, sf), 25).select(
        F.last_day("day").alias("day"), F.lit("density").alias("name"), F.col("density").alias("x"))
    return ft.exog_columns(joined, ft.join_exog(days, dens))


def _columns(spark, sf):
    return nine_columns(spark, sf).select("day", "name", *r("x", digits=6))


def _assemble(spark, sf):
    w = b.weights(spark, sf)
    lags = ft.lag_features(w, P)
    ex = ft.join_exog(w, b.exog(spark, sf))
    names = ft.feature_names(lags, ex)
    rows = ft.assemble(ft.positioned(lags, ex, names), P * 6 + 4)
    return rows.select("t", "day", F.size("x").alias("n"), *[
        F.round(F.element_at("x", k), 6).alias(f"x{k}") for k in (1, 6, 7, 18, 19, 22)])


def _targets(spark, sf):
    w = b.weights(spark, sf)
    return ft.align_targets(ft.lag_features(w, P), w, P).select("t", "day", "asset", *r("y", digits=9))


def _sequences(spark, sf):
    w = b.weights(spark, sf)
    x = ft.assemble(ft.lag_features(w, 1).withColumn("pos", F.col("name")))
    seqs = ft.make_sequences(x, ft.target_arrays(ft.align_targets(x, w, 1)), SEQ)
    first, last = F.element_at("seq", 1), F.element_at("seq", -1)
    return seqs.select("t", F.size("seq").alias("steps"), F.size(first).alias("width"),
                       F.round(F.element_at(first, 1), 9).alias("oldest"),
                       F.round(F.element_at(last, 6), 9).alias("newest"),
                       F.round(F.aggregate("seq", F.lit(0.0), lambda a, x: a + F.element_at(x, 2)), 8).alias("sum_second"),
                       F.round(F.element_at("y", 3), 9).alias("target_third"))


def _pad(spark, sf):
    w = b.weights(spark, sf)
    pred = b.naive_predictions(w)
    days = ft.index_days(w).select((F.col("t") - 20).alias("t"), "day", "asset")
    body, pad = (days.join(pred.filter(F.col("model") == m), ["day", "asset"]).select("t", "day", "asset", "w_hat")
                 for m in ("lag1", "mean20"))
    return ft.pad_left(body, pad, PAD).select("t", "day", "asset", "padded", *r("w_hat", digits=9))


def _wide(spark, sf):
    out = files.to_wide(b.weights(spark, sf), TYPES)
    return out.select("day", *[F.round(t, 9).alias(t) for t in TYPES])


def _long(spark, sf):
    """Wide and back again: one row per cell."""
    return files.to_long(files.to_wide(b.weights(spark, sf), TYPES)).select("day", "asset", *r("w", digits=9))


QUERIES = {
    "a04_weights_wide": _wide,
    "a04_weights_long": _long,
    "e01_lag_features": _lags,
    "e02_join_exog": _exog,
    "e03_exog_columns": _columns,
    "e04_assemble": _assemble,
    "e05_targets": _targets,
    "e06_sequences": _sequences,
    "e07_pad_left": _pad,
}

_ASOF = """
od AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*)::DOUBLE AS n_orders, avg(o_totalprice) AS avg_price,
              sum(o_totalprice) AS sum_price,
              avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0 END) AS urgent_share
       FROM orders GROUP BY 1),
ol AS (SELECT CAST(day + INTERVAL 1 DAY AS DATE) AS day, name, x
       FROM (UNPIVOT od ON n_orders, avg_price, sum_price, urgent_share INTO NAME name VALUE x)),
want AS (SELECT day, name FROM (SELECT DISTINCT day FROM weights) CROSS JOIN (SELECT DISTINCT name FROM ol)),
ex AS (SELECT w.day, w.name, o.x FROM want w ASOF LEFT JOIN ol o ON w.name = o.name AND w.day >= o.day)"""
_LAGGED = f"""
lg AS (SELECT x.t, x.day, y.lag, x.asset AS name, z.w AS v
       FROM idx x CROSS JOIN (SELECT unnest(range(1, {P} + 1)) AS lag) y
       JOIN idx z ON z.asset = x.asset AND z.t = x.t - y.lag WHERE x.t >= {P})"""

ORACLES = {
    "a04_weights_wide": f"""
WITH {weights_cte()} SELECT day, {', '.join(f"round(max(w) FILTER (asset = '{t}'), 9) AS {t}" for t in TYPES)}
FROM weights GROUP BY day""",
    "a04_weights_long": f"WITH {weights_cte()} SELECT day, asset, round(w, 9) AS w FROM weights",
    "e01_lag_features": f"""
WITH {weights_cte()}, {_LAGGED}
SELECT CAST(t AS INT) AS t, day, CAST(lag AS INT) AS lag, name, round(v, 9) AS v FROM lg""",
    "e02_join_exog": f"WITH {weights_cte('day', 'l_linestatus')}, {_ASOF} SELECT day, name, round(x, 6) AS x FROM ex",
    "e03_exog_columns": f"""
WITH {_EDGES}, {weights_cte('day', 'l_linestatus')}, {_ASOF},
dn AS (SELECT CAST(last_day(mon.day) + INTERVAL 1 DAY AS DATE) AS day, count(i) / 300.0::DOUBLE AS x
       FROM mon LEFT JOIN edges USING (day) GROUP BY mon.day),
al AS (SELECT day, name, x FROM ex
       UNION ALL SELECT day, 'd_' || name, coalesce(x - lag(x) OVER (PARTITION BY name ORDER BY day), 0) FROM ex
       UNION ALL SELECT w.day, 'density', dn.x FROM (SELECT DISTINCT day FROM weights) w
       ASOF LEFT JOIN dn ON w.day >= dn.day)
SELECT day, name, round(x, 6) AS x FROM al""",
    "e04_assemble": f"""
WITH {weights_cte()}, {_ASOF}, {_LAGGED},
c AS (SELECT t, lg.day, (lag - 1) * 6 + row_number() OVER (PARTITION BY t, lag ORDER BY name) AS pos, v FROM lg
      UNION ALL SELECT d.t, ex.day, 18 + row_number() OVER (PARTITION BY d.t ORDER BY ex.name), x
      FROM ex JOIN (SELECT DISTINCT t, day FROM idx WHERE t >= {P}) d USING (day))
SELECT CAST(t AS INT) AS t, day, CAST(count(*) AS INT) AS n,
       {', '.join(f'round(max(v) FILTER (pos = {k}), 6) AS x{k}' for k in (1, 6, 7, 18, 19, 22))}
FROM c GROUP BY t, day HAVING count(v) = 22""",
    "e05_targets": f"""
WITH {weights_cte()} SELECT CAST(t AS INT) AS t, day, asset, round(w, 9) AS y FROM idx WHERE t >= {P}""",
    "e06_sequences": f"""
WITH {weights_cte()},
n AS (SELECT t, row_number() OVER (PARTITION BY t ORDER BY asset) AS k, w,
             lag(w) OVER (PARTITION BY asset ORDER BY t) AS x FROM idx)
SELECT CAST(a.t AS INT) AS t, CAST(count(DISTINCT b.t) AS INT) AS steps, CAST(count(DISTINCT b.k) AS INT) AS width,
       round(max(b.x) FILTER (b.t = a.t - {SEQ - 1} AND b.k = 1), 9) AS oldest,
       round(max(b.x) FILTER (b.t = a.t AND b.k = 6), 9) AS newest,
       round(sum(b.x) FILTER (b.k = 2), 8) AS sum_second,
       round(max(b.w) FILTER (b.t = a.t AND b.k = 3), 9) AS target_third
FROM (SELECT DISTINCT t FROM n WHERE t >= {SEQ}) a JOIN n b ON b.t BETWEEN a.t - {SEQ - 1} AND a.t GROUP BY a.t""",
    "e07_pad_left": f"""
WITH {weights_cte()}, {predictions_cte()}
SELECT CAST(t - 20 AS INT) AS t, day, asset, t - 20 < {PAD} AS padded, round(w_hat, 9) AS w_hat
FROM predictions JOIN idx USING (day, asset)
WHERE (model = 'mean20' AND t - 20 < {PAD}) OR (model = 'lag1' AND t - 20 >= {PAD})""",
}
