"""Group D and F7: portfolio weights.

Solves run on the two line statuses where SQL has a closed form, and on all
part types as rows-only queries.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import covariance as cv
from ..operators import portfolio as pf
from ..sources import bindings as b
from ..sources.scratch import stage
from .covariance import (_PAIR_COV, EXACT, LAM, PAIR, PAIR_PREC, PIVOT, SOLVE, WINDOW, pair_cov, pair_solved,
                         r, type_cov)
from .sqltext import cov_cte, predictions_cte, trade_returns_cte, weights_cte

LIM, ROUNDS = 0.17, 10
ETA, RHO = 0.3, 0.7


def _w_prec(spark, sf):
    return pf.w_from_prec(cv.precision_cells(pair_solved(spark, sf)), "day", "lambda").select(
        "day", "lambda", "asset", *r("w", digits=6))


def _w_prec_types(spark, sf):
    return pf.w_from_prec(cv.precision_cells(cv.glasso(type_cov(spark, sf), [LAM], ridges=(0.0, 1e-4)))).select(
        "day", "asset", *r("w", digits=6))


def _sample(spark, sf):
    return pf.gmvp_sample(pair_cov(spark, sf), WINDOW).select("day", "asset", *r("w"))


def _sample_types(spark, sf):
    return pf.gmvp_sample(type_cov(spark, sf), WINDOW).select("day", "asset", *r("w"))


def _shrunk(spark, sf):
    returns = stage(b.trade_returns(spark, sf), "returns")
    return pf.shrunk_cov(returns, cv.realized_cov(returns), WINDOW).select(
        "day", "i", "j", *r("v"), *r("shrinkage"))


def _shrink(spark, sf):
    returns = stage(b.trade_returns(spark, sf, PAIR), "returns")
    return pf.gmvp_shrink(returns, cv.realized_cov(returns), WINDOW).select("day", "asset", *r("w"))


def _gmvp_glasso(spark, sf):
    solved = cv.glasso(cv.rolling_cov(pair_cov(spark, sf), WINDOW), [LAM], **EXACT)
    return pf.w_from_prec(cv.precision_cells(solved)).select("day", "asset", *r("w"))


def _gmvp_glasso_types(spark, sf):
    return pf.gmvp_glasso(type_cov(spark, sf), LAM, WINDOW, ridges=(0.0, 1e-4)).select("day", "asset", *r("w", digits=6))


def _equal(spark, sf):
    return pf.equal_weights(b.weights(spark, sf)).select("day", "asset", *r("w", digits=9))


def _skewed(spark, sf):
    """Forecasts that do not sum to 1, and one model ('centred') whose totals vanish."""
    pred = b.naive_predictions(b.weights(spark, sf)).filter(F.col("model").isin("mean5", "equal"))
    centred = pred.filter(F.col("model") == "equal").select(
        F.lit("centred").alias("model"), "day", "asset",
        F.when(F.col("asset") == "ECONOMY", 1.0).when(F.col("asset") == "LARGE", -1.0).otherwise(0.0).alias("w_hat"))
    return pred.withColumn("w_hat", F.col("w_hat") * 1.5 - 0.02).unionByName(centred)


def _renorm(spark, sf):
    return pf.renormalise(_skewed(spark, sf)).select("model", "day", "asset", *r("w_hat", digits=8))


def _box(spark, sf):
    pred = b.naive_predictions(b.weights(spark, sf))
    return pf.box(pred, LIM, ROUNDS).select("model", "day", "asset", *r("w_hat", digits=8))


def _dfl(spark, sf, asset=PAIR, lim=None):
    w = b.weights(spark, sf, "month", asset)
    cov = cv.rolling_cov(cv.realized_cov(b.trade_returns(spark, sf, asset)), WINDOW)
    out = pf.decision_focused(b.naive_predictions(w), cov, pf.held_before(w), ETA, RHO, lim)
    return out.select("model", "day", "asset", *r("w_hat"))


def _dfl_own(spark, sf):
    w = b.weights(spark, sf, "month", "p_type")
    cov = cv.rolling_cov(type_cov(spark, sf), WINDOW)
    out = pf.decision_focused_own(b.naive_predictions(w), cov, ETA, RHO, lim=0.3)
    return out.select("model", "day", "asset", *r("w_hat"))


QUERIES = {
    "d01_weights_from_precision": _w_prec,
    "d01_weights_from_precision_types": _w_prec_types,
    "d02_gmvp_sample": _sample,
    "d02_gmvp_sample_types": _sample_types,
    "d03_shrunk_cov": _shrunk,
    "d03_gmvp_shrinkage": _shrink,
    "d04_gmvp_glasso": _gmvp_glasso,
    "d04_gmvp_glasso_types": _gmvp_glasso_types,
    "d05_equal_weights": _equal,
    "d06_renormalise": _renorm,
    "d07_box": _box,
    "f07_decision_focused": _dfl,
    "f07_decision_focused_types": lambda spark, sf: _dfl(spark, sf, "p_type", 0.3),
    "f07_decision_focused_own": _dfl_own,
}

_ROLLED = """
rolled AS (SELECT * FROM (
  SELECT day, i, j, avg(v) OVER w AS v, count(*) OVER w AS n_days FROM cov
  WINDOW w AS (PARTITION BY i, j ORDER BY day ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)) WHERE n_days = {n})"""
_ROLL = _ROLLED.format(n=WINDOW)
_SHRUNK = """
q AS (SELECT day, sum(x * x) AS q4, count(*) AS m FROM (
        SELECT day, bar, sum(ret * ret) AS x FROM rets GROUP BY 1, 2) GROUP BY day),
past AS (SELECT * FROM (SELECT day, sum(q4) OVER w AS q4, sum(m) OVER w AS m, count(*) OVER w AS seen FROM q
         WINDOW w AS (ORDER BY day ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)) WHERE seen = {n}),
tot AS (SELECT day, i, j, sum(v) OVER (PARTITION BY i, j ORDER BY day
               ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS total FROM cov),
sc AS (SELECT day, i, j, total / m AS v, q4, m FROM tot JOIN past USING (day)),
st AS (SELECT day, sum(v) FILTER (i = j) / count(*) FILTER (i = j) AS mu, count(*) FILTER (i = j) AS k,
              sum(CASE WHEN i = j THEN v * v ELSE 2 * v * v END) AS norm2, any_value(q4) AS q4, any_value(m) AS m
       FROM sc GROUP BY day),
sh AS (SELECT day, mu, CASE WHEN norm2 - k * mu * mu > 0
         THEN least(greatest((q4 / m - norm2) / m, 0), norm2 - k * mu * mu) / (norm2 - k * mu * mu) ELSE 1 END
         AS shrinkage FROM st),
shrunk AS (SELECT day, i, j, (1 - shrinkage) * v + CASE WHEN i = j THEN shrinkage * mu ELSE 0 END AS v, shrinkage
           FROM sc JOIN sh USING (day))""".format(n=WINDOW)
_TWO = """
SELECT day, 'F' AS asset, round((b - c) / (a + b - 2 * c), 7) AS w FROM {m}
UNION ALL SELECT day, 'O', round((a - c) / (a + b - 2 * c), 7) FROM {m}"""


def _box_sql() -> str:
    clip = "greatest({0}, least({1}, {2}))".format(-LIM, LIM, "{0}")
    steps = [f"b0 AS (SELECT model, day, asset, {clip.format('w_hat')} AS w FROM predictions)"]
    for k in range(1, ROUNDS + 1):
        steps.append(f"""
s{k} AS (SELECT *, sum(w) OVER d AS total, count(*) FILTER (abs(w) < {LIM}) OVER d AS free FROM b{k - 1}
         WINDOW d AS (PARTITION BY model, day)),
b{k} AS (SELECT model, day, asset, {clip.format(f'CASE WHEN abs(w) < {LIM} THEN w + (1 - total) / free ELSE w END')} AS w
         FROM s{k})""")
    return (f"WITH {weights_cte()}, {predictions_cte()}, {', '.join(steps)} "
            f"SELECT model, day, asset, round(w, 8) AS w_hat FROM b{ROUNDS}")


ORACLES = {
    "d01_weights_from_precision": f"""
WITH {PAIR_PREC}, x AS (SELECT day, "lambda", (b - c) / (a + b - 2 * c) AS f FROM s)
SELECT day, "lambda", 'F' AS asset, round(f, 6) AS w FROM x
UNION ALL SELECT day, "lambda", 'O', round(1 - f, 6) FROM x""",
    "d02_gmvp_sample": f"WITH {_PAIR_COV}, {_ROLL}, {PIVOT.format(source='rolled')} {_TWO.format(m='m')}",
    "d03_shrunk_cov": f"""
WITH {trade_returns_cte()}, {cov_cte()}, {_SHRUNK}
SELECT day, i, j, round(v, 7) AS v, round(shrinkage, 7) AS shrinkage FROM shrunk""",
    "d03_gmvp_shrinkage": f"WITH {_PAIR_COV}, {_SHRUNK}, {PIVOT.format(source='shrunk')} {_TWO.format(m='m')}",
    "d04_gmvp_glasso": f"""
WITH {_PAIR_COV}, {_ROLL}, {PIVOT.format(source='rolled')},
{SOLVE.format(lambdas=f'{LAM}::DOUBLE')} {_TWO.format(m='s')}""",
    "d05_equal_weights": f"""
WITH {weights_cte()} SELECT day, asset, round(1.0 / (SELECT count(*) FROM assets)::DOUBLE, 9) AS w FROM weights""",
    "d06_renormalise": f"""
WITH {weights_cte()}, {predictions_cte()},
p AS (SELECT model, day, asset, w_hat * 1.5 - 0.02 AS w_hat FROM predictions WHERE model IN ('mean5', 'equal')
      UNION ALL SELECT 'centred', day, asset, CASE asset WHEN 'ECONOMY' THEN 1.0 WHEN 'LARGE' THEN -1.0 ELSE 0.0 END
      FROM predictions WHERE model = 'equal'),
s AS (SELECT *, sum(w_hat) OVER (PARTITION BY model, day) AS total FROM p)
SELECT model, day, asset, round(w_hat / CASE WHEN abs(total) < 1e-10 THEN 1.0 ELSE total END, 8) AS w_hat FROM s""",
    "d07_box": _box_sql(),
    "f07_decision_focused": f"""
WITH {_PAIR_COV}, {_ROLL}, {PIVOT.format(source='rolled')},
{weights_cte('month', PAIR)}, {predictions_cte()},
h AS (SELECT day, asset, lag(w) OVER (PARTITION BY asset ORDER BY day) AS w_before FROM weights),
x AS (SELECT model, day, max({ETA} * w_before + {RHO} * w_hat) FILTER (asset = 'F') AS f,
             max({ETA} * w_before + {RHO} * w_hat) FILTER (asset = 'O') AS o
      FROM predictions JOIN h USING (day, asset) GROUP BY 1, 2),
y AS (SELECT model, day, f, o, a + {ETA + RHO} AS a, b + {ETA + RHO} AS b, c,
             (a + {ETA + RHO}) * (b + {ETA + RHO}) - c * c AS det FROM x JOIN m USING (day)),
z AS (SELECT model, day, (b * f - c * o) / det AS f, (a * o - c * f) / det AS o,
             (b - c) / det AS uf, (a - c) / det AS uo FROM y),
w AS (SELECT model, day, f + uf * (1 - f - o) / (uf + uo) AS f, o + uo * (1 - f - o) / (uf + uo) AS o FROM z)
SELECT model, day, 'F' AS asset, round(f, 7) AS w_hat FROM w
UNION ALL SELECT model, day, 'O', round(o, 7) FROM w""",
}
