"""Group C: covariances, precision matrices, networks.

Kernels that SQL cannot express run twice: on all assets (rows only, property
tests in tests/) and on the two line statuses, where closed forms exist.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import covariance as cv
from ..operators import network as nw
from ..operators import quality as q
from ..operators import penalty as pn
from ..sources import bindings as b
from ..sources.scratch import stage
from .sqltext import cov_cte, event_returns_cte, trade_returns_cte

PAIR = "l_linestatus"
LAMBDAS = [0.05, 0.5, 2.0]
LAM = 0.5
CORR = 0.2
WINDOW = 40
#: solver settings where the result is compared digit by digit
EXACT = {"max_iter": 20000, "tol": 1e-13}


def r(*names, digits=7):
    return [F.round(n, digits).alias(n) for n in names]


def pair_cov(spark, sf):
    return stage(cv.realized_cov(b.trade_returns(spark, sf, PAIR)), "cov")


def type_cov(spark, sf):
    return stage(cv.realized_cov(b.trade_returns(spark, sf)), "cov")


def pair_solved(spark, sf, lambdas=LAMBDAS):
    return stage(cv.glasso(pair_cov(spark, sf), lambdas, **EXACT), "precision")


def brand_edges(spark, sf):
    """Pairs of brands whose daily bars correlate within a month."""
    return stage(b.correlated_pairs(b.trade_returns(spark, sf, "p_brand"), CORR), "edges")


def months(spark, sf):
    return b.table(spark, sf, "lineitem").select(
        F.to_date(F.date_trunc("month", "l_shipdate")).alias("day")).distinct()


def _cov(spark, sf):
    return cv.realized_cov(b.event_returns(spark, sf), ridge=1e-6).select("day", "i", "j", *r("v"))


def _cov_tiled(spark, sf):
    return cv.realized_cov(b.trade_returns(spark, sf, "p_brand"), bar_block=8, tiles=3).select(
        "day", "i", "j", *r("v"))


def _pooled(spark, sf):
    cov = cv.realized_cov(b.event_returns(spark, sf))
    days = cov.filter(F.col("day") < F.lit("2024-01-16").cast("date"))
    return cv.pooled_cov(cov, days).select("i", "j", *r("v"))


def _rolling(spark, sf):
    return cv.rolling_cov(cv.realized_cov(b.trade_returns(spark, sf)), WINDOW).select("day", "i", "j", *r("v"), "n_days")


def _twin_cov(spark, sf):
    """Two assets that are copies of one series in even months: singular there."""
    twins = (b.trade_returns(spark, sf, PAIR).groupBy("day", "bar")
             .agg(F.max(F.when(F.col("asset") == "O", F.col("ret"))).alias("o"),
                  F.max(F.when(F.col("asset") == "F", F.col("ret"))).alias("f"))
             .withColumn("f", F.when(F.month("day") % 2 == 0, F.col("o")).otherwise(F.col("f"))))
    return cv.realized_cov(twins.unpivot(["day", "bar"], ["o", "f"], "asset", "ret"))


def _chain(spark, sf):
    done = cv.solve_status(cv.glasso(_twin_cov(spark, sf), [0.0], ridges=(0.0, 1e-14, 1e-3), max_iter=50))
    return done.select("day", "status", "ridge_used")


def _chain_report(spark, sf):
    # 1e-14 repairs a singular month only while its variances are below 0.01
    done = cv.solve_status(cv.glasso(_twin_cov(spark, sf), [0.5], ridges=(0.0, 1e-14)))
    return cv.solve_report(done).select("month", "n_days", "n_failed", *r("solved_share"))


def _glasso(spark, sf):
    solved = cv.glasso(cv.realized_cov(b.trade_returns(spark, sf)), LAMBDAS, ridges=(0.0, 1e-4, 1e-2))
    return cv.precision_cells(solved).select("day", "lambda", "i", "j", *r("v"))


def _glasso_pair(spark, sf):
    return cv.precision_cells(pair_solved(spark, sf)).select("day", "lambda", "i", "j", *r("v", digits=6))


def _edges(spark, sf):
    return nw.edges(cv.precision_cells(cv.glasso(pair_cov(spark, sf), [LAM])))


def _density(spark, sf):
    return nw.density(brand_edges(spark, sf), months(spark, sf), 25).select("day", *r("density"))


def _degree(spark, sf):
    return nw.degree(brand_edges(spark, sf))


def _degree_summary(spark, sf):
    return nw.degree_summary(brand_edges(spark, sf), months(spark, sf), 25).select(
        "day", *r("mean_degree", "sd_degree", digits=6))


def _pagerank(spark, sf):
    return nw.pagerank(brand_edges(spark, sf)).select("day", "node", *r("rank", digits=8))


def _clustering(spark, sf):
    return nw.clustering(brand_edges(spark, sf)).select("day", "node", *r("clustering"))


def _abar(spark, sf):
    return nw.rolling_network_mean(brand_edges(spark, sf), months(spark, sf)).select("day", "i", "j", *r("p"))


def _mask(spark, sf, use_last_day=False):
    days = months(spark, sf)
    abar = nw.rolling_network_mean(brand_edges(spark, sf), days)
    calendar = q.day_index(days).filter("t >= 19")
    return nw.network_mask(stage(abar, "abar"), 0.3, use_last_day, calendar=calendar).select("i", "j", *r("p", digits=9))


def _scan(spark, sf):
    return pn.lambda_scan(pair_solved(spark, sf), pair_cov(spark, sf), 2).select(
        "lambda", "n_days", *r("success_rate", "density"), *r("oos_variance", digits=6))


def chosen_lambda(spark, sf):
    return pn.select_lambda(pair_cov(spark, sf), LAMBDAS, **EXACT)


def _select(spark, sf):
    return chosen_lambda(spark, sf).select("lambda", *r("score"))


def _factor_bic(spark, sf):
    returns = stage(b.trade_returns(spark, sf), "returns")
    return pn.factor_bic(returns, 1, LAMBDAS, ridges=(1e-2, 1e-1)).select(
        "day", "lambda", "n_edges", *r("bic", digits=4))


QUERIES = {
    "c01_realized_cov": _cov,
    "c01_realized_cov_tiled": _cov_tiled,
    "c02_pooled_cov": _pooled,
    "c03_rolling_cov": _rolling,
    "c04_ridge_chain": _chain,
    "c05_glasso": _glasso,
    "c05_glasso_pair": _glasso_pair,
    "c06_edges": _edges,
    "c07_density": _density,
    "c08_degree": _degree,
    "c08_degree_summary": _degree_summary,
    "c09_pagerank": _pagerank,
    "c10_clustering": _clustering,
    "c11_rolling_network": _abar,
    "c12_network_mask": _mask,
    "c12_network_mask_last_day": lambda spark, sf: _mask(spark, sf, True),
    "c13_lambda_scan": _scan,
    "c14_lambda_selection": _select,
    "c15_factor_bic": _factor_bic,
    "c16_solve_report": _chain_report,
}

_PAIR_COV = f"{trade_returns_cte(PAIR)}, {cov_cte()}"
PIVOT = """
m AS (SELECT day, max(v) FILTER (i = 'F' AND j = 'F') AS a, max(v) FILTER (i = 'O' AND j = 'O') AS b,
             max(v) FILTER (i <> j) AS c FROM {source} GROUP BY day)"""
SOLVE = """
s AS (SELECT day, "lambda", a, b, sign(c) * greatest(abs(c) - "lambda", 0) AS c FROM m
      CROSS JOIN (SELECT unnest([{lambdas}]) AS "lambda")),
prec AS (
  SELECT day, "lambda", 'F' AS i, 'F' AS j, b / (a * b - c * c) AS v FROM s
  UNION ALL SELECT day, "lambda", 'O', 'O', a / (a * b - c * c) FROM s
  UNION ALL SELECT day, "lambda", 'F', 'O', -c / (a * b - c * c) FROM s WHERE c <> 0)"""
PAIR_PREC = f"{_PAIR_COV}, {PIVOT.format(source='cov')}, {SOLVE.format(lambdas=', '.join(f'{x}::DOUBLE' for x in LAMBDAS))}"
_EDGES = f"""{trade_returns_cte('p_brand')},
edges AS (
  SELECT x.day, x.asset AS i, y.asset AS j FROM rets x
  JOIN rets y ON x.day = y.day AND x.bar = y.bar AND x.asset < y.asset
  GROUP BY 1, 2, 3 HAVING NOT isnan(corr(x.ret, y.ret)) AND corr(x.ret, y.ret) > {CORR}),
ends AS (SELECT day, i AS node, j AS other FROM edges UNION ALL SELECT day, j, i FROM edges),
deg AS (SELECT day, node, count(*) AS degree FROM ends GROUP BY 1, 2),
mon AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS day FROM lineitem)"""
_ABAR = f"""{_EDGES},
t AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS t FROM mon),
et AS (SELECT i, j, t FROM edges JOIN t USING (day)),
abar AS (SELECT t.t, t.day, e.i, e.j, count(*) / 20.0 AS p FROM t JOIN et e ON e.t BETWEEN t.t - 19 AND t.t
         WHERE t.t >= 19 GROUP BY 1, 2, 3, 4)"""


def _pagerank_sql(iters: int = 20, damping: float = 0.85) -> str:
    steps = ["r0 AS (SELECT day, node, degree, 1.0::DOUBLE / count(*) OVER (PARTITION BY day) AS rank, "
             "count(*) OVER (PARTITION BY day) AS n FROM deg)"]
    for k in range(1, iters + 1):
        steps.append(
            f"r{k} AS MATERIALIZED (SELECT r.day, r.node, any_value(r.degree) AS degree, "
            f"{1 - damping}::DOUBLE / any_value(r.n) + {damping}::DOUBLE * sum(o.rank / o.degree) AS rank, "
            f"any_value(r.n) AS n FROM r{k - 1} r JOIN ends e ON e.day = r.day AND e.node = r.node "
            f"JOIN r{k - 1} o ON o.day = e.day AND o.node = e.other GROUP BY 1, 2)")
    return f"WITH {_EDGES}, {', '.join(steps)} SELECT day, node, round(rank, 8) AS rank FROM r{iters}"


_TWINS = f"{trade_returns_cte(PAIR)}, mon AS (SELECT DISTINCT day, month(day) % 2 = 0 AS twin FROM rets)"

ORACLES = {
    "c01_realized_cov": f"WITH {event_returns_cte()}, {cov_cte(1e-6)} SELECT day, i, j, round(v, 7) AS v FROM cov",
    "c01_realized_cov_tiled": f"""
WITH {trade_returns_cte('p_brand')}, {cov_cte()} SELECT day, i, j, round(v, 7) AS v FROM cov""",
    "c02_pooled_cov": f"""
WITH {event_returns_cte()}, {cov_cte()}
SELECT i, j, round(avg(v), 7) AS v FROM cov WHERE day < DATE '2024-01-16' GROUP BY 1, 2""",
    "c03_rolling_cov": f"""
WITH {trade_returns_cte()}, {cov_cte()},
x AS (SELECT day, i, j, avg(v) OVER w AS v, count(*) OVER w AS n_days FROM cov
      WINDOW w AS (PARTITION BY i, j ORDER BY day ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING))
SELECT day, i, j, round(v, 7) AS v, n_days FROM x WHERE n_days = {WINDOW}""",
    "c04_ridge_chain": f"""
WITH {_TWINS} SELECT day, 'ok' AS status, CASE WHEN twin THEN 1e-3::DOUBLE ELSE 0.0::DOUBLE END AS ridge_used FROM mon""",
    "c05_glasso_pair": f"""WITH {PAIR_PREC} SELECT day, "lambda", i, j, round(v, 6) AS v FROM prec""",
    "c06_edges": f"""WITH {PAIR_PREC} SELECT day, i, j FROM prec WHERE i < j AND "lambda" = {LAM}""",
    "c07_density": f"""
WITH {_EDGES} SELECT day, round(count(i) / 300.0::DOUBLE, 7) AS density FROM mon LEFT JOIN edges USING (day) GROUP BY day""",
    "c08_degree": f"WITH {_EDGES} SELECT day, node, degree FROM deg",
    "c08_degree_summary": f"""
WITH {_EDGES}, n AS (SELECT mon.day, b.p_brand AS node FROM mon CROSS JOIN (SELECT DISTINCT p_brand FROM part) b),
d AS (SELECT n.day, coalesce(degree, 0) AS degree FROM n LEFT JOIN deg USING (day, node))
SELECT day, round(avg(degree), 6) AS mean_degree, round(stddev_pop(degree), 6) AS sd_degree FROM d GROUP BY day""",
    "c09_pagerank": _pagerank_sql(),
    "c10_clustering": f"""
WITH {_EDGES},
tri AS (SELECT a.day, a.node, count(*) AS twice FROM ends a JOIN ends b ON a.day = b.day AND a.other = b.node
        JOIN ends c ON c.day = a.day AND c.node = a.node AND c.other = b.other GROUP BY 1, 2)
SELECT day, node, round(CASE WHEN degree > 1 THEN coalesce(twice, 0)::DOUBLE / (degree * (degree - 1)) ELSE 0 END, 7)
       AS clustering FROM deg LEFT JOIN tri USING (day, node)""",
    "c11_rolling_network": f"WITH {_ABAR} SELECT day, i, j, round(p::DOUBLE, 7) AS p FROM abar",
    "c12_network_mask": f"""
WITH {_ABAR}, x AS (SELECT e.i, e.j, count(*)::DOUBLE / (20 * (SELECT count(*) FROM t WHERE t >= 19)) AS p
                    FROM t JOIN et e ON e.t BETWEEN t.t - 19 AND t.t WHERE t.t >= 19 GROUP BY 1, 2)
SELECT i, j, round(p, 9) AS p FROM x WHERE p >= 0.3""",
    "c12_network_mask_last_day": f"""
WITH {_ABAR} SELECT i, j, round(p::DOUBLE, 9) AS p FROM abar WHERE t = (SELECT max(t) FROM t) AND p >= 0.3""",
    "c13_lambda_scan": f"""
WITH {PAIR_PREC},
nx AS (SELECT *, lead(day) OVER (ORDER BY day) AS next FROM m),
w AS (SELECT s."lambda" AS l, nx.next AS day, (s.b - s.c) / (s.a + s.b - 2 * s.c) AS f, s.c FROM s JOIN nx ON nx.day = s.day),
v AS (SELECT l, avg(f * f * m.a + (1 - f) * (1 - f) * m.b + 2 * f * (1 - f) * m.c) AS oos
      FROM w JOIN m ON m.day = w.day GROUP BY l)
SELECT w.l AS "lambda", count(*) AS n_days, 1.0::DOUBLE AS success_rate,
       round(avg(CASE WHEN w.c <> 0 THEN 1.0::DOUBLE ELSE 0 END), 7) AS density, round(any_value(oos), 6) AS oos_variance
FROM w JOIN v ON v.l = w.l GROUP BY w.l""",
    "c14_lambda_selection": f"""
WITH {_PAIR_COV},
t AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS t FROM (SELECT DISTINCT day FROM cov)),
pool AS (SELECT DATE '1970-01-01' AS day, i, j, avg(v) AS v FROM cov JOIN t USING (day) WHERE t < 44 GROUP BY i, j),
{PIVOT.format(source='pool')}, {SOLVE.format(lambdas=', '.join(f'{x}::DOUBLE' for x in LAMBDAS))},
w AS (SELECT "lambda", (b - c) / (a + b - 2 * c) AS f, (a - c) / (a + b - 2 * c) AS o FROM s),
val AS (SELECT day, max(v) FILTER (i = 'F' AND j = 'F') AS a, max(v) FILTER (i = 'O' AND j = 'O') AS b,
               max(v) FILTER (i <> j) AS c FROM cov JOIN t USING (day) WHERE t BETWEEN 44 AND 48 GROUP BY day),
score AS (SELECT "lambda", avg(f * f * a + o * o * b + 2 * f * o * c) AS score FROM w CROSS JOIN val GROUP BY "lambda")
SELECT "lambda", round(score, 7) AS score FROM score ORDER BY score.score, "lambda" DESC LIMIT 1""",
    "c16_solve_report": f"""
WITH {trade_returns_cte(PAIR)},
o AS (SELECT day, bar, max(ret) FILTER (asset = 'O') AS o, max(ret) FILTER (asset = 'F') AS f FROM rets GROUP BY 1, 2),
twins AS (SELECT day, o, CASE WHEN month(day) % 2 = 0 THEN o ELSE f END AS f FROM o),
m AS (SELECT day, sum(f * f) AS a, sum(o * o) AS b, sum(f * o) AS c FROM twins GROUP BY day),
least AS (SELECT day, (a + b) / 2 AS mean, (a + b) / 2 - sqrt((a - b) * (a - b) / 4 + c * c) AS low FROM m),
ridged AS (SELECT day, low + ridge > 1e-12::DOUBLE * (mean + ridge) AS definite FROM least
           CROSS JOIN (SELECT unnest([0.0::DOUBLE, 1e-14::DOUBLE]) AS ridge)),
done AS (SELECT day, bool_or(definite) AS ok FROM ridged GROUP BY day)
SELECT day AS month, 1::BIGINT AS n_days, CASE WHEN ok THEN 0 ELSE 1 END::BIGINT AS n_failed,
       CASE WHEN ok THEN 1.0 ELSE 0.0 END::DOUBLE AS solved_share FROM done""",
}

SELECTED_SQL = ORACLES["c14_lambda_selection"]
