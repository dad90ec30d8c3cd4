"""Shared pieces of the checking SQL: the bindings written as CTEs."""

from __future__ import annotations


def weights_cte(grain: str = "week", asset: str = "p_type") -> str:
    """cells, days, assets, weights(day, asset, value, w), idx(.., t)."""
    join = "JOIN part ON l_partkey = p_partkey" if asset.startswith("p_") else ""
    dim = "part" if asset.startswith("p_") else "lineitem"
    return f"""
cells AS (
  SELECT CAST(date_trunc('{grain}', l_shipdate) AS DATE) AS day, {asset} AS asset,
         sum(l_extendedprice * (1 - l_discount)) AS value
  FROM lineitem {join} GROUP BY 1, 2),
days AS (SELECT DISTINCT day FROM cells),
assets AS (SELECT DISTINCT {asset} AS asset FROM {dim}),
weights AS (
  SELECT d.day, a.asset, coalesce(c.value, 0) AS value,
         coalesce(c.value, 0) / sum(coalesce(c.value, 0)) OVER (PARTITION BY d.day) AS w
  FROM days d CROSS JOIN assets a LEFT JOIN cells c ON c.day = d.day AND c.asset = a.asset),
idx AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY day) - 1 AS t FROM weights)"""


def predictions_cte() -> str:
    """predictions(model, day, asset, w_hat) on top of weights_cte."""
    return """
base AS (
  SELECT day, asset,
         lag(w) OVER a AS lag1,
         avg(w) OVER (a ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS mean5,
         avg(w) OVER (a ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS mean20,
         1.0 / count(*) OVER (PARTITION BY day) AS equal, t
  FROM idx WINDOW a AS (PARTITION BY asset ORDER BY day)),
predictions AS (
  SELECT model, day, asset, w_hat
  FROM (UNPIVOT (SELECT day, asset, lag1, mean5, mean20, equal FROM base WHERE t >= 20)
        ON lag1, mean5, mean20, equal INTO NAME model VALUE w_hat))"""


def event_returns_cte() -> str:
    """rets(day, bar, asset, ret) of the hourly event panel."""
    return """
ecells AS (
  SELECT CAST(ts AS DATE) AS day, hour(ts) AS bar, event_type AS asset, sum(value) AS value
  FROM events GROUP BY 1, 2, 3),
egrid AS (
  SELECT d.day, b.bar, a.asset, ln(1 + coalesce(c.value, 0)) AS l
  FROM (SELECT DISTINCT day FROM ecells) d CROSS JOIN (SELECT unnest(range(24)) AS bar) b
  CROSS JOIN (SELECT DISTINCT event_type AS asset FROM events) a
  LEFT JOIN ecells c ON c.day = d.day AND c.bar = b.bar AND c.asset = a.asset),
rets AS (
  SELECT * FROM (SELECT day, bar, asset, l - lag(l) OVER (PARTITION BY day, asset ORDER BY bar) AS ret
                 FROM egrid) WHERE ret IS NOT NULL)"""


def trade_returns_cte(asset: str = "p_type") -> str:
    """rets(day = month start, bar, asset, ret) of the shipment panel."""
    join = "JOIN part ON l_partkey = p_partkey" if asset.startswith("p_") else ""
    dim = "part" if asset.startswith("p_") else "lineitem"
    return f"""
tcells AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS day, day(l_shipdate) AS bar,
         {asset} AS asset, sum(l_extendedprice * (1 - l_discount)) AS value
  FROM lineitem {join} GROUP BY 1, 2, 3),
tgrid AS (
  SELECT d.day, d.bar, a.asset, ln(1 + coalesce(c.value, 0)) AS l
  FROM (SELECT day, unnest(range(1, day(last_day(day)) + 1)) AS bar
        FROM (SELECT DISTINCT day FROM tcells)) d
  CROSS JOIN (SELECT DISTINCT {asset} AS asset FROM {dim}) a
  LEFT JOIN tcells c ON c.day = d.day AND c.bar = d.bar AND c.asset = a.asset),
rets AS (
  SELECT * FROM (SELECT day, bar, asset, l - lag(l) OVER (PARTITION BY day, asset ORDER BY bar) AS ret
                 FROM tgrid) WHERE ret IS NOT NULL)"""


def cov_cte(ridge: float = 0.0) -> str:
    """cov(day, i, j, v), i <= j, on top of rets."""
    return f"""
cov AS (
  SELECT x.day, x.asset AS i, y.asset AS j,
         sum(x.ret * y.ret) + CASE WHEN x.asset = y.asset THEN {ridge!r} ELSE 0 END AS v
  FROM rets x JOIN rets y ON x.day = y.day AND x.bar = y.bar AND x.asset <= y.asset
  GROUP BY 1, 2, 3)"""
