"""Bind the driver's tables to panels (weights, returns, exogenous series).

Each binding scans its fact table once.  Asset universes come from the
dimension table where there is one, so that a missing (day, asset) cell can be
filled without a second scan of the facts and without a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.covariance import realized_cov
from ..operators.features import trailing_means
from ..operators.panel import bar_returns, densify, period_shares
from .scratch import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _truncate(grain: str, ts: str) -> Column:
    return F.to_date(ts) if grain == "day" else F.to_date(F.date_trunc(grain, ts))


def _asset(columns: str) -> Column:
    """One attribute, or several joined by commas: 'p_brand,p_type' makes 150 assets."""
    names = columns.split(",")
    return F.col(names[0]) if len(names) == 1 else F.concat_ws("|", *names)


def _trades(spark: SparkSession, sf_dir: str, grain: str, asset: str) -> DataFrame:
    """Shipped lines as (day, bar, asset, value); bar is the day of the month."""
    value = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    lines = table(spark, sf_dir, "lineitem")
    name = _asset(asset)
    if asset.startswith("p_"):
        # no broadcast hint: the optimiser broadcasts `part` only while it is
        # small, and splits a hot part key of a sort-merge join at run time
        part = table(spark, sf_dir, "part").select("p_partkey", name.alias("asset"))
        lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        name = F.col("asset")
    return lines.select(_truncate(grain, "l_shipdate").alias("day"),
                        F.dayofmonth("l_shipdate").alias("bar"),
                        name.alias("asset"), value.alias("value"))


def universe(spark: SparkSession, sf_dir: str, asset: str) -> DataFrame:
    """All assets, one row each."""
    source = {"p": "part", "l": "lineitem", "e": "events"}[asset[0]]
    return table(spark, sf_dir, source).select(_asset(asset).alias("asset")).distinct()


def weights(spark: SparkSession, sf_dir: str, grain: str = "week", asset: str = "p_type") -> DataFrame:
    """Revenue shares: (day, asset, value, w), dense, summing to 1 per day.

    Written once and read back: every later step reads days x assets rows
    instead of scanning the facts again.
    """
    cells = (_trades(spark, sf_dir, grain, asset)
             .groupBy("day", "asset").agg(F.sum("value").alias("value")))
    return stage(period_shares(densify(cells, universe(spark, sf_dir, asset), 0.0)), "weights")


def event_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly log-changes of event value per event type: (day, bar, asset, ret)."""
    cells = (table(spark, sf_dir, "events")
             .select(F.to_date("ts").alias("day"), F.hour("ts").alias("bar"),
                     F.col("event_type").alias("asset"), "value")
             .groupBy("day", "bar", "asset").agg(F.sum("value").alias("value")))
    return bar_returns(cells, universe(spark, sf_dir, "event_type"), F.sequence(F.lit(0), F.lit(23)))


def trade_returns(spark: SparkSession, sf_dir: str, asset: str = "p_type") -> DataFrame:
    """Months of daily bars from shipments: (day = month start, bar, asset, ret)."""
    cells = (_trades(spark, sf_dir, "month", asset)
             .groupBy("day", "bar", "asset").agg(F.sum("value").alias("value")))
    return bar_returns(cells, universe(spark, sf_dir, asset),
                       F.sequence(F.lit(1), F.dayofmonth(F.last_day("day"))))


def correlated_pairs(returns: DataFrame, above: float) -> DataFrame:
    """Stand-in networks for the graph operators: (day, i, j) whose bars correlate more than `above`.

    Series are centred and scaled to length 1, so that the sums of products are
    correlations and need no join with variances. Constant series drop out.
    """
    series = Window.partitionBy("day", "asset")
    centred = returns.withColumn("c", F.col("ret") - F.avg("ret").over(series))
    unit = centred.withColumn("ret", F.try_divide("c", F.sqrt(F.sum(F.col("c") * F.col("c")).over(series))))
    cells = realized_cov(unit.filter(F.col("ret").isNotNull()).select("day", "bar", "asset", "ret"))
    return cells.filter((F.col("i") < F.col("j")) & (F.col("v") > above)).select("day", "i", "j")


def exog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order flow per order day, long: (day, name, x)."""
    price = F.col("o_totalprice")
    daily = (table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day"))
             .agg(F.count(F.lit(1)).cast("double").alias("n_orders"),
                  F.avg(price).alias("avg_price"),
                  F.sum(price).alias("sum_price"),
                  F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("urgent_share")))
    return daily.unpivot("day", ["n_orders", "avg_price", "sum_price", "urgent_share"], "name", "x")


def naive_predictions(w: DataFrame) -> DataFrame:
    """Forecasts that need no fit: previous share, moving means, equal weight.

    Only days with a full 20-day history are forecast, so that all models share
    one test window.  Returns (model, day, asset, w_hat).
    """
    base = trailing_means(w, {"lag1": 1, "mean5": 5, "mean20": 20}, full=20)
    base = base.withColumn("equal", 1 / F.count(F.lit(1)).over(Window.partitionBy("day")))
    return (base.unpivot(["day", "asset"], ["lag1", "mean5", "mean20", "equal"], "model", "w_hat")
            .select("model", "day", "asset", "w_hat"))
