"""Tables behind the figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import cumulative


def lambda_curve(scores: DataFrame) -> DataFrame:
    """H1: mean score per lambda with its rank."""
    per = scores.groupBy("lambda").agg(F.avg("score").alias("score"))
    return per.withColumn("rank", F.rank().over(Window.orderBy("score")))  # one row per lambda


def weight_heatmap(weights: DataFrame, grain: str = "quarter", buckets: int = 3) -> DataFrame:
    """H2: mean weight per time bucket and asset bucket (assets ordered by mean weight).

    Buckets are computed on one row per asset and joined back."""
    means = weights.groupBy("asset").agg(F.avg("w").alias("mean_w"))
    bucket = means.select("asset", F.ntile(buckets).over(Window.orderBy("mean_w", "asset")).alias("asset_bucket"))
    return (weights.join(bucket, "asset")
            .groupBy(F.to_date(F.date_trunc(grain, "day")).alias("period"), "asset_bucket")
            .agg(F.avg("w").alias("mean_w"), F.count(F.lit(1)).alias("n")))


def density_turnover(density: DataFrame, turnover: DataFrame) -> DataFrame:
    """H3: both series of a day side by side."""
    return density.select("day", "density").join(turnover.select("day", "turnover"), "day", "full")


def cumulative_all(port: DataFrame) -> DataFrame:
    """H4: running return of every model."""
    return cumulative(port).select("model", "day", "cum")


def grid_heatmap(grid: DataFrame, model: str, lam_net: float, taus: list[float]) -> DataFrame:
    """H5: lambda x tau table of the mean validation MSE at one network penalty."""
    return (grid.filter((F.col("model") == model) & (F.col("LAMBDA_NETWORK") == lam_net))
            .groupBy("LAMBDA_LASSO").pivot("NETWORK_THRESHOLD", taus).agg(F.min("mean_val_mse")))


def grid_ranking(grid: DataFrame) -> DataFrame:
    """H5: all configurations ordered by MSE; one row per configuration."""
    order = Window.orderBy("mean_val_mse", "model", "config_id")
    return grid.withColumn("place", F.row_number().over(order)).select("place", "model", "config_id", "mean_val_mse")
