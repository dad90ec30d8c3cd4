"""Forecast accuracy, turnover, tests and portfolio performance.

Predictions are (model, day, asset, w_hat); realised weights (day, asset, w).
All windows are per (model, asset) or per model over days, never over the
whole table.  Ratios with a vanishing denominator (a constant series, identical
models) are null rather than an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import log10_normal_tail

DAYS_PER_YEAR = 252


def _errors(pred: DataFrame, act: DataFrame) -> DataFrame:
    return pred.join(act.select("day", "asset", "w"), ["day", "asset"]).withColumn(
        "err", F.col("w_hat") - F.col("w"))


def accuracy(pred: DataFrame, act: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """G1 and G2 in one pass: (model, mse, mae)."""
    return _errors(pred, act).groupBy(*keys).agg(
        F.avg(F.col("err") * F.col("err")).alias("mse"), F.avg(F.abs("err")).alias("mae"))


def mse(pred: DataFrame, act: DataFrame) -> DataFrame:
    return accuracy(pred, act).select("model", "mse")


def mae(pred: DataFrame, act: DataFrame) -> DataFrame:
    return accuracy(pred, act).select("model", "mae")


def daily_loss(pred: DataFrame, act: DataFrame) -> DataFrame:
    """Loss of a day: mean squared error over the assets. (model, day, loss)"""
    return _errors(pred, act).groupBy("model", "day").agg(
        F.avg(F.col("err") * F.col("err")).alias("loss"))


def turnover_by_day(pred: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Sum of absolute changes of the forecast per day; a model's first day is left out."""
    w = Window.partitionBy(*keys, "asset").orderBy("day")
    moved = pred.withColumn("move", F.abs(F.col("w_hat") - F.lag("w_hat").over(w)))
    return (moved.filter(F.col("move").isNotNull())
            .groupBy(*keys, "day").agg(F.sum("move").alias("turnover")))


def turnover_seq(pred: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Mean over days of the forecast's own turnover."""
    return turnover_by_day(pred, keys).groupBy(*keys).agg(F.avg("turnover").alias("turnover_seq"))


def economic_turnover_by_day(pred: DataFrame, weights: DataFrame,
                             keys: tuple[str, ...] = ("model",)) -> DataFrame:
    w = Window.partitionBy("asset").orderBy("day")
    before = weights.select("day", "asset", F.lag("w").over(w).alias("w_before")).filter(
        F.col("w_before").isNotNull())
    return (pred.join(before, ["day", "asset"])
            .groupBy(*keys, "day").agg(F.sum(F.abs(F.col("w_hat") - F.col("w_before"))).alias("turnover")))


def turnover_econ(pred: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Mean over days of the distance to the weights held the day before."""
    return economic_turnover_by_day(pred, weights, keys).groupBy(*keys).agg(
        F.avg("turnover").alias("turnover_econ"))


def dm_test(losses: DataFrame, base: str, lags: int = 0) -> DataFrame:
    """Diebold-Mariano statistic of each model against `base` (negative = better).

    With lags > 0 the variance is Newey-West with Bartlett weights.  The log10
    of the two-sided p-value stays finite where the p-value underflows.
    """
    ref = losses.filter(F.col("model") == base).select("day", F.col("loss").alias("base_loss"))
    diff = (losses.filter(F.col("model") != base).join(ref, "day")
            .select("model", "day", (F.col("loss") - F.col("base_loss")).alias("d")))
    per_model = Window.partitionBy("model")
    cent = diff.withColumn("mean_d", F.avg("d").over(per_model)).withColumn("c", F.col("d") - F.col("mean_d"))
    order = per_model.orderBy("day")
    terms = [F.sum(F.col("c") * F.col("c"))]
    for l in range(1, lags + 1):
        cent = cent.withColumn(f"c{l}", F.lag("c", l).over(order))
        terms.append(2 * (1 - l / (lags + 1)) * F.coalesce(F.sum(F.col("c") * F.col(f"c{l}")), F.lit(0.0)))
    n = F.count(F.lit(1))
    long_run = sum(terms[1:], terms[0]) / n
    stat = cent.groupBy("model").agg(F.try_divide(F.first("mean_d"), F.sqrt(long_run / n)).alias("dm_stat"),
                                     n.alias("n_days"))
    return (stat.withColumn("dm_log10_p", log10_normal_tail(F.col("dm_stat")))
            .withColumn("dm_p", F.pow(F.lit(10.0), F.col("dm_log10_p"))))


def portfolio_return(pred: DataFrame, day_returns: DataFrame) -> DataFrame:
    """(model, day, ret) with ret = sum of weight times return."""
    return (pred.join(day_returns, ["day", "asset"])
            .groupBy("model", "day").agg(F.sum(F.col("w_hat") * F.col("ret")).alias("ret")))


def volatility(port: DataFrame) -> DataFrame:
    """Annualised standard deviation."""
    return port.groupBy("model").agg(
        (F.stddev_samp("ret") * F.sqrt(F.lit(float(DAYS_PER_YEAR)))).alias("volatility"))


def portfolio_variance(pred: DataFrame, cov: DataFrame) -> DataFrame:
    """G11 per day: w' S w from the upper triangle. (model, day, variance)

    Joins the weights to the covariance cells, first by row, then by column;
    the work is models x cells and every join is an equality on the day.
    """
    left = pred.select("model", "day", F.col("asset").alias("i"), F.col("w_hat").alias("w_i"))
    right = pred.select("model", "day", F.col("asset").alias("j"), F.col("w_hat").alias("w_j"))
    double = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    return (cov.join(left, ["day", "i"]).join(right, ["model", "day", "j"])
            .groupBy("model", "day")
            .agg(F.sum(double * F.col("v") * F.col("w_i") * F.col("w_j")).alias("variance")))


def annual_rpv(variance: DataFrame) -> DataFrame:
    return variance.groupBy("model").agg((F.avg("variance") * DAYS_PER_YEAR).alias("annual_rpv"))


def sharpe(port: DataFrame, turnover: DataFrame, eta: float = 1e-4) -> DataFrame:
    """Annualised ratio before and after costs of eta per unit of turnover."""
    net = F.col("ret") - eta * F.coalesce(F.col("turnover"), F.lit(0.0))
    year = F.sqrt(F.lit(float(DAYS_PER_YEAR)))
    both = port.join(turnover, ["model", "day"], "left").withColumn("net", net)
    return both.groupBy("model").agg((F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * year).alias("sharpe"),
                                     (F.try_divide(F.avg("net"), F.stddev_samp("net")) * year).alias("net_sharpe"))


def cumulative(port: DataFrame, compound: bool = False) -> DataFrame:
    """Running return per model, added up or compounded."""
    run = Window.partitionBy("model").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    total = F.exp(F.sum(F.log1p("ret")).over(run)) - 1 if compound else F.sum("ret").over(run)
    return port.withColumn("cum", total)


def max_drawdown(port: DataFrame, compound: bool = False) -> DataFrame:
    """Largest fall from a running peak (the peak is at least the start, 0)."""
    run = Window.partitionBy("model").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    curve = cumulative(port, compound).withColumn("peak", F.greatest(F.max("cum").over(run), F.lit(0.0)))
    fall = F.col("cum") - F.col("peak")
    if compound:
        fall = fall / (1 + F.col("peak"))
    return curve.groupBy("model").agg(F.min(fall).alias("max_drawdown"))


def dfl_loss(variance: DataFrame, turnover: DataFrame, eta: float = 1e-4) -> DataFrame:
    """G15 per day: w' S w + eta * |w - w_before|. (model, day, loss)"""
    return variance.join(turnover, ["model", "day"]).select(
        "model", "day", (F.col("variance") + eta * F.col("turnover")).alias("loss"))


def compare(*tables: DataFrame, rank_by: str = "mse") -> DataFrame:
    """Metric tables joined by model, with the rank by one metric.

    The first table names the models; a metric another lacks is null."""
    out = tables[0]
    for other in tables[1:]:
        out = out.join(other, "model", "left")
    # one row per model: the only global window in this module
    return out.withColumn(f"{rank_by}_rank", F.rank().over(Window.orderBy(rank_by)))


def sparsity(coefs: DataFrame, n_assets: int, n_features: int, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Non-zero coefficients and the share of zeros. coefs: (.., asset, pos, beta), intercept at pos 0."""
    alive = F.count_if((F.col("pos") > 0) & (F.col("beta") != 0))
    return coefs.groupBy(*keys).agg(
        alive.alias("n_alive"), (1 - alive / F.lit(float(n_assets * n_features))).alias("sparsity"))


def effective_ratio(coefs: DataFrame, n_train: int | Column, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Non-zeros per equation and observations per effective parameter.

    n_train may be a column of the keys, such as one number per fold."""
    n_train = n_train if isinstance(n_train, Column) else F.lit(n_train)
    alive = F.count_if((F.col("pos") > 0) & (F.col("beta") != 0))
    per_eq = alive / F.count_distinct("asset")
    return coefs.groupBy(*keys).agg(per_eq.alias("per_equation"),
                                    (F.first(n_train).cast("double") / F.when(per_eq > 0, per_eq)).alias("t_over_p"))


def ablation(metrics: DataFrame, full: str, value: str = "net_sharpe") -> DataFrame:
    """Every variant minus the full model."""
    ref = metrics.filter(F.col("model") == full).select(value).scalar()
    return metrics.withColumn("full_value", ref).select(
        "model", value, (F.col(value) - F.col("full_value")).alias("delta"))


def improvement(metrics: DataFrame, ref: str, value: str = "mse") -> DataFrame:
    """Reduction against a reference model, in percent."""
    base = metrics.filter(F.col("model") == ref).select(value).scalar()
    return metrics.withColumn("ref_value", base).select(
        "model", value, (100 * (1 - F.try_divide(value, "ref_value"))).alias("improvement_pct"))


def describe_weights(weights: DataFrame) -> DataFrame:
    """Moments and quantiles of w, one row per statistic.

    Skewness and kurtosis are population moments, kurtosis not reduced by 3."""
    sums = weights.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("w").alias("mean"),
                       F.skewness("w").alias("skewness"), (F.kurtosis("w") + 3).alias("kurtosis"), F.stddev_samp("w").alias("sd"), F.min("w").alias("min"), F.max("w").alias("max"),
                       F.percentile("w", F.lit(0.25)).alias("p25"), F.percentile("w", F.lit(0.5)).alias("p50"),
                       F.percentile("w", F.lit(0.75)).alias("p75"))
    wide = sums.select("mean", "n", "sd", "min", "max", "p25", "p50", "p75", "skewness", "kurtosis")
    return wide.unpivot([], wide.columns, "statistic", "value")


def daily_stats(weights: DataFrame, density: DataFrame) -> DataFrame:
    """Exposure, short share, largest weight, turnover and density per day."""
    w = Window.partitionBy("asset").orderBy("day")
    per_day = (weights.withColumn("move", F.abs(F.col("w") - F.lag("w").over(w)))
               .groupBy("day").agg(F.sum(F.abs("w")).alias("gross"),
                                   F.sum(F.greatest(-F.col("w"), F.lit(0.0))).alias("short"),
                                   F.max(F.abs("w")).alias("max_abs"),
                                   F.sum("move").alias("turnover")))
    return per_day.join(density.select("day", "density"), "day", "left")


def sensitivity(grid: DataFrame, by: str, baseline: float | DataFrame) -> DataFrame:
    """Per value of one parameter, how many configurations beat the baseline."""
    base = baseline.scalar() if isinstance(baseline, DataFrame) else F.lit(baseline)
    return (grid.withColumn("baseline", base).groupBy(by)
            .agg(F.count(F.lit(1)).alias("n_configs"),
                 F.count_if(F.col("mean_val_mse") < F.col("baseline")).alias("n_better"),
                 F.min("mean_val_mse").alias("min_mse"), F.max("mean_val_mse").alias("max_mse")))


def grid_slice(grid: DataFrame, model: str, columns: list[str]) -> DataFrame:
    """The rows of one model, its own columns only."""
    return grid.filter(F.col("model") == model).select(*columns)


def fold_dispersion(fold_metrics: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and population sd over the folds, per configuration."""
    aggs = [a for m in metrics for a in (F.avg(m).alias(f"mean_{m}"), F.stddev_pop(m).alias(f"std_{m}"))]
    return fold_metrics.groupBy(*keys).agg(*aggs)
