"""Choice of the penalty of the sparse precision matrix: scan, validation, BIC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .covariance import glasso, pooled_cov, precision_cells, realized_cov
from .evaluate import portfolio_variance
from .portfolio import w_from_prec
from .quality import fixed_window


def next_day_variance(solved: DataFrame, cov: DataFrame) -> DataFrame:
    """(lambda, day, variance): weights of a day under the covariance of the next one."""
    # one row per day: the calendar, not the panel
    following = cov.select("day").distinct().withColumn("next", F.lead("day").over(Window.orderBy("day")))
    held = (w_from_prec(precision_cells(solved), "day", "lambda").join(following, "day")
            .select(F.col("lambda").alias("model"), F.col("next").alias("day"), "asset", F.col("w").alias("w_hat")))
    return portfolio_variance(held, cov).withColumnRenamed("model", "lambda")


def lambda_scan(solved: DataFrame, cov: DataFrame, n_assets: int) -> DataFrame:
    """Per lambda the days tried, share solved, mean density, next-day variance and seconds.

    `solved` comes from `glasso` over a list of penalties, which solves all of
    them inside a day's group: no product of days and penalties is formed.
    """
    pairs = n_assets * (n_assets - 1) / 2
    ok = F.col("status") == "ok"
    out = solved.groupBy("lambda").agg(
        F.count(F.lit(1)).alias("n_days"), F.avg(ok.cast("double")).alias("success_rate"),
        F.avg(F.when(ok, F.col("n_edges") / pairs)).alias("density"), F.avg("seconds").alias("seconds"))
    later = next_day_variance(solved, cov).groupBy("lambda").agg(F.avg("variance").alias("oos_variance"))
    return out.join(later, "lambda", "left")


def choose_lambda(scores: DataFrame) -> DataFrame:
    """The lambda with the lowest score (the larger one on a tie)."""
    return scores.agg(F.min_by("lambda", F.struct("score", -F.col("lambda"))).alias("lambda"),
                      F.min("score").alias("score"))


def select_lambda(cov: DataFrame, lambdas: Sequence[float], train: int = 44, valid: int = 5, test: int = 22,
                  **solver) -> DataFrame:
    """C14: pool the training days, solve per lambda, keep the one whose weights have the least
    mean variance over the validation days."""
    window = fixed_window(cov, train, valid, test)
    pooled = pooled_cov(cov, window.filter("part = 'train'"))
    solved = glasso(pooled.withColumn("day", F.lit("1970-01-01").cast("date")), lambdas, **solver)
    w = w_from_prec(precision_cells(solved), "lambda")
    # at most `valid` days, as one array: every candidate is tried on each
    days = window.filter("part = 'validation'").agg(F.collect_list("day")).scalar()
    tried = w.withColumn("days", days).select(
        F.col("lambda").alias("model"), F.explode("days").alias("day"), "asset", F.col("w").alias("w_hat"))
    scores = portfolio_variance(tried, cov).groupBy(F.col("model").alias("lambda")).agg(
        F.avg("variance").alias("score"))
    return choose_lambda(scores)


def bic_choice(solved: DataFrame, n_bars: DataFrame) -> DataFrame:
    """Per day the lambda with the lowest BIC = -2 loglik + log(M) * edges.

    n_bars is (day, n_bars); the covariance is a sum over M bars, so the
    log-likelihood is M/2 * (log det - trace) up to a constant of the day."""
    loss = F.col("n_bars") * (F.col("trace") - F.col("log_det")) + F.log("n_bars") * F.col("n_edges")
    scored = solved.filter("status = 'ok'").join(n_bars, "day").withColumn("bic", loss)
    best = F.min_by(F.struct("lambda", "n_edges", "bic"), F.struct("bic", "lambda"))
    return scored.groupBy("day").agg(best.alias("b")).select("day", "b.*")


def factor_bic(returns: DataFrame, n_factors: int, lambdas: Sequence[float], ridges: Sequence[float] = (0.0,),
               **solver) -> DataFrame:
    """Take out the leading principal components of the day's bars, then choose lambda by BIC."""
    bars = returns.groupBy("day").agg(F.count_distinct("bar").cast("double").alias("n_bars"))
    return bic_choice(glasso(realized_cov(returns), lambdas, ridges, n_factors=n_factors, **solver), bars)
