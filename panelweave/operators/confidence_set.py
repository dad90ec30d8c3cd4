"""Model Confidence Set with a block bootstrap (Hansen, Lunde and Nason, 2011)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import mixed_integer


def common_days(losses: DataFrame) -> DataFrame:
    """The losses of the days on which every model has one."""
    models = losses.agg(F.count_distinct("model")).scalar()
    full = losses.filter("loss IS NOT NULL").groupBy("day").agg(F.count_distinct("model").alias("n")).withColumn("models", models)
    return losses.join(full.filter("n = models").select("day"), "day", "left_semi")


def bootstrap_means(losses: DataFrame, reps: int = 2000, block: int = 5, seed: int = 1) -> DataFrame:
    """(rep, model, mean_loss) over moving blocks of days with wrap-around.

    `losses` is (model, day, loss); days that a model lacks are left out for all.  The sum of a
    block is computed once per start day; a replication then adds up n/block
    sums instead of n losses.  Block starts follow an integer congruential
    rule, so a run can be repeated anywhere.
    """
    losses = common_days(losses)
    numbered = losses.withColumn("t", F.row_number().over(Window.partitionBy("model").orderBy("day")) - 1)
    n_days = losses.agg(F.count_distinct("day").cast("int")).scalar()
    spark = losses.sparkSession
    draws = (spark.range(reps).select(F.col("id").cast("int").alias("rep")).withColumn("n", n_days)
             .withColumn("n_blocks", F.ceil(F.col("n") / block).cast("int"))
             .select("rep", "n", "n_blocks", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("nth"))
             .withColumn("start", (mixed_integer(F.col("rep").cast("long") * F.col("n_blocks") + F.col("nth") + 1,
                                                 seed) % F.col("n")).cast("int")))
    offs = F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("off")
    tail = F.when(F.col("n") % block == 0, block).otherwise(F.col("n") % block)
    sums = (numbered.withColumn("n", n_days).select("model", "loss", "t", "n", offs)
            .withColumn("start", F.pmod(F.col("t") - F.col("off"), "n"))
            .groupBy("model", "start").agg(
                F.sum("loss").alias("whole"),
                F.sum(F.when(F.col("off") < tail, F.col("loss"))).alias("cut")))
    # the last block of a replication is shortened so that n days are drawn
    got = F.when(F.col("nth") < F.col("n_blocks") - 1, F.col("whole")).otherwise(F.col("cut"))
    return (draws.join(sums, "start").groupBy("rep", "model")
            .agg((F.sum(got) / F.first("n")).alias("mean_loss")))


def mcs(losses: DataFrame, reps: int = 2000, block: int = 5, seed: int = 1, level: float = 0.10) -> DataFrame:
    """(model, mcs_p, in_set): T-max elimination on the bootstrap means.

    The elimination sees a table of reps x models numbers, whatever the length
    of the series; p is the running maximum over the order of elimination.
    """
    means = common_days(losses).groupBy("model").agg(F.avg("loss").alias("mean_loss"))
    boot = bootstrap_means(losses, reps, block, seed).unionByName(
        means.select(F.lit(-1).alias("rep"), "model", "mean_loss"))

    def eliminate(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="rep", columns="model", values="mean_loss").sort_index()
        real, sim = wide.iloc[0].to_numpy(), wide.iloc[1:].to_numpy()
        left, done, p = list(range(wide.shape[1])), {}, 0.0
        while len(left) > 1:
            d = real[left] - real[left].mean()
            ds = sim[:, left] - sim[:, left].mean(axis=1, keepdims=True) - d
            sd = np.sqrt((ds ** 2).mean(axis=0))
            t = np.divide(d, sd, out=np.zeros_like(d), where=sd > 0)
            ts = np.divide(ds, sd, out=np.zeros_like(ds), where=sd > 0)
            p = max(p, float((ts.max(axis=1) >= t.max()).mean()))
            done[left.pop(int(t.argmax()))] = p
        done[left[0]] = 1.0
        return pd.DataFrame({"model": [wide.columns[k] for k in done], "mcs_p": list(done.values())})

    out = boot.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(eliminate, "model string, mcs_p double")
    return out.withColumn("in_set", F.col("mcs_p") >= level)
