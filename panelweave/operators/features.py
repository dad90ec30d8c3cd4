"""Features and targets: lags, exogenous series, assembly, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def index_days(panel: DataFrame) -> DataFrame:
    """Add t = 0, 1, ... of the panel's calendar, the same for all assets also where one misses a day."""
    # the only global window: one row per day
    days = panel.select("day").distinct().withColumn("t", F.row_number().over(Window.orderBy("day")) - 1)
    return panel.join(days, "day")


def trailing_means(panel: DataFrame, windows: dict[str, int], full: int) -> DataFrame:
    """Means of w over the preceding days, one column per window; rows with fewer
    than `full` preceding days are left out."""
    w = Window.partitionBy("asset").orderBy("day")
    cols = [F.avg("w").over(w.rowsBetween(-n, -1)).alias(name) for name, n in windows.items()]
    seen = F.count(F.lit(1)).over(w.rowsBetween(-full, -1)).alias("seen")
    return panel.select("day", "asset", *cols, seen).filter(F.col("seen") == full).drop("seen")


def lag_features(weights: DataFrame, p: int) -> DataFrame:
    """(t, day, lag, name, v) for lags 1..p of the calendar, long; days without p lags are dropped.

    The lag of a day the asset misses is null."""
    w = Window.partitionBy("asset").orderBy("t")

    def lagged(l):
        # of the last p rows, the one that is l days old
        back = [F.when(F.lag("t", k).over(w) == F.col("t") - l, F.lag("w", k).over(w)) for k in range(1, l + 1)]
        return F.struct(F.lit(l).alias("lag"), F.coalesce(*back).alias("v"))

    lags = F.array(*[lagged(l) for l in range(1, p + 1)])
    return (index_days(weights).select("t", "day", F.col("asset").alias("name"), lags.alias("lags"))
            .filter(F.col("t") >= p).select("t", "day", "name", F.inline("lags"))
            .select("t", "day", "lag", "name", "v"))


def join_exog(days: DataFrame, exog: DataFrame, lag: int = 1) -> DataFrame:
    """Last value of every series at or before `lag` calendar days before each day.

    As-of join by union and one window per series: observations are shifted by
    `lag` days, merged with the calendar and carried forward.
    """
    names = exog.agg(F.sort_array(F.collect_set("name"))).scalar()
    wanted = (days.select("day").distinct().withColumn("names", names)
              .select("day", F.explode("names").alias("name"),
                      F.lit(None).cast("double").alias("x"), F.lit(True).alias("asked")))
    known = exog.select(F.date_add("day", lag).alias("day"), "name", "x", F.lit(False).alias("asked"))
    w = (Window.partitionBy("name").orderBy("day", "asked")
         .rowsBetween(Window.unboundedPreceding, 0))
    return (wanted.unionByName(known)
            .withColumn("x", F.last("x", ignorenulls=True).over(w))
            .filter("asked").select("day", "name", "x"))


def exog_columns(joined: DataFrame, topology: DataFrame | None = None) -> DataFrame:
    """Model columns from the joined series: level and day-to-day change of each,
    plus any per-day network series (day, name, x)."""
    w = Window.partitionBy("name").orderBy("day")
    change = joined.select("day", F.concat(F.lit("d_"), "name").alias("name"),
                           F.coalesce(F.col("x") - F.lag("x").over(w), F.lit(0.0)).alias("x"))
    out = joined.select("day", "name", "x").unionByName(change)
    return out if topology is None else out.unionByName(topology.select("day", "name", "x"))


def feature_names(features: DataFrame, exog: DataFrame) -> DataFrame:
    """Fixed positions 1..p: lags first (by lag, then asset), exogenous columns last.

    The window runs over the distinct names, p rows in all."""
    lags = features.select(F.lit("lag").alias("kind"), "lag", "name").distinct()
    ex = exog.select(F.lit("exog").alias("kind"), F.lit(0).alias("lag"), "name").distinct()
    order = Window.orderBy((F.col("kind") == "exog"), "lag", "name")
    return lags.unionByName(ex).withColumn("pos", F.row_number().over(order))


def positioned(features: DataFrame, exog: DataFrame, names: DataFrame) -> DataFrame:
    """Long design (t, day, pos, v) with both feature kinds; null cells are dropped."""
    lags = features.select("t", "day", F.lit("lag").alias("kind"), "lag", "name", "v")
    days = features.select("t", "day").distinct()
    ex = exog.join(days, "day").select("t", "day", F.lit("exog").alias("kind"), F.lit(0).alias("lag"),
                                       "name", F.col("x").alias("v"))
    return (lags.unionByName(ex).join(names, ["kind", "lag", "name"])
            .select("t", "day", "pos", "v"))


def assemble(long: DataFrame, p: int | None = None) -> DataFrame:
    """One row per t with x ordered by position, and its one-step change dx.

    With `p` given, rows that lack a position or hold a null are left out."""
    w = Window.partitionBy("pos").orderBy("t")
    cells = long.withColumn("dv", F.col("v") - F.lag("v").over(w))
    packed = cells.groupBy("t", "day").agg(
        F.array_sort(F.collect_list(F.struct("pos", "v", "dv"))).alias("c"))
    out = packed.select("t", "day", F.col("c.v").alias("x"), F.col("c.dv").alias("dx"))
    if p is None:
        return out
    return out.filter((F.size("x") == p) & ~F.exists("x", lambda v: v.isNull()))


def align_targets(features: DataFrame, weights: DataFrame, p: int) -> DataFrame:
    """E5: (t, day, asset, y) for the days that have features; the first p days drop out."""
    days = features.select("t").distinct()
    return (index_days(weights).filter(F.col("t") >= p).join(days, "t", "left_semi")
            .select("t", "day", "asset", F.col("w").alias("y")))


def target_arrays(targets: DataFrame) -> DataFrame:
    """One row per t with y ordered by asset name."""
    packed = targets.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("asset", "y"))).alias("c"))
    return packed.select("t", F.col("c.y").alias("y"))


def make_sequences(features: DataFrame, targets: DataFrame, seq_len: int) -> DataFrame:
    """The seq_len feature rows ending at each target row, as array<array<double>>.

    Every row is sent to the seq_len targets that need it; a target's group is
    seq_len rows, so nothing depends on the length of the history.
    """
    sent = features.select(F.explode(F.sequence("t", F.col("t") + seq_len - 1)).alias("target"), "t", "x")
    seqs = (sent.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("c"))
            .filter(F.size("c") == seq_len)
            .select(F.col("target").alias("t"), F.col("c.x").alias("seq")))
    return seqs.join(targets, "t")


def pad_left(pred: DataFrame, pad: DataFrame, n: int) -> DataFrame:
    """The first n days of `pad` fill the days before the first forecast of `pred`.

    Both are (t, day, asset, w_hat); t counts the days of the test window."""
    head = pad.filter(F.col("t") < n).withColumn("padded", F.lit(True))
    body = pred.filter(F.col("t") >= n).withColumn("padded", F.lit(False))
    return head.unionByName(body)


def select_features(long: DataFrame, kept: DataFrame) -> DataFrame:
    """Keep the feature positions another model used; `kept` has column pos."""
    return long.join(kept.select("pos").distinct(), "pos", "left_semi")


def fit_scaler(long: DataFrame, floor: float = 1e-8) -> DataFrame:
    """Training mean and population sd per position, sd floored."""
    return long.groupBy("pos").agg(F.avg("v").alias("mean"),
                                   F.greatest(F.stddev_pop("v"), F.lit(floor)).alias("sd"))


def apply_scaler(long: DataFrame, scaler: DataFrame) -> DataFrame:
    return (long.join(scaler, "pos")
            .withColumn("v", (F.col("v") - F.col("mean")) / F.col("sd")).drop("mean", "sd"))
