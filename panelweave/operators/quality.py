"""Checks on incoming panels, day selection and time splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def check_days(panel: DataFrame, step: str = "1 day") -> DataFrame:
    """B1: calendar days between the first and the last day that the panel lacks.

    The calendar is unfolded from two scalars, so only the distinct days of
    the panel are shuffled for the anti join."""
    have = panel.select("day").distinct()
    span = panel.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    calendar = span.select(F.explode(F.expr(f"sequence(first, last, interval {step})")).alias("day"))
    return calendar.join(have, "day", "left_anti")


def day_count(panel: DataFrame, expected: int) -> DataFrame:
    """B1: number of days against the expected number."""
    return panel.agg(F.count_distinct("day").alias("n_days")).select(
        "n_days", F.lit(expected).cast("long").alias("expected"),
        (F.lit(expected) - F.col("n_days")).alias("missing"))


def check_shape(returns: DataFrame, k: int, m: int | Column) -> DataFrame:
    """B2: assets, bars and rows of each day against the expected K x M.

    Cells are grouped first, so a doubled cell cannot stand in for a missing one."""
    m = m if isinstance(m, Column) else F.lit(m)
    cells = returns.groupBy("day", "asset", "bar").agg(F.count(F.lit(1)).alias("rows"))
    counts = cells.groupBy("day").agg(F.count_distinct("asset").alias("n_assets"),
                                      F.count_distinct("bar").alias("n_bars"), F.sum("rows").alias("n_cells"),
                                      F.count(F.lit(1)).alias("n_filled"))
    return counts.withColumn("ok", (F.col("n_assets") == k) & (F.col("n_bars") == m)
                             & (F.col("n_filled") == F.col("n_assets") * F.col("n_bars"))
                             & (F.col("n_cells") == F.col("n_filled"))).drop("n_filled")


def check_missing(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Nulls, NaNs and infinities of one column."""
    c = F.col(column)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c.isNull()).alias("n_null"),
        F.count_if(F.isnan(c)).alias("n_nan"),
        F.count_if(F.abs(c) == F.lit(float("inf"))).alias("n_inf"))


def check_range(df: DataFrame, column: str, limit: float, *keys: str) -> DataFrame:
    """Extremes and the number of cells beyond +-limit."""
    c = F.col(column)
    return df.groupBy(*keys).agg(F.min(c).alias("lowest"), F.max(c).alias("highest"),
                                 F.count_if(F.abs(c) > limit).alias("n_outside"))


def check_types(df: DataFrame, expected: T.StructType) -> None:
    """Raise, before any job runs, unless the columns have the expected types."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f"{f.name}: {actual.get(f.name)} instead of {f.dataType}"
             for f in expected.fields if actual.get(f.name) != f.dataType]
    if wrong:
        raise TypeError("; ".join(wrong))


def type_report(df: DataFrame, expected: T.StructType) -> DataFrame:
    """B5 as a table: one row per expected column, next to the number of values it holds."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    counts = df.agg(*[F.count(f.name).alias(f.name) for f in expected.fields if f.name in actual])
    long = counts.unpivot([], counts.columns, "column", "n_values")
    want = F.create_map(*[F.lit(x) for f in expected.fields for x in (f.name, f.dataType.simpleString())])
    have = F.create_map(*[F.lit(x) for kv in actual.items() for x in kv])
    return long.select("column", have[F.col("column")].alias("type"),
                       (have[F.col("column")] == want[F.col("column")]).alias("ok"), "n_values")


def day_index(days: DataFrame) -> DataFrame:
    """Number distinct days 0, 1, ...; the window runs over the calendar only
    (a few thousand rows however large the panel)."""
    return days.select("day").distinct().withColumn("t", F.row_number().over(Window.orderBy("day")) - 1)


def valid_days(weights: DataFrame, solved: DataFrame, p: int, window: int) -> DataFrame:
    """Solved days with at least max(p, window) solved days before them, renumbered."""
    ok = weights.select("day").distinct().join(solved.select("day").distinct(), "day", "left_semi")
    history = max(p, window)
    return (day_index(ok).filter(F.col("t") >= history)
            .select("day", (F.col("t") - history).alias("t")))


def sample_days(df: DataFrame, n: int, seed: int) -> DataFrame:
    """N days in md5 order of (day, seed); the same days on every run and engine."""
    key = F.md5(F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(f":{seed}")))
    return df.select("day").distinct().orderBy(key).limit(n)


def split_time(days: DataFrame, train: float = 0.70, valid: float = 0.85) -> DataFrame:
    """Chronological split by share of the days."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    t = F.col("t")
    return day_index(days).select(
        "day", "t", F.when(t < F.floor(n * train), "train")
        .when(t < F.floor(n * valid), "validation").otherwise("test").alias("part"))


def expanding_folds(days: DataFrame, cuts: list[int], horizon: int) -> DataFrame:
    """(fold, part, t, day); fold f trains on t < cut and validates on the next `horizon` days.

    Each day is expanded into the folds it takes part in; there is no theta join."""
    folds = F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(c).alias("cut")) for f, c in enumerate(cuts)])
    part = F.when(F.col("t") < F.col("cut"), "train").when(F.col("t") < F.col("cut") + horizon, "validation")
    return (day_index(days).select("day", "t", F.inline(folds)).withColumn("part", part)
            .filter(F.col("part").isNotNull()).select("fold", "part", "t", "day"))


def fixed_window(days: DataFrame, train: int = 44, valid: int = 5, test: int = 22) -> DataFrame:
    """The first train + valid + test days, labelled."""
    t = F.col("t")
    part = (F.when(t < train, "train").when(t < train + valid, "validation")
            .when(t < train + valid + test, "test"))
    return day_index(days).withColumn("part", part).filter(F.col("part").isNotNull()).select("day", "t", "part")


def eval_window(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows between two dates, both included; reaches the scan as a pushed filter."""
    return df.filter(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
