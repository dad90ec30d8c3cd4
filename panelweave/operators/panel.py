"""Building dense panels from sparse cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def densify(cells: DataFrame, universe: DataFrame, fill, value: str = "value") -> DataFrame:
    """One row per (day, asset of the universe); absent cells take `fill`.

    `cells` holds at most one row per (day, asset), so a day's group is bounded
    by the number of assets whatever the size of the raw data.  The universe
    enters as a scalar subquery: no cross join, no second scan of the facts.
    """
    assets = universe.agg(F.sort_array(F.collect_set("asset"))).scalar()
    per_day = (cells.groupBy("day")
               .agg(F.map_from_entries(F.collect_list(F.struct("asset", value))).alias("by_asset"))
               .withColumn("assets", assets))
    fill = fill if isinstance(fill, Column) else F.lit(fill)
    cell = F.transform("assets", lambda a: F.struct(
        a.alias("asset"), F.coalesce(F.col("by_asset")[a], fill).alias(value)))
    return per_day.select("day", F.inline(cell))


def period_shares(dense: DataFrame) -> DataFrame:
    """Add w = value / total of the day, null on a day without value."""
    return dense.withColumn("w", F.try_divide("value", F.sum("value").over(Window.partitionBy("day"))))


def bar_returns(cells: DataFrame, universe: DataFrame, bars: Column) -> DataFrame:
    """Log-changes of ln(1 + value) between the bars of a day; the first bar has none.

    `bars` is an array expression over `day` listing the day's bars.  Work is
    done on one array per (day, asset); there is no window over raw rows.
    """
    by_bar = (cells.groupBy("day", "asset")
              .agg(F.map_from_entries(F.collect_list(F.struct("bar", "value"))).alias("m"))
              .withColumn("bars", bars))
    level = F.transform("bars", lambda b: F.log1p(F.coalesce(F.col("m")[b], F.lit(0.0))))
    change = F.transform(F.sequence(F.lit(1), F.size("l") - 1),
                         lambda k: F.col("l")[k] - F.col("l")[k - 1])
    arrays = by_bar.withColumn("l", level).select("day", "asset", change.alias("value"))
    zeros = F.array_repeat(F.lit(0.0), F.size(bars) - 1)
    return (densify(arrays, universe, zeros)
            .select("day", "asset", F.posexplode("value").alias("pos", "ret"))
            .select("day", F.element_at(bars, F.col("pos") + 2).alias("bar"), "asset", "ret"))


def spread(df: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """Hash rows by key over a fixed number of tasks, twice the session's cores by default.

    For groups that are small in bytes and heavy in arithmetic: adaptive
    execution would merge them by size into a few tasks and leave cores idle.
    The grouping that follows reuses this partitioning, so no shuffle is added.
    """
    tasks = tasks or 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks, *keys)
