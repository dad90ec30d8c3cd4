"""Readers and writers: daily return files, macro series, stores for every stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed value: how a daily file carries its date
DAY_IN_NAME = r"(\d{4})[ _-](\d{2})[ _-](\d{2})_1min_log_return"

EXOG = T.StructType([T.StructField("day", T.DateType()), T.StructField("x", T.DoubleType())])

#: fixed values: the entries of a parameter set
PARAMS = T.StructType(
    [T.StructField("P_LAGS", T.IntegerType()), T.StructField("A_BAR_ROLLING_WINDOW", T.IntegerType())]
    + [T.StructField(n, T.DoubleType()) for n in (
        "LAMBDA_LASSO_M2", "LAMBDA_LASSO_M3", "LAMBDA_LASSO_M3a", "LAMBDA_LASSO_M4", "LAMBDA_EXOG",
        "LAMBDA_NETWORK", "NETWORK_THRESHOLD")]
    + [T.StructField("USE_LAST_DAY", T.BooleanType()), T.StructField("LAMBDA_TURNOVER", T.DoubleType()),
       T.StructField("m4_selected_reason", T.StringType()), T.StructField("m5_selected_reason", T.StringType())]
    + [T.StructField(n, T.MapType(T.StringType(), T.DoubleType())) for n in (
        "mean_val_mse", "mean_turnover_econ", "mean_sparsity", "mean_n_alive")]
    + [T.StructField("mean_network_density", T.DoubleType())])


def read_returns(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A1: daily files -> (day, bar, asset, ret); the day comes from the path of the file.

    'csv': one line per asset, its name and then one return per bar (days may
    differ in length). 'parquet': rows (bar, asset, ret).  What cannot be read stays as
    a null for the checks (B2, B3) and the failed days (A8): the day of a file without
    a date in its name, a malformed return, and bar and return of a line that is a name only.  A file is a whole day,
    so a filter on day becomes a filter on files once the cache (A2) is written.
    """
    place = F.url_decode(F.col("_metadata.file_path"))
    part = [F.regexp_extract(place, DAY_IN_NAME, k) for k in (1, 2, 3)]
    day = F.try_to_timestamp(F.concat_ws("-", *part)).cast("date").alias("day")
    if fmt == "parquet":
        return spark.read.schema("bar int, asset string, ret double").option("recursiveFileLookup", "true").parquet(
            path).select(day, "bar", "asset", "ret")
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    cells = lines.select(day, F.split("value", ",").alias("c")).filter(F.trim(F.col("c")[0]) != "")
    return cells.select("day", F.col("c")[0].alias("asset"),
                        F.posexplode_outer(F.slice("c", 2, F.size("c") - 1)).alias("bar", "ret")).select(
        "day", "bar", "asset", F.col("ret").try_cast("double").alias("ret"))


def cache_returns(returns: DataFrame, path: str, bar_block: int = 4096) -> None:
    """A2: columnar cache, arrays of up to `bar_block` returns per (day, asset), partitioned by year.

    Blocks keep every array, and so every group, small however long a day is;
    the rebalance splits large years over tasks and merges small ones."""
    cells = F.array_sort(F.collect_list(F.struct("bar", "ret")))
    (returns.groupBy("day", "asset", F.floor(F.col("bar") / bar_block).alias("block")).agg(cells.alias("c"))
     .select(F.year("day").alias("year"), "day", "asset", F.col("c.bar").alias("bars"), F.col("c.ret").alias("r"))
     .hint("rebalance", "year").write.partitionBy("year").parquet(path))


def read_cached_returns(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """A2: back to (day, bar, asset, ret); a date range prunes whole years and skips row groups."""
    df = spark.read.parquet(path)
    if start:
        df = df.filter((F.col("year") >= int(start[:4])) & (F.col("day") >= F.lit(start).cast("date")))
    if end:
        df = df.filter((F.col("year") <= int(end[:4])) & (F.col("day") <= F.lit(end).cast("date")))
    return df.select("day", "asset", F.inline(F.arrays_zip("bars", "r"))).select(
        "day", F.col("bars").alias("bar"), "asset", F.col("r").alias("ret"))


def read_exog(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """A3: one CSV (day, x) per macro series -> (day, name, x)."""
    parts = [spark.read.schema(EXOG).option("header", True).csv(p).select("day", F.lit(n).alias("name"), "x")
             for n, p in sorted(paths.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def to_wide(weights: DataFrame, assets: Sequence[str]) -> DataFrame:
    """A4: one column per asset."""
    return weights.groupBy("day").pivot("asset", list(assets)).agg(F.first("w"))


def to_long(wide: DataFrame) -> DataFrame:
    """A4: (day, asset, w); empty cells stay out."""
    assets = [c for c in wide.columns if c != "day"]
    return wide.unpivot("day", assets, "asset", "w").filter(F.col("w").isNotNull())


def write_edges(edges: DataFrame, path: str) -> None:
    """A5: network store, partitioned by month; days sorted inside so that a day filter skips row groups."""
    (edges.withColumn("month", F.date_format("day", "yyyy-MM"))
     .hint("rebalance", "month").sortWithinPartitions("month", "day").write.partitionBy("month").parquet(path))


def read_edges(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    df = spark.read.schema("day date, i string, j string, month string").parquet(path)
    if day:
        df = df.filter((F.col("month") == day[:7]) & (F.col("day") == F.lit(day).cast("date")))
    return df.drop("month")


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """The parameter set, one row."""
    return spark.read.schema(PARAMS).option("multiLine", True).json(path)


def write_params(params: DataFrame, path: str) -> None:
    params.coalesce(1).write.json(path)


def params_long(params: DataFrame) -> DataFrame:
    """The nested maps as rows (metric, model, value)."""
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))

    def rows_of(name):
        return F.transform(F.map_entries(F.coalesce(name, nothing)), lambda e: F.struct(
            F.lit(name).alias("metric"), e["key"].alias("model"), e["value"].alias("value")))

    maps = [f.name for f in params.schema.fields if isinstance(f.dataType, T.MapType)]
    return params.select(F.inline(F.concat(*[rows_of(m) for m in maps])))


def write_table(df: DataFrame, path: str) -> None:
    """A result table (a handful of rows) as one CSV file with a header."""
    df.coalesce(1).write.option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def split_failed(status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(solved days, failed days)."""
    return status.filter("status = 'ok'"), status.filter("status != 'ok' or status is null")


def write_predictions(pred: DataFrame, path: str) -> None:
    """Prediction store, one partition per model.

    The rebalance splits a model that is larger than the others over several tasks."""
    (pred.hint("rebalance", "model").sortWithinPartitions("model", "day")
     .write.partitionBy("model").parquet(path))


def read_predictions(spark: SparkSession, path: str, models: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.schema("day date, asset string, w_hat double, model string").parquet(path)
    return df.filter(F.col("model").isin(list(models))) if models else df


def write_model(coefs: DataFrame, scalers: DataFrame, names: DataFrame, path: str) -> None:
    """A10: coefficients, scalers and column list of the fitted models."""
    coefs.write.partitionBy("model").parquet(f"{path}/coefs")
    scalers.write.parquet(f"{path}/scalers")
    names.write.parquet(f"{path}/feature_names")


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{n}") for n in ("coefs", "scalers", "feature_names"))


def publish_lambda(chosen: DataFrame, path: str) -> None:
    """The chosen penalty, one row of JSON."""
    chosen.coalesce(1).write.json(path)


def read_lambda(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("lambda double, score double").json(path)
