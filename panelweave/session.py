"""Session settings the package is written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that hold on a laptop and on a cluster alike.  Parallelism comes
#: from the data (AQE splits and merges partitions); every Python kernel is one
#: BLAS thread per task so that tasks, not BLAS, use the cores.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
}


def local_session(cpus: int | str = 8, app: str = "panelweave", **extra) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    local = {
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**SETTINGS, **local, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
