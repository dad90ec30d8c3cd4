"""Registered queries and the SQL they are checked against, one module per family."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FAMILIES = ["flagship", "files", "quality", "covariance", "portfolio", "features", "models",
            "evaluation", "reports"]

Query = Callable[[SparkSession, str], DataFrame]


def _modules():
    for name in FAMILIES:
        yield importlib.import_module(f"{__name__}.{name}")


def all_queries() -> dict[str, Query]:
    return {key: fn for m in _modules() for key, fn in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {key: sql for m in _modules() for key, sql in m.ORACLES.items()}
