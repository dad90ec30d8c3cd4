"""Column and session helpers shared by the text operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: blank and the five control characters from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def text_or_empty(column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """The runs of characters that are not white space, in order; an empty array where there is none."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def small_batches(spark: SparkSession, rows: int = 512, mb: int = 8) -> None:
    """Hand Python tasks few rows and few bytes at a time, since one text may be very long.

    Smaller settings of the session are kept.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, f"{64 << 20}b").rstrip("b")
    if not now.isdigit() or int(now) > mb << 20:
        spark.conf.set(key, f"{mb << 20}b")


def byte_slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20):
    """Consecutive parts of a batch whose texts, bytes or lists in a column hold at most so many bytes, or one row."""
    values = batch.column(column)
    if pa.types.is_list(values.type):
        size = pc.list_value_length(values)
    else:
        size = pc.binary_length(values)
    ends = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype("i8"))
    first = 0
    while first < batch.num_rows:
        base = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, base + most, "right")), first + 1)
        yield batch.slice(first, last - first)
        first = last
