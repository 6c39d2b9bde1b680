"""Checked size bounds.

An operator that would hold a whole group in one task, or broadcast a side,
first needs a bound on it.  Bounds come from Parquet footers (``count()`` with
no columns reads nothing else) or, where a table has more rows than a task may
hold, from counting its groups over the key columns alone.  With no bound, or
one that is too large, the operator takes the route that splits the group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one group a single task may sort without concern.
TASK_ROWS = 5_000_000
#: Bytes of a broadcast side, before the driver and every executor hold it.
BROADCAST_BYTES = 64 * 1024 * 1024

_counts: dict[tuple, int] = {}


def counted(spark: SparkSession, path: str, what: str, count: Callable[[], int]) -> int:
    """A count over a Parquet path, remembered under ``what`` while its files are the same."""
    files = spark.read.schema("_ int").parquet(path).inputFiles()  # a listing, nothing is read
    key = (spark.sparkContext.applicationId, path, hash(frozenset(files)), what)
    if key not in _counts:
        _counts[key] = count()
    return _counts[key]


def footer_rows(spark: SparkSession, path: str) -> int:
    """Row count of a Parquet path from its footers."""
    return counted(spark, path, "rows", lambda: spark.read.parquet(path).count())


def fits_task(rows: int | None) -> bool:
    return rows is not None and rows <= TASK_ROWS


def small(df: DataFrame, rows: int | None, row_bytes: int = 64) -> DataFrame:
    """Hint a broadcast when ``rows`` proves it small, else leave it to AQE."""
    if rows is not None and rows * row_bytes <= BROADCAST_BYTES:
        return F.broadcast(df)
    return df


def within(name: str, value: float, low: float | None = None, high: float | None = None) -> None:
    """Refuse a parameter outside ``[low, high]``."""
    if (low is not None and value < low) or (high is not None and value > high):
        raise ValueError(f"{name} is {value}, outside [{low}, {high}]")
