"""Window helpers with the null-until-full rule.

All per-name windows share one ``partitionBy(symbol).orderBy(event_time)``, so
Catalyst plans a single Exchange and Sort for any number of them.  A symbol has
at most one row per session, hence a partition is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.sizing import small


def by(key: str | list[str] = "symbol", order: str | list = "event_time"):
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order] if isinstance(order, str) else list(order)
    return W.partitionBy(*keys).orderBy(*orders)


def rolling(
    agg: Callable[[Column], Column],
    value: Column,
    n: int,
    window=None,
    min_samples: int | None = None,
) -> Column:
    """``agg`` over the last ``n`` rows, null until enough non-null values."""
    frame = (window if window is not None else by()).rowsBetween(-(n - 1), 0)
    need = n if min_samples is None else min_samples
    return F.when(F.count(value).over(frame) >= need, agg(value).over(frame))


def running_sums(df: DataFrame, columns: dict[str, Column], window=None) -> DataFrame:
    """Attach prefix sums; one pass whatever the width of the later frame."""
    frame = (window if window is not None else by()).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns(
        {name: F.sum(F.coalesce(col, F.lit(0.0))).over(frame) for name, col in columns.items()}
    )


def trailing(name: str, n: int, window=None) -> Column:
    """Difference of a prefix sum over the last ``n`` rows."""
    w = window if window is not None else by()
    return F.col(name) - F.coalesce(F.lag(name, n).over(w), F.lit(0.0))


def compound(factor: Column, frame) -> Column:
    """Product over a frame; factors must be positive."""
    return F.exp(F.coalesce(F.sum(F.ln(factor)).over(frame), F.lit(0.0)))


def simple_return(k: int = 1, window=None, price: str = "close") -> Column:
    w = window if window is not None else by()
    return F.try_divide(F.col(price), F.lag(price, k).over(w)) - 1


def copied_to(rows: DataFrame, dates: DataFrame, column: str, start: str, until: str, bound: int | None = None) -> DataFrame:
    """``rows`` copied to each distinct date in ``[start, until)``, in ``column``; no ``until`` is for good.

    Dates are numbered along the calendar; a row looks up the numbers of its two
    ends by equality and is copied to those in between.  So there is neither a
    range join nor a list of dates on every row, however many dates are asked.
    ``bound`` is one on the times of either table: where it is small, rows meet the calendar where they lie.
    """
    calendar_rows = None if bound is None else 2 * bound
    asked = dates.select(column, F.col(column).cast("timestamp").alias("_at")).distinct()
    stamps = asked.select("_at", F.lit(1).alias("_is")).unionByName(
        rows.select(F.explode(F.array(F.col(start).cast("timestamp"), F.col(until).cast("timestamp"))).alias("_at"), F.lit(0).alias("_is"))
        .where("_at is not null")
        .distinct()
    )
    # one row per date of the calendar
    before = W.orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    calendar = stamps.groupBy("_at").agg(F.max("_is").alias("_is")).withColumn("_no", F.coalesce(F.sum("_is").over(before), F.lit(0)))
    numbers = small(calendar.where("_is = 1").join(asked, "_at").select("_no", column), bound)
    first = small(calendar.select(F.col("_at").alias("_first_at"), F.col("_no").alias("_first")), calendar_rows)
    last = small(calendar.select(F.col("_at").alias("_last_at"), F.col("_no").alias("_last")), calendar_rows)
    framed = rows.join(first, F.col(start).cast("timestamp") == F.col("_first_at")).join(
        last, F.col(until).cast("timestamp") == F.col("_last_at"), "left"
    )
    end = F.when(F.col(until).isNull(), asked.agg(F.count(F.lit(1))).scalar()).otherwise(F.col("_last"))
    held = F.when(end > F.col("_first"), F.sequence(F.col("_first"), end - 1)).otherwise(F.array().cast("array<bigint>"))
    return (
        framed.withColumn("_no", F.explode(held))
        .drop("_first_at", "_first", "_last_at", "_last")
        .join(numbers, "_no")
        .drop("_no")
    )
