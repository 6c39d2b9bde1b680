"""Interval, as-of and alignment joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.stats import finite
from tickloom.functions.windows import by, simple_return
from tickloom.sizing import small


def resolve_symbols(requests: DataFrame, aliases: DataFrame, alias_rows: int | None = None) -> DataFrame:
    """Instrument of ``(symbol, exchange, as_of)``; null where no alias covers it.

    Equality on the folded symbol does the work, the validity interval filters.
    """
    a = aliases.select(
        F.upper("symbol").alias("_sym"), F.col("exchange").alias("_exch"), "instrument_id", "valid_from", "valid_to"
    )
    covers = (F.col("valid_from") <= F.col("as_of")) & (
        F.col("valid_to").isNull() | (F.col("as_of") < F.col("valid_to"))
    )
    same = (F.upper("symbol") == F.col("_sym")) & (F.col("exchange") == F.col("_exch"))
    return requests.join(small(a, alias_rows, 96), same & covers, "left").drop("_sym", "_exch", "valid_from", "valid_to")


def symbols_of(aliases: DataFrame, moment: str | Column) -> DataFrame:
    """Every symbol an instrument carries at a moment, sorted."""
    at = moment if isinstance(moment, Column) else F.lit(moment).cast("timestamp")
    live = (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))
    # aliases of one instrument at one moment: a handful
    return aliases.where(live).groupBy("instrument_id").agg(F.sort_array(F.collect_set("symbol")).alias("symbols"))


def asof_latest(
    left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str
) -> DataFrame:
    """Latest right row at or before each left time, whatever its value.

    ``left`` has unique ``(key, time)``; both sides are bounded by the calendar,
    and one sort of their union replaces a range join.
    """
    marks = left.select(key, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_v"))
    facts = right.select(key, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(value).cast("double").alias("_v"))
    # a fact at the decision time counts, so facts sort first
    order = W.partitionBy(key).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_side") == 0, F.struct("_v", "_t")), ignorenulls=True).over(order)
    return (
        marks.unionByName(facts)
        .withColumn("_seen", seen)
        .where(F.col("_side") == 1)
        .select(key, F.col("_t").alias(left_time), F.col("_seen._v").alias(value), F.col("_seen._t").alias("value_time"))
    )


def scores_at(decisions: DataFrame, scores: DataFrame, key: str = "symbol") -> DataFrame:
    """Score each decision sees: the latest one, dropped when not finite."""
    seen = asof_latest(decisions, scores, key, "decision_time", "event_time", "signal")
    return seen.where(finite(F.col("signal")))


def aligned_returns(panel: DataFrame, names: DataFrame, count: int) -> DataFrame:
    """Returns over the sessions on which all ``count`` names traded.

    Returns are taken between aligned sessions, not calendar ones.
    """
    listed = names.select("symbol").distinct()
    if listed.limit(count + 1).count() > count:
        raise ValueError(f"more than {count} names chosen")
    chosen = panel.join(F.broadcast(listed), "symbol", "left_semi")
    complete = chosen.groupBy("event_time").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == count)
    aligned = chosen.join(complete.select("event_time"), "event_time", "left_semi")
    return (
        aligned.withColumn("ret", simple_return(window=by()))
        .where(F.col("ret").isNotNull())
        .select("event_time", "symbol", "ret")
    )
