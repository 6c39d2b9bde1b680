"""Medians of any window from mergeable quantile sketches, exact where a sketch can't decide.

One KLL sketch per name and month is kept; a window of months is a merge of sketches, so it reads
no bars.  A sketch places a value within ``margin(k)`` of its rank.  Names whose median is
farther from the threshold than that are decided by it, the few others by their bars.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch; up to so many values it holds all of them.
SKETCH_K = 1024
#: How many times the rank error at 99 % confidence a decision keeps away from the threshold.
SAFETY = 4.0


def margin(k: int = SKETCH_K) -> float:
    """Distance of ranks at which a sketch is believed.

    The published error of one rank at 99 % confidence is 2.296 / k ** 0.9723, some 2.6 standard
    deviations; four times that leaves odds of about 1e-24 a decision.
    """
    return SAFETY * 2.296 / k**0.9723


def traded_value() -> Column:
    """What the medians are of; not a number counts as greatest, as it does in Spark's order."""
    value = F.col("close") * F.col("volume")
    return F.when(F.isnan(value), F.lit(math.inf)).otherwise(value)


def month_of(time: str = "event_time") -> Column:
    return F.trunc(F.to_date(time), "month")


def monthly_sketches(panel: DataFrame, key: str = "symbol", k: int = SKETCH_K) -> DataFrame:
    """``(key, month, sketch, n)``: values are aggregated where they lie, sketches travel.  Nulls are no values."""
    if margin(k) >= 0.25:
        raise ValueError(f"sketches of size {k} decide too little")
    rows = panel.select(key, month_of().alias("month"), traded_value().alias("_v")).where("_v is not null")
    return rows.groupBy(key, "month").agg(F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch"), F.count("_v").alias("n"))


def _within(month: Column, since: str | None, until: str | None) -> Column:
    out = F.lit(True)
    if since is not None:
        out &= month >= F.trunc(F.lit(since).cast("date"), "month")
    if until is not None:
        out &= month <= F.trunc(F.lit(until).cast("date"), "month")
    return out


def merged(sketches: DataFrame, since: str | None = None, until: str | None = None, key: str = "symbol") -> DataFrame:
    """One sketch per name over whole months from ``since`` to ``until``, both included."""
    months = sketches.where(_within(F.col("month"), since, until))
    return months.groupBy(key).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))


def exact_medians(panel: DataFrame, names: DataFrame, since: str | None, until: str | None, key: str = "symbol") -> DataFrame:
    """Medians of ``names`` from their bars."""
    bars = panel.where(_within(month_of(), since, until)).join(names.select(key), key, "left_semi")
    return bars.groupBy(key).agg(F.median(traded_value()).alias("median_value")).where("median_value is not null")


def liquid_names(
    sketches: DataFrame, panel: DataFrame, min_adv: float, since: str | None = None, until: str | None = None,
    key: str = "symbol", k: int = SKETCH_K,
) -> DataFrame:
    """Names whose median traded value over whole months reaches ``min_adv``.

    ``decided`` tells whether the sketch decided (``sketch``) or the bars did (``bars``).  A name
    without values is none.
    """
    below = F.kll_sketch_get_rank_double("sketch", F.lit(math.nextafter(min_adv, -math.inf)))  # share of lesser values
    placed = merged(sketches, since, until, key).select(key, below.alias("_below"))
    sure = placed.where(F.col("_below") < 0.5 - margin(k)).select(key, F.lit("sketch").alias("decided"))
    unsure = placed.where(F.abs(F.col("_below") - 0.5) <= margin(k))
    exact = exact_medians(panel, unsure, since, until, key).where(F.col("median_value") >= min_adv)
    return sure.unionByName(exact.select(key, F.lit("bars").alias("decided")))


def most_liquid(
    sketches: DataFrame, panel: DataFrame, top: int, since: str | None = None, until: str | None = None,
    key: str = "symbol", k: int = SKETCH_K,
) -> DataFrame:
    """The ``top`` names by median traded value, with exact medians, ties by name.

    Sketches give every name a lower and an upper bound; bars are read only for names whose
    upper bound reaches the lower bound at place ``top``.
    """
    few = F.col("n") < 2 / margin(k)  # the two middle values of a few are farther apart in rank

    def at(rank: float) -> Column:
        return F.kll_sketch_get_quantile_double("sketch", F.lit(rank))

    bounds = merged(sketches, since, until, key).select(
        key, F.when(few, at(0.0)).otherwise(at(0.5 - margin(k))).alias("_low"), F.when(few, at(1.0)).otherwise(at(0.5 + margin(k))).alias("_high")
    )
    least = bounds.orderBy(F.desc("_low")).limit(top).agg(F.min("_low")).scalar()
    exact = exact_medians(panel, bounds.where(F.col("_high") >= least), since, until, key)
    return exact.orderBy(F.desc("median_value"), key).limit(top)
