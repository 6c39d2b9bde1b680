"""Corporate actions: validation, interval joins, back-adjustment, inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.windows import by, compound, simple_return

SUSPECT_MOVE = 0.35
RATIO_TOLERANCE = 0.02
#: Price multipliers a split or bonus takes on its ex-date (fixed values).
COMMON_RATIOS = (0.1, 0.125, 0.2, 0.25, 1 / 3, 0.4, 0.5, 2 / 3, 1.5, 2.0, 3.0, 5.0, 10.0)
SHARE_ACTIONS = ("SPLIT", "BONUS")
PRICES = ("open", "high", "low", "close")


def multipliers(actions: DataFrame) -> DataFrame:
    """Quantity and price multipliers; only splits and bonuses have any."""
    shares = F.col("action_type").isin(*SHARE_ACTIONS)
    return actions.withColumns(
        {
            "quantity_multiplier": F.when(shares, F.col("ratio")).otherwise(F.lit(1.0)),
            "price_multiplier": F.when(shares, 1 / F.col("ratio")).otherwise(F.lit(1.0)),
        }
    )


def validate_actions(actions: DataFrame) -> DataFrame:
    """Name the rule an action breaks; null when it is sound."""
    return actions.withColumn(
        "violation",
        F.when(F.col("announcement_date") > F.col("ex_date"), "announced_after_ex_date")
        .when(F.col("action_type").isin(*SHARE_ACTIONS) & (F.col("ratio") == 1), "ratio_without_effect")
        .when((F.col("action_type") == "DIVIDEND") & (F.col("cash_per_share") <= 0), "dividend_without_cash"),
    )


def vendor_actions(rows: DataFrame) -> DataFrame:
    """Vendor rows carry a split ratio and a dividend; emit the ones present."""
    both = F.array(
        F.struct(
            F.lit("SPLIT").alias("action_type"),
            F.col("split_ratio").alias("ratio"),
            F.lit(0.0).alias("cash_per_share"),
        ),
        F.struct(
            F.lit("DIVIDEND").alias("action_type"),
            F.lit(1.0).alias("ratio"),
            F.col("dividend").alias("cash_per_share"),
        ),
    )
    plausible = F.col("a.ratio").between(0.01, 100.0) & (F.col("a.ratio") != 1.0)
    split = (F.col("a.action_type") == "SPLIT") & plausible
    cash = (F.col("a.action_type") == "DIVIDEND") & (F.col("a.cash_per_share") > 0)
    return (
        rows.select("instrument_id", "ex_date", F.explode(both).alias("a"))
        .where(split | cash)
        .select("instrument_id", "ex_date", "a.action_type", "a.ratio", "a.cash_per_share")
    )


def uncovered(names: DataFrame, actions: DataFrame) -> DataFrame:
    """Names without any recorded action."""
    return names.select("instrument_id").distinct().join(actions, "instrument_id", "left_anti")


def known_at(actions: DataFrame, as_of: str | Column) -> DataFrame:
    """Actions that were public: announced, or without a date gone ex."""
    at = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")
    return actions.where(F.coalesce("announcement_date", "ex_date") <= at)


def quantity_factors(intervals: DataFrame, actions: DataFrame) -> DataFrame:
    """Share-count factor of every ``(start, end]`` interval of an instrument."""
    m = multipliers(actions).select("instrument_id", "ex_date", "quantity_multiplier")
    inside = (F.col("start") < F.col("ex_date")) & (F.col("ex_date") <= F.col("end"))
    joined = intervals.join(
        m.withColumnRenamed("instrument_id", "_id"),
        (F.col("instrument_id") == F.col("_id")) & inside,
        "left",
    )
    return joined.groupBy("instrument_id", "start", "end").agg(
        F.count("ex_date").alias("actions"),
        F.exp(F.coalesce(F.sum(F.ln("quantity_multiplier")), F.lit(0.0))).alias("factor"),
    )


def back_adjust(bars: DataFrame, actions: DataFrame, key: str = "instrument_id") -> DataFrame:
    """Scale bars before each ex-date; for display only, it knows the future.

    Actions per name are few, so each name carries its own as one short array
    and a bar folds the ones that come later: no bar-by-action rows.
    """
    m = multipliers(actions).where(F.col("price_multiplier") != 1.0)
    per_name = m.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("ex_date", "price_multiplier"))).alias("_actions")
    )
    later = F.filter("_actions", lambda a: F.col("event_time") < a["ex_date"].cast("timestamp"))
    factor = F.coalesce(
        F.aggregate(later, F.lit(1.0), lambda acc, a: acc * a["price_multiplier"]), F.lit(1.0)
    )
    joined = bars.join(per_name, key, "left").withColumn("_f", factor)
    updates = {c: F.col(c) * F.col("_f") for c in PRICES if c in bars.columns}
    updates["volume"] = F.col("volume") / F.col("_f")
    return joined.withColumns(updates).drop("_actions", "_f")


def matched_ratio(step: Column) -> Column:
    """First common ratio within tolerance of a suspect price step, else 1."""
    hit = F.coalesce(
        *[F.when(F.abs(step - r) / r <= RATIO_TOLERANCE, F.lit(r)) for r in COMMON_RATIOS], F.lit(1.0)
    )
    return F.when((step > 0) & (F.abs(step - 1.0) > SUSPECT_MOVE), hit).otherwise(F.lit(1.0))


def inferred_split_factors(panel: DataFrame) -> DataFrame:
    """Attach ``split_factor``: the product of the splits after each row."""
    step = F.try_divide(F.col("close"), F.lag("close").over(by()))
    after = by().rowsBetween(1, W.unboundedFollowing)
    return (
        panel.withColumn("_step", step)
        .withColumn("_f", matched_ratio(F.col("_step")))
        .withColumn("split_factor", compound(F.col("_f"), after))
        .drop("_step", "_f")
    )


def adjust_inferred_splits(panel: DataFrame) -> DataFrame:
    """Prices continuous across inferred splits; traded value is unchanged."""
    framed = inferred_split_factors(panel)
    updates = {c: F.col(c) * F.col("split_factor") for c in PRICES if c in panel.columns}
    if "volume" in panel.columns:
        updates["volume"] = F.col("volume") / F.col("split_factor")
    return framed.withColumns(updates).drop("split_factor")


def unexplained_jumps(bars: DataFrame, actions: DataFrame, threshold: float = SUSPECT_MOVE) -> DataFrame:
    """Moves beyond the threshold on dates without a recorded action."""
    moves = (
        bars.withColumn("move", simple_return(window=by("instrument_id")))
        .where(F.abs("move") > threshold)
        .select("instrument_id", F.to_date("event_time").alias("ex_date"), "move")
    )
    return moves.join(actions.select("instrument_id", "ex_date"), ["instrument_id", "ex_date"], "left_anti")


def display_series(panel: DataFrame, actions: DataFrame, symbols: list[str] | None = None) -> DataFrame:
    """Back-adjusted bars keyed by symbol, which may span several instruments."""
    bars = panel if symbols is None else panel.where(F.col("symbol").isin(symbols))
    return back_adjust(bars, actions, key="symbol")
