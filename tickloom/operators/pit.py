"""Point-in-time reads, session windows and panel filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.windows import by
from tickloom.schemas import acausal, bad_ohlc

#: Marker of listed companies inside an instrument id.
COMPANY_MARKER = ":INE"
#: Bars below which no study of a name means anything.
MIN_BARS = 273
MIN_ADV = 1e7


def observable(df: DataFrame, as_of: str | Column) -> DataFrame:
    """Rows whose receive time is not after ``as_of``."""
    moment = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    return df.where(F.col("receive_time") <= moment)


def observability_audit(df: DataFrame, decision: str = "decision_time") -> DataFrame:
    """How many rows a decision could not have seen, and by how far."""
    ahead = F.unix_seconds("receive_time") - F.unix_seconds(decision)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(ahead > 0).alias("violations"),
        F.coalesce(F.max(F.when(ahead > 0, ahead)), F.lit(0)).alias("max_ahead_seconds"),
    )


def last_sessions(df: DataFrame, n: int, time: str = "event_time") -> DataFrame:
    """The latest ``n`` distinct sessions."""
    return df.select(time).distinct().orderBy(F.desc(time)).limit(n)


def trailing_sessions(df: DataFrame, n: int, time: str = "event_time") -> DataFrame:
    """Rows of the latest ``n`` distinct sessions; the broadcast side has ``n`` rows."""
    return df.join(F.broadcast(last_sessions(df, n, time)), time, "left_semi")


def liquid_names(panel: DataFrame, min_adv: float, key: str = "symbol") -> DataFrame:
    """Rows of names whose median traded value reaches ``min_adv``."""
    keep = (
        panel.groupBy(key)
        .agg(F.median(F.col("close") * F.col("volume")).alias("_adv"))
        .where(F.col("_adv") >= min_adv)
        .select(key)
    )
    return panel.join(keep, key, "left_semi")


def long_enough(panel: DataFrame, bars: int = MIN_BARS, key: str = "symbol") -> DataFrame:
    keep = panel.groupBy(key).count().where(F.col("count") >= bars).select(key)
    return panel.join(keep, key, "left_semi")


def prepare_panel(
    panel: DataFrame,
    window: int = 0,
    min_adv: float = MIN_ADV,
    min_bars: int = MIN_BARS,
    marker: str | None = COMPANY_MARKER,
    adjust_splits: bool = True,
) -> DataFrame:
    """Windowed, split-adjusted panel of liquid names with enough history.

    The name filters are partition-wide windows over ``symbol``: the factor
    windows that follow need that partitioning anyway, so all of it shares one
    Exchange.  A symbol holds at most one row per session.
    """
    from tickloom.operators.corpactions import adjust_inferred_splits

    df = trailing_sessions(panel, window) if window > 0 else panel
    if adjust_splits:
        df = adjust_inferred_splits(df)
    if marker:
        df = df.where(F.col("instrument_id").contains(marker))
    name = W.partitionBy("symbol")
    checks = {"_bars": F.count(F.lit(1)).over(name)}
    if min_adv > 0:
        checks["_adv"] = F.median(F.col("close") * F.col("volume")).over(name)
    df = df.withColumns(checks).where(F.col("_bars") >= min_bars)
    if min_adv > 0:
        df = df.where(F.col("_adv") >= min_adv)
    return df.drop("_bars", "_adv")


def latest_close(panel: DataFrame, key: str = "instrument_id") -> DataFrame:
    """Latest close and symbol of each instrument, in one pass."""
    last = F.max_by(F.struct("close", "symbol"), "event_time")
    return panel.groupBy(key).agg(last.alias("_last"), F.max("event_time").alias("event_time")).select(
        key, F.col("_last.close").alias("close"), F.col("_last.symbol").alias("symbol"), "event_time"
    )


def series(panel: DataFrame, instrument_id: str) -> DataFrame:
    return panel.where(F.col("instrument_id") == instrument_id).orderBy("event_time")


def bar_count(panel: DataFrame) -> DataFrame:
    return panel.agg(F.countDistinct("event_time").alias("bars"))


def wide_closes(panel: DataFrame, names: list[str], key: str = "symbol") -> DataFrame:
    """Close matrix of the named columns, one row per session."""
    return panel.where(F.col(key).isin(names)).groupBy("event_time").pivot(key, names).agg(F.first("close"))


def search(panel: DataFrame, prefix: str, sessions: int = 60, limit: int = 60) -> DataFrame:
    """Symbols with a prefix, the most liquid of the last sessions first."""
    hit = F.col("symbol").startswith(prefix.strip().upper())
    return (
        trailing_sessions(panel, sessions)
        .where(hit)
        .groupBy("symbol")
        .agg(
            F.median(F.col("close") * F.col("volume")).alias("traded_value"),
            F.count(F.lit(1)).alias("bars"),
        )
        .orderBy(F.desc("traded_value"), "symbol")
        .limit(limit)
    )


def suggestions(panel: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """Near misses of a name: prefix matches, or where none exist substrings."""
    wanted = text.strip().upper()
    names = panel.select("symbol").distinct()
    ranked = names.withColumn(
        "priority",
        F.when(F.col("symbol").startswith(wanted), 1).when(F.col("symbol").contains(wanted), 2),
    ).where(F.col("priority").isNotNull())
    best = ranked.agg(F.min("priority").alias("priority"))
    return ranked.join(F.broadcast(best), "priority").orderBy("symbol").limit(limit).select("symbol", "priority")


def tradable_on(instruments: DataFrame, moment: str | Column) -> DataFrame:
    """Listed, not delisted, not expired at ``moment`` (half-open intervals)."""
    at = moment if isinstance(moment, Column) else F.lit(moment).cast("timestamp")
    listed = F.col("listed_at").isNull() | (F.col("listed_at") <= at)
    gone = F.coalesce(F.col("delisted_at") <= at, F.lit(False))
    expired = F.coalesce(F.col("expiry") <= at, F.lit(False))
    return instruments.withColumn("tradable", listed & ~gone & ~expired)


def corrupt_future(panel: DataFrame, fraction: float = 0.5, factor: float = 3.0) -> DataFrame:
    """Scale prices from the session at ``fraction`` of the calendar on.

    A study that looks ahead changes its earlier decisions on such a panel.
    """
    order = W.orderBy("event_time")
    spine = panel.select("event_time").distinct()
    total = spine.agg(F.count(F.lit(1)).alias("n"))
    cutoff = (
        # one row per session, never per bar
        spine.withColumn("_i", F.row_number().over(order) - 1)
        .join(F.broadcast(total), F.col("_i") == F.floor(F.col("n") * fraction))
        .select(F.col("event_time").alias("_cutoff"))
    )
    late = F.col("event_time") >= F.col("_cutoff")
    prices = [c for c in ("open", "high", "low", "close") if c in panel.columns]
    return (
        panel.join(F.broadcast(cutoff), F.lit(True), "left")
        .withColumns({c: F.when(late, F.col(c) * factor).otherwise(F.col(c)) for c in prices})
        .drop("_cutoff")
    )


def refuse_forward_columns(scored: DataFrame) -> DataFrame:
    """A book may not be built from a panel that carries future returns."""
    leaking = [c for c in scored.columns if c.startswith("fwd_")]
    if leaking:
        raise ValueError(f"scores carry forward returns: {leaking}")
    return scored


def bar_violations(bars: DataFrame) -> DataFrame:
    """Name the first broken rule of each bar; null when the bar is sound."""
    return bars.withColumn(
        "violation",
        F.when(acausal(), "receive_before_event")
        .when(F.least("open", "high", "low", "close") <= 0, "non_positive_price")
        .when(bad_ohlc(), "ohlc_order"),
    )


def quote_violations(ticks: DataFrame) -> DataFrame:
    return ticks.withColumn(
        "violation",
        F.when(acausal(), "receive_before_event").when(F.col("bid") > F.col("ask"), "crossed_book"),
    )


def bar_columns(bars: DataFrame) -> DataFrame:
    return bars.withColumns(
        {
            "typical_price": (F.col("high") + F.col("low") + F.col("close")) / 3,
            "is_doji": F.col("open") == F.col("close"),
        }
    )


def quote_columns(ticks: DataFrame) -> DataFrame:
    return ticks.withColumns(
        {"spread": F.col("ask") - F.col("bid"), "mid": (F.col("ask") + F.col("bid")) / 2}
    )


def tail(df: DataFrame, n: int, key: str = "symbol", time: str = "event_time") -> DataFrame:
    """Last ``n`` rows of every name."""
    recent = W.partitionBy(key).orderBy(F.desc(time))
    return df.withColumn("_r", F.row_number().over(recent)).where(F.col("_r") <= n).drop("_r")


def every_kth(df: DataFrame, k: int, key: str = "symbol", time: str = "event_time") -> DataFrame:
    w = by(key, time)
    return df.withColumn("_r", F.row_number().over(w) - 1).where(F.col("_r") % k == 0).drop("_r")
