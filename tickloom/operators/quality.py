"""Data-quality findings of every instrument in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.chunks import with_previous
from tickloom.schemas import TIMEFRAMES, acausal, bad_ohlc

EXTREME_RETURN = 0.35
FLAT_SHARE = 0.05
MAX_GAP_DAYS = 10
SAMPLES = 3

#: Severity of each check (fixed values); flat_bars is WARN above a share.
SEVERITY = {
    "duplicate_timestamps": "CRITICAL",
    "out_of_order": "CRITICAL",
    "receive_before_event": "CRITICAL",
    "invalid_ohlc": "CRITICAL",
    "extreme_move": "WARN",
    "flat_bars": "INFO",
    "zero_volume": "INFO",
    "missing_bars": "WARN",
    "missing_history": "CRITICAL",
}
_SAMPLED = ("receive_before_event", "invalid_ohlc", "extreme_move", "missing_bars", "missing_history")


def _flags(timeframe: str, continuous: bool) -> dict[str, Column]:
    gap = F.unix_micros("event_time") - F.unix_micros("prev_event_time")
    limit = TIMEFRAMES[timeframe] if continuous else MAX_GAP_DAYS * 86400
    move = F.abs(F.try_divide(F.col("close"), F.col("prev_close")) - 1)
    return {
        "duplicate_timestamps": F.col("event_time") == F.col("prev_event_time"),
        "receive_before_event": acausal(),
        "invalid_ohlc": bad_ohlc(),
        "extreme_move": move > EXTREME_RETURN,
        "flat_bars": F.col("high") == F.col("low"),
        "zero_volume": F.col("volume") == 0,
        ("missing_bars" if continuous else "missing_history"): gap > limit * 1_000_000,
    }


def flagged_bars(
    bars: DataFrame,
    timeframe: str = "1d",
    continuous: bool = False,
    sequence: str | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Bars with one boolean per check; ``sequence`` is the stored order.

    Raw bars may repeat a timestamp, so an instrument is bounded only by
    ``rows``; without that it is cut by month.
    """
    month = F.date_trunc("month", "event_time")
    tie = [sequence] if sequence else ["receive_time", "close", "volume"]
    df = with_previous(bars, ["instrument_id"], ["event_time", *tie], ["event_time", "close"], rows, month)
    flags = _flags(timeframe, continuous)
    out = df.withColumns({f"is_{k}": F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    if sequence:
        stored = bars.select("instrument_id", sequence, F.col("event_time").alias("_stored"))
        back = with_previous(
            stored, ["instrument_id"], [sequence], ["_stored"], rows, F.floor(F.col(sequence) / 1_000_000)
        ).where(F.col("_stored") < F.col("prev__stored"))
        mark = back.select("instrument_id", sequence, F.lit(True).alias("is_out_of_order"))
        out = out.join(mark, ["instrument_id", sequence], "left").fillna(False, ["is_out_of_order"])
    return out.drop("prev_event_time", "prev_close")


def findings(flagged: DataFrame) -> DataFrame:
    """Long report ``(instrument, check, severity, count, sample)``.

    Only flagged rows travel for the samples, three per finding at most.
    """
    checks = [c[3:] for c in flagged.columns if c.startswith("is_")]
    counts = flagged.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(f"is_{c}").alias(c) for c in checks]
    )
    # the stored order is judged as a whole: one finding per instrument
    if "out_of_order" in checks:
        counts = counts.withColumn("out_of_order", F.least(F.col("out_of_order"), F.lit(1)))
    long = counts.unpivot(["instrument_id", "_rows"], checks, "check", "count").where("count > 0")
    severity = F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))])[F.col("check")]
    flat = (F.col("check") == "flat_bars") & (F.col("count") / F.col("_rows") > FLAT_SHARE)
    named = [c for c in checks if c in _SAMPLED]
    fired = F.filter(
        F.array(*[F.when(F.col(f"is_{c}"), F.lit(c)) for c in named]), lambda c: c.isNotNull()
    )
    each = flagged.select("instrument_id", "event_time", F.explode(fired).alias("check"))
    first = W.partitionBy("instrument_id", "check").orderBy("event_time")
    samples = (
        each.withColumn("_i", F.row_number().over(first))
        .where(F.col("_i") <= SAMPLES)
        .groupBy("instrument_id", "check")
        .agg(F.sort_array(F.collect_list("event_time")).alias("sample"))
    )
    return (
        long.withColumn("severity", F.when(flat, "WARN").otherwise(severity))
        .join(samples, ["instrument_id", "check"], "left")
        .select("instrument_id", "check", "severity", "count", "sample")
    )


def empty_findings(names: DataFrame, bars: DataFrame) -> DataFrame:
    """Expected instruments without a single bar are a finding themselves."""
    missing = names.select("instrument_id").distinct().join(bars, "instrument_id", "left_anti")
    return missing.select(
        "instrument_id",
        F.lit("empty").alias("check"),
        F.lit("CRITICAL").alias("severity"),
        F.lit(0).cast("bigint").alias("count"),
        F.lit(None).cast("array<timestamp>").alias("sample"),
    )


def report(found: DataFrame) -> DataFrame:
    """Per instrument: findings, critical ones, and whether it is clean."""
    critical = F.count_if(F.col("severity") == "CRITICAL")
    return found.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("findings"), critical.alias("critical"), (critical == 0).alias("is_clean")
    )


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("check", "severity").agg(
        F.count(F.lit(1)).alias("instruments"), F.sum("count").alias("rows")
    )
