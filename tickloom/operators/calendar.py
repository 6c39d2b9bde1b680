"""Trading calendars as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Zone, open and close of each venue (fixed values).
VENUES = {
    "NSE": ("Asia/Kolkata", "09:15:00", "15:30:00"),
    "US": ("America/New_York", "09:30:00", "16:00:00"),
}


def sessions_between(spark: SparkSession, start: str, end: str, holidays: DataFrame | None = None) -> DataFrame:
    """Weekdays of a range without the holidays."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("session")
    )
    open_days = days.where(F.weekday("session") < 5)
    if holidays is not None:
        open_days = open_days.join(holidays.select("session"), "session", "left_anti")
    return open_days


def observed_sessions(panel: DataFrame) -> DataFrame:
    """Sessions that happened: they override the declared rules."""
    return panel.select("session").distinct()


def with_next_session(sessions: DataFrame) -> DataFrame:
    """Each session with its successor; one row per day, so one task is enough."""
    return sessions.withColumn("next_session", F.lead("session").over(W.orderBy("session")))


def next_session(days: DataFrame, sessions: DataFrame, limit_days: int = 30) -> DataFrame:
    """First session after each day, within the limit."""
    after = (F.col("session") > F.col("day")) & (F.col("session") <= F.date_add("day", limit_days))
    return days.join(F.broadcast(sessions), after, "left").groupBy("day").agg(F.min("session").alias("next_session"))


def local_time(ts: Column, venue: str) -> Column:
    return F.from_utc_timestamp(ts, VENUES[venue][0])


def session_date(ts: Column, venue: str) -> Column:
    return F.to_date(local_time(ts, venue))


def session_bounds(day: Column, venue: str) -> tuple[Column, Column]:
    """UTC open and close of a local session day, daylight saving included."""
    zone, opens, closes = VENUES[venue]
    stamp = lambda hour: F.to_utc_timestamp(
        F.to_timestamp(F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), F.lit(hour))), zone
    )
    return stamp(opens), stamp(closes)


def is_open(ts: Column, venue: str) -> Column:
    """Within the venue's hours on a weekday; holidays are joined separately."""
    zone, opens, closes = VENUES[venue]
    clock = F.date_format(F.from_utc_timestamp(ts, zone), "HH:mm:ss")
    weekday = F.weekday(F.to_date(F.from_utc_timestamp(ts, zone))) < 5
    return weekday & (clock >= opens) & (clock < closes)


def staleness_seconds(later: Column, earlier: Column) -> Column:
    return F.unix_seconds(later) - F.unix_seconds(earlier)
