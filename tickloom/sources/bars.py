"""Bar and panel tables on Parquet: conform, upsert, point-in-time reads."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.schemas import BAR, PANEL, TIMEFRAMES, SchemaError, acausal, bad_ohlc, conform
from tickloom.session import shared_folder


#: Rows one task writes of one session.
FILE_ROWS = 5_000_000


class NoDataError(LookupError):
    """Nothing was ever written where a reader looks."""


#: Rows come with the number of their write, below timeframe, month (199902) and state: compacted or appended.
BAR_TABLE = T.StructType(
    [
        *BAR.fields,
        T.StructField("write_id", T.LongType()),
        T.StructField("timeframe", T.StringType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("state", T.StringType()),
    ]
)
BAR_KEY = ("instrument_id", "event_time")
#: What orders versions of a bar: the write, then when it was received, then its values.
BAR_VERSION = ("write_id", "receive_time", "close", "open", "high", "low", "volume")
PANEL_TABLE = T.StructType([*PANEL.fields, T.StructField("venue", T.StringType()), T.StructField("session_date", T.DateType())])


def _exists(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The table, or nothing.  The schema is given: a partition named ``1d``
    would be inferred as a number."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def conform_bars(bars: DataFrame) -> DataFrame:
    """Project, cast and refuse bars that break an invariant: one pass."""
    df = conform(bars, BAR)
    seen = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(acausal()).alias("acausal"),
        F.count_if(bad_ohlc()).alias("prices"),
    ).first()
    if not seen["rows"]:
        raise SchemaError("refusing to write an empty frame")
    if seen["acausal"]:
        raise SchemaError(f"{seen['acausal']} bars received before they occurred")
    if seen["prices"]:
        raise SchemaError(f"{seen['prices']} bars with contradictory prices")
    return df


def conform_panel(panel: DataFrame) -> DataFrame:
    """Project and cast a panel; each instrument once per session."""
    df = conform(panel, PANEL)
    bad = df.where(acausal()).limit(1).count()
    if bad:
        raise SchemaError("panel rows received before they occurred")
    twice = df.groupBy("instrument_id", "event_time").count().where("count > 1").limit(1).count()
    if twice:
        raise SchemaError("an instrument appears twice in a session")
    return df


def keep_last(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key, the last by ``order``."""
    newest = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") == 1).drop("_r")


def _month(moment: Column) -> Column:
    return F.year(moment) * 100 + F.month(moment)


class BarStore:
    """Bars of every instrument, partitioned by timeframe and month.

    A write appends its bars and reads nothing, so one day's bars cost one day.
    Readers take the last version of each bar; months without appended bars
    hold one version already and are read as they are.  ``compact`` merges
    what was appended into its months, as a job of its own.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    @property
    def path(self) -> str:
        return f"{self.root}/bars"

    def write(self, bars: DataFrame, timeframe: str, version: tuple[str, ...] = ()) -> int:
        """Append bars; the number of rows comes back.

        The bar of the later write wins.  With ``version`` (a prefix of what orders versions, from
        ``receive_time`` on) writes do not order bars: the greatest version wins, however rows
        arrive, and a repeated write changes nothing.
        """
        if timeframe not in TIMEFRAMES:
            raise ValueError(f"unknown timeframe {timeframe}")
        if version and tuple(version) != BAR_VERSION[1 : 1 + len(version)]:
            raise ValueError(f"versions are ordered by {BAR_VERSION[1:]}")
        number = F.lit(0 if version else time.time_ns())
        new = conform_bars(bars).withColumns(
            {"write_id": number.cast("long"), "timeframe": F.lit(timeframe), "month": _month(F.col("event_time")), "state": F.lit("appended")}
        )
        stage = shared_folder(self.spark, "stage")
        new.write.option("compression", "zstd").parquet(stage)  # a failed write leaves the table as it was
        staged = self.spark.read.schema(new.schema).parquet(stage)
        self._lay(staged, "append")
        return staged.count()

    def _lay(self, rows: DataFrame, mode: str) -> None:
        (
            rows.hint("rebalance", "timeframe", "month")
            .sortWithinPartitions("timeframe", "month", "instrument_id", "event_time")
            .write.mode(mode)
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "zstd")
            .partitionBy("timeframe", "month", "state")
            .parquet(self.path)
        )

    def compact(self, timeframe: str) -> int:
        """Merge appended bars into their months; the number of months comes back.

        Only months with appended bars are rewritten, and only the appended files that were read are
        removed, after the merged months are in place: a job that dies between finds the same
        bars twice, which readers and the next run see as one.
        """
        table = self._table(timeframe)
        appended = table.where(F.col("state") == "appended")
        months = self._months(appended)
        # the listing behind this table, which is not pruned by its filters
        read = [f for f in appended.inputFiles() if f"/timeframe={timeframe}/" in f and "/state=appended/" in f]
        if months:
            merged = keep_last(table.where(F.col("month").isin(months)), list(BAR_KEY), *BAR_VERSION)
            stage = shared_folder(self.spark, "stage")
            merged.withColumn("state", F.lit("compacted")).write.option("compression", "zstd").parquet(stage)
            self._lay(self.spark.read.schema(BAR_TABLE).parquet(stage), "overwrite")
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for name in read:
            path = hadoop(name)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)
        return len(months)

    def _months(self, appended: DataFrame) -> list[int]:
        """Months with appended bars: a few per year of data."""
        return sorted(r["month"] for r in appended.select("month").distinct().collect())

    def _table(self, timeframe: str) -> DataFrame:
        table = _exists(self.spark, self.path, BAR_TABLE)
        if table is None:
            raise NoDataError(self.path)
        return table.where(F.col("timeframe") == timeframe)

    def _current(self, timeframe: str, bounds: Column | None = None) -> DataFrame:
        """The last version of every bar, of months within ``bounds``."""
        table = self._table(timeframe)
        if bounds is not None:
            table = table.where(bounds)
        months = self._months(table.where(F.col("state") == "appended"))
        settled = table.where(~F.col("month").isin(months)) if months else table
        if not months:
            return settled
        return settled.unionByName(keep_last(table.where(F.col("month").isin(months)), list(BAR_KEY), *BAR_VERSION))

    def view(self, timeframe: str, *, as_of: str, start: str | None = None, instrument: str | None = None) -> DataFrame:
        """Current bars that were received by ``as_of``; the month bounds prune partitions."""
        moment = F.lit(as_of).cast("timestamp")
        within = F.col("month") <= _month(moment)
        begin = None if start is None else F.lit(start).cast("timestamp")
        if begin is not None:
            within &= F.col("month") >= _month(begin)
        df = self._current(timeframe, within).where(F.col("receive_time") <= moment)
        if begin is not None:
            df = df.where(F.col("event_time") >= begin)
        if instrument is not None:
            df = df.where(F.col("instrument_id") == instrument)
        return df.select(*BAR.names).orderBy("instrument_id", "event_time")

    def coverage(self, timeframe: str) -> DataFrame:
        return coverage(self._current(timeframe))

    def instruments(self, timeframe: str) -> DataFrame:
        return self._table(timeframe).select("instrument_id").distinct()


def coverage(bars: DataFrame) -> DataFrame:
    """First and last bar and the count of every instrument."""
    return bars.groupBy("instrument_id").agg(
        F.min("event_time").alias("first"), F.max("event_time").alias("last"), F.count(F.lit(1)).alias("bars")
    )


class PanelStore:
    """Cross-sections, one partition per venue and session."""

    def __init__(self, spark: SparkSession, root: str, venue: str = "NSE") -> None:
        self.spark, self.root, self.venue = spark, root.rstrip("/"), venue

    @property
    def path(self) -> str:
        return f"{self.root}/panel"

    def write(self, panel: DataFrame) -> None:
        """Write sessions, replacing the dates the frame holds."""
        df = conform_panel(panel).withColumns({"venue": F.lit(self.venue), "session_date": F.to_date("event_time")})
        largest = df.groupBy("session_date").count().agg(F.max("count")).first()[0] or 0
        splits = 1 + largest // FILE_ROWS  # a crowded session is spread over tasks
        tasks = max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        (
            df.repartition(tasks, "session_date", F.pmod(F.xxhash64("instrument_id"), F.lit(splits)))
            .sortWithinPartitions("session_date", "instrument_id")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "zstd")
            .partitionBy("venue", "session_date")
            .parquet(self.path)
        )

    def _table(self) -> DataFrame:
        table = _exists(self.spark, self.path, PANEL_TABLE)
        if table is None:
            raise NoDataError(self.path)
        return table.where(F.col("venue") == self.venue)

    def sessions(self) -> DataFrame:
        """Sessions present, from the partition column alone."""
        return self._table().select("session_date").distinct().orderBy("session_date")

    def view(self, *, as_of: str, start: str | None = None, end: str | None = None) -> DataFrame:
        """Rows known at ``as_of``, of sessions from ``start`` to ``end``; empty, not an error, when nothing is."""
        moment = F.lit(as_of).cast("timestamp")
        df = self._table().where((F.col("session_date") <= F.to_date(moment)) & (F.col("receive_time") <= moment))
        if start is not None:
            df = df.where(F.col("session_date") >= F.lit(start).cast("date"))
        if end is not None:
            df = df.where(F.col("session_date") <= F.lit(end).cast("date"))
        return df.select(*PANEL.names)

    def session_view(self, session: str, *, as_of: str) -> DataFrame:
        return self.view(as_of=as_of, start=session, end=session).where(F.to_date("event_time") == F.lit(session).cast("date"))
