"""Structured Streaming jobs over ticks and bars."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tickloom.operators.pit import bar_violations
from tickloom.schemas import TIMEFRAMES
from tickloom.sources.bars import BAR_VERSION, BarStore


def tick_bars(ticks: DataFrame, timeframe: str, delay: str = "10 minutes") -> DataFrame:
    """OHLCV bars of any timeframe, stamped at the end of their window.

    Prices reduce to a few numbers per key and window before the shuffle, so a
    busy instrument costs no more than a quiet one.
    """
    seconds = TIMEFRAMES[timeframe]
    at = F.struct("event_time", "sequence")
    return (
        ticks.withWatermark("event_time", delay)
        .groupBy("instrument_id", F.window("event_time", f"{seconds} seconds").alias("w"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("size").alias("volume"),
            F.count(F.lit(1)).alias("trades"),
            F.max("receive_time").alias("_seen"),
        )
        .select(
            "instrument_id",
            F.col("w.end").alias("event_time"),
            F.greatest(F.col("_seen"), F.col("w.end")).alias("receive_time"),
            "open", "high", "low", "close", "volume", "trades",
        )
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_state(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, time: str, initial: DataFrame | None = None) -> DataFrame:
    """``rows`` by ``key`` through a processor whose state lies in RocksDB, below the query's checkpoint."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    first = None if initial is None else initial.groupBy(key)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "Append", time, first)


#: What orders versions of a bar: when it was received, then its values, so
#: that the outcome does not depend on the order of arrival.
VERSION = BAR_VERSION[1:]
#: Outcomes of bars that go to the table.
TAKEN = ("new", "revision")


class _Versions(StatefulProcessor):
    """Tells new bars, revisions, repeats and late bars apart, per instrument.

    The state holds the newest bar time and, of each bar time within the delay, the versions seen: one
    value, read and written once a batch, since a call for each bar costs more than the bar.  A
    bar is late if it lies behind the newest one of *earlier* batches by more than the delay, so what
    is older than that need not be remembered.
    """

    def __init__(self, delay: float) -> None:
        self.delay = int(delay * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "newest bigint, versions string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest, versions = self.known.get() if self.known.exists() else (None, "{}")
        seen = {int(when): marks for when, marks in json.loads(versions).items()}
        limit = None if newest is None else newest - self.delay
        for frame in rows:
            at, version = frame["at__"].to_numpy(), frame["version__"].to_numpy()
            outcome = frame["violation"].to_numpy(dtype=object).copy()
            for k in np.flatnonzero(pd.isna(outcome)):
                when, mark = int(at[k]), str(version[k])
                if limit is not None and when < limit:
                    outcome[k] = "late"
                    continue
                marks = seen.setdefault(when, [])
                outcome[k] = "repeat" if mark in marks else "revision" if marks else "new"
                if mark not in marks:
                    marks.append(mark)
                newest = when if newest is None else max(newest, when)
            yield frame.assign(violation=outcome).drop(columns=["at__", "version__"])
        if newest is not None:
            kept = {when: marks for when, marks in seen.items() if when >= newest - self.delay}
            self.known.update((newest, json.dumps(kept)))

    def close(self) -> None:
        pass


def with_outcomes(bars: DataFrame, delay_seconds: float) -> DataFrame:
    """A stream of bars with ``outcome``: a violation, ``late``, ``repeat``, ``revision`` or ``new``."""
    judged = bar_violations(bars)
    names = [c for c in judged.columns if c != "violation"]
    marked = judged.select(*names, F.col("violation").cast("string"), F.unix_micros("event_time").alias("at__"), F.xxhash64(*[c for c in VERSION if c in names]).alias("version__"))
    schema = T.StructType([f for f in marked.schema if f.name not in ("at__", "version__")])
    known = _with_state(marked, "instrument_id", _Versions(delay_seconds), schema, "None")
    return known.withColumnRenamed("violation", "outcome")


def ingest_bars(
    bars: DataFrame, store: BarStore, timeframe: str, quarantine: str, checkpoint: str, delay_seconds: float = 90 * 86400.0
) -> StreamingQuery:
    """Validate, set broken and late bars aside, append every new version of the others.

    A bar is judged before its key counts, so a broken one takes no place.  Repeats that the state knows
    are dropped; the table keeps the last version of each bar, so files may come in any order
    within the delay, and replaying a batch changes nothing.  Each row of the quarantine says why
    in ``violation``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        aside = ~F.col("outcome").isin(*TAKEN, "repeat")
        bad = batch.where(aside).withColumnRenamed("outcome", "violation")
        bad.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
        good = batch.where(F.col("outcome").isin(*TAKEN)).drop("outcome")
        if not good.isEmpty():
            store.write(good, timeframe, VERSION)
        batch.unpersist()

    return (
        with_outcomes(bars, delay_seconds)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


GAPS = "instrument_id string, previous_sequence bigint, sequence bigint, missing bigint, gap_seconds double"


class _Gaps(StatefulProcessor):
    def __init__(self, max_seconds: float, step: int | None, ttl_seconds: float | None) -> None:
        self.max_seconds, self.step, self.ttl = max_seconds, step, ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = None if self.ttl is None else int(self.ttl * 1000)
        self.last = handle.getValueState("last", "sequence bigint, seconds double", ttl)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        newest = initialState.sort_values("sequence").iloc[-1]
        self.last.update((int(newest["sequence"]), float(newest["seconds"])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else (None, None)
        frame = pd.concat(list(rows)).sort_values("sequence", kind="stable")
        sequence = frame["sequence"].to_numpy()
        seconds = frame["event_time"].astype("int64").to_numpy() / _unit(frame["event_time"])
        before = pd.Series(sequence).shift(1)
        then = pd.Series(seconds).shift(1)
        if last[0] is not None:
            before.iloc[0], then.iloc[0] = last
        out = pd.DataFrame(
            {
                "instrument_id": key[0],
                "previous_sequence": before,
                "sequence": sequence,
                "missing": (sequence - before) / (self.step or 1) - 1,
                "gap_seconds": seconds - then,
            }
        ).dropna(subset=["previous_sequence"])
        self.last.update((int(sequence[-1]), float(seconds[-1])))
        broken = out["missing"] < 0 if self.step is None else out["missing"] != 0
        hit = out[(out["gap_seconds"] > self.max_seconds) | broken]
        yield hit.astype({"previous_sequence": "int64", "missing": "int64"})

    def close(self) -> None:
        pass


def sequence_gaps(
    ticks: DataFrame, max_seconds: float, step: int | None = 1, known: DataFrame | None = None, forget_seconds: float | None = None
) -> DataFrame:
    """Breaks in the sequence or in time of each instrument, across batches.

    ``step`` is what an instrument's numbers should grow by: fewer and more are
    both reported.  A feed that numbers all instruments together has none
    (``None``): only its order and time gaps count.  The state of an instrument
    is its last sequence number and time; ``known`` (``instrument_id, sequence, seconds``) is what
    a new query starts from, and an instrument without ticks for ``forget_seconds`` of clock
    time is forgotten.
    """
    processor = _Gaps(max_seconds, step, forget_seconds)
    time = "None" if forget_seconds is None else "ProcessingTime"
    return _with_state(ticks.select("instrument_id", "sequence", "event_time"), "instrument_id", processor, GAPS, time, known)


def _unit(times: pd.Series) -> float:
    return {"ns": 1e9, "us": 1e6, "ms": 1e3, "s": 1.0}[getattr(times.dtype, "unit", "ns")]


ALERTS = "instrument_id string, kind string, at timestamp, value double"


class _Watch(StatefulProcessor):
    def __init__(self, stale_seconds: int, rungs: tuple[float, ...]) -> None:
        self.stale, self.levels = stale_seconds, np.asarray(rungs)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("watch", "peak double, rung int, last bigint, timer bigint")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        self.state.update((float(row["peak"]), int(row["rung"]), 0, -1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        peak, rung, last, timer = self.state.get() if self.state.exists() else (0.0, 0, 0, -1)
        frame = pd.concat(list(rows)).sort_values("sequence", kind="stable")
        price = frame["price"].to_numpy(float)
        high = np.maximum.accumulate(np.append(peak, price))
        fall = np.where(high[1:] > 0, price / np.where(high[1:] > 0, high[1:], 1) - 1, 0.0)
        reached = (fall[:, None] <= self.levels).sum(1)
        # what the rung was before each tick, since the last peak
        episode = np.cumsum(price >= high[:-1])
        start = pd.Series(np.append(rung, reached)).groupby(np.append(0, episode)).cummax().to_numpy()
        before = np.where(price >= high[:-1], 0, start[:-1])
        hit = reached > before
        last = max(last, int(frame["event_time"].max().timestamp() * 1000))
        if timer >= 0:
            self.handle.deleteTimer(timer)
        timer = max(last + self.stale * 1000, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(timer)
        self.state.update((float(high[-1]), int(start[-1]), last, timer))
        yield self._alerts(key, "drawdown_rung", frame["event_time"].to_numpy()[hit], fall[hit])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        peak, rung, last, _ = self.state.get()
        self.state.update((peak, rung, last, -1))
        yield self._alerts(key, "data_stale", [pd.Timestamp(last, unit="ms")], [float(self.stale)])

    def _alerts(self, key, kind: str, at, value) -> pd.DataFrame:
        return pd.DataFrame({"instrument_id": key[0], "kind": kind, "at": at, "value": value})

    def close(self) -> None:
        pass


def stream_alerts(
    ticks: DataFrame,
    stale_seconds: int,
    rungs: tuple[float, ...] = (-0.05, -0.08, -0.10),
    delay: str = "10 minutes",
    known: DataFrame | None = None,
) -> DataFrame:
    """Drawdown rungs as they are reached, and feeds that fall silent.

    A rung is reported once per fall from a peak; a price at or above the peak
    starts a new one.  A timer per instrument fires when the watermark passes
    its last tick by more than the allowed age.  Silence changes neither peak
    nor rung, and is reported once until the feed speaks again.  ``known``
    (``instrument_id, peak, rung``) is what a new query starts from.
    """
    watched = ticks.select("instrument_id", "sequence", "event_time", "price").withWatermark("event_time", delay)
    return _with_state(watched, "instrument_id", _Watch(stale_seconds, rungs), ALERTS, "EventTime", known)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process everything available into a table and return it."""
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def file_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files)
    return reader.parquet(folder)

