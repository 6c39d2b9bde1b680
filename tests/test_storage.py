"""Stores, feeds, logs and streams."""

import datetime as dt
import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from tickloom.schemas import SchemaError
from tickloom.sources import bars, feeds
from tickloom.streaming import jobs


def _bars(spark, closes, start=dt.datetime(2023, 12, 28, 10)):
    rows = []
    for i, close in enumerate(closes):
        at = start + dt.timedelta(days=i)
        rows.append(("X:1", "X", at, at + dt.timedelta(hours=2), close, close * 1.01, close * 0.99, close, 1000.0, 5))
    return spark.createDataFrame(
        rows,
        "instrument_id string, symbol string, event_time timestamp, receive_time timestamp, open double, high double, low double, close double, volume double, trades bigint",
    )


def test_upsert_replaces_and_keeps(spark, tmp_path):
    store = bars.BarStore(spark, str(tmp_path))
    store.write(_bars(spark, [10.0, 11.0, 12.0, 13.0, 14.0, 15.0]), "1d")
    store.write(_bars(spark, [20.0, 21.0], dt.datetime(2023, 12, 31, 10)), "1d")
    got = [r["close"] for r in store.view("1d", as_of="2025-01-01 00:00:00").collect()]
    assert got == [10.0, 11.0, 12.0, 20.0, 21.0, 15.0]
    assert store.coverage("1d").first()["bars"] == 6


def _files(path):
    return {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_a_day_is_appended_and_compaction_keeps_what_readers_see(spark, tmp_path):
    store = bars.BarStore(spark, str(tmp_path))
    store.write(_bars(spark, [10.0 + i for i in range(100)], dt.datetime(2023, 10, 1, 10)), "1d")
    assert store.compact("1d") == 4 and store.compact("1d") == 0
    before = _files(tmp_path)
    assert len(before) == 4 and all("state=compacted" in str(p) for p in before)
    # one day costs one file and touches no other
    assert store.write(_bars(spark, [77.0], dt.datetime(2023, 11, 5, 10)), "1d") == 1
    after = _files(tmp_path)
    assert {p: t for p, t in after.items() if p in before} == before
    (added,) = set(after) - set(before)
    assert "month=202311/state=appended" in str(added)
    store.write(_bars(spark, [5.0], dt.datetime(2023, 11, 5, 10)).withColumn("receive_time", F.col("event_time")), "1d", ("receive_time",))
    seen = lambda: [tuple(r) for r in store.view("1d", as_of="2100-01-01 00:00:00").collect()]
    rows = seen()
    assert len(rows) == 100 and [r[6] for r in rows if r[1] == dt.datetime(2023, 11, 5, 10)] == [77.0]
    assert store.compact("1d") == 1 and seen() == rows
    left = _files(tmp_path)
    assert len(left) == 4 and not any("state=appended" in str(p) for p in left)
    # a compaction that died before it removed what it read: the same bars twice are one
    store.write(_bars(spark, [78.0], dt.datetime(2023, 11, 6, 10)), "1d")
    (kept,) = set(_files(tmp_path)) - set(left)
    data = kept.read_bytes()
    store.compact("1d")
    rows = seen()
    kept.write_bytes(data)
    spark.catalog.refreshByPath(str(tmp_path))
    assert seen() == rows and len(rows) == 100


def test_view_is_point_in_time(spark, tmp_path):
    store = bars.BarStore(spark, str(tmp_path))
    store.write(_bars(spark, [10.0, 11.0, 12.0]), "1d")
    assert store.view("1d", as_of="2023-12-29 11:59:59").count() == 1
    assert store.view("1d", as_of="2023-12-29 12:00:00").count() == 2
    assert store.view("1d", as_of="2020-01-01 00:00:00").count() == 0
    plan = store.view("1d", as_of="2023-12-29 12:00:00")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "LessThanOrEqual(receive_time" in plan


def test_nothing_written_is_an_error(spark, tmp_path):
    with pytest.raises(bars.NoDataError):
        bars.BarStore(spark, str(tmp_path / "none")).view("1d", as_of="2024-01-01 00:00:00")


def test_bad_bars_are_refused(spark):
    good = _bars(spark, [10.0])
    with pytest.raises(SchemaError):
        bars.conform_bars(good.withColumn("receive_time", F.col("event_time") - F.expr("INTERVAL 1 HOURS")))
    with pytest.raises(SchemaError):
        bars.conform_bars(good.withColumn("high", F.lit(1.0)))
    with pytest.raises(SchemaError):
        bars.conform_bars(good.drop("trades"))
    with pytest.raises(SchemaError):
        bars.conform_bars(good.withColumn("event_time", F.col("event_time").cast("timestamp_ntz")))
    with pytest.raises(SchemaError):
        bars.conform_bars(good.limit(0))


def test_panel_sessions_are_replaced(spark, tmp_path):
    store = bars.PanelStore(spark, str(tmp_path))
    store.write(_bars(spark, [10.0, 11.0]))
    store.write(_bars(spark, [50.0], dt.datetime(2023, 12, 29, 10)))
    got = store.view(as_of="2024-01-01 00:00:00").orderBy("event_time").collect()
    assert [r["close"] for r in got] == [10.0, 50.0]
    assert store.sessions().count() == 2
    assert store.session_view("2023-12-29", as_of="2023-12-29 11:00:00").count() == 0
    with pytest.raises(SchemaError):
        store.write(_bars(spark, [1.0]).unionByName(_bars(spark, [1.0])))


LEGACY = (
    "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,LAST,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP,TOTALTRADES,ISIN,\n"
    "ABC, EQ,10,12,9,11,11,10,1000,11000,01-JAN-2020,50,INE000A,\n"
    "DEF,BE,10,12,9,11,11,10,1000,11000,01-JAN-2020,50,INE000B,\n"
    "BAD,EQ,-,12,9,11,11,10,1000,11000,01-JAN-2020,50,INE000C,\n"
    "LOW,EQ,1,12,0,11,11,10,1000,11000,01-JAN-2020,50,INE000D,\n"
)
UDIFF = "TradDt,ISIN,TckrSymb,SctySrs,OpnPric,HghPric,LwPric,ClsPric,TtlTradgVol,TtlTrfVal,TtlNbOfTxsExctd\n2024-07-09,,xyz,EQ,5,6,4,5.5,200,1100,\n"


def test_bhavcopy_layouts(spark, tmp_path):
    (tmp_path / "cm01JAN2020bhav.csv").write_text(LEGACY)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        archive.writestr("inner.csv", UDIFF)
    (tmp_path / "BhavCopy_20240709_F.csv.zip").write_bytes(packed.getvalue())
    (tmp_path / "junk_20240710.csv").write_text("a,b\n1,2\n")
    raw = feeds.read_bhavcopy(spark, str(tmp_path))
    got = {r["symbol"]: r for r in feeds.bhavcopy_bars(raw).collect()}
    assert set(got) == {"ABC", "xyz"}
    assert got["ABC"]["instrument_id"] == "NSE:INE000A" and got["xyz"]["instrument_id"] == "NSE:XYZ"
    assert got["ABC"]["event_time"] == dt.datetime(2020, 1, 1, 10) and got["ABC"]["receive_time"] == dt.datetime(2020, 1, 1, 12, 30)
    assert got["xyz"]["trades"] == 0
    assert raw.where("error IS NOT NULL").count() == 1


def test_log_survives_a_torn_line(spark, tmp_path):
    path = str(tmp_path / "log")
    feeds.append_log(spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-02", 2.0)], "at string, equity double"), path)
    (tmp_path / "log" / "part-torn.json").write_text('{"at": "2024-01-03", "equ')
    assert feeds.read_log(spark, path, "at string, equity double").count() == 2
    assert feeds.read_log(spark, path, "at string, equity double", last=1).first()["equity"] == 2.0


def test_dataset_version_follows_content_and_place(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.parquet").write_bytes(b"one")
    (tmp_path / "y.parquet").write_bytes(b"two")
    first = feeds.dataset_version(feeds.file_digests(spark, str(tmp_path))).first()
    again = feeds.dataset_version(feeds.file_digests(spark, str(tmp_path))).first()
    assert first["content_hash"] == again["content_hash"] and first["files"] == 2 and first["bytes"] == 6
    (tmp_path / "y.parquet").rename(tmp_path / "a" / "y.parquet")
    assert feeds.dataset_version(feeds.file_digests(spark, str(tmp_path))).first()["content_hash"] != first["content_hash"]


def _plain_digests(folder):
    import hashlib

    return {str(p.relative_to(folder)): (hashlib.sha256(p.read_bytes()).hexdigest(), p.stat().st_size) for p in folder.rglob("*.parquet")}


def test_digests_of_large_files_are_those_of_their_bytes(spark, tmp_path, monkeypatch):
    import random

    rng = random.Random(3)
    (tmp_path / "a b+c%20{d}").mkdir()
    odd = [b"small", b"\n", b"one line, no end of it", b"ends\n", b"\n\n\n\n\n\n\n\n\n\n\n\n", b"windows\r\nlines\r\n\r", b"\xef\xbb\xbfmarked, with a line\n", b"\n\xef\xbb\xbf not at the start"]
    odd += [bytes(rng.choices(b"\n\r\x00ab\xff", k=5000)) for _ in range(4)]
    for i, data in enumerate(odd):
        (tmp_path / (["a b+c%20{d}", "."][i % 2]) / f"x{i} +%41.parquet").write_bytes(data)
    monkeypatch.setattr(feeds, "STREAMED", 10)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = {r["path"]: (r["digest"], r["bytes"]) for r in feeds.file_digests(spark, str(tmp_path)).collect()}
    assert got == _plain_digests(tmp_path) and len(got) == 12
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    # files that are cut all the same are read as a whole
    monkeypatch.setattr(type(spark.conf), "set", lambda *args: None)
    cut = feeds.file_digests(spark, str(tmp_path)).collect()
    assert {r["path"]: (r["digest"], r["bytes"]) for r in cut} == got


def test_a_file_beyond_any_task_has_a_digest(spark, tmp_path):
    import hashlib

    size, step = (2 << 30) + 12_345, 1 << 20
    with open(tmp_path / "big.parquet", "wb") as file:  # mostly holes
        for at in range(step, size, step):
            file.seek(at)
            file.write(b"\n")
        file.truncate(size)
    state = hashlib.sha256()
    with open(tmp_path / "big.parquet", "rb") as file:
        while block := file.read(step):
            state.update(block)
    assert [tuple(r) for r in feeds.file_digests(spark, str(tmp_path)).collect()] == [("big.parquet", state.hexdigest(), size)]


def _tick_files(spark, folder, batches):
    for rows in batches:
        df = spark.createDataFrame(rows, "instrument_id string, sequence bigint, event_time timestamp, receive_time timestamp, price double, size double")
        df.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    return jobs.file_stream(spark, folder, df.schema, files=1)


def _tick(i, minutes, price, name="A"):
    at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    return (name, i, at, at, float(price), 1.0)


def test_gaps_are_seen_across_batches(spark, tmp_path):
    stream = _tick_files(spark, str(tmp_path / "in"), [[_tick(1, 0, 10), _tick(2, 1, 10)], [_tick(5, 300, 10), _tick(6, 301, 10)]])
    got = jobs.run_to_table(jobs.sequence_gaps(stream, 3600), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    assert [(r["previous_sequence"], r["sequence"], r["missing"]) for r in got] == [(2, 5, 2)]
    assert got[0]["gap_seconds"] == 299 * 60


def test_alerts_for_rungs_and_silence(spark, tmp_path):
    first = [_tick(1, 0, 100), _tick(2, 1, 94), _tick(3, 2, 89), _tick(4, 3, 88)]
    later = [_tick(1, 600, 50, "B")]
    stream = _tick_files(spark, str(tmp_path / "in"), [first, later, [_tick(2, 601, 50, "B")]])
    got = jobs.run_to_table(jobs.stream_alerts(stream, 3600), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    rungs = sorted(round(r["value"], 4) for r in got if r["kind"] == "drawdown_rung")
    assert rungs == [-0.11, -0.06]
    assert [r["instrument_id"] for r in got if r["kind"] == "data_stale"] == ["A"]


def test_stream_bars_equal_batch_bars(spark, tmp_path):
    rows = [_tick(i, i, 100 + (i * 7) % 13) for i in range(1, 180)]
    stream = _tick_files(spark, str(tmp_path / "in"), [rows[:90], rows[90:]])
    got = jobs.run_to_table(jobs.tick_bars(stream, "30m"), str(tmp_path / "out"), str(tmp_path / "state")).orderBy("event_time").collect()
    assert len(got) == 5 and got[1]["trades"] == 30
    inside = [r for r in rows if 30 <= r[1] < 60]
    assert got[1]["open"] == inside[0][4] and got[1]["close"] == inside[-1][4] and got[1]["high"] == max(r[4] for r in inside)
    assert got[1]["event_time"] == dt.datetime(2024, 1, 1, 1)


def test_ingest_quarantines_and_deduplicates(spark, tmp_path):
    good = _bars(spark, [10.0, 11.0, 12.0]).drop("symbol")
    bad = good.limit(1).withColumns({"high": F.lit(1.0), "event_time": F.col("event_time") + F.expr("INTERVAL 3 DAYS"), "receive_time": F.col("receive_time") + F.expr("INTERVAL 3 DAYS")})
    good.unionByName(good.limit(1)).unionByName(bad).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, str(tmp_path / "in"), good.schema)
    store = bars.BarStore(spark, str(tmp_path / "store"))
    jobs.ingest_bars(stream, store, "1d", str(tmp_path / "bad"), str(tmp_path / "state")).awaitTermination()
    assert store.view("1d", as_of="2025-01-01 00:00:00").count() == 3
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_ingest_takes_revisions_and_mended_bars(spark, tmp_path):
    base = _bars(spark, [10.0, 11.0]).drop("symbol")
    later = lambda df, days: df.withColumn("receive_time", F.col("receive_time") + F.expr(f"INTERVAL {days} DAYS"))
    same = lambda df, value: df.withColumns({c: F.lit(value) for c in ("open", "high", "low", "close")})
    first, second = base.orderBy("event_time").limit(1), base.orderBy(F.desc("event_time")).limit(1)
    parts = [
        later(same(first, 99.0), 1),  # the revision comes before what it revises
        first.unionByName(second.withColumn("high", F.lit(1.0))),  # the second bar is broken
        later(same(second, 12.0), 1).unionByName(second.withColumn("low", F.lit(-1.0))),  # and then right
    ]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = jobs.file_stream(spark, str(tmp_path / "in"), base.schema, files=1)
    store = bars.BarStore(spark, str(tmp_path / "store"))
    jobs.ingest_bars(stream, store, "1d", str(tmp_path / "bad"), str(tmp_path / "state")).awaitTermination()
    got = store.view("1d", as_of="2100-01-01 00:00:00").orderBy("event_time").collect()
    assert [r["close"] for r in got] == [99.0, 12.0]
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 2


def test_lost_numbers_are_reported_without_a_pause(spark, tmp_path):
    stream = _tick_files(spark, str(tmp_path / "in"), [[_tick(1, 0, 10), _tick(2, 1, 10)], [_tick(50, 2, 10), _tick(51, 3, 10)]])
    got = jobs.run_to_table(jobs.sequence_gaps(stream, 3600), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    assert [(r["previous_sequence"], r["sequence"], r["missing"]) for r in got] == [(2, 50, 47)]


def test_gaps_survive_a_restart_and_start_from_what_is_known(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    known = spark.createDataFrame([("A", 1, 0.0), ("Z", 7, 0.0)], "instrument_id string, sequence bigint, seconds double")
    for part in ([_tick(4, 0, 10), _tick(5, 1, 10)], [_tick(9, 2, 10)]):
        stream = _tick_files(spark, folder, [part])
        got = jobs.run_to_table(jobs.sequence_gaps(stream, 1e18, known=known), out, state)
    assert sorted((r["previous_sequence"], r["sequence"], r["missing"]) for r in got.collect()) == [(1, 4, 2), (5, 9, 3)]


def test_alerts_start_from_known_peaks(spark, tmp_path):
    known = spark.createDataFrame([("A", 100.0, 1)], "instrument_id string, peak double, rung int")
    stream = _tick_files(spark, str(tmp_path / "in"), [[_tick(1, 0, 94), _tick(2, 1, 91), _tick(3, 2, 89)]])
    got = jobs.run_to_table(jobs.stream_alerts(stream, 3600, known=known), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    assert sorted(round(r["value"], 4) for r in got if r["kind"] == "drawdown_rung") == [-0.11, -0.09]


def test_late_bars_go_aside_and_repeats_away(spark, tmp_path):
    day = lambda k: dt.datetime(2024, 1, 1, 10) + dt.timedelta(days=k)
    base = lambda k, n, close=10.0: _bars(spark, [close] * n, day(k)).drop("symbol")
    parts = [base(0, 20), base(18, 10), base(3, 2).unionByName(base(22, 1, 12.0)).unionByName(base(28, 1)).unionByName(base(28, 1))]
    stored = bars.BarStore(spark, str(tmp_path / "store"))
    for part in parts:  # each run goes on from the state of the one before
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.file_stream(spark, str(tmp_path / "in"), base(0, 1).schema, files=1)
        jobs.ingest_bars(stream, stored, "1d", str(tmp_path / "bad"), str(tmp_path / "state"), 10 * 86400.0).awaitTermination()
    rows = stored.view("1d", as_of="2100-01-01 00:00:00").collect()
    assert [r["event_time"] for r in rows] == [day(k) for k in range(29)] and rows[22]["close"] == 12.0
    aside = spark.read.parquet(str(tmp_path / "bad")).collect()
    assert sorted((r["event_time"], r["violation"]) for r in aside) == [(day(3), "late"), (day(4), "late")]
    # 20 new, 8 new after 2 repeats, one revision and one new
    assert spark.read.parquet(stored.path).count() == 30


def test_the_peak_outlives_silence(spark, tmp_path):
    parts = [[_tick(1, 0, 100)], [_tick(1, 600, 50, "B")], [_tick(2, 610, 50, "B")], [_tick(2, 700, 80)], [_tick(3, 701, 79), _tick(4, 702, 101), _tick(5, 703, 95)]]
    stream = _tick_files(spark, str(tmp_path / "in"), parts)
    got = jobs.run_to_table(jobs.stream_alerts(stream, 3600), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    assert sorted(round(r["value"], 4) for r in got if r["kind"] == "drawdown_rung") == [-0.2, -0.0594]
    assert sorted(r["instrument_id"] for r in got if r["kind"] == "data_stale") == ["A", "B"]


def test_row_days_in_both_layouts(spark):
    df = spark.createDataFrame([("2024-01-05",), ("05-JAN-2024",), (" 5-jan-2024 ",), ("x",), (None,)], "day string")
    got = [str(r[0]) for r in df.select(feeds.date_from_row(F.col("day"))).collect()]
    assert got == ["2024-01-05", "2024-01-05", "2024-01-05", "None", "None"]
