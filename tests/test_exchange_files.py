"""The folder source, its ingest, and Merkle trees."""

import datetime as dt
import os

import pytest

from tickloom.sources import exchange_files, feeds, merkle
from tickloom.sources.bars import PanelStore
from tests.test_storage import LEGACY, UDIFF


def _put(folder, name, data):
    path = folder / name
    path.parent.mkdir(exist_ok=True, parents=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def _outcomes(frame):
    return {r["path"]: (r["status"], r["bars"]) for r in frame.collect()}


def test_one_row_tells_of_every_file(spark, tmp_path):
    _put(tmp_path, "cm01JAN2020bhav.csv", LEGACY)
    _put(tmp_path, "deep/bhav_20240709.csv", UDIFF)
    _put(tmp_path, "bhav_20240710.csv", "a,b\n1,2\n")
    _put(tmp_path, "bhav_20240711.csv", "")
    _put(tmp_path, "bhav_20240712.zip", b"PK no archive")
    _put(tmp_path, "undated.csv", UDIFF)
    _put(tmp_path, "notes_20240101.txt", "not a daily file")
    _put(tmp_path, "_hidden/bhav_20240101.csv", UDIFF)
    exchange_files.register(spark)
    read = spark.read.format("exchange_files").option("path", str(tmp_path)).option("stored", "20200101").load()
    told = {r["path"]: (r["status"], r["session"]) for r in read.where("status is not null").collect()}
    assert {k: v[0] for k, v in told.items()} == {
        "cm01JAN2020bhav.csv": "skipped", "deep/bhav_20240709.csv": "ok", "bhav_20240710.csv": "failed",
        "bhav_20240711.csv": "failed", "bhav_20240712.zip": "failed", "undated.csv": "failed",
    }
    assert told["deep/bhav_20240709.csv"][1] == dt.date(2024, 7, 9)
    assert {r["path"] for r in read.where("status is null").collect()} == {"deep/bhav_20240709.csv"}


def test_ingest_resumes_and_the_later_file_counts(spark, tmp_path):
    folder, panel = tmp_path / "in", PanelStore(spark, str(tmp_path / "store"))
    _put(folder, "cm01JAN2020bhav.csv", LEGACY)
    assert _outcomes(exchange_files.ingest_folder(panel, str(folder)))["cm01JAN2020bhav.csv"][0] == "ok"
    _put(folder, "a_20240709.csv", UDIFF)
    _put(folder, "b_20240709.csv", UDIFF)
    body = UDIFF.strip().split("\n")
    _put(folder, "twice_20240708.csv", "\n".join([*body, *body[1:]]))
    _put(folder, "none_20240707.csv", body[0] + "\n")
    got = {k: v[0] for k, v in _outcomes(exchange_files.ingest_folder(panel, str(folder))).items()}
    assert got == {
        "cm01JAN2020bhav.csv": "skipped", "a_20240709.csv": "replaced", "b_20240709.csv": "ok",
        "twice_20240708.csv": "failed", "none_20240707.csv": "empty",
    }
    assert [r["session_date"] for r in panel.sessions().collect()] == [dt.date(2020, 1, 1), dt.date(2024, 7, 9)]
    again = _outcomes(exchange_files.ingest_folder(panel, str(folder), refetch=True))
    assert again["cm01JAN2020bhav.csv"][0] == "ok"


def test_an_empty_folder_is_no_error(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert exchange_files.ingest_folder(PanelStore(spark, str(tmp_path / "store")), str(tmp_path / "in")).count() == 0


def test_names_give_the_dates_that_columns_give(spark):
    names = ["bhav_20240709.csv", "cm01JAN2020bhav.csv.zip", "cm31feb2020bhav.csv", "x_20241399.csv", "none.csv", "20240131_01FEB2024.csv"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    columns = {r["name"]: r["day"] for r in rows.select("name", feeds.date_from_name(rows["name"]).alias("day")).collect()}
    assert {n: exchange_files.session_of(n) for n in names} == columns


def test_small_files_share_a_task_and_large_ones_do_not():
    small = [(f"a_{i}.csv", 1000, 0) for i in range(100)]
    packed = exchange_files._packed(small, set())
    assert sum(len(p.files) for p in packed) == 100 and len(packed) == 4
    large = [(f"a_{i}.csv", 200 * 1024 * 1024, 0) for i in range(3)]
    assert [len(p.files) for p in exchange_files._packed(large, set())] == [1, 1, 1]


def test_files_are_followed_as_they_come(spark, tmp_path):
    folder, panel = tmp_path / "in", PanelStore(spark, str(tmp_path / "store"))
    _put(folder, "cm01JAN2020bhav.csv", LEGACY)

    def run():
        job = exchange_files.follow_folder(panel, str(folder), str(tmp_path / "told"), str(tmp_path / "check"))
        query = job.start()
        query.processAllAvailable()
        query.stop()

    run()
    _put(folder, "bhav_20240709.csv", UDIFF)
    _put(folder, "bhav_20240710.csv", "a,b\n1,2\n")
    later = os.stat(folder / "cm01JAN2020bhav.csv").st_mtime_ns + 10**9
    for name in ("bhav_20240709.csv", "bhav_20240710.csv"):
        os.utime(folder / name, ns=(later, later))
    run()
    told = sorted((r["path"], r["status"]) for r in spark.read.parquet(str(tmp_path / "told")).collect())
    assert told == [("bhav_20240709.csv", "ok"), ("bhav_20240710.csv", "failed"), ("cm01JAN2020bhav.csv", "ok")]
    assert panel.sessions().count() == 2


MAP = [(f"p{i}", f"d{i % 7}") for i in range(300)]


def _map(spark, rows, parts=3):
    return spark.createDataFrame(rows, "path string, digest string").repartition(parts)


def test_a_tree_does_not_depend_on_order_or_partitions(spark, tmp_path):
    merkle.write_tree(_map(spark, MAP, 1), str(tmp_path / "a"), 2)
    merkle.write_tree(_map(spark, MAP[::-1] + [(None, "x")], 7), str(tmp_path / "b"), 2)
    a, b = (merkle.read_tree(spark, str(tmp_path / x)) for x in "ab")
    assert merkle.root(a).first() == merkle.root(b).first() and merkle.root(a).first()["entries"] == 300
    assert merkle.changed_leaves(a, b, 2).count() == 0


def test_one_change_is_found_below_one_path(spark, tmp_path):
    after = [("p5", "other") if p == "p5" else (p, d) for p, d in MAP if p != "p6"] + [("new", None)]
    frames = [_map(spark, MAP), _map(spark, after)]
    for frame, name in zip(frames, "ab", strict=True):
        merkle.write_tree(frame, str(tmp_path / name), 2)
    trees = [merkle.read_tree(spark, str(tmp_path / x)) for x in "ab"]
    assert 1 <= merkle.changed_leaves(*trees, 2).count() <= 3
    assert {tuple(r) for r in merkle.changes(*frames, *trees, 2).collect()} == {("p5", "changed"), ("p6", "removed"), ("new", "added")}


def test_an_empty_map_has_no_nodes_and_depth_is_checked(spark, tmp_path):
    empty = spark.createDataFrame([], "path string, digest string")
    merkle.write_tree(empty, str(tmp_path / "a"), 1)
    merkle.write_tree(_map(spark, MAP[:2]), str(tmp_path / "b"), 1)
    a, b = (merkle.read_tree(spark, str(tmp_path / x)) for x in "ab")
    assert a.count() == 0
    assert {r["change"] for r in merkle.changes(empty, _map(spark, MAP[:2]), a, b, 1).collect()} == {"added"}
    with pytest.raises(ValueError):
        merkle.write_tree(empty, str(tmp_path / "c"), 0)
