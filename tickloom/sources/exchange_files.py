"""Folders of daily exchange files as a Spark data source, batch and stream, and their resumable ingest.

``spark.read.format("exchange_files")`` gives the rows of every file as text and, after the rows of
a file, one outcome row of that file, so one pass yields both the data and the report.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tickloom.session import shared_folder
from tickloom.sources.bars import NoDataError, PanelStore
from tickloom.sources.feeds import LAYOUTS, RAW, bhavcopy_bars, daily_rows

FORMAT = "exchange_files"
ENDINGS = (".csv", ".zip")
#: A task reads files up to so many bytes, each counted with the cost of opening it.
TASK_BYTES = 128 * 1024 * 1024
OPEN_BYTES = 4 * 1024 * 1024
SCHEMA = "path string, session date, status string, file_rows bigint, problem string, " + ", ".join(f"{c} string" for c in RAW)
_ARROW = pa.schema(
    [("path", pa.string()), ("session", pa.date32()), ("status", pa.string()), ("file_rows", pa.int64()), ("problem", pa.string())]
    + [(c, pa.string()) for c in RAW]
)


def session_of(name: str) -> dt.date | None:
    """Session date of a file name, by the rule of ``feeds.date_from_name``."""
    iso = re.search(r"(?:19|20)\d{6}", name)
    legacy = re.search(r"\d{2}[A-Z]{3}(?:19|20)\d{2}", name, re.IGNORECASE)
    for found, pattern in ((iso, "%Y%m%d"), (legacy, "%d%b%Y")):
        try:
            if found:
                return dt.datetime.strptime(found.group().title(), pattern).date()
        except ValueError:
            continue
    return None


def _opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if re.match(r"file:/[^/]", path):  # as Hadoop writes local paths
        path = path[len("file:") :]
    return arrow_fs.FileSystem.from_uri(path)


def _listed(folder: str) -> list[tuple[str, int, int]]:
    """Name below the folder, bytes and time of change (ns) of every daily file, in order of names."""
    files, base = _opened(folder)
    out = []
    for info in files.get_file_info(arrow_fs.FileSelector(base, recursive=True)):
        name = info.path[len(base) :].lstrip("/")
        hidden = any(part[:1] in "._" for part in name.split("/"))
        if info.is_file and not hidden and name.lower().endswith(ENDINGS):
            out.append((name, info.size, info.mtime_ns or 0))
    return sorted(out)


class Files(InputPartition):
    """Files of one task: name, session, and whether the session is stored already."""

    def __init__(self, files: list[tuple[str, dt.date | None, bool]]) -> None:
        super().__init__(None)
        self.files = files


def _packed(listed: list[tuple[str, int, int]], stored: set[str]) -> list[Files]:
    """Neighbouring files as tasks of like size; a file is never cut."""
    out, room = [], 0
    for name, size, _ in listed:
        session = session_of(name.split("/")[-1])
        known = session is not None and f"{session:%Y%m%d}" in stored
        cost = OPEN_BYTES // 64 if known else OPEN_BYTES + size
        if not out or cost > room:
            out.append([])
            room = TASK_BYTES
        out[-1].append((name, session, known))
        room -= cost
    return [Files(x) for x in out]


def _batch(name: str, session: dt.date | None, columns: dict[str, list], n: int) -> pa.RecordBatch:
    values = {"path": [name] * n, "session": [session] * n} | columns
    arrays = [pa.array(values[f.name], f.type, from_pandas=True) if f.name in values else pa.nulls(n, f.type) for f in _ARROW]
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def _read(folder: str, part: Files | None) -> Iterator[pa.RecordBatch]:
    if part is None:  # how Spark asks for the rows of no partition
        return
    files, base = _opened(folder)
    for name, session, known in part.files:
        outcome: dict[str, list] = {"status": ["skipped"]}
        if not known:
            try:
                if session is None:
                    raise ValueError("no date in its name")
                with files.open_input_file(f"{base.rstrip('/')}/{name}") as stream:
                    rows = daily_rows(stream.read())
                yield _batch(name, session, {c: rows[c].tolist() for c in RAW}, len(rows))
                outcome = {"status": ["ok"], "file_rows": [len(rows)]}
            except FileNotFoundError:
                outcome = {"status": ["failed"], "problem": ["FileNotFoundError"]}
            except OSError:  # storage, not the file: the task is tried again
                raise
            except Exception as problem:  # a bad file is reported, the rest goes on
                outcome = {"status": ["failed"], "problem": [type(problem).__name__]}
        yield _batch(name, session, outcome, 1)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.stored = set(filter(None, options.get("stored", "").split(",")))

    def partitions(self) -> list[Files]:
        return _packed(_listed(self.folder), self.stored)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _read(self.folder, partition)


class _Stream(DataSourceStreamReader):
    """Files in the order of their times of change; an offset is a time of change.

    Files that are younger than ``settle`` seconds (0 if not given) wait for a later batch, for
    storage whose clocks are too coarse to tell files of one moment apart.
    """

    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.settle = int(float(options.get("settle", "0")) * 1e9)

    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        until = int(dt.datetime.now(dt.timezone.utc).timestamp() * 1e9) - self.settle
        return {"changed": max((at for _, _, at in _listed(self.folder) if not self.settle or at <= until), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return _packed([f for f in _listed(self.folder) if start["changed"] < f[2] <= end["changed"]], set())

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _read(self.folder, partition)


class ExchangeFiles(DataSource):
    """Daily files below ``path``; sessions in ``stored`` (yyyymmdd, comma-joined) are reported as skipped and not opened.

    A file is one session of one exchange and is read whole by its task; small files share a task.
    A file that can't be read as a daily file gives one ``failed`` row, an empty folder no row.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ExchangeFiles)


def _bytes_of(rows: pd.DataFrame, broken: bool, name: str) -> bytes:
    if broken:
        text = "no,known,layout\n1,2,3\n"
    else:
        layout = LAYOUTS[0] if name.endswith(".zip") else LAYOUTS[1]
        text = rows[list(layout)].rename(columns=layout).to_csv(index=False)
    if not name.endswith(".zip"):
        return text.encode()
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(name[: -len(".zip")], text)
    return packed.getvalue()


def write_daily_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write text rows as one daily file per ``file``; zipped ones take the legacy layout.

    Nothing is written before the result, a row per file, is asked for.  A file with ``broken``
    rows gets another layout, as an export that went wrong.  A repeated task writes the same bytes again.
    """

    def put(frame: pd.DataFrame) -> pd.DataFrame:
        files, base = _opened(folder)
        name = frame["file"].iat[0]
        files.create_dir(base, recursive=True)
        ordered = frame.sort_values(["isin", "symbol"], kind="stable")
        with files.open_output_stream(f"{base.rstrip('/')}/{name}") as out:
            out.write(_bytes_of(ordered, bool(frame["broken"].any()), name))
        return pd.DataFrame({"file": [name], "rows": [len(frame)]})

    return rows.groupBy("file").applyInPandas(put, "file string, rows bigint")


# ---- ingest ---------------------------------------------------------------------------


def _take(panel: PanelStore, read: DataFrame, series: tuple[str, ...]) -> DataFrame:
    """Write the sessions of ``read`` to the panel; the outcome of every file comes back."""
    spark = panel.spark
    stage = shared_folder(spark, "exchange-files")
    read.write.option("compression", "zstd").parquet(stage)  # files are opened once
    staged = spark.read.schema(read.schema).parquet(stage)
    cleaned = staged.where("status is null").withColumns({c: F.trim(c) for c in ("symbol", "series", "isin")} | {"error": F.lit(None)})
    if series:
        cleaned = cleaned.where(F.col("series").isin(*series))
    bars = bhavcopy_bars(cleaned, panel.venue, keep=("path", "session"))
    counts = bars.groupBy("path", "instrument_id").count().groupBy("path").agg(F.sum("count").alias("bars"), F.max("count").alias("_most"))
    outcomes = staged.where("status is not null").join(counts, "path", "left")
    twice = F.col("_most") > 1
    read_well = F.when(twice, "failed").when(F.col("bars").isNull() & (F.col("status") == "ok"), "empty").otherwise(F.col("status"))
    judged = outcomes.select(
        "path", "session", read_well.alias("status"), F.coalesce("bars", F.lit(0)).alias("bars"),
        F.when(twice, "repeated instrument").otherwise(F.col("problem")).alias("problem"),
    )
    last = judged.where("status = 'ok'").groupBy("session").agg(F.max("path").alias("_last"))
    final = judged.join(last, "session", "left").select(
        "path", "session", F.when((F.col("status") == "ok") & (F.col("path") != F.col("_last")), "replaced").otherwise(F.col("status")).alias("status"),
        "bars", "problem",
    )
    kept = final.where("status = 'ok'").select("path")
    panel.write(bars.join(kept, "path", "left_semi").drop("path", "session"))
    return final


def ingest_folder(panel: PanelStore, folder: str, series: tuple[str, ...] = ("EQ",), refetch: bool = False) -> DataFrame:
    """Bring a folder of daily files into the panel; one row per file comes back.

    Sessions that the panel holds are ``skipped`` unless ``refetch``, so an interrupted
    backfill goes on where it stopped.  A file without a date in its name, of no known
    layout, or with an instrument twice ``failed``; one without a sound bar is ``empty``.
    Of two good files of one session the later by name counts, the other is ``replaced``.
    """
    register(panel.spark)
    stored = ""
    if not refetch:
        try:  # as many dates as the calendar has
            stored = ",".join(f"{r['session_date']:%Y%m%d}" for r in panel.sessions().collect())
        except NoDataError:
            pass
    read = panel.spark.read.format(FORMAT).option("path", folder).option("stored", stored).load()
    return _take(panel, read, series)


def follow_folder(panel: PanelStore, folder: str, outcomes: str, checkpoint: str, series: tuple[str, ...] = ("EQ",), settle: float = 0):
    """A stream that brings files into the panel as they come; outcomes are written below ``outcomes``, one folder a batch.

    A session that comes again replaces what is stored, so a batch that is repeated after a failure changes nothing.
    """
    register(panel.spark)
    source = panel.spark.readStream.format(FORMAT).option("path", folder).option("settle", str(settle)).load()

    def take(batch: DataFrame, number: int) -> None:
        _take(panel, batch, series).write.mode("overwrite").parquet(f"{outcomes}/batch={number}")

    return source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
