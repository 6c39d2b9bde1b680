"""A query that reads a costly table in several branches computes it once."""

import pytest

from tickloom.plans import REGISTRY

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["l7_book_weights", "rk7_halt", "rk7_reconciliation", "rk9_alerts"])
def test_the_ledger_runs_once(spark, name):
    df = REGISTRY[name].run(spark, FOLDER)
    plan = df._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" in plan and "_episode" not in plan.split("InMemoryRelation")[0]
    assert df.count()
    spark.catalog.clearCache()


def test_bar_files_are_written_by_many_tasks(spark, monkeypatch):
    from pathlib import Path

    from tickloom import session
    from tickloom.plans import storage

    monkeypatch.setattr(storage, "_made", {})
    # so small a table would be packed into one task
    monkeypatch.setitem(session.DEFAULTS, "spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert REGISTRY["st1_bar_ingest"].run(spark, FOLDER).count()
    made = Path(storage._made[(spark.sparkContext.applicationId, FOLDER, "bar-files")].removeprefix("file:"))
    assert max(sum(1 for _ in made.glob(f"file={k}/*.parquet")) for k in range(4)) > 1
    monkeypatch.undo()
    session.configure(spark)


def test_versions_are_read_once_a_batch():
    import numpy as np
    import pandas as pd

    from tickloom.streaming.jobs import _Versions

    calls = []

    class Value:
        def __init__(self, kept=None):
            self.kept = kept

        def __getattr__(self, name):  # of a map or a list too: every call counts
            return lambda *args: calls.append(name)

        def exists(self):
            calls.append("exists")
            return self.kept is not None

        def get(self):
            calls.append("get")
            return self.kept

        def update(self, value):
            calls.append("update")
            self.kept = value

    class Handle:
        def __getattr__(self, name):
            return lambda *args: Value()

    processor = _Versions(86400.0)
    processor.init(Handle())
    frame = pd.DataFrame({"at__": np.arange(500) * 1_000_000, "version__": np.arange(500), "violation": [None] * 500})
    for expected in ("new", "repeat"):
        out = list(processor.handleInputRows(("A",), iter([frame]), None))
        assert set(out[0]["violation"]) == {expected}
    assert len(calls) <= 6
