"""Medians by sketches, chosen factors, and small refusals."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions.scalar import clip
from tickloom.operators import composite, pit, sketches

PANEL = "symbol string, event_time timestamp, close double, volume double"


def _panel(spark, names=30, rows=400, seed=5):
    rng = np.random.default_rng(seed)
    start, out = dt.datetime(2020, 1, 1, 10), []
    for i in range(names):
        # medians crowd around 100, a few lie far off; many equal values
        values = np.round(rng.normal(100 + (i % 5 - 2) * 0.3 + (40 if i % 10 == 0 else 0), 5, rows - i % 2), 1)
        out += [(f"S{i:02d}", start + dt.timedelta(days=k), float(v), 1.0) for k, v in enumerate(values)]
    out += [("NONE", start, None, 1.0), ("NAN", start, math.nan, 1.0), ("ONE", start, 100.0, 1.0)]
    return spark.createDataFrame(out, PANEL)


@pytest.mark.parametrize("k", [64, 1024])
@pytest.mark.parametrize("least", [99.7, 100.0, 140.0, 500.0])
def test_sketches_name_what_medians_name(spark, k, least):
    panel = _panel(spark)
    kept = sketches.monthly_sketches(panel, k=k)
    got = sketches.liquid_names(kept, panel, least, k=k).collect()
    exact = panel.where("close is not null").groupBy("symbol").agg(F.median(F.col("close") * F.col("volume")).alias("m"))
    assert sorted(r["symbol"] for r in got) == sorted(r["symbol"] for r in exact.where(F.col("m") >= least).collect())


def test_far_names_need_no_bars(spark):
    panel = _panel(spark)
    decided = {r["symbol"]: r["decided"] for r in sketches.liquid_names(sketches.monthly_sketches(panel), panel, 120.0).collect()}
    assert decided["S00"] == "sketch" and decided["S10"] == "sketch"


def test_the_most_liquid_of_whole_months(spark):
    panel = _panel(spark)
    kept = sketches.monthly_sketches(panel)
    window = panel.where("event_time >= '2020-03-01' and event_time < '2020-06-01' and close is not null")
    exact = window.groupBy("symbol").agg(F.median(F.col("close") * F.col("volume")).alias("m")).orderBy(F.desc("m"), "symbol").limit(7)
    got = sketches.most_liquid(kept, panel, 7, "2020-03-20", "2020-05-02")
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in exact.collect()]
    assert sketches.most_liquid(kept, panel, 5, "2030-01-01").count() == 0


def test_a_sketch_too_small_is_refused(spark):
    with pytest.raises(ValueError):
        sketches.monthly_sketches(_panel(spark, 1, 2), k=8)


def test_factors_are_chosen_by_their_signals(spark):
    rows = [(1.0, None, 2.0 if i % 10 == 0 else None, math.nan) for i in range(100)]
    wide = spark.createDataFrame(rows, "a double, b double, c double, d double")
    assert composite.covered_factors(wide, ["c", "b", "a", "d"]) == ["c", "a"]
    assert composite.covered_factors(wide, ["a", "b", "c", "d"], 0.25) == ["a"]
    assert {r["factor"] for r in composite.skipped_factors(wide, ["a", "b", "c", "d"]).collect()} == {"b", "d"}
    assert composite.covered_factors(wide.limit(0), ["a"]) == []


def test_future_returns_are_refused_in_scores(spark):
    scored = spark.createDataFrame([("A", 1.0, 0.1)], "symbol string, signal double, fwd_5 double")
    with pytest.raises(ValueError, match="fwd_5"):
        pit.refuse_forward_columns(scored)
    assert pit.refuse_forward_columns(scored.drop("fwd_5")).columns == ["symbol", "signal"]


def test_clip_keeps_nulls(spark):
    rows = spark.createDataFrame([(None,), (-5.0,), (0.5,), (7.0,)], "x double")
    assert [r[0] for r in rows.select(clip(F.col("x"), -1.0, 1.0)).collect()] == [None, -1.0, 0.5, 1.0]
