"""Registered queries against their SQL twins on the smallest tables.

``python tests/compare.py`` runs all of them on any scale.
"""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import differences, oracle_connection

FOLDER = "/root/testdata/sf0.001"
CHECKED = [
    "r1_reversal_ic", "k16_downside_beta", "r9_orthogonalised", "a2_universe_schedule", "j1_resolve_symbols",
    "j6_asof_scores", "c4_inferred_splits", "q1_quality_findings", "pf_summary", "ts1_hurst", "x2_ledoit_wolf",
    "co1_nse_delivery", "l2_positions", "l6_equity_curve", "rk4_verdicts", "po9_evaluation", "g6_overfitting_probability",
    "s15_vendor_bars", "e2_period_mismatches", "st2_tick_bars", "st1_bar_ingest", "x9_leaf_order", "x9_hierarchical_weights", "ts3_fixed_order",
    "ts4_kpss", "w3_falling_market_means", "p4_liquid_by_sketch", "a10_most_liquid_by_sketch", "f8_number_functions", "p12_signals_alone",
    "s17_merkle_tree", "s17_merkle_changes", "r8_skipped_factors",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    expected = oracle_connection(FOLDER).execute(entry.oracle_sql()[name]).df()
    assert differences(got, expected) == []


def test_entry_runs(spark):
    row = entry.entry(spark).first()
    assert row["sessions"] == 891


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
