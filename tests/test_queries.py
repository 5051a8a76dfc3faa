"""Registered queries against their SQL equivalents.

A spread of queries by default; all of them with ``ALL_QUERIES=1``.
"""

import os

import pytest

import __spark_entry__ as entry
from tools.check_queries import compare, connect

DATA = "/root/testdata/sf0.001"
SPREAD = [
    "sig1_ta_signals", "sig3_tech_scores", "sig4_decisions", "ds4_uniqueness", "ds6_walk_forward", "ds1_window_last",
    "join1_band_join", "join3_asof_funding", "agg1_monthly_performance", "agg18_roc_auc", "pos2_pos3_pair_trades",
    "pos9_drawdown", "src8_time_bars_one_hour", "src13_log_records", "out2_join13_resolve_outcomes", "ml3_ml4_ml5_regimes",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(entry.queries()) if os.environ.get("ALL_QUERIES") else SPREAD)
def test_query_matches_sql(spark, con, name):
    text, _, _, ok = compare(spark, con, DATA, name)
    assert ok, text


def test_entry_and_registry(spark):
    assert entry.entry(spark).limit(5).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
