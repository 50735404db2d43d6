"""Queries against their SQL on the smallest tables; tests/check.py runs all of them."""
import pytest

import __spark_entry__ as entry
from tests.check import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = (
    "ohlcv_bars dedupe_last features support_resistance condition_scores flagship trade_metrics barrier_reentry_trailing "
    "portfolio_inverse_vol exact_ffill_join asof_macro panel_outer spearman rolling_corr allocation walkforward_folds "
    "impute_median classification_metrics dominant_cycles ar_forecast tensor_long csv_scan feed_items lexicon_sentiment "
    "run_report gated_signals"
).split()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, SF)
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
