"""Registry contract, and a sample of oracles at the smallest scale (tools/check.py runs all of them)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
from check import TABLES, compare

SAMPLE = """features_returns features_rsi features_volume features_momentum labels_dead_zone listing_continuity back_adjusted_bars
    trade_costs journal_cumulative_pnl confidence_calibration orb_backtest flow_rolling_rank regime_hysteresis risk_state stress_test
    savings_plan_summary trade_signals stream_hourly_bars""".split()


def test_names_and_schema(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100
    df = entry.entry(spark)
    assert df.columns[0] == "symbol" and df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf).toPandas()
    assert compare(got, con.execute(entry.oracle_sql()[name]).df()) == "ok"
