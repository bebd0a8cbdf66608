"""The named jobs run end to end on the smallest tables; their results equal the operators' own, computed apart."""

import pytest
from pyspark.sql import functions as F

from tickloom import jobs
from tickloom.operators import factors, flow, risk
from tickloom.session import cut_lineage
from tickloom.sources import tables as tb

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    bars = cut_lineage(tb.bars_daily(spark, SF))
    days = bars.select("symbol", "date", "close", (F.dayofmonth("date") % 3 == 0).alias("signal"))
    intraday = cut_lineage(tb.bars_intraday(spark, SF))
    return {"bars": bars, "intraday": intraday, "benchmark": tb.benchmark_daily(spark, SF), "oi": tb.participant_oi(spark, SF), "days": days}


def same(a, b):
    a, b = ([str(r) for r in df.select(*sorted(df.columns)).collect()] for df in (a, b))
    return len(a) > 0 and sorted(a) == sorted(b)


def test_every_mode_has_a_job():
    assert len(jobs.JOBS) == 20 and jobs.dead_zone() >= 0.01
    assert len(set(jobs.JOBS.values())) == 20


def test_stress_job(inputs):
    got = jobs.stress_test(inputs)
    assert same(got["results"], risk.stress_test(inputs["bars"]))
    rows = got["results"].collect()
    worst = got["worst_case"].first()
    known = [r["worst_day_return_pct"] for r in rows if r["data_available"]]
    assert worst["data_available"] == bool(known) and worst["worst_return_pct"] == min(known, default=None)
    assert worst["n_symbols_with_no_data"] == len({r["symbol"] for r in rows if not r["data_available"]})


def test_opening_range_job_covers_whole_sessions(inputs):
    rows = jobs.orb_test(inputs)["reports"].collect()
    assert rows and all(r["total_trades"] == r["winning_trades"] + r["losing_trades"] > 0 for r in rows)
    sessions = inputs["intraday"].select("symbol", "session_date").distinct().count()
    assert sum(r["total_trades"] for r in rows) <= sessions * len(rows)


def test_flow_jobs(inputs):
    got = jobs.flow_test(inputs)["reports"]
    assert same(got, flow.flow_backtest(inputs["bars"], flow.net_positioning(inputs["oi"]), jobs.CAPITAL))
    trades = jobs.flow_paper(inputs)["closed_trades"].collect()
    closes = {(r["symbol"], r["date"]): r["close"] for r in inputs["bars"].collect()}
    assert len(trades) > 100
    assert all(r["exit_date"] > r["entry_date"] and r["entry_price"] == closes[r["symbol"], r["entry_date"]] for r in trades)


def test_intraday_baseline_trades_only_the_last_tenth_of_dates(inputs):
    got = jobs.intraday_baseline(inputs)
    metrics = {r["split"]: r["n"] for r in got["metrics"].collect()}
    assert set(metrics) == {"train", "es", "meta", "oos"} and metrics["train"] > 6 * metrics["oos"]
    assert all(r["total_trades"] > 0 for r in got["reports"].collect())


def test_midcap_jobs_pay_for_impact(spark):
    assert jobs.MIDCAP_COSTS.slippage_pct == 0.006
    bars = cut_lineage(tb.bars_panel(spark, "/root/testdata/sf0.01"))
    rate = {}
    for name, costs in (("impact", jobs.MIDCAP_COSTS), ("plain", jobs.DEFAULT_COSTS)):
        rows = factors.staggered_backtest(bars, costs=costs).collect()
        rate[name] = sum(r["total_cost_drag_pct"] for r in rows)
    assert rate["impact"] > 3 * rate["plain"] > 0
