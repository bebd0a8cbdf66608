"""Jobs that compose models, folds and recalibration, end to end on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from tickloom import jobs
from tickloom.operators import journal, learning, regimes
from tickloom.operators.genes import Evolver
from tickloom.session import cut_lineage
from tickloom.sources import tables as tb

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    bars = cut_lineage(tb.bars_daily(spark, SF))
    bench = cut_lineage(tb.benchmark_daily(spark, SF))
    oi = cut_lineage(tb.participant_oi(spark, SF))
    return {"bars": bars, "intraday": cut_lineage(tb.bars_intraday(spark, SF)), "benchmark": bench, "oi": oi, "index_bars": bench.withColumn("symbol", F.lit("index"))}


@pytest.fixture
def small_trees(monkeypatch):
    gbt = learning.gbt
    monkeypatch.setattr(learning, "gbt", lambda *a, **k: gbt(3, 2, 0.1))


def test_walk_forward_job(inputs, small_trees):
    got = jobs.swing_walk_forward(inputs)
    folds = got["folds"].collect()
    assert folds and all(r["winning_trades"] + r["losing_trades"] == r["total_trades"] for r in folds)
    summary = got["summary"].first()
    assert summary["n_folds"] == len(folds) and summary["mean_win_rate"] == pytest.approx(sum(r["win_rate"] for r in folds) / len(folds))


def test_gated_job_trades_trending_regimes_only(inputs, small_trees):
    got = jobs.regime_gated_test(inputs)
    by_regime, by_symbol = got["reports"].collect(), got["by_symbol"].collect()
    assert {r["regime"] for r in by_regime} <= {"bull_trend", "bear_trend"}
    assert sum(r["total_trades"] for r in by_regime) == sum(r["total_trades"] for r in by_symbol)


def test_event_job_counts_its_events(inputs):
    got = jobs.event_drift_test(inputs)
    counts = got["event_counts"].collect()
    assert all(r["train_events"] >= 0 and r["oos_events"] >= 0 and r["split_date"] is not None for r in counts)
    traded = sum(r["total_trades"] for r in got["reports"].where("window = 5").collect())
    assert traded <= sum(r["oos_events"] for r in counts)


def test_passive_and_factor_jobs(inputs):
    got = jobs.passive_benchmarks_test(inputs)
    plans = got["savings_plan"].collect()
    assert plans and all(r["total_invested"] > 0 and r["final_value"] >= 0 for r in plans)
    assert "annualized_sharpe" in got["factors"].columns


def test_model_jobs_name_their_recipes_and_folds(inputs):
    got = jobs.flow_pooled_ml_test(inputs, Evolver(population=4, generations=1))
    folds = got["folds"].orderBy("fold").collect()
    assert [r["fold"] for r in folds] == [0, 1, 2] and all(a["end_date"] == b["start_date"] for a, b in zip(folds, folds[1:], strict=False))
    assert sum(r["n_genes"] for r in folds) == got["recipes"].count()
    pooled = got["pooled"].first()
    assert pooled["portfolio"] == "all" and pooled["benchmark_total_trades"] > 0
    assert got["comparison"].count() >= 1
    assert all(r["recurring"] == (r["n_folds"] > 1) for r in got["recurrence"].collect())


def test_recalibration_only_when_due(spark, inputs):
    state = spark.createDataFrame([("2024-01-20", "x")], "last_run string, verdict string")
    assert not jobs.flow_recalibration_check(inputs | {"state": state}, as_of="2024-02-01")["due"].first()["due"]
    scan = {k: inputs[k] for k in ("oi", "index_bars")} | {"bars": inputs["index_bars"], "state": state}
    got = jobs.flow_recalibration_check(scan, evolver=Evolver(population=4, generations=1, pooled=False), as_of="2024-03-01")
    assert {r["model"] for r in got["models"].collect()} == {"pooled", "single"}
    verdict = got["verdict"].first()
    assert verdict["recommendation"] in ("consider the model", "no change needed", "review candidates")
    assert verdict["symbol"] == "index" and (verdict["winning_model"] is None) == (verdict["recommendation"] != "consider the model")


def test_targets_summary_and_metric_rows(spark):
    df = spark.createDataFrame([("swing",), ("intraday",), ("other",), (None,)], "h string").select("h", regimes.horizon_targets("h").alias("t"))
    assert [tuple(r["t"]) for r in df.collect()] == [regimes.TARGETS[k] for k in ("swing", "intraday", "intraday", "intraday")]
    metrics = spark.createDataFrame([(0.5, 7, "x")], "accuracy double, n long, name string")
    row = journal.metric_rows(metrics, "v1", "2024-01-01").first()
    assert row["metrics"] == {"accuracy": 0.5, "n": 7.0} and row["model_version"] == "v1"
    trades = spark.createDataFrame(
        [("2024-01-01", "CLOSED", 1.0, "b"), ("2024-01-01", "CLOSED", -1.0, "a"), ("2024-01-01", "OPEN", None, "c"), ("2024-01-02", "CLOSED", 0.0, "a")],
        "date string, status string, pnl double, regime string",
    )
    got = sorted(tuple(r) for r in journal.daily_summary(trades).collect())
    assert got == [("2024-01-01", 2, 1, 1, 0.0, "a"), ("2024-01-02", 1, 0, 0, 0.0, "a")]
