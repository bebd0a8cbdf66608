"""Artifacts: what is published loads and scores the same; a failed write leaves the version before it. The train job end to end."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom import artifacts, jobs
from tickloom.operators import events, learning, reports
from tickloom.operators.genes import Evolver
from tickloom.session import cut_lineage, scratch_path
from tickloom.sources import tables as tb

SF = "/root/testdata/sf0.001"


@pytest.fixture
def small_trees(monkeypatch):
    gbt = learning.gbt
    monkeypatch.setattr(learning, "gbt", lambda *a, **k: gbt(3, 2, 0.1))


@pytest.fixture
def rows(spark):
    draw = random.Random(1)
    data = [("s", dt.date(2024, 1, 1) + dt.timedelta(days=i // 3), draw.random(), draw.random(), draw.choice(["bull_trend", "sideways"])) for i in range(300)]
    df = spark.createDataFrame(data, "symbol string, date date, x double, y double, regime string")
    return cut_lineage(df.withColumn("label", (F.col("x") + F.col("y") / 4 > 0.6).cast("double")))


def scores(df):
    return sorted((r["x"], round(r["p_up"], 12)) for r in df.collect())


def test_published_models_score_the_same(spark, rows, small_trees):
    store = artifacts.Store(spark, scratch_path(spark, "store"))
    assert store.current("swing") is None and store.versions("swing") == []
    with pytest.raises(KeyError):
        store.models("swing")
    models = {"general": learning.fit_stopping(rows, ["x", "y"])} | learning.regime_models(rows, ["x", "y"], min_rows=50)
    assert set(models) == {"general", "bull_trend", "sideways"}
    first = store.publish("swing", models, {"recipes": rows.limit(0), "allocation": rows.limit(3)}, {"columns": ["x", "y"]})
    loaded = store.models("swing")
    for k, m in models.items():
        assert scores(learning.score(loaded[k], rows, ["x", "y"])) == scores(learning.score(m, rows, ["x", "y"]))
    assert store.settings("swing") == {"columns": ["x", "y"]}
    assert store.table("swing", "recipes").count() == 0 and store.table("swing", "allocation").count() == 3
    by_regime = artifacts.score_by_regime({k: v for k, v in loaded.items() if k != "sideways"}, rows, ["x", "y"], learning.score)
    assert by_regime.count() == rows.count()
    assert by_regime.where("regime = 'sideways' AND p_up <> p_general").count() == 0 < by_regime.where("regime <> 'sideways' AND p_up <> p_general").count()
    second = store.publish("swing", settings={"n": 2})
    assert store.current("swing") == second and store.versions("swing") == [first, second]
    store.restore("swing", first)
    assert store.current("swing") == first and set(store.models("swing")) == set(models)


def test_failed_write_leaves_the_old_version(spark, rows, small_trees):
    store = artifacts.Store(spark, scratch_path(spark, "store"))
    first = store.publish("a", tables={"t": rows})
    broken = rows.withColumn("z", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        store.publish("a", tables={"t": rows.limit(1), "u": broken})
    assert store.current("a") == first and store.versions("a") == [first] and store.table("a", "t").count() == rows.count()
    with pytest.raises(KeyError):
        store.restore("a", "nothing")


def test_train_job_publishes_what_it_returns(spark, small_trees):
    store = artifacts.Store(spark, scratch_path(spark, "store"))
    got = jobs.train({"bars": cut_lineage(tb.bars_daily(spark, SF))}, store, Evolver(population=6, generations=1))
    table = got["scores"].collect()
    assert {r["model"] for r in table} == set(jobs.SUB_MODELS) and {r["split"] for r in table} == {"es", "meta", "oos"}
    assert all(0 <= r["p_up"] <= 1 for r in table) and len({(r["symbol"], r["date"], r["model"]) for r in table}) == len(table)
    weights = {r["model"]: r["weight"] for r in got["weights"].collect()}
    assert weights["xgboost"] == pytest.approx(0.6) and weights["linear"] + weights["regime"] == pytest.approx(0.4)
    assert sum(r["n"] for r in got["metrics"].collect() if r["split"] == "oos" and r["model"] == "linear") <= len(table)
    assert {"general", "linear", "stacker"} <= set(store.models("swing"))
    assert store.table("swing", "allocation").count() == got["allocation"].count()




def test_pooled_report_and_recurrence(spark):
    draw = random.Random(5)
    trades = [(draw.choice("ab"), dt.date(2024, 1, 1) + dt.timedelta(days=draw.randrange(200)), draw.gauss(0.01, 0.05)) for _ in range(60)]
    df = spark.createDataFrame([*trades, ("c", None, None)], "symbol string, exit_date date, pnl_pct double")
    r = reports.pooled_report(df).first()
    x = [t[2] for t in trades]
    mean = sum(x) / 60
    dev = (sum((v - mean) ** 2 for v in x) / 59) ** 0.5
    year = 60 / ((max(t[1] for t in trades) - min(t[1] for t in trades)).days / 365.25)
    assert (r["total_trades"], r["sharpe_ratio"]) == (60, pytest.approx(mean / dev * year**0.5)) and r["trades_per_year"] == pytest.approx(year)
    lone = reports.pooled_report(df.where("symbol = 'c' OR pnl_pct IS NULL"), ["symbol"])
    assert lone.count() == 0
    verdict = learning.pooled_comparison(df.where("pnl_pct IS NOT NULL"), df.limit(0)).first()
    assert verdict["verdict"] == "does_not_beat_benchmark" and verdict["model_total_trades"] == 60
    recipes = spark.createDataFrame([(0, "x", "y"), (0, "x", None), (1, "x", "z"), (2, "w", None)], "fold int, a string, b string")
    got = {r["feature"]: (r["n_folds"], r["folds"], r["recurring"]) for r in learning.feature_recurrence(learning.recipe_features(recipes)).collect()}
    assert got == {"x": (2, [0, 1], True), "y": (1, [0], False), "z": (1, [1], False), "w": (1, [2], False)}


def test_event_counts_equal_the_events(spark):
    bars, bench = cut_lineage(tb.bars_daily(spark, "/root/testdata/sf0.01")), tb.benchmark_daily(spark, "/root/testdata/sf0.01")
    excess = cut_lineage(events.excess_returns(bars, bench))
    counts = {r["symbol"]: r for r in events.event_counts(excess).collect()}
    found = events.reaction_events(excess).collect()
    assert sum(r["train_events"] + r["oos_events"] for r in counts.values()) == len(found) > 0
    for s, r in counts.items():
        assert r["oos_events"] == sum(e["symbol"] == s and e["date"] >= r["split_date"] for e in found)
