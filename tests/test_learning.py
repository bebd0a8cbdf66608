"""Splits, early stopping, derived-feature search and the gate they pass."""

import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import genes as gn
from tickloom.operators import learning as ml
from tickloom.operators.significance import permutation_p, pooled_permutation_p


def panel(n=400, symbols=3, seed=5):
    rng = np.random.default_rng(seed)
    days = pd.bdate_range("2001-01-01", periods=n)
    parts = []
    for k in range(symbols):
        x = rng.normal(size=(n, 3))
        parts.append(pd.DataFrame({"symbol": f"s{k}", "date": days.date, "f1": x[:, 0], "f2": x[:, 1], "f3": x[:, 2], "future_return": x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=n)}))
    return pd.concat(parts).assign(label=lambda d: (d["future_return"] > 0).astype(float))


def test_split_has_four_parts_in_order_of_time(spark):
    got = ml.with_split(spark.createDataFrame(panel())).groupBy("split").agg(F.min("date").alias("a"), F.max("date").alias("b"), F.count_distinct("date").alias("n"))
    rows = {r["split"]: r for r in got.collect()}
    assert {k: r["n"] for k, r in rows.items()} == {"train": 320, "es": 20, "meta": 20, "oos": 40}
    assert rows["train"]["b"] < rows["es"]["a"] and rows["es"]["b"] < rows["meta"]["a"] and rows["meta"]["b"] < rows["oos"]["a"]


def test_early_stopping_stops_and_scaling_ignores_the_other_rows(spark):
    rng = np.random.default_rng(2)
    noise = panel().assign(label=lambda d: rng.integers(0, 2, len(d)).astype(float))
    rows = ml.with_split(spark.createDataFrame(noise))
    stopped = ml.fit_split(rows, ["f1", "f2", "f3"], ml.gbt(max_iter=12))
    assert len(stopped.stages[-1].trees) < 12
    fitted_alone = ml.fit_classifier(rows.filter("split = 'train'"), ["f1", "f2", "f3"], ml.gbt(max_iter=2))
    assert stopped.stages[1].mean == fitted_alone.stages[1].mean


def test_planted_difference_is_found_and_passes_the_gate(spark):
    df = spark.createDataFrame(panel(300))
    train, val = df.filter("date < '2001-10-01'"), df.filter("date >= '2001-10-01'")
    for pooled in (True, False):
        search = gn.Evolver(population=8, generations=2, top_k=3, pooled=pooled)
        part = (train, val) if pooled else tuple(d.filter("symbol = 's0'") for d in (train, val))
        kept = search.validated(*part, ["f1", "f2", "f3"], n_candidates=4, n_permutations=200)
        assert kept and all(p <= 0.05 / 4 for _, _, p in kept)


def test_gate_that_nothing_can_pass_is_refused(spark):
    with pytest.raises(ValueError):
        gn.Evolver().validated(spark.createDataFrame(panel(40)), None, ["f1"], n_permutations=200)


def test_recipes(spark):
    df = spark.createDataFrame(panel(30, 1))
    recipes = [gn.Recipe(op, "f1", "f2" if o.arity == 2 else None) for op, o in gn.OPERATIONS.items()] + [gn.Recipe("diff", "f1", "absent")]
    got = gn.apply_genes(df, recipes).orderBy("date").toPandas()
    np.testing.assert_allclose(got["evolved_f1_diff_f2"], got["f1"] - got["f2"])
    np.testing.assert_allclose(got["evolved_rolling_mean_5_f1"], got["f1"].rolling(5, min_periods=1).mean())
    assert (got["evolved_f1_diff_absent"] == 0).all()


def test_pooled_permutation_of_one_series_equals_the_plain_one(spark):
    df = spark.createDataFrame(panel(80, 1)).withColumn("gene", F.lit("g"))
    plain = permutation_p(df, ["gene"], "date", "f3", "future_return", 150, 5).first()["p_value"]
    pooled = pooled_permutation_p(df, ["gene"], ["symbol"], "date", "f3", "future_return", 150, 5).first()["p_value"]
    assert plain == pytest.approx(pooled)


def test_ticks_are_not_sorted_before_they_are_aggregated(spark):
    from tickloom.sources import tables as tb

    for build in (tb.bars_daily, tb.bars_intraday, tb.bars_panel):
        plan = build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan


@pytest.fixture()
def together(monkeypatch):
    """Fits wait for each other: a fold that is fitted after another one has ended breaks the barrier."""

    def of(n, name):
        meet, fit = threading.Barrier(n), getattr(ml, name)

        def waiting(*a, **k):
            meet.wait(60)
            return fit(*a, **k)

        monkeypatch.setattr(ml, name, waiting)

    return of


def in_turn(monkeypatch, run):
    """The rows of a run with its folds side by side are those of a run one by one."""
    got = sorted(map(tuple, run().collect()))
    monkeypatch.undo()
    monkeypatch.setattr(ml, "FOLDS_AT_ONCE", 1)
    assert got == sorted(map(tuple, run().collect())) and got


def test_validation_folds_are_fitted_side_by_side(spark, monkeypatch, together):
    rows = spark.createDataFrame(panel(120))
    together(3, "fit_stopping")
    in_turn(monkeypatch, lambda: ml.time_series_cv(rows, ["f1", "f2", "f3"], 3, ml.linear(5)))


def test_walk_forward_folds_are_fitted_side_by_side(spark, monkeypatch, together):
    rows = spark.createDataFrame(panel(120).assign(close=100.0))
    together(3, "fit_stopping")
    in_turn(monkeypatch, lambda: ml.walk_forward(rows, ["f1", "f2", "f3"], 3, ml.linear(5)))


def test_flow_folds_are_fitted_side_by_side(spark, monkeypatch, together):
    rng = np.random.default_rng(1)
    days = pd.bdate_range("2001-01-01", periods=420).date
    prices = spark.createDataFrame(pd.concat(pd.DataFrame({"symbol": s, "date": days, "close": 100 + rng.normal(size=420).cumsum()}) for s in "ab"))
    flows = spark.createDataFrame(pd.DataFrame({"date": days, "dii_net_index_future": rng.normal(size=420)}))
    together(2, "fit_classifier")
    in_turn(monkeypatch, lambda: ml.flow_ml_run(prices, flows, 2, classifier=ml.linear(5)).folds)


def test_small_partitions_are_merged_and_large_ones_kept(spark, monkeypatch):
    rows = spark.range(0, 1000, 1, 16)
    assert ml.few_tasks(rows).rdd.getNumPartitions() == 1 and ml.few_tasks(rows).count() == 1000
    monkeypatch.setattr(ml, "ROWS_A_TASK", 10)
    assert ml.few_tasks(rows).rdd.getNumPartitions() == 16
