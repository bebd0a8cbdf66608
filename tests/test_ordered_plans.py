"""Block scans must equal a plain ordered walk, also when one key holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators.reports import drawdown_of_series, performance_report
from tickloom.operators.significance import average_rank, bootstrap_sharpe, hash_grid, permutation_p, pooled_rank, spearman_ic, subperiods
from tickloom.plans.ordered import global_rank, mix, running_equity, running_sum


@pytest.fixture(scope="module")
def trades():
    rng = np.random.default_rng(3)
    n = 900
    key = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n))
    day = pd.to_datetime("2020-01-01") + pd.to_timedelta(rng.integers(0, 40, n), unit="D")
    r = rng.normal(0.002, 0.05, n)
    return pd.DataFrame({"k": key, "day": day.date, "id": np.arange(n), "pnl_pct": r, "pnl": r * 1000, "confidence": 1.0})


def test_rank_sum_and_equity_match_a_walk(spark, trades):
    df = spark.createDataFrame(trades)
    ranked = global_rank(df, ["k"], "day", ["id"])
    got = running_equity(running_sum(ranked, ["k"], "day", ["id"], "pnl", "cum"), ["k"], "day", ["id"], "pnl_pct", 100.0).toPandas()
    for k, g in trades.sort_values(["day", "id"]).groupby("k"):
        mine = got[got["k"] == k].sort_values("rn")
        eq = (1 + g["pnl_pct"]).cumprod().to_numpy() * 100
        assert mine["id"].tolist() == g["id"].tolist()
        assert (mine["n_total"] == len(g)).all()
        np.testing.assert_allclose(mine["cum"], g["pnl"].cumsum())
        np.testing.assert_allclose(mine["equity"], eq)
        np.testing.assert_allclose(mine["equity_peak"], np.maximum.accumulate(eq))
        assert mine["is_first"].tolist() == [True] + [False] * (len(g) - 1)


def test_equity_with_a_total_loss_and_a_short_squeeze(spark):
    rows = [("x", 1, 1, 0.5), ("x", 1, 2, -2.0), ("x", 2, 3, 0.5), ("x", 3, 4, -1.5), ("x", 3, 5, -1.0)]
    got = running_equity(spark.createDataFrame(rows, "k string, b int, o int, r double"), ["k"], "b", ["o"], "r").orderBy("o").toPandas()
    eq = np.cumprod(1 + np.array([0.5, -2.0, 0.5, -1.5, -1.0]))
    np.testing.assert_allclose(got["equity"], eq)
    np.testing.assert_allclose(got["equity_peak"], np.maximum.accumulate(eq))


def test_report_edge_cases(spark):
    rows = [("one", 1, 0.1, 10.0), ("wins", 1, 0.1, 10.0), ("wins", 2, 0.2, 20.0), ("mixed", 1, 0.1, 10.0), ("mixed", 2, -0.2, -20.0), ("mixed", 3, 0.1, 0.0)]
    df = spark.createDataFrame(rows, "k string, d int, pnl_pct double, pnl double").withColumn("confidence", F.lit(1.0))
    df = df.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), "d"))
    r = {x["k"]: x for x in performance_report(df, ["k"], "day", ["d"], 1000.0).collect()}
    assert r["one"]["sharpe_ratio"] == 0.0 and r["one"]["calmar_ratio"] == 0.0
    assert r["wins"]["profit_factor"] == float("inf") and r["wins"]["kelly_fraction"] == 0.0
    m = r["mixed"]
    assert (m["winning_trades"], m["losing_trades"]) == (2, 1)
    assert m["max_drawdown_pct"] == pytest.approx(-0.2)
    assert m["max_dd_peak_date"] == "2024-01-02" and m["max_dd_trough_date"] == "2024-01-03"
    assert m["expectancy"] == pytest.approx(2 / 3 * 0.1 - 1 / 3 * 0.2)


def test_drawdown_of_series_takes_first_peak(spark):
    rows = [("s", i, float(v)) for i, v in enumerate([5, 7, 7, 4, 6, 4, 8])]
    got = drawdown_of_series(spark.createDataFrame(rows, "k string, t int, v double"), ["k"], "t", "v").first()
    assert (got["peak_date"], got["trough_date"]) == (1, 3)
    assert got["max_drawdown"] == pytest.approx(-3 / 7)


def test_hash_is_the_same_in_columns_and_numpy(spark):
    got = spark.range(50).select(mix(("id", 1000003), (F.lit(7), 8191), seed=42).alias("h")).toPandas()["h"]
    want = hash_grid(np.arange(50, dtype=np.int64), np.full(50, 7, dtype=np.int64), 42)
    assert got.tolist() == want.tolist()


def test_ranks_with_heavy_ties(spark):
    rng = np.random.default_rng(0)
    v = np.where(rng.random(500) < 0.4, 0.0, rng.normal(size=500).round(1))
    pdf = pd.DataFrame({"g": rng.choice(["p", "q"], 500), "i": np.arange(500), "v": v})
    df = spark.createDataFrame(pdf)
    want = pdf.groupby("g")["v"].rank(method="average")
    for fn in (average_rank, pooled_rank):
        got = fn(df, ["g"], "v", "r").orderBy("i").toPandas()["r"]
        np.testing.assert_allclose(got, want)


def test_permutation_p_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    n, block, reps = 60, 5, 200
    x = rng.normal(size=n)
    y = x * 0.3 + rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"f": "a", "t": np.arange(n), "x": x, "y": y}))
    got = permutation_p(df, ["f"], "t", "x", "y", reps, block, 9).first()["p_value"]
    rx, ry = pd.Series(x).rank().to_numpy(), pd.Series(y).rank().to_numpy()
    seen, hits = abs(np.corrcoef(rx, ry)[0, 1]), 0
    for r in range(1, reps + 1):
        h = hash_grid(np.full(n // block, r, dtype=np.int64), np.arange(n // block, dtype=np.int64), 9)
        order = np.concatenate([np.arange(b * block, b * block + block) for b in np.argsort(h, kind="stable")])
        hits += abs(np.corrcoef(rx, ry[order])[0, 1]) >= seen - 1e-12
    assert got == pytest.approx((hits + 1) / (reps + 1))
    assert spearman_ic(df, ["f"], "x", "y").first()["ic"] == pytest.approx(np.corrcoef(rx, ry)[0, 1])


def test_bootstrap_brackets_the_sharpe_and_subperiods_split_like_linspace(spark):
    rng = np.random.default_rng(1)
    r = rng.normal(0.02, 0.04, 50)
    df = spark.createDataFrame(pd.DataFrame({"s": "m", "t": np.arange(50), "r": r}))
    b = bootstrap_sharpe(df, ["s"], "t", "r", 500).first()
    assert b["ci_low_5pct"] < r.mean() / r.std(ddof=1) * np.sqrt(12) < b["ci_high_95pct"]
    sub = subperiods(df, ["s"], "t", "r", 3).orderBy("bucket").toPandas()
    edges = np.linspace(0, 50, 4, dtype=int)
    assert sub["n_periods"].tolist() == np.diff(edges).tolist()
