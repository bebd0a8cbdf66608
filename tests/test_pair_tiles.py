"""Tiles of matrix products equal pair-by-pair least squares; batched unit-root tests equal single ones."""

import datetime as dt

import numpy as np
import pytest

from tickloom.operators import pairs as pr


def test_batched_unit_roots_equal_single_ones():
    rng = np.random.default_rng(3)
    resid = np.cumsum(rng.normal(size=(25, 260)), axis=1) * rng.uniform(0.1, 1, (25, 1)) + rng.normal(size=(25, 260))
    assert pr.unit_root_taus(resid) == pytest.approx([pr.unit_root_tau(r) for r in resid], rel=1e-8)
    with_flat = np.vstack([resid[:2], np.zeros(260)])
    got = pr.unit_root_taus(with_flat)
    assert got[:2] == pytest.approx([pr.unit_root_tau(r) for r in resid[:2]], rel=1e-8) and np.isnan(got[2])


@pytest.mark.parametrize("tiles", [None, 1, 7])
def test_tiles_equal_pairs(spark, tiles):
    rng = np.random.default_rng(5)
    d0, prices, rows = dt.date(2022, 1, 1), {}, []
    for i in range(9):
        x = np.exp(np.cumsum(rng.normal(0, 0.02, 300)) + 4)
        keep = np.sort(rng.choice(300, 300 if i < 5 else 240, replace=False))
        prices[f"s{i}"] = {int(t): float(x[t]) for t in keep}
    prices["flat"] = {t: 7.0 for t in range(300)}
    prices["short"] = {t: 7.0 + t for t in range(50)}
    for s, series in prices.items():
        rows += [(s, d0 + dt.timedelta(days=t), v) for t, v in series.items()]
    df = spark.createDataFrame(rows, "symbol string, date date, close double")
    got = {(r["symbol_a"], r["symbol_b"]): r for r in pr.pair_statistics(df, tiles).collect()}
    names = sorted(prices)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            days = sorted(prices[a].keys() & prices[b].keys())
            if len(days) < 200 or b == "flat":
                assert (a, b) not in got
                continue
            x, y = (np.log([prices[s][t] for t in days]) for s in (a, b))
            slope = ((x - x.mean()) * (y - y.mean())).sum() / ((y - y.mean()) ** 2).sum()
            icpt = x.mean() - slope * y.mean()
            r = got[a, b]
            assert (r["n_rows"], r["hedge_ratio"], r["intercept"]) == (len(days), pytest.approx(slope, rel=1e-7, abs=1e-9), pytest.approx(icpt, rel=1e-7))
            if a != "flat":
                assert r["p_value"] == pytest.approx(pr.cointegration_p(pr.unit_root_tau(x - icpt - slope * y)), rel=1e-5, abs=1e-9)
