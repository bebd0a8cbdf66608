"""Feature library: recursion across chunks, masks, causality."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tickloom.operators import features as ft
from tickloom.operators.regimes import with_hysteresis


def walk(n, symbol="x", seed=42):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    d0 = dt.date(2000, 1, 3)
    return pd.DataFrame(
        {
            "symbol": symbol, "date": [d0 + dt.timedelta(days=i) for i in range(n)], "open": close * 0.999, "high": close * 1.01,
            "low": close * 0.99, "close": close, "volume": rng.integers(1000, 5000, n).astype(float), "turnover": close * 1000,
        }
    )


@pytest.fixture(scope="module")
def long_series():
    return walk(3 * ft.CHUNK + 37)


def test_smoothing_equals_the_recursion_over_chunk_borders(spark, long_series):
    got = ft.add_families(spark.createDataFrame(long_series), ["averages", "macd", "rsi"]).orderBy("date").toPandas()
    c = long_series["close"]
    for n in (5, 50):
        np.testing.assert_allclose(got[f"ema_{n}"], c.ewm(span=n, adjust=False).mean(), rtol=1e-11)
    macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    np.testing.assert_allclose(got["macd_signal"], macd.ewm(span=9, adjust=False).mean(), rtol=1e-8, atol=1e-10)
    delta = c.diff()
    g = delta.where(delta > 0, 0).ewm(alpha=1 / 14, adjust=False).mean()
    l = (-delta.where(delta < 0, 0)).ewm(alpha=1 / 14, adjust=False).mean()
    np.testing.assert_allclose(got["rsi_14"].iloc[1:], (100 - 100 / (1 + g / l)).iloc[1:], rtol=1e-9)


def test_flat_and_rising_series(spark):
    up = walk(80)
    up["close"] = np.arange(1.0, 81.0)
    flat = walk(80, "flat")
    for c in ("open", "high", "low", "close"):
        flat[c] = 10.0
    got = ft.add_families(spark.createDataFrame(pd.concat([up, flat])), ["rsi", "order_flow", "momentum", "volume"]).orderBy("date").toPandas()
    assert (got[got["symbol"] == "x"]["rsi_14"].iloc[1:] == 100).all()
    f = got[got["symbol"] == "flat"]
    assert f["rsi_14"].isna().all() and f["stoch_k"].isna().all() and f["return_autocorr_10"].isna().all()
    assert (f["directional_streak"] == 0).all()


def test_features_do_not_look_ahead(spark):
    full = walk(150)
    cut = full.iloc[:120]
    a = ft.feature_frame(spark.createDataFrame(full)).filter("date < '2000-05-02'").orderBy("date").toPandas()
    b = ft.feature_frame(spark.createDataFrame(cut)).orderBy("date").toPandas()
    cols = ft.feature_columns(spark.createDataFrame(full).limit(0)) + ["rsi_14", "adx", "cci", "obv", "bb_squeeze", "volatility_20d"]
    n = min(len(a), len(b))
    for c in cols:
        np.testing.assert_allclose(a[c].iloc[:n].astype(float), b[c].iloc[:n].astype(float), rtol=1e-9, equal_nan=True)


def test_short_series_have_no_features_and_labels_drop_the_tail(spark):
    df = spark.createDataFrame(walk(40))
    assert ft.feature_frame(df).count() == 0
    lab = ft.forward_labels(df, periods=5).toPandas()
    assert len(lab) == 35
    assert set(lab["label"].dropna().unique()) <= {0, 1}
    assert lab.loc[lab["future_return"].abs() <= 0.003, "label"].isna().all()


def test_hysteresis_equals_the_automaton(spark):
    rng = np.random.default_rng(2)
    cand = rng.choice(["a", "b", "c"], 300, p=[0.5, 0.3, 0.2])
    pdf = pd.DataFrame({"k": "k", "t": np.arange(300), "cand": cand})
    for cooldown in (0, 1, 3):
        got = with_hysteresis(spark.createDataFrame(pdf), ["k"], "t", "cand", cooldown).orderBy("t").toPandas()["regime"].tolist()
        cur, pend, n, want = None, None, 0, []
        for c in cand:
            if cur is None or c == cur:
                cur, pend, n = c, None, 0
            else:
                n, pend = (n + 1 if c == pend else 1), c
                if n >= max(cooldown, 1):
                    cur, pend, n = c, None, 0
            want.append(cur)
        assert got == want


@pytest.mark.parametrize("span", [1, 1.5, 3, 50, 200, 1000, 100_000])
def test_smoothing_equals_the_recursion_for_any_alpha(spark, span):
    n = 5000
    series = walk(n)
    s = ft.SeriesSpec()
    layers = ft.smooth(s, 1, {"y": ("close", ft.span_alpha(span))})
    got = ft.apply_layers(s.positions(spark.createDataFrame(series)), layers).orderBy("date").select("y").toPandas()["y"]
    np.testing.assert_allclose(got, series["close"].ewm(span=span, adjust=False).mean(), rtol=1e-9)


def test_alpha_out_of_range_is_refused():
    with pytest.raises(ValueError):
        ft.smooth(ft.SeriesSpec(), 1, {"y": ("close", 0.0)})
