"""Streams equal their batch twins and resume strictly after what was processed."""

import datetime as dt

import numpy as np
import pandas as pd

from tickloom.operators.flow import concurrent_trades
from tickloom.operators.regimes import with_hysteresis
from tickloom.streaming import stateful as ss
from tickloom.streaming.accounts import Account, AccountRules
from tickloom.streaming.runner import drain, file_stream

DAYS = "symbol string, date date, close double, signal boolean"


def day_rows(n, seed=0):
    rng = np.random.default_rng(seed)
    d0 = dt.date(2022, 1, 1)
    return [(s, d0 + dt.timedelta(days=i), float(c), bool(f)) for s in ("a", "b") for i, (c, f) in enumerate(zip(rng.uniform(90, 110, n), rng.random(n) < 0.5))]


def test_tranches_resume_and_equal_the_batch(spark, tmp_path):
    rows = day_rows(120)
    src, chk, out = (str(tmp_path / x) for x in ("src", "chk", "out"))
    half = rows[0][1] + dt.timedelta(days=60)
    frame = spark.createDataFrame(rows, DAYS)
    frame.filter(frame.date < half).coalesce(1).write.mode("append").parquet(src)
    first = drain(ss.stream_tranches(file_stream(spark, src, DAYS), 5, 3), chk, out).count()
    frame.filter(frame.date >= half - dt.timedelta(days=3)).coalesce(1).write.mode("append").parquet(src)  # three days land twice
    got = drain(ss.stream_tranches(file_stream(spark, src, DAYS), 5, 3), chk, out).toPandas()
    want = concurrent_trades(frame, ["symbol"], "signal", 5, (5,), 3, count_on_entry_day=True).toPandas()
    key = ["symbol", "signal_date", "entry_date", "exit_date"]
    assert 0 < first < len(got)
    a, b = (x.sort_values(key).reset_index(drop=True) for x in (got, want))
    assert a[key].astype(str).equals(b[key].astype(str))


def test_regime_stream_equals_windows(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [("x", dt.date(2022, 1, 1) + dt.timedelta(days=i), str(c)) for i, c in enumerate(rng.choice(["p", "q"], 100))]
    df = spark.createDataFrame(rows, "symbol string, date date, candidate string")
    df.coalesce(1).write.parquet(str(tmp_path / "s"))
    got = drain(ss.stream_regimes(file_stream(spark, str(tmp_path / "s"), df.schema), 3)).orderBy("date").toPandas()["regime"]
    want = with_hysteresis(df, ["symbol"], "date", "candidate", 3).orderBy("date").toPandas()["regime"]
    assert got.tolist() == want.tolist()


def test_decisions_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = []
    for a in ("acc1", "acc2"):
        for i in range(80):
            ts = dt.datetime(2024, 1, 1, 9, 15) + dt.timedelta(minutes=5 * i)
            for s in ("u", "v"):
                rows.append((a, ts, s, float(100 + rng.normal() * 2), float(rng.uniform(0.4, 0.95)), str(rng.choice(["BUY", "SELL", "HOLD"])), str(rng.choice(["execute_full", "execute_half", "none"])), 1.0))
    df = spark.createDataFrame(rows, "account string, ts timestamp, symbol string, price double, confidence double, action string, execution string, multiplier double")
    df.coalesce(1).write.parquet(str(tmp_path / "s"))
    key = ["account", "symbol", "entry_time", "exit_time"]
    got = drain(ss.stream_decisions(file_stream(spark, str(tmp_path / "s"), df.schema))).toPandas().sort_values(key).reset_index(drop=True)
    want = ss.batch_decisions(df).toPandas().sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)
    assert len(got) > 0 and (pd.to_datetime(got["exit_time"]).dt.hour < 16).all()


def test_account_halts_for_the_day_and_resets():
    acct = Account(AccountRules(capital=100_000.0, daily_loss=0.0005))
    t = lambda h, m, d=1: pd.Timestamp(2024, 1, d, h, m)
    assert acct.step(t(10, 0), "s", 100.0, 0.9, "BUY", "execute_full", 1.0) == []
    assert "s" in acct.open
    closed = acct.step(t(10, 5), "s", 98.0, 0.9, "BUY", "execute_full", 1.0)
    assert closed[0][7] == "stop_loss" and acct.halted and not acct.open
    assert acct.step(t(10, 10), "s", 98.0, 0.9, "BUY", "execute_full", 1.0) == [] and not acct.open
    acct.step(t(10, 0, 2), "s", 98.0, 0.9, "BUY", "execute_full", 1.0)
    assert "s" in acct.open and not acct.halted
    assert Account(acct.r, acct.doc()).doc() == acct.doc()
    assert acct.step(t(15, 15, 2), "s", 98.5, 0.9, "BUY", "execute_full", 1.0)[0][7] == "square_off"
