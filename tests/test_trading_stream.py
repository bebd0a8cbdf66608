"""The trading stream: session timers, resume, breakers, book and journal."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions.costs import DEFAULT_COSTS, net_pnl
from tickloom.operators import regimes as rg
from tickloom.streaming import runner
from tickloom.streaming import trading as tr
from tickloom.streaming.accounts import AccountRules, _leg


def at(day, hour, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


def row(ts, symbol="s", price=100.0, up=1.0, account="a", vix=15.0, cap=None, by_regime=None, subs=None):
    """With these indicators the regime is sideways, in which both directions are allowed."""
    return (account, ts, symbol, price, [1 - up, up], by_regime, subs, {"nifty_vs_20dma": 1.0, "nifty_vs_50dma": 1.0, "india_vix": vix}, cap)


def run(spark, parts, **options):
    """One micro-batch per part, each in a run of its own."""
    base = runner.scratch_path(spark, "test")
    for rows in parts:
        spark.createDataFrame(rows, tr.ROWS).coalesce(1).write.mode("append").parquet(f"{base}/files")
        stream = runner.file_stream(spark, f"{base}/files", spark.createDataFrame([], tr.ROWS).schema)
        out = runner.drain(tr.stream_trading(stream, **options), f"{base}/chk", f"{base}/sink")
    return out


def lines(journal):
    rows = sorted(journal.collect(), key=lambda r: (r["account"], r["seq"]))
    return [(r["account"], dt.datetime.fromtimestamp(r["ms"] / 1000, dt.UTC).replace(tzinfo=None), r["kind"], r["symbol"], r["reason"]) for r in rows]


def test_positions_close_at_square_off_without_a_further_row(spark):
    """The last row of account a is at noon; only b's rows move the clock, and a's position closes at 15:15 all the same."""
    parts = [[row(at(1, 12)), row(at(1, 12), account="b")], [row(at(1, 15, 30), account="b", up=0.5)]]
    got = lines(run(spark, parts))
    assert [x for x in got if x[0] == "a"] == [("a", at(1, 12), "OPEN", "s", None), ("a", at(1, 15, 15), "CLOSE", "s", "square_off")]
    # before the watermark has passed 15:15 nothing closes
    early = lines(run(spark, [parts[0], [row(at(1, 15, 20), account="b", up=0.5)]]))
    assert [x[2] for x in early if x[0] == "a"] == ["OPEN"]


def test_next_day_closes_yesterday_and_resets(spark):
    parts = [[row(at(1, 10), price=100.0)], [row(at(2, 10), price=50.0)], [row(at(2, 10, 5), price=50.0)]]
    got = run(spark, parts)
    assert [x[1:] for x in lines(got)] == [
        (at(1, 10), "OPEN", "s", None), (at(1, 15, 15), "CLOSE", "s", "square_off"), (at(2, 10), "OPEN", "s", None),
    ]
    closed = got.where("kind = 'CLOSE'").first()
    assert closed["price"] == 100.0 and closed["open_positions"] == 0


def test_no_entry_after_fifteen_hundred_and_rows_seen_before(spark):
    parts = [[row(at(1, 14, 59), "a"), row(at(1, 15, 0), "b")], [row(at(1, 14, 58), "c"), row(at(1, 14, 59), "a", up=0.0), row(at(1, 15, 1), "a", up=0.0)]]
    assert [x[2:] for x in lines(run(spark, parts))] == [("OPEN", "a", None)]


def test_flip_and_cap_and_blend(spark):
    """A reversal closes and opens; a cap bounds the capital that the size is a share of; the regime's own model can turn the signal."""
    turn = {"sideways": [1.0, 0.0]}
    parts = [[row(at(1, 10), cap=20_000.0), row(at(1, 10, 1), "t", up=0.6, by_regime=turn)], [row(at(1, 10, 5), up=0.0, cap=0.0), row(at(1, 10, 6), up=0.0)]]
    got = sorted(run(spark, parts).collect(), key=lambda r: r["seq"])
    assert [(r["kind"], r["symbol"], r["action"], r["quantity"], r["reason"]) for r in got if r["symbol"] == "s"][:2] == [
        ("OPEN", "s", "BUY", 6, None), ("CLOSE", "s", "BUY", 6, "reversal"),
    ]
    assert [r["action"] for r in got if r["symbol"] == "t" and r["kind"] == "OPEN"] == ["SELL"]
    again = [r for r in got if r["symbol"] == "s" and r["kind"] == "OPEN"][1]
    assert again["ms"] == got[-1]["ms"] and again["action"] == "SELL" and again["quantity"] > 6


def test_volatility_breaker_closes_all_and_halts_the_day(spark):
    parts = [[row(at(1, 10), "a"), row(at(1, 10), "b")], [row(at(1, 11), "c", vix=25.0), row(at(1, 12), "c")], [row(at(2, 10), "c")]]
    assert [x[1:] for x in lines(run(spark, parts))][2:] == [
        (at(1, 11), "HALT", None, "vix_spike"), (at(1, 11), "CLOSE", "a", "circuit_breaker"), (at(1, 11), "CLOSE", "b", "circuit_breaker"),
        (at(2, 10), "OPEN", "c", None),
    ]


def test_drawdown_over_days_halts(spark):
    """Two losing days: the second breaks the drawdown from the peak, which the day's reset does not forget."""
    rules = AccountRules(capital=10_000.0, max_drawdown=0.008, daily_loss=0.5)
    parts = [[row(at(d, 10)), row(at(d, 11), price=80.0), row(at(d, 12), price=80.0)] for d in (1, 2, 3)]
    got = lines(run(spark, parts, rules=rules))
    halts = [x for x in got if x[2] == "HALT"]
    assert halts and halts[0][1].day == 2 and halts[0][4] == "max_drawdown"


def test_book_and_figures_from_the_journal(spark):
    parts = [[row(at(1, 10), s) for s in "abcdefg"], [row(at(1, 15, 5), "a", price=110.0)]]
    journal = run(spark, parts)
    book = {r["symbol"]: r["quantity"] for r in tr.open_positions(journal).collect()}
    assert sorted(book) == ["b", "c", "d", "e"]  # five at most, and a took its profit
    f = tr.account_figures(journal).first()
    assert (f["trades"], f["wins"], f["open_positions"]) == (1, 1, 4) and f["capital"] == pytest.approx(1_000_000 + f["pnl"])
    assert tr.equity_by_day(journal).count() == 1


def test_regime_columns_equal_the_batch_signals(spark):
    """The choice for a regime is what the batch operator says when that regime's model is blended in."""
    rows = [row(at(1, 10), str(i), up=i / 20, by_regime={"sideways": [0.3, 0.7], "bull_trend": [0.9, 0.1]}, subs={"x": [0.6, 0.4]}) for i in range(21)]
    df = spark.createDataFrame(rows, tr.ROWS)
    for regime in rg.MULTIPLIER:
        own = F.try_element_at("by_regime", F.lit(regime))
        p = F.when(own.isNull(), F.col("probabilities")).otherwise(F.zip_with("probabilities", own, lambda x, y: (x + y) / 2))
        subs = F.when(own.isNull(), F.col("sub_models")).otherwise(F.map_concat("sub_models", F.create_map(F.lit("own"), own)))
        leaning = F.when(p[1] >= p[0], "BUY").otherwise("SELL")
        want = rg.signals(
            df.select("symbol", p.alias("probabilities"), subs.alias("subs"), rg.strategy_allowed(F.lit(regime), rg.infer_strategy(F.lit(regime), leaning)).alias("aligned")),
            sub_models="subs",
        ).select("symbol", "action", F.round("confidence", 9).alias("confidence"))
        got = tr.decision_rows(df).select("symbol", F.col(regime)["action"].alias("action"), F.round(F.col(regime)["confidence"], 9).alias("confidence"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_python_costs_equal_the_columns(spark):
    rows = [(100.0, 101.5, 7.0, "BUY"), (2500.0, 2400.0, 400.0, "BUY"), (80.0, 95.0, 3000.0, "SELL"), (10.0, 9.0, 1.0, "SELL")]
    df = spark.createDataFrame(rows, "entry double, out double, qty double, side string")
    got = [r[0] for r in df.select(net_pnl("entry", "out", "qty", F.col("side"))).collect()]
    for (entry, out, qty, side), x in zip(rows, got, strict=True):
        buy = side == "BUY"
        gross = (out - entry if buy else entry - out) * qty
        assert gross - _leg(entry * qty, not buy, DEFAULT_COSTS) - _leg(out * qty, buy, DEFAULT_COSTS) == pytest.approx(x, abs=1e-9)


def test_nulls_are_not_traded(spark):
    bad = [("a", at(1, 9), "s", None, [0.0, 1.0], None, None, None, None), (None, at(1, 9), "s", 1.0, [0.0, 1.0], None, None, None, None)]
    empty = ("a", at(1, 10), "s", 100.0, None, None, None, None, None)
    assert run(spark, [bad + [empty], [row(at(1, 11))]]).count() == 1
    assert pd.isna(run(spark, [[row(at(1, 11))]]).first()["pnl"])
