"""The paper account resumes a saved account or starts fresh; the session price runs over micro-batches; open counts sweep."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import risk as rk
from tickloom.operators.flow import concurrent_trades
from tickloom.streaming import bars as sb
from tickloom.streaming import paper, runner

D0 = dt.date(2022, 1, 3)


def days(symbol, signals, first=0, price=100.0):
    return [(symbol, D0 + dt.timedelta(days=first + i), price + first + i, bool(s)) for i, s in enumerate(signals)]


def run(spark, parts, saved=None, schema=paper.DAYS, build=None):
    base = runner.scratch_path(spark, "test")
    for rows in parts:
        df = rows if hasattr(rows, "columns") else spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").parquet(f"{base}/files")
        stream = runner.file_stream(spark, f"{base}/files", df.schema)
        out = runner.drain(build(stream) if build else paper.stream_paper(stream, saved, hold=2, max_positions=2), f"{base}/chk", f"{base}/sink")
    return out


def told(out):
    rows = sorted(out.collect(), key=lambda r: (r["symbol"], r["exit_date"] or r["entry_date"], r["kind"], r["entry_date"]))
    return [(r["symbol"], r["kind"], (r["entry_date"] - D0).days, r["exit_date"] and (r["exit_date"] - D0).days, r["open_tranches"]) for r in rows]


def test_fresh_account_starts_on_the_latest_day(spark):
    """Signals of earlier days in the first micro-batch are history; the last but one day's signal is traded on the last."""
    got = told(run(spark, [days("s", [1, 1, 1, 1, 0]), days("s", [1, 0, 0, 0], 5)]))
    assert got == [("s", "open", 4, None, 1), ("s", "close", 4, 6, 0), ("s", "open", 6, None, 1), ("s", "close", 6, 8, 0)]
    assert told(run(spark, [days("s", [1, 1, 0])])) == [("s", "open", 2, None, 1)]
    assert told(run(spark, [days("s", [1])])) == []


def test_saved_account_resumes_with_its_tranches(spark):
    """Days up to the last processed one are skipped; a tranche closes by the rows it has been held."""
    saved = spark.createDataFrame(
        [("s", 7, D0 + dt.timedelta(days=2), True, [(6, D0, D0 + dt.timedelta(days=1), 50.0)]), ("new", 0, None, None, None)], paper.ACCOUNT
    )
    got = run(spark, [days("s", [1, 1, 1, 0, 0, 0]) + days("new", [1, 1, 0])], saved)
    assert told(got) == [("new", "open", 2, None, 1), ("s", "close", 1, 3, 0), ("s", "open", 3, None, 1), ("s", "close", 3, 5, 0)]
    first = got.where("symbol = 's' AND kind = 'close'").orderBy("exit_date").first()
    assert first["quantity"] == pytest.approx(500_000 / 50.0) and first["pnl"] > 0 and first["tranche_id"] == f"t-{D0}"


def test_days_that_land_twice_and_open_tranches(spark):
    got = run(spark, [days("s", [0, 1]), days("s", [0, 1, 1, 1], 0), days("s", [1, 1], 2)])
    assert [x[1:4] for x in told(got)] == [("open", 2, None), ("open", 3, None)]
    assert sorted(r["entry_date"] for r in paper.open_tranches(got).collect()) == [D0 + dt.timedelta(days=i) for i in (2, 3)]


def test_trades_equal_the_batch_after_a_fresh_start(spark):
    draw = random.Random(3)
    rows = [r for s in ("a", "b") for r in days(s, [draw.random() < 0.5 for _ in range(80)])]
    edge = D0 + dt.timedelta(days=1)
    parts = [[r for r in rows if r[1] <= edge], [r for r in rows if edge < r[1] <= edge + dt.timedelta(days=40)], [r for r in rows if r[1] > edge + dt.timedelta(days=40)]]
    got = run(spark, parts).where("kind = 'close'").select("symbol", "signal_date", "entry_date", "exit_date")
    want = concurrent_trades(spark.createDataFrame(rows, paper.DAYS), ["symbol"], "signal", 2, (2,), 2, count_on_entry_day=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_running_session_price_over_micro_batches(spark):
    draw = random.Random(8)
    rows = []
    for day in (1, 2, 3):
        for h in range(9, 16):
            for s in ("x", "y"):
                low = draw.uniform(90, 100)
                rows.append((s, dt.datetime(2024, 1, day, h), low + 5, low, low + draw.uniform(0, 5), float(draw.choice([0, 0, 10, 25]))))
    schema = "symbol string, date timestamp, high double, low double, close double, volume double"
    cut = [dt.datetime(2024, 1, 1, 11), dt.datetime(2024, 1, 1, 14), dt.datetime(2024, 1, 2, 12), dt.datetime(2024, 1, 9)]
    parts = [[r for r in rows if lo < r[1] <= hi] for lo, hi in zip([dt.datetime(2023, 1, 1), *cut], cut, strict=False)]
    parts[1] += parts[0][-2:]  # two bars land again
    got = {(r["symbol"], r["date"]): r["session_vwap"] for r in run(spark, parts, schema=schema, build=sb.stream_running_vwap).collect()}
    assert len(got) == len(rows)
    for s, t, *_ in rows:
        seen = [r for r in rows if r[0] == s and r[1].date() == t.date() and r[1] <= t]
        size = sum(r[5] for r in seen)
        assert got[s, t] == (pytest.approx(sum((r[2] + r[3] + r[4]) / 3 * r[5] for r in seen) / size) if size else None)


def test_open_counts_equal_a_loop(spark):
    draw = random.Random(2)
    trades = [(draw.choice("ab"), D0 + dt.timedelta(days=draw.randrange(15)), draw.choice([None, 1, 2, 5]), i) for i in range(80)]
    rows = [(a, d, None if h is None else d + dt.timedelta(days=h), i) for a, d, h, i in trades]
    df = spark.createDataFrame(rows, "account string, entry date, exit date, ref long")
    halts = spark.createDataFrame([("a", D0 + dt.timedelta(days=3), True)], "account string, entry date, halted boolean")
    got = {r["ref"]: (r["open_before"], r["can_open"]) for r in rk.open_position_counts(df, "account", "entry", "exit", ["ref"], halts=halts).collect()}
    for a, d, _, i in rows:
        held = sum(x == a and (e < d or (e == d and j < i)) and (out is None or out > d) for x, e, out, j in rows)
        assert got[i] == (held, held < 5 and not (a == "a" and d == D0 + dt.timedelta(days=3)))
    assert rk.open_position_counts(df.limit(0), "account", "entry", "exit", ["ref"]).where(F.lit(True)).count() == 0
