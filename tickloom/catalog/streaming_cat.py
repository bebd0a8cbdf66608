"""Queries that run as streams over landed files until all input is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog.flow_cat import _rule_sql, wide
from tickloom.catalog.risk_cat import SQL as RISK_SQL
from tickloom.catalog.risk_cat import _indicators
from tickloom.catalog.sqltext import final
from tickloom.functions.scalar import rounded
from tickloom.operators import flow as fl
from tickloom.operators import regimes as rg
from tickloom.session import cut_lineage
from tickloom.sources import tables as tb
from tickloom.streaming import bars as sb
from tickloom.streaming import runner
from tickloom.streaming import stateful as ss

QUERIES, SQL = {}, {}


def _ticks(spark, d):
    return runner.file_stream(spark, d, sb.TICK_SCHEMA, "events.parquet")


def _bars(spark, d):
    out = runner.drain(sb.stream_bars(_ticks(spark, d)))
    return rounded(out.select("symbol", F.date_format("date", "yyyy-MM-dd HH:mm").alias("bar_time"), "open", "high", "low", "close", "volume"))


QUERIES["stream_hourly_bars"] = _bars
SQL["stream_hourly_bars"] = final(
    """b AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS t, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY ALL)""",
    """SELECT symbol, strftime(t, '%Y-%m-%d %H:%M') AS bar_time, open, high, low, close, volume FROM b
  WHERE t + INTERVAL 1 HOUR <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 10 MINUTE""",
    "symbol, bar_time",
)
QUERIES["stream_session_vwap"] = lambda spark, d: rounded(runner.drain(sb.stream_session_vwap(_ticks(spark, d))))
SQL["stream_session_vwap"] = final(
    "b AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS session_date, sum(value * (user_id % 7 + 1)) / sum(user_id % 7 + 1) AS session_vwap, count(*) AS n_ticks FROM events GROUP BY ALL)",
    "SELECT * FROM b WHERE session_date + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
    "symbol, session_date, n_ticks",
)


def _signal_days(spark, d):
    s = fl.flow_signals(tb.bars_daily(spark, d), wide(spark, d), "dii_net_index_future")
    return s.select("symbol", "date", "close", F.coalesce(F.col("rank") >= 0.8, F.lit(False)).alias("signal"))


def _paper(spark, d):
    return rounded(runner.drain_in_turn(_signal_days(spark, d), "date", ss.stream_tranches))


_PAPER_SQL = final(
    _rule_sql().replace("x >= p.idx - w.hold_days)", "x >= p.idx - w.hold_days + 1)"),
    "SELECT symbol, signal_date, entry_date, entry_price, quantity, exit_date, exit_price, pnl, pnl_pct FROM tr",
    "symbol, signal_date, entry_date, exit_date", recursive=True,
)
QUERIES["stream_paper_tranches"] = _paper
SQL["stream_paper_tranches"] = _PAPER_SQL


def _paper_batch(spark, d):
    t = fl.concurrent_trades(_signal_days(spark, d), ["symbol"], "signal", count_on_entry_day=True)
    return rounded(t.select("symbol", "signal_date", "entry_date", "entry_price", "quantity", "exit_date", "exit_price", "pnl", "pnl_pct"))


QUERIES["paper_tranches_batch"] = _paper_batch
SQL["paper_tranches_batch"] = _PAPER_SQL


def _stream_regimes(spark, d):
    c = _indicators(spark, d).select("symbol", "date", rg.match_regime().alias("candidate"))
    return runner.drain_in_turn(c, "date", ss.stream_regimes).select("date", "candidate", "regime")


QUERIES["stream_regimes"] = _stream_regimes
SQL["stream_regimes"] = f"SELECT date, candidate, regime FROM ({RISK_SQL['regime_hysteresis']}) q"


def decision_rows(spark, d):
    """Hourly prices of each event type per account (user group) with a signal from the price's own position."""
    bars = tb.bars_intraday(spark, d)
    conf = F.lit(0.5) + F.pmod(F.col("volume") * 7 + F.col("hour"), F.lit(10)) / 20
    up = (F.col("close") > (F.col("high") + F.col("low")) / 2) | (F.col("high") == F.col("low"))
    return bars.select(
        F.date_format("session_date", "yyyy-MM-dd").alias("account"), F.col("date").cast("timestamp").alias("ts"), "symbol",
        (F.col("close") * 100).alias("price"), conf.alias("confidence"), F.when(up, "BUY").otherwise("SELL").alias("action"),
        F.when(conf >= 0.75, "execute_full").when(conf >= 0.6, "execute_half").otherwise("queue_review").alias("execution"),
        F.lit(0.7).alias("multiplier"),
    )


def _decisions(spark, d):
    rows = cut_lineage(decision_rows(spark, d))
    s = runner.file_stream(spark, rows.inputFiles()[0].rsplit("/", 1)[0], rows.schema)
    return rounded(runner.drain(ss.stream_decisions(s)).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm") for c in ("entry_time", "exit_time")}))


QUERIES["stream_account_decisions"] = _decisions
