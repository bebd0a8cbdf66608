"""Queries of the event, opening-range and factor back-tests and their significance tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog.sqltext import (
    BENCH, DAILY, INTRADAY, PANEL, REPORT_KEYS, final, pnl_sql, report_sql, t_p_sql,
)
from tickloom.functions.costs import round_trip_cost_pct
from tickloom.functions.scalar import rounded, squash
from tickloom.operators import events as ev
from tickloom.operators import factors as fc
from tickloom.operators import orb
from tickloom.operators import reports as rp
from tickloom.operators import significance as sg
from tickloom.session import cut_lineage
from tickloom.sources import tables as tb

QUERIES, SQL = {}, {}


def log_scaled(df, *cols):
    """The fixture prices are no real price path, so compounded figures reach 1e36; they are compared on a log scale."""
    return df.withColumns({x: squash(x) for x in cols})


def log_scaled_sql(*cols):
    return "* REPLACE (" + ", ".join(f"sign({x}) * ln(1 + abs({x})) AS {x}" for x in cols) + ")"


CAPITAL = 1_000_000.0

# --- events -------------------------------------------------------------------------------------


def _excess(spark, d):
    return ev.excess_returns(tb.bars_daily(spark, d), tb.benchmark_daily(spark, d))


QUERIES["excess_returns"] = lambda spark, d: rounded(_excess(spark, d))
_EX = DAILY + ",\n" + BENCH + """,
ex AS (SELECT symbol, b.date, b.close, b.volume, k.close AS benchmark_close,
  b.close / lag(b.close) OVER w - 1 AS "return", k.close / lag(k.close) OVER w - 1 AS benchmark_return
  FROM bars b JOIN bench k ON k.date = b.date WINDOW w AS (PARTITION BY symbol ORDER BY b.date)),
e AS (SELECT *, "return" - benchmark_return AS excess_return FROM ex)"""
SQL["excess_returns"] = final(_EX, "SELECT * FROM e", "symbol, date")

_SCORE = _EX + """,
f AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS idx, count(*) OVER (PARTITION BY symbol) AS n,
  CASE WHEN count(excess_return) OVER b = 60 THEN (excess_return - avg(excess_return) OVER b) / nullif(stddev_samp(excess_return) OVER b, 0) END AS excess_return_z,
  CASE WHEN count(volume) OVER b = 60 THEN (volume - avg(volume) OVER b) / nullif(stddev_samp(volume) OVER b, 0) END AS volume_z,
  lead(close, 1) OVER (PARTITION BY symbol ORDER BY date) AS entry_price
  FROM e WINDOW b AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
evs AS (SELECT * FROM f WHERE abs(excess_return_z) > 2.5 AND volume_z > 2)"""
QUERIES["reaction_events"] = lambda spark, d: rounded(ev.reaction_events(_excess(spark, d)))
SQL["reaction_events"] = final(
    _SCORE,
    """SELECT symbol, date, close, volume, benchmark_close, "return", benchmark_return, excess_return, excess_return_z,
  volume_z, CAST(idx AS INTEGER) AS idx, CASE WHEN excess_return_z > 0 THEN 'positive' ELSE 'negative' END AS direction FROM evs""",
    "symbol, date, idx, direction",
)
QUERIES["event_split_counts"] = lambda spark, d: ev.event_counts(cut_lineage(_excess(spark, d)))
SQL["event_split_counts"] = (
    "WITH " + _SCORE + """,
hit AS (SELECT *, coalesce(abs(excess_return_z) > 2.5 AND volume_z > 2, false) AS hit, idx >= floor(n * 0.7::DOUBLE) AS late FROM f WHERE n >= 150)
SELECT symbol, min(date) FILTER (late) AS split_date, count(*) FILTER (hit AND NOT late) AS train_events, count(*) FILTER (hit AND late) AS oos_events FROM hit GROUP BY symbol"""
)


def _event_trades(spark, d):
    return ev.event_trades(_excess(spark, d), capital=CAPITAL)


_ET = _SCORE + f""",
fwd AS (SELECT v.symbol, v.idx, w.w AS "window", arg_max(x.close, x.idx) FILTER (x.idx = v.idx + w.w) AS exit_price,
  arg_max(x.date, x.idx) FILTER (x.idx = v.idx + w.w) AS exit_date,
  CASE WHEN count(x.excess_return) = max(w.w) THEN product(1 + x.excess_return) - 1 END AS drift
  FROM evs v JOIN (SELECT unnest([5, 10, 20]) AS w) w ON true
  JOIN f x ON x.symbol = v.symbol AND x.idx BETWEEN v.idx + 1 AND v.idx + w.w GROUP BY ALL),
t0 AS (SELECT v.symbol, v.date, v.idx, entry_price, CASE WHEN excess_return_z > 0 THEN 'BUY' ELSE 'SELL' END AS side,
  "window", exit_price, exit_date, floor(100000.0 / entry_price) AS quantity, drift
  FROM evs v JOIN fwd USING (symbol, idx) WHERE n >= 150 AND idx >= floor(n * 0.7::DOUBLE) AND entry_price > 0 AND exit_price IS NOT NULL),
t AS (SELECT *, {pnl_sql('entry_price', 'exit_price', 'quantity', "side = 'SELL'", True)} AS pnl FROM t0 WHERE quantity > 0),
trades AS (SELECT symbol, date, idx, entry_price, side, "window", exit_price, exit_date, quantity, pnl,
  pnl / (entry_price * quantity) AS pnl_pct, CASE WHEN side = 'BUY' THEN drift ELSE -drift END AS continuation_pct,
  CASE WHEN side = 'BUY' THEN 'positive' ELSE 'negative' END AS direction, 1.0 AS confidence FROM t)"""
QUERIES["event_trades"] = lambda spark, d: rounded(_event_trades(spark, d))
SQL["event_trades"] = final(
    _ET,
    """SELECT * REPLACE (CAST(idx AS INTEGER) AS idx, CAST(quantity AS BIGINT) AS quantity, CAST("window" AS INTEGER) AS "window",
  CAST(confidence AS DOUBLE) AS confidence) FROM trades""",
    'symbol, date, idx, side, "window", exit_date, quantity, direction',
)
QUERIES["event_drift_significance"] = lambda spark, d: rounded(
    ev.continuation_summary(_event_trades(spark, d), ["window", "direction"])
)
SQL["event_drift_significance"] = final(
    _ET + """,
s AS (SELECT "window", direction, count(continuation_pct) AS n, coalesce(avg(continuation_pct) * 100, 0.0) AS mean_pct,
  stddev_samp(continuation_pct) * 100 AS std_pct,
  CASE WHEN count(continuation_pct) >= 2 THEN median(continuation_pct) * 100 END AS median_pct FROM trades GROUP BY ALL),
u AS MATERIALIZED (SELECT *, CASE WHEN n >= 2 THEN mean_pct / nullif(std_pct / sqrt(n), 0) END AS t_stat, CAST(n - 1 AS DOUBLE) AS df FROM s),
v AS (SELECT * EXCLUDE (df), """ + t_p_sql("t_stat", "df") + """ AS p_value, 0.05 / 6 AS corrected_alpha FROM u)""",
    'SELECT *, coalesce(p_value < corrected_alpha, false) AS significant FROM v',
    '"window", direction, n, significant',
)
QUERIES["event_drift_report"] = lambda spark, d: rounded(
    log_scaled(
        rp.performance_report(
            cut_lineage(_event_trades(spark, d)), ["window", "direction"], "exit_date", ["symbol", "idx"], CAPITAL
        ),
        "calmar_ratio",
    )
)
SQL["event_drift_report"] = final(
    _ET + ",\n" + report_sql("trades", '"window", direction', "exit_date", "symbol, idx", CAPITAL),
    f"SELECT {log_scaled_sql('calmar_ratio')} FROM rep", '"window", direction, ' + REPORT_KEYS,
)

# --- opening range ------------------------------------------------------------------------------


_ORB = INTRADAY + f""",
m AS (SELECT *, hour * 60 AS minute FROM bars),
rng AS (SELECT symbol, session_date, max(high) AS range_high, min(low) AS range_low, avg(volume) AS range_volume, count(*) AS range_bars
  FROM m WHERE minute < 570 GROUP BY ALL HAVING count(*) >= 2),
ent AS (SELECT symbol, session_date, min(date) AS entry_time, arg_min(close, date) AS entry_price, any_value(range_high) AS range_high,
  any_value(range_low) AS range_low FROM m JOIN rng USING (symbol, session_date)
  WHERE range_high > range_low AND minute BETWEEN 570 AND 900 AND (range_volume <= 0 OR volume >= 1.5 * range_volume)
  AND (close > range_high OR close < range_low) GROUP BY ALL),
plan AS (SELECT *, entry_price > range_high AS lng, CASE WHEN entry_price > range_high THEN range_low ELSE range_high END AS stop FROM ent),
tgt AS (SELECT *, entry_price + 2.0 * (entry_price - stop) AS target FROM plan),
walk AS (SELECT t.*, m.date AS bar_at, m.close, m.minute < 915 AS live, CASE WHEN lng THEN low <= stop ELSE high >= stop END AS hs,
  CASE WHEN lng THEN high >= target ELSE low <= target END AS ht FROM tgt t JOIN m USING (symbol, session_date) WHERE m.date > entry_time),
outc AS (SELECT symbol, session_date, any_value(entry_time) AS entry_time, any_value(entry_price) AS entry_price, any_value(lng) AS lng,
  any_value(range_high) AS range_high, any_value(range_low) AS range_low,
  arg_min(CASE WHEN hs THEN stop ELSE target END, bar_at) FILTER (live AND (hs OR ht)) AS hit_price,
  arg_min(CASE WHEN hs THEN 'stop' ELSE 'target' END, bar_at) FILTER (live AND (hs OR ht)) AS hit_reason,
  arg_max(close, bar_at) FILTER (live) AS last_price, arg_min(close, bar_at) AS next_price FROM walk GROUP BY ALL),
orb AS (SELECT symbol, session_date, CASE WHEN lng THEN 'long' ELSE 'short' END AS direction, entry_time, entry_price,
  coalesce(hit_price, last_price, next_price) AS exit_price, coalesce(hit_reason, 'square_off') AS exit_reason, range_high, range_low FROM outc)"""
QUERIES["opening_range"] = lambda spark, d: rounded(orb.opening_range(tb.bars_intraday(spark, d)))
SQL["opening_range"] = final(_ORB, "SELECT * FROM rng", "symbol, session_date, range_bars")
QUERIES["orb_trades"] = lambda spark, d: rounded(
    orb.breakout_trades(tb.bars_intraday(spark, d)).withColumn("entry_time", F.date_format("entry_time", "yyyy-MM-dd HH:mm"))
)
SQL["orb_trades"] = final(
    _ORB, "SELECT * REPLACE (strftime(entry_time, '%Y-%m-%d %H:%M') AS entry_time) FROM orb",
    "symbol, session_date, direction, entry_time, exit_reason",
)
QUERIES["orb_backtest"] = lambda spark, d: rounded(
    log_scaled(orb.breakout_backtest(tb.bars_intraday(spark, d), CAPITAL), "calmar_ratio")
)
SQL["orb_backtest"] = final(
    _ORB + f""",
q AS (SELECT *, floor(100000.0 / entry_price) AS quantity FROM orb WHERE entry_price > 0),
p AS (SELECT *, {pnl_sql('entry_price', 'exit_price', 'quantity', "direction = 'short'")} AS pnl FROM q WHERE quantity > 0),
o AS (SELECT *, pnl / (entry_price * quantity) AS pnl_pct, 1.0::DOUBLE AS confidence,
  row_number() OVER (ORDER BY session_date, symbol) AS pos, count(*) OVER () AS n FROM p),
co AS (SELECT *, CASE WHEN pos <= floor(n * 0.7::DOUBLE) THEN 'train' ELSE 'oos' END AS split, unnest(['all', direction]) AS cohort FROM o),
""" + report_sql("co", "split, cohort", "session_date", "symbol", CAPITAL),
    f"SELECT {log_scaled_sql('calmar_ratio')} FROM rep", "split, cohort, " + REPORT_KEYS,
)

# --- factor portfolios --------------------------------------------------------------------------
COST = round_trip_cost_pct()


def _factor_sql(target_ns, lookbacks, every_n, vol=60, skip=21, staggered=0):
    """Periods of the factor back-test as set-based SQL (`per`) and its summary (`summ`)."""
    ns, lbs = ", ".join(map(str, target_ns)), ", ".join(map(str, lookbacks))
    head = PANEL + f""",
ok AS (SELECT date FROM bars GROUP BY date HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars)),
p AS MATERIALIZED (SELECT symbol, date, close, row_number() OVER w - 1 AS idx, close / lag(close) OVER w - 1 AS r
  FROM bars JOIN ok USING (date) WINDOW w AS (PARTITION BY symbol ORDER BY date)),
u AS (SELECT count(DISTINCT symbol) AS n_symbols FROM p),
ms0 AS (SELECT lookback_days, min(date) AS date FROM (SELECT DISTINCT date, idx FROM p), (SELECT unnest([{lbs}]) AS lookback_days)
  WHERE idx >= greatest(lookback_days, {vol}) + 5 GROUP BY lookback_days, date_trunc('month', date)),
ms1 AS (SELECT *, row_number() OVER (PARTITION BY lookback_days ORDER BY date) - 1 AS i FROM ms0),
ms AS MATERIALIZED (SELECT lookback_days, date, i // {every_n} AS period,
  lead(date) OVER (PARTITION BY lookback_days ORDER BY date) AS next_date FROM ms1 WHERE i % {every_n} = 0),
sc AS MATERIALIZED (SELECT ms.*, a.symbol, e.close / s.close - 1 AS momentum, z.close / a.close - 1 AS fwd,
  (SELECT -stddev_samp(r) FROM p v WHERE v.symbol = a.symbol AND v.idx BETWEEN a.idx - {vol - 1} AND a.idx - 1) AS low_vol
  FROM ms JOIN p a ON a.date = ms.date JOIN p s ON s.symbol = a.symbol AND s.idx = a.idx - lookback_days
  JOIN p e ON e.symbol = a.symbol AND e.idx = a.idx - {skip} LEFT JOIN p z ON z.symbol = a.symbol AND z.date = ms.next_date),
rk AS (SELECT *, row_number() OVER (PARTITION BY lookback_days, date ORDER BY momentum DESC, symbol) AS rm,
  row_number() OVER (PARTITION BY lookback_days, date ORDER BY low_vol DESC, symbol) AS rv FROM sc),
w AS MATERIALIZED (SELECT target_n, lookback_days, strategy, period, date, symbol, fwd, CASE strategy
    WHEN 'momentum' THEN CASE WHEN rm <= target_n THEN 1.0 / least(target_n, n_symbols) ELSE 0.0 END
    WHEN 'low_vol' THEN CASE WHEN rv <= target_n THEN 1.0 / least(target_n, n_symbols) ELSE 0.0 END
    ELSE 1.0 / n_symbols END AS w
  FROM rk, u, (SELECT unnest([{ns}]) AS target_n), (SELECT unnest(['momentum', 'low_vol', 'equal_weight_all']) AS strategy))"""
    g = "target_n, lookback_days, strategy"
    if staggered:
        k = staggered
        head += f""",
held AS (SELECT a.*, t.t AS tranche, (a.period - t.t) % {k} = 0 AS due, o.w AS held, q.w AS old
  FROM w a, (SELECT unnest(range({k})) AS t) t
  LEFT JOIN w o ON o.target_n = a.target_n AND o.lookback_days = a.lookback_days AND o.strategy = a.strategy AND o.symbol = a.symbol
    AND o.period = a.period - ((a.period - t.t) % {k})
  LEFT JOIN w q ON q.target_n = a.target_n AND q.lookback_days = a.lookback_days AND q.strategy = a.strategy AND q.symbol = a.symbol
    AND q.period = a.period - {k} AND a.period - {k} >= t.t
  WHERE a.fwd IS NOT NULL AND a.period >= t.t),
pt AS (SELECT {g}, period, date, tranche, sum(held * fwd) AS gross, CASE WHEN bool_or(due) THEN sum(abs(w - coalesce(old, 0.0))) / 2 END AS turnover
  FROM held GROUP BY ALL),
per AS MATERIALIZED (SELECT {g}, period, date, sum(gross - coalesce(turnover, 0.0) * {COST!r}) / {k} AS net_return,
  sum(turnover) AS turnover, count(turnover) AS rebalances FROM pt GROUP BY ALL)"""
        extra = f"sum(turnover) / sum(rebalances) * 100 AS avg_turnover_pct, sum(turnover) / {k} * {COST!r} * 100 AS total_cost_drag_pct, {k} AS n_tranches"
        ppy = 12.0
    else:
        head += f""",
dw AS (SELECT *, abs(w - coalesce(lag(w) OVER (PARTITION BY {g}, symbol ORDER BY date), 0.0)) AS dw FROM w),
per AS MATERIALIZED (SELECT {g}, period, date, sum(w * fwd) AS gross_return, sum(dw) / 2 AS turnover,
  sum(w * fwd) - sum(dw) / 2 * {COST!r} AS net_return FROM dw WHERE fwd IS NOT NULL GROUP BY ALL)"""
        extra = f"avg(turnover) * 100 AS avg_turnover_pct, sum(turnover) * {COST!r} * 100 AS total_cost_drag_pct"
        ppy = 12.0 / every_n
    head += f""",
eqc AS (SELECT *, product(1 + net_return) OVER (PARTITION BY {g} ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM per),
eqp AS (SELECT *, max(e) OVER (PARTITION BY {g} ORDER BY date ROWS UNBOUNDED PRECEDING) AS pk FROM eqc),
summ AS (SELECT {g}, count(*) AS n_periods, (arg_max(e, date) - 1) * 100 AS total_return_pct,
  CASE WHEN coalesce(stddev_samp(net_return), 0) > 1e-12 THEN avg(net_return) / stddev_samp(net_return) * sqrt({ppy}) ELSE 0.0 END AS annualized_sharpe,
  min((e - pk) / pk) * 100 AS max_drawdown_pct, {extra} FROM eqp GROUP BY {g})"""
    return head


_G = "target_n, lookback_days, strategy"
TWO = {"target_ns": (2,), "lookbacks": (126,)}
GRID = {"target_ns": (1, 2, 3), "lookbacks": (63, 126, 189, 252)}


def _panel(spark, d):
    # The panel jobs read the bars several times (universe, calendar, prices): bars are a stored table for them.
    return cut_lineage(tb.bars_panel(spark, d))


QUERIES["complete_panel"] = lambda spark, d: rounded(fc.complete_panel(_panel(spark, d)))
SQL["complete_panel"] = final(
    PANEL + """,
ok AS (SELECT date, count(*) AS n_symbols FROM bars GROUP BY date HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars))""",
    "SELECT symbol, date, close, n_symbols, CAST(row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS INTEGER) AS idx FROM bars JOIN ok USING (date)",
    "symbol, date, n_symbols, idx",
)
QUERIES["factor_periods"] = lambda spark, d: rounded(fc.factor_periods(_panel(spark, d), **TWO))
SQL["factor_periods"] = final(
    _factor_sql((2,), (126,), 1), "SELECT * REPLACE (CAST(period AS INTEGER) AS period) FROM per", _G + ", period, date"
)
QUERIES["factor_backtest"] = lambda spark, d: rounded(log_scaled(fc.factor_backtest(_panel(spark, d), **TWO), "total_return_pct"))
SQL["factor_backtest"] = final(_factor_sql((2,), (126,), 1), f"SELECT {log_scaled_sql('total_return_pct')} FROM summ", _G + ", n_periods")
QUERIES["factor_backtest_quarterly"] = lambda spark, d: rounded(log_scaled(fc.factor_backtest(_panel(spark, d), every_n=3, **TWO), "total_return_pct"))
SQL["factor_backtest_quarterly"] = final(_factor_sql((2,), (126,), 3), f"SELECT {log_scaled_sql('total_return_pct')} FROM summ", _G + ", n_periods")
QUERIES["staggered_periods"] = lambda spark, d: rounded(fc.staggered_periods(_panel(spark, d), **TWO))
SQL["staggered_periods"] = final(
    _factor_sql((2,), (126,), 1, staggered=3),
    "SELECT * REPLACE (CAST(period AS INTEGER) AS period) FROM per", _G + ", period, date, rebalances",
)
QUERIES["staggered_backtest"] = lambda spark, d: rounded(log_scaled(fc.staggered_backtest(_panel(spark, d), **TWO), "total_return_pct"))
SQL["staggered_backtest"] = final(
    _factor_sql((2,), (126,), 1, staggered=3), f"SELECT {log_scaled_sql('total_return_pct')} FROM summ", _G + ", n_periods, n_tranches"
)


def _verdict_sql(staggered):
    def of(s, x):
        return f"max({x}) FILTER (strategy = '{s}')"

    m, q = "momentum", "equal_weight_all"
    logs = log_scaled_sql("momentum_return_pct", "equal_weight_return_pct")
    return final(
        _factor_sql(GRID["target_ns"], GRID["lookbacks"], 1, staggered=staggered),
        f"""SELECT {logs} FROM (SELECT target_n, lookback_days, {of(m, 'annualized_sharpe')} AS momentum_sharpe, {of(m, 'total_return_pct')} AS momentum_return_pct,
  {of(q, 'annualized_sharpe')} AS equal_weight_sharpe, {of(q, 'total_return_pct')} AS equal_weight_return_pct,
  {of(m, 'annualized_sharpe')} > {of(q, 'annualized_sharpe')} AS momentum_beats_equal_weight_sharpe FROM summ GROUP BY 1, 2)""",
        "target_n, lookback_days, momentum_beats_equal_weight_sharpe",
    )


QUERIES["factor_parameter_grid"] = lambda spark, d: rounded(
    log_scaled(
        fc.grid_verdicts(fc.factor_backtest(_panel(spark, d), **GRID)), "momentum_return_pct", "equal_weight_return_pct"
    )
)
SQL["factor_parameter_grid"] = _verdict_sql(0)
QUERIES["staggered_parameter_grid"] = lambda spark, d: rounded(
    log_scaled(
        fc.grid_verdicts(fc.staggered_backtest(_panel(spark, d), **GRID)), "momentum_return_pct", "equal_weight_return_pct"
    )
)
SQL["staggered_parameter_grid"] = _verdict_sql(3)


# --- significance on factor periods -------------------------------------------------------------
def _two(spark, d):
    return fc.factor_periods(_panel(spark, d), **TWO)


def _paired(spark, d):
    p = _two(spark, d)
    a, b = (p.filter(F.col("strategy") == s) for s in ("momentum", "equal_weight_all"))
    return rounded(sg.paired_t(a, b, ["target_n", "period"], ["target_n"], "net_return"))


QUERIES["factor_paired_test"] = _paired
SQL["factor_paired_test"] = final(
    _factor_sql((2,), (126,), 1) + """,
df0 AS (SELECT target_n, a.net_return - b.net_return AS x FROM per a JOIN per b USING (target_n, period)
  WHERE a.strategy = 'momentum' AND b.strategy = 'equal_weight_all'),
s AS (SELECT target_n, count(*) AS n, avg(x) * 100 AS mean_pct, stddev_samp(x) * 100 AS std_pct FROM df0 GROUP BY 1),
t AS MATERIALIZED (SELECT *, mean_pct / (std_pct / sqrt(n)) AS t_stat, CAST(n - 1 AS DOUBLE) AS df FROM s)""",
    "SELECT * EXCLUDE (df), " + t_p_sql("t_stat", "df") + " AS p_value FROM t",
    "target_n, n",
)
QUERIES["factor_subperiods"] = lambda spark, d: rounded(
    sg.subperiods(_two(spark, d), ["target_n", "strategy"], "date", "net_return", 3)
)
SQL["factor_subperiods"] = final(
    _factor_sql((2,), (126,), 1) + """,
i AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY strategy) AS n FROM per),
b AS (SELECT *, (SELECT max(k) FROM range(3) g(k) WHERE floor(k * n / 3.0) <= i) AS bucket FROM i WHERE n >= 6)""",
    """SELECT target_n, strategy, CAST(bucket AS INTEGER) AS bucket, min(date) AS start_date, max(date) AS end_date, count(*) AS n_periods,
  avg(net_return) * 100 AS mean_return_pct, CASE WHEN coalesce(stddev_samp(net_return), 0) > 1e-12 THEN avg(net_return) / stddev_samp(net_return) ELSE 0.0 END AS naive_sharpe,
  avg((net_return > 0)::INT::DOUBLE) AS win_rate FROM b GROUP BY ALL""",
    "target_n, strategy, bucket, start_date, end_date, n_periods",
)
QUERIES["bootstrap_sharpe"] = lambda spark, d: rounded(
    sg.bootstrap_sharpe(_two(spark, d), ["target_n", "strategy"], "date", "net_return")
)


def mix_sql(terms: str, seed: int = 0) -> str:
    p = 2147483647
    h = f"(({seed} + {terms}) % {p})"
    for a, b in ((48271, 11), (16807, 7)):
        h = f"(({h} * {h} + {h} * {a} + {b}) % {p})"
    return h


SQL["bootstrap_sharpe"] = final(
    _factor_sql((2,), (126,), 1) + f""",
s AS MATERIALIZED (SELECT target_n, strategy, net_return AS v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY target_n, strategy) AS n
  FROM per WINDOW w AS (PARTITION BY target_n, strategy ORDER BY date)),
h0 AS (SELECT n, rep, j, (42 + rep * 1000003 + j * 8191) % 2147483647 AS h FROM (SELECT max(n) AS n FROM s), range(1, 5001) r(rep), range(0, (SELECT max(n) FROM s)) g(j)),
h1 AS (SELECT n, rep, (h * h + h * 48271 + 11) % 2147483647 AS h FROM h0),
h2 AS (SELECT rep, (h * h + h * 16807 + 7) % 2147483647 % n AS i FROM h1),
b AS (SELECT target_n, strategy, rep, avg(v) AS m, stddev_samp(v) AS sd FROM h2 JOIN s USING (i) GROUP BY ALL)""",
    """SELECT target_n, strategy, (SELECT max(n) FROM s) AS n_periods, quantile_cont(m / sd * sqrt(12), 0.5) AS sharpe_median,
  quantile_cont(m / sd * sqrt(12), 0.05) AS ci_low_5pct, quantile_cont(m / sd * sqrt(12), 0.95) AS ci_high_95pct FROM b WHERE sd >= 1e-12 GROUP BY ALL""",
    "target_n, strategy, n_periods",
)
