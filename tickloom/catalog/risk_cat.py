"""Queries of pairs, savings plans, regimes, signals, allocation, risk state and stress."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog.data_cat import _J, journal
from tickloom.catalog.features_cat import _RET, _smoothed
from tickloom.catalog.flow_cat import _rule_sql, wide
from tickloom.catalog.sqltext import DAILY, INTRADAY, LINE, REPORT_KEYS, TRADES, final, full, lag, pnl_sql, report_sql
from tickloom.functions.scalar import rounded
from tickloom.operators import features as ft
from tickloom.operators import flow as fl
from tickloom.operators import pairs as pr
from tickloom.operators import quality as ql
from tickloom.operators import regimes as rg
from tickloom.operators import reports as rp
from tickloom.operators import risk as rk
from tickloom.operators import savings as sv
from tickloom.session import cut_lineage
from tickloom.sources import tables as tb

QUERIES, SQL = {}, {}
CAPITAL = 1_000_000.0

# --- pairs
QUERIES["pair_regressions"] = lambda spark, d: rounded(pr.pair_statistics(tb.bars_daily(spark, d), with_p=False).drop("p_value"))
SQL["pair_regressions"] = final(
    DAILY, """SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, count(*) AS n_rows, regr_slope(ln(a.close), ln(b.close)) AS hedge_ratio,
  regr_intercept(ln(a.close), ln(b.close)) AS intercept FROM bars a JOIN bars b ON a.date = b.date AND a.symbol < b.symbol
  GROUP BY 1, 2 HAVING count(*) >= 200""", "symbol_a, symbol_b, n_rows",
)
# unit-root t value of every pair's residuals at two lags: least squares of the residual's step on its level and two steps
QUERIES["pair_unit_root"] = lambda spark, d: rounded(
    pr.pair_statistics(tb.bars_daily(spark, d), lags=2).select("symbol_a", "symbol_b", "n_rows", F.col("p_value").alias("tau"))
)
SQL["pair_unit_root"] = final(
    DAILY + """,
pa AS MATERIALIZED (SELECT a.symbol AS sa, b.symbol AS sb, a.date, ln(a.close) AS x, ln(b.close) AS y FROM bars a JOIN bars b ON a.date = b.date AND a.symbol < b.symbol),
rg AS (SELECT sa, sb, count(*) AS n, regr_slope(x, y) AS m, regr_intercept(x, y) AS c FROM pa GROUP BY ALL HAVING count(*) >= 200),
rs AS (SELECT sa, sb, n, date, x - c - m * y AS e FROM pa JOIN rg USING (sa, sb)),
l0 AS (SELECT *, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2, lag(e, 3) OVER w AS e3 FROM rs WINDOW w AS (PARTITION BY sa, sb ORDER BY date)),
q AS (SELECT sa, sb, n, e - e1 AS d0, e1 AS u, e1 - e2 AS v, e2 - e3 AS w FROM l0 WHERE e3 IS NOT NULL),
k AS (SELECT sa, sb, n, count(*) AS t, sum(u * u) AS a, sum(u * v) AS b, sum(u * w) AS c, sum(v * v) AS d, sum(v * w) AS e, sum(w * w) AS f,
  sum(u * d0) AS p, sum(v * d0) AS q, sum(w * d0) AS r, sum(d0 * d0) AS s FROM q GROUP BY ALL),
i AS (SELECT *, d * f - e * e AS i11, c * e - b * f AS i12, b * e - c * d AS i13, a * f - c * c AS i22, b * c - a * e AS i23, a * d - b * b AS i33,
  a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM k),
z AS (SELECT *, (i11 * p + i12 * q + i13 * r) / det AS b1, (i12 * p + i22 * q + i23 * r) / det AS b2, (i13 * p + i23 * q + i33 * r) / det AS b3 FROM i)""",
    "SELECT sa AS symbol_a, sb AS symbol_b, n AS n_rows, b1 / sqrt((s - b1 * p - b2 * q - b3 * r) / (t - 3) * i11 / det) AS tau FROM z",
    "symbol_a, symbol_b, n_rows",
)


def _selected(spark, d):
    bars = cut_lineage(tb.bars_intraday(spark, d))
    return bars, cut_lineage(pr.cointegrated_pairs(pr.train_slice(bars, 0.8)))


def _scores(spark, d):
    bars, pairs = _selected(spark, d)
    return pr.spread_scores(bars, pairs, "session_date")


QUERIES["cointegrated_pairs"] = lambda spark, d: rounded(_selected(spark, d)[1])
QUERIES["pair_trades"] = lambda spark, d: rounded(pr.pair_trades(_scores(spark, d), "session_date"))
QUERIES["pairs_backtest"] = lambda spark, d: rounded(
    rp.performance_report(
        cut_lineage(pr.pair_trades(_scores(spark, d), "session_date")), ["symbol_a", "symbol_b"], "exit_date", ["entry_date"], CAPITAL
    )
)



def _all_scores(spark, d):
    """Spread scores of every pair, hedged on its own training part."""
    bars = cut_lineage(tb.bars_intraday(spark, d))
    return pr.spread_scores(bars, cut_lineage(pr.pair_statistics(pr.train_slice(bars, 0.8), with_p=False)), "session_date")


_PAIR = INTRADAY + """,
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) > floor(count(*) OVER (PARTITION BY symbol) * 0.8::DOUBLE) AS oos FROM bars),
h AS (SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, regr_slope(ln(a.close), ln(b.close)) AS hedge_ratio, regr_intercept(ln(a.close), ln(b.close)) AS intercept
  FROM n a JOIN n b ON a.date = b.date AND a.symbol < b.symbol WHERE NOT a.oos AND NOT b.oos GROUP BY 1, 2 HAVING count(*) >= 200),
s AS (SELECT h.*, a.date, a.session_date, a.hour, a.close AS close_a, b.close AS close_b, a.oos, ln(a.close) - (intercept + hedge_ratio * ln(b.close)) AS spread
  FROM h JOIN n a ON a.symbol = symbol_a JOIN n b ON b.symbol = symbol_b AND b.date = a.date WHERE a.oos = b.oos),
zz AS (SELECT *, CASE WHEN count(spread) OVER w = 20 THEN (spread - avg(spread) OVER w) / nullif(stddev_samp(spread) OVER w, 0) END AS z
  FROM s WINDOW w AS (PARTITION BY symbol_a, symbol_b ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
o AS MATERIALIZED (SELECT * FROM zz WHERE oos)"""
QUERIES["pair_spread_scores"] = lambda spark, d: rounded(
    _all_scores(spark, d).select("symbol_a", "symbol_b", "session_date", F.hour("date").alias("hour"), "hedge_ratio", "spread", "z")
)
SQL["pair_spread_scores"] = final(
    _PAIR, "SELECT symbol_a, symbol_b, session_date, hour, hedge_ratio, spread, z FROM o", "symbol_a, symbol_b, session_date, hour"
)
_PK = ["symbol_a", "symbol_b", "position", "entry_time", "exit_time"]
QUERIES["pair_trades_all"] = lambda spark, d: rounded(
    pr.pair_trades(_all_scores(spark, d), "session_date").select(
        *_PK[:3], F.date_format("entry_date", "yyyy-MM-dd HH:mm").alias("entry_time"), F.date_format("exit_date", "yyyy-MM-dd HH:mm").alias("exit_time"),
        "entry_a", "entry_b", "exit_a", "exit_b", "exit_z", "pnl", "pnl_pct", "confidence",
    )
)
_LONG, _SHORT_SPREAD = "position = 'long_spread'", "position = 'short_spread'"
_PAIR_TRADES = _PAIR + f""",
q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol_a, symbol_b ORDER BY date) AS rn,
  coalesce(lead(session_date) OVER (PARTITION BY symbol_a, symbol_b ORDER BY date) <> session_date, true) AS last_bar FROM o),
wk(symbol_a, symbol_b, rn, position, ein, entry_a, entry_b, closed) AS (
  SELECT DISTINCT symbol_a, symbol_b, 0::BIGINT, NULL::VARCHAR, NULL::TIMESTAMP, NULL::DOUBLE, NULL::DOUBLE, false FROM q
  UNION ALL
  SELECT q.symbol_a, q.symbol_b, q.rn,
    CASE WHEN (w.position IS NULL OR w.closed) AND abs(z) > 2 THEN CASE WHEN z > 0 THEN 'short_spread' ELSE 'long_spread' END WHEN w.closed THEN NULL ELSE w.position END,
    CASE WHEN (w.position IS NULL OR w.closed) AND abs(z) > 2 THEN q.date WHEN w.closed THEN NULL ELSE w.ein END,
    CASE WHEN (w.position IS NULL OR w.closed) AND abs(z) > 2 THEN close_a WHEN w.closed THEN NULL ELSE w.entry_a END,
    CASE WHEN (w.position IS NULL OR w.closed) AND abs(z) > 2 THEN close_b WHEN w.closed THEN NULL ELSE w.entry_b END,
    coalesce(w.position IS NOT NULL AND NOT w.closed AND (abs(z) < 0.5 OR abs(z) > 4 OR last_bar) AND z IS NOT NULL, false)
  FROM wk w JOIN q ON q.symbol_a = w.symbol_a AND q.symbol_b = w.symbol_b AND q.rn = w.rn + 1),
c AS (SELECT w.*, q.date AS xout, close_a AS exit_a, close_b AS exit_b, z AS exit_z, floor(50000.0 / entry_a) AS qa, floor(50000.0 / entry_b) AS qb
  FROM wk w JOIN q USING (symbol_a, symbol_b, rn) WHERE closed),
p AS (SELECT *, {pnl_sql('entry_a', 'exit_a', 'qa', _SHORT_SPREAD)} + {pnl_sql('entry_b', 'exit_b', 'qb', _LONG)} AS pnl FROM c WHERE qa > 0 AND qb > 0)"""
SQL["pair_trades_all"] = final(
    _PAIR_TRADES,
    """SELECT symbol_a, symbol_b, position, strftime(ein, '%Y-%m-%d %H:%M') AS entry_time, strftime(xout, '%Y-%m-%d %H:%M') AS exit_time, entry_a, entry_b, exit_a, exit_b,
  exit_z, pnl, pnl / (entry_a * qa + entry_b * qb) AS pnl_pct, least(1.0, abs(exit_z) / 2.0) AS confidence FROM p""",
    ", ".join(_PK), recursive=True,
)

QUERIES["pairs_backtest_all"] = lambda spark, d: rounded(
    rp.performance_report(cut_lineage(pr.pair_trades(_all_scores(spark, d), "session_date")), ["symbol_a", "symbol_b"], "exit_date", ["entry_date"], CAPITAL)
    .withColumns({c: F.substring(F.col(c).cast("string"), 1, 10) for c in ("max_dd_peak_date", "max_dd_trough_date")})
)
SQL["pairs_backtest_all"] = final(
    _PAIR_TRADES + """,
pt AS (SELECT symbol_a, symbol_b, ein AS entry_date, xout AS exit_date, pnl, pnl / (entry_a * qa + entry_b * qb) AS pnl_pct, least(1.0, abs(exit_z) / 2.0) AS confidence FROM p),
""" + report_sql("pt", "symbol_a, symbol_b", "exit_date", "entry_date", CAPITAL),
    "SELECT * FROM rep", "symbol_a, symbol_b, " + REPORT_KEYS, recursive=True,
)

# --- savings plan
_SIP = DAILY + """,
m AS (SELECT symbol, date, close, CASE WHEN row_number() OVER (PARTITION BY symbol, date_trunc('month', date) ORDER BY date) = 1 AND close > 0
  THEN 10000.0::DOUBLE ELSE 0.0::DOUBLE END AS invested FROM bars),
v AS MATERIALIZED (SELECT *, sum(invested / close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS units FROM m)"""
QUERIES["savings_plan_curve"] = lambda spark, d: rounded(sv.plan_curve(tb.bars_daily(spark, d), 10_000.0), 4)
SQL["savings_plan_curve"] = final(_SIP, "SELECT symbol, date, close, invested, units, units * close AS value FROM v", "symbol, date", 4)
QUERIES["savings_plan_summary"] = lambda spark, d: rounded(sv.plan_summary(tb.bars_daily(spark, d)), 4)
SQL["savings_plan_summary"] = final(
    _SIP + """,
s AS (SELECT symbol, count(*) FILTER (invested > 0) AS n_contributions, sum(invested) AS total_invested, arg_max(units * close, date) AS final_value,
  min(date) FILTER (invested > 0) AS t0, max(date) AS t1 FROM v GROUP BY symbol),
cf AS MATERIALIZED (SELECT symbol, (date - t0) / 365.0 AS t, -invested AS amount FROM v JOIN s USING (symbol) WHERE invested > 0
  UNION ALL SELECT symbol, (t1 - t0) / 365.0, final_value FROM s),
ends AS (SELECT symbol, sum(amount * power(1 - 0.9999::DOUBLE, -t)) AS a, sum(amount * power(11.0::DOUBLE, -t)) AS b FROM cf GROUP BY symbol),
bis(symbol, k, lo, hi, side) AS (
  SELECT symbol, 0, -0.9999::DOUBLE, 10.0::DOUBLE, sign(a) FROM ends WHERE a * b <= 0
  UNION ALL
  SELECT x.symbol, x.k + 1, CASE WHEN sign(n.npv) = x.side THEN (x.lo + x.hi) / 2 ELSE x.lo END, CASE WHEN sign(n.npv) = x.side THEN x.hi ELSE (x.lo + x.hi) / 2 END, x.side
  FROM bis x, LATERAL (SELECT sum(amount * power(1 + (x.lo + x.hi) / 2, -t)) AS npv FROM cf WHERE cf.symbol = x.symbol) n WHERE x.k < 80),
irr AS (SELECT symbol, (lo + hi) / 2 * 100 AS xirr_pct FROM bis WHERE k = 80),
dd AS (SELECT symbol, min(val / top - 1) * 100 AS max_drawdown_pct FROM (SELECT symbol, units * close AS val,
  max(units * close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS top FROM v) GROUP BY symbol)""",
    """SELECT symbol, n_contributions, total_invested, final_value, final_value - total_invested AS absolute_gain, xirr_pct, max_drawdown_pct
  FROM s LEFT JOIN irr USING (symbol) JOIN dd USING (symbol)""",
    "symbol, n_contributions", 4, recursive=True,
)
QUERIES["max_drawdown"] = lambda spark, d: rounded(rp.drawdown_of_series(tb.bars_daily(spark, d), ["symbol"], "date", "close"))
SQL["max_drawdown"] = final(
    DAILY + """,
p AS (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS top FROM bars),
t AS (SELECT symbol, min(close / top - 1) AS max_drawdown, arg_min(date, (close / top - 1, date)) AS trough_date FROM p GROUP BY symbol)""",
    """SELECT t.symbol, max_drawdown, trough_date, (SELECT min(b.date) FROM bars b WHERE b.symbol = t.symbol AND b.date <= trough_date AND b.close =
  (SELECT max(c.close) FROM bars c WHERE c.symbol = t.symbol AND c.date <= trough_date)) AS peak_date FROM t""",
    "symbol, trough_date, peak_date",
)


# --- regimes
def index_bars(spark, d):
    return tb.bars_from_ticks(tb._line_ticks(spark, d), ["date"], "px", "qty", turnover="value").withColumn("symbol", F.lit("index"))


def vix(spark, d):
    """Volatility index stand-in: 250 times the day's mean tax rate, a number around 10."""
    li = tb.table(spark, d, "lineitem")
    return li.groupBy(F.col("l_shipdate").cast("date").alias("date")).agg((F.avg("l_tax") * 350 + 5).alias("close"))


def _indicators(spark, d):
    return rg.index_indicators(index_bars(spark, d), vix(spark, d))


_IND = LINE + f""",
ib AS (SELECT date, max(px) AS high, min(px) AS low, arg_max(px, (l_orderkey, l_linenumber, px)) AS close FROM line GROUP BY date),
vx AS (SELECT CAST(l_shipdate AS DATE) AS date, avg(l_tax) * 350 + 5 AS vix FROM lineitem GROUP BY 1),
i0 AS (SELECT 'index' AS symbol, date, close, greatest(high - low, abs(high - lag(close) OVER (ORDER BY date)), abs(low - lag(close) OVER (ORDER BY date))) AS tr FROM ib),
i1 AS (SELECT *, {full('avg(close)', 'close', 20)} AS a, {full('avg(close)', 'close', 50)} AS b, {full('avg(tr)', 'tr', 14)} AS c FROM i0),
ind AS (SELECT symbol, date, CASE WHEN b IS NOT NULL THEN close / a END AS v20, CASE WHEN b IS NOT NULL THEN close / b END AS v50,
  CASE WHEN b IS NOT NULL THEN c / close END AS atr, vix FROM i1 LEFT JOIN vx USING (date)),
cand AS (SELECT *, CASE WHEN v20 > 1.02 AND v50 > 1.05 AND vix < 15 THEN 'bull_trend' WHEN v50 < 0.98 AND vix > 18 THEN 'bear_trend'
  WHEN v20 > 0.99 AND v50 < 1.01 AND vix < 20 THEN 'sideways' WHEN vix > 22 AND atr > 0.02 THEN 'high_volatility' ELSE 'sideways' END AS candidate FROM ind)"""


def _ind(name):
    return F.try_element_at("indicators", F.lit(name))


QUERIES["regime_indicators"] = lambda spark, d: rounded(
    _indicators(spark, d).select(
        "date", _ind("nifty_vs_20dma").alias("v20"), _ind("nifty_vs_50dma").alias("v50"), _ind("atr_14_pct").alias("atr"), _ind("india_vix").alias("vix"),
        rg.match_regime().alias("candidate"),
    )
)
SQL["regime_indicators"] = final(_IND, "SELECT date, v20, v50, atr, vix, candidate FROM cand", "date, candidate")


def _regimes(spark, d):
    c = _indicators(spark, d).withColumn("candidate", rg.match_regime())
    return rg.with_hysteresis(c, ["symbol"], "date", "candidate")


QUERIES["regime_hysteresis"] = lambda spark, d: _regimes(spark, d).select(
    "date", "candidate", "regime", rg.size_multiplier(F.col("regime")).alias("multiplier"),
    rg.infer_strategy(F.col("regime"), F.lit("BUY")).alias("strategy"),
    rg.strategy_allowed(F.col("regime"), rg.infer_strategy(F.col("regime"), F.lit("BUY"))).alias("allowed"),
)
SQL["regime_hysteresis"] = "WITH RECURSIVE " + _IND + """,
n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY date) AS rn FROM cand),
h(rn, date, candidate, regime, pending, cnt) AS (
  SELECT rn, date, candidate, candidate, NULL::VARCHAR, 0 FROM n WHERE rn = 1
  UNION ALL
  SELECT n.rn, n.date, n.candidate,
    CASE WHEN n.candidate <> h.regime AND (CASE WHEN n.candidate IS NOT DISTINCT FROM h.pending THEN h.cnt + 1 ELSE 1 END) >= 5 THEN n.candidate ELSE h.regime END,
    CASE WHEN n.candidate = h.regime OR (CASE WHEN n.candidate IS NOT DISTINCT FROM h.pending THEN h.cnt + 1 ELSE 1 END) >= 5 THEN NULL ELSE n.candidate END,
    CASE WHEN n.candidate = h.regime OR (CASE WHEN n.candidate IS NOT DISTINCT FROM h.pending THEN h.cnt + 1 ELSE 1 END) >= 5 THEN 0
      WHEN n.candidate IS NOT DISTINCT FROM h.pending THEN h.cnt + 1 ELSE 1 END
  FROM h JOIN n ON n.rn = h.rn + 1)
SELECT date, candidate, regime, CASE regime WHEN 'bull_trend' THEN 1.0::DOUBLE WHEN 'bear_trend' THEN 0.5 WHEN 'high_volatility' THEN 0.4 ELSE 0.7 END AS multiplier,
  CASE regime WHEN 'bear_trend' THEN 'long_momentum' WHEN 'sideways' THEN 'mean_reversion' WHEN 'high_volatility' THEN 'volatility_breakout' ELSE 'trend_following' END AS strategy,
  regime <> 'bear_trend' AS allowed FROM h"""


def _proxy(spark, d):
    f = ft.add_families(tb.bars_daily(spark, d), ["returns", "averages", "atr"])
    f = f.select("symbol", "date", "close_to_sma_20", "close_to_sma_50", "volatility_20d", "atr_pct").dropna()
    return rg.label_regimes(f, rg.regime_thresholds(f.filter(F.col("date") < "2000-01-01")))


QUERIES["regime_proxy_labels"] = lambda spark, d: (
    _proxy(spark, d).groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("n"))
)

SQL["regime_proxy_labels"] = "WITH RECURSIVE " + _RET + f""",
tr AS (SELECT symbol, date, close, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr FROM bars),
{_smoothed('tr', {'atr': ('tr', 1 / 14)})},
f0 AS (SELECT r.symbol, r.date, {full('stddev_samp(returns)', 'returns', 20, 'r.date', 'r.symbol')} * sqrt(252) AS vol, r.close / ({full('avg(r.close)', 'r.close', 20, 'r.date', 'r.symbol')}) - 1 AS c20,
  r.close / ({full('avg(r.close)', 'r.close', 50, 'r.date', 'r.symbol')}) - 1 AS c50, atr / r.close AS atr_pct FROM r JOIN sm USING (symbol, date)),
f AS (SELECT * FROM f0 WHERE vol IS NOT NULL AND c50 IS NOT NULL),
t AS (SELECT symbol, quantile_cont(vol, 0.33) AS lo, quantile_cont(vol, 0.67) AS hi, quantile_cont(atr_pct, 0.67) AS ah FROM f WHERE date < DATE '2000-01-01' GROUP BY symbol)
SELECT symbol, CASE WHEN c20 > 0.02 AND c50 > 0.05 AND vol < lo THEN 'bull_trend' WHEN c50 < -0.02 AND vol > hi THEN 'bear_trend'
  WHEN atr_pct > ah THEN 'high_volatility' ELSE 'sideways' END AS regime, count(*) AS n FROM f JOIN t USING (symbol) GROUP BY ALL"""


# --- signals
def _signals(spark, d):
    t = tb.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        F.array(F.lit(1.0) - (F.col("l_discount") * 5 + 0.4), F.col("l_discount") * 5 + 0.4).alias("probabilities"),
        F.create_map(
            F.lit("trees"), F.array(F.lit(1.0) - F.col("l_tax") * 10, F.col("l_tax") * 10), F.lit("linear"), F.array(F.lit(0.45), F.lit(0.55))
        ).alias("subs"),
        (F.col("l_returnflag") != "R").alias("aligned"),
    )
    return rg.signals(t, sub_models="subs")


QUERIES["trade_signals"] = lambda spark, d: rounded(
    _signals(spark, d).select("l_orderkey", "l_linenumber", "l_extendedprice", "confidence", "ensemble_agreement", "action", "tier", "execution_action")
)
SQL["trade_signals"] = final(
    """t AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount * 5 + 0.4::DOUBLE AS up, l_tax * 10 AS st, l_returnflag <> 'R' AS al FROM lineitem),
u AS (SELECT *, CASE WHEN 1.0 - up >= up THEN 0 ELSE 1 END AS pick FROM t),
v AS (SELECT *, ((CASE WHEN 1.0 - st >= st THEN 0 ELSE 1 END = pick)::INT + (pick = 1)::INT) / 2.0 AS ensemble_agreement FROM u),
w AS (SELECT *, least(greatest(0.30 * greatest(1.0 - up, up) + 0.25 * ensemble_agreement + 0.20 * al::INT + 0.15 * 0.5 + 0.10 * 1.0, 0.0), 1.0) AS confidence FROM v)""",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, confidence, ensemble_agreement,
  CASE WHEN confidence < 0.6 THEN 'HOLD' WHEN pick = 0 THEN 'SELL' ELSE 'BUY' END AS action,
  CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' WHEN confidence >= 0.5 THEN 'low' ELSE 'none' END AS tier,
  CASE WHEN confidence < 0.6 THEN 'none' WHEN confidence >= 0.75 THEN 'execute_full' ELSE 'execute_half' END AS execution_action FROM w""",
    "l_orderkey, l_linenumber, action, tier, execution_action",
)
QUERIES["position_sizes"] = lambda spark, d: rounded(
    tb.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        rk.position_size(F.col("l_discount") * 10, F.lit(0.4) + F.col("l_tax") * 4, F.lit(0.015), F.lit(0.008), 0.7).alias("size_pct"),
    )
)
SQL["position_sizes"] = final(
    """k AS (SELECT *, 0.4::DOUBLE + l_tax * 4 AS w, 0.015::DOUBLE / 0.008::DOUBLE AS r FROM lineitem),
s AS (SELECT *, greatest(least((w * r - (1 - w)) / r * 0.25, 0.5), 0.0) AS kelly FROM k)""",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, greatest(least(least(kelly, 0.02::DOUBLE / 0.008::DOUBLE, 0.10::DOUBLE) * 0.7::DOUBLE
  * least(greatest(l_discount * 10, 0.0), 1.0), 0.10), 0.0) AS size_pct FROM s""",
    "l_orderkey, l_linenumber",
)


# --- allocation over the flow rule's out-of-sample reports
def _allocation(spark, d):
    bars = cut_lineage(tb.bars_daily(spark, d))
    rep = cut_lineage(fl.flow_backtest(bars, wide(spark, d), CAPITAL).filter(F.col("split") == "oos"))
    cont = ql.listing_continuity(bars, min_coverage=0.5, max_gap=60.0).filter("is_continuous")
    return rk.allocate(rep.select("symbol", "total_trades", "expectancy", "sharpe_ratio"), ql.liquidity_daily(bars), cont, CAPITAL, min_adtv_cr=0.01)


QUERIES["capital_allocation"] = lambda spark, d: rounded(_allocation(spark, d), 4)
SQL["capital_allocation"] = final(
    _rule_sql() + ",\n" + report_sql("sp", "symbol, quantile_threshold, hold_days, split", "exit_date", "entry_date", CAPITAL, True) + """,
lq AS (SELECT symbol, avg(close * volume) / 1e7 AS adtv FROM bars GROUP BY symbol),
gp AS (SELECT *, date - lag(date) OVER (PARTITION BY symbol ORDER BY date) AS gap FROM bars),
ls AS (SELECT symbol, count(*) AS n, max(gap) AS longest, avg((volume <= 0)::INT) AS zero,
  len(list_filter(generate_series(min(date), max(date), INTERVAL 1 DAY), lambda x: isodow(x) < 6)) AS wd FROM gp GROUP BY symbol),
al AS (SELECT ls.symbol, total_trades, expectancy, sharpe_ratio, coalesce(adtv, 0.0) AS adtv_cr, CASE WHEN total_trades IS NULL THEN 'no backtest result'
  WHEN total_trades < 20 THEN printf('only %d backtest trades (need >= 20)', total_trades)
  WHEN coalesce(adtv, 0.0) < 0.01 THEN printf('ADTV Rs.%.1fcr below Rs.0.01cr minimum', coalesce(adtv, 0.0))
  WHEN expectancy <= 0 THEN printf('non-positive expectancy (%.5f) after costs', expectancy) END AS reason
  FROM ls LEFT JOIN (SELECT * FROM rep WHERE split = 'oos') r USING (symbol) LEFT JOIN lq USING (symbol)
  WHERE n / greatest(wd, 1) >= 0.5 AND coalesce(longest, 0) <= 60 AND zero <= 0.05),
ch AS (SELECT symbol, expectancy FROM al WHERE reason IS NULL ORDER BY sharpe_ratio DESC, symbol LIMIT 5),
wt AS (SELECT symbol, expectancy / sum(expectancy) OVER () AS weight FROM ch)""",
    "SELECT al.symbol, total_trades, expectancy, sharpe_ratio, adtv_cr, weight, weight * 1000000 AS allocated_capital, reason FROM al LEFT JOIN wt USING (symbol)",
    "symbol, total_trades, reason", 4, recursive=True,
)


# --- running risk state of one account per symbol, exits, stress
def _closed(spark, d):
    return journal(spark, d).filter(F.col("status") == "CLOSED").withColumn("pnl", F.col("pnl") / 40)


QUERIES["risk_state"] = lambda spark, d: rounded(
    rk.risk_state(_closed(spark, d), "symbol", "date", ["order_ref", "entry_price"]).select(
        "symbol", "date", "order_ref", "entry_price", "daily_pnl", "current_capital", "peak_capital", "consecutive_losses", "halt_reason", "size_multiplier"
    ), 3
)
SQL["risk_state"] = final(
    _J + """,
c AS (SELECT *, pnl / 40 AS p, row_number() OVER (PARTITION BY symbol ORDER BY date, order_ref, entry_price) AS rn FROM j WHERE status = 'CLOSED'),
a AS (SELECT *, sum(p) OVER (PARTITION BY symbol, date ORDER BY rn ROWS UNBOUNDED PRECEDING) AS daily_pnl,
  1000000 + sum(p) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING) AS current_capital,
  count(*) FILTER (p >= 0) OVER (PARTITION BY symbol, date ORDER BY rn ROWS UNBOUNDED PRECEDING) AS g FROM c),
b AS (SELECT *, greatest(1000000.0, max(current_capital) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING)) AS peak_capital,
  count(*) FILTER (p < 0) OVER (PARTITION BY symbol, date, g ORDER BY rn ROWS UNBOUNDED PRECEDING) AS consecutive_losses FROM a),
t AS (SELECT *, CASE WHEN -daily_pnl / 1000000 >= 0.03 THEN 'daily_loss_limit_breached' WHEN (peak_capital - current_capital) / peak_capital >= 0.12
  THEN 'max_drawdown_breached' END AS trip FROM b)""",
    """SELECT symbol, date, order_ref, entry_price, daily_pnl, current_capital, peak_capital, CAST(consecutive_losses AS INTEGER) AS consecutive_losses,
  last_value(trip IGNORE NULLS) OVER (PARTITION BY symbol, date ORDER BY rn ROWS UNBOUNDED PRECEDING) AS halt_reason,
  CASE WHEN consecutive_losses >= 3 THEN 0.5 ELSE 1.0 END AS size_multiplier FROM t""",
    "symbol, date, order_ref, consecutive_losses, halt_reason", 3,
)


# --- open positions at every order; closed trades are held for one to nine days
def _held(spark, d):
    closed = F.when(F.col("status") == "CLOSED", F.date_add("date", (F.col("order_ref") % 9 + 1).cast("int")))
    return journal(spark, d).withColumn("pnl", F.col("pnl") / 40).withColumn("exit_date", closed)


def _counts(spark, d):
    held = cut_lineage(_held(spark, d))
    order = ["order_ref", "entry_price"]
    state = rk.risk_state(held.where("exit_date IS NOT NULL"), "symbol", "exit_date", order)
    halts = state.groupBy("symbol", F.col("exit_date").alias("date")).agg(F.bool_or("halted").alias("halted"))
    # only the first two years' trades are still open at their end, so the count moves around the limit
    some = held.where("exit_date IS NOT NULL OR date < DATE '1995-03-01'")
    out = rk.open_position_counts(some, "symbol", "date", "exit_date", order, rk.RiskLimits(max_open_positions=8), halts)
    return out.select("symbol", "date", "order_ref", "entry_price", "open_before", "halted", "can_open")


QUERIES["open_position_counts"] = lambda spark, d: rounded(_counts(spark, d), 3)
SQL["open_position_counts"] = final(
    _J + """,
h AS (SELECT *, pnl / 40 AS p, CASE WHEN status = 'CLOSED' THEN date + CAST(order_ref % 9 + 1 AS INTEGER) END AS exit_date FROM j),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY exit_date, order_ref, entry_price) AS rn FROM h WHERE exit_date IS NOT NULL),
a AS (SELECT *, sum(p) OVER (PARTITION BY symbol, exit_date ORDER BY rn ROWS UNBOUNDED PRECEDING) AS daily_pnl,
  1000000 + sum(p) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING) AS capital FROM k),
b AS (SELECT *, greatest(1000000.0, max(capital) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING)) AS peak FROM a),
t AS (SELECT symbol, exit_date AS date, bool_or(-daily_pnl / 1000000 >= 0.03 OR (peak - capital) / peak >= 0.12) AS halted FROM b GROUP BY ALL),
o AS (SELECT * FROM h WHERE exit_date IS NOT NULL OR date < DATE '1995-03-01'),
e AS (SELECT symbol, date AS happened, 1 AS step, order_ref, entry_price FROM o UNION ALL SELECT symbol, exit_date, -1, order_ref, entry_price FROM o WHERE exit_date IS NOT NULL),
s AS (SELECT *, sum(step) OVER (PARTITION BY symbol ORDER BY happened, step, order_ref, entry_price ROWS UNBOUNDED PRECEDING) - 1 AS open_before FROM e)""",
    """SELECT s.symbol, s.happened AS date, order_ref, entry_price, CAST(open_before AS BIGINT) AS open_before, coalesce(halted, false) AS halted,
  NOT coalesce(halted, false) AND open_before < 8 AS can_open FROM s LEFT JOIN t ON t.symbol = s.symbol AND t.date = s.happened WHERE step = 1""",
    "symbol, date, order_ref, open_before, halted, can_open", 3,
)


def _exits(spark, d):
    opened = tb.trades(spark, d).filter(F.col("status") == "OPEN")
    latest = tb.bars_daily(spark, d).groupBy("symbol").agg(F.max_by("close", "date").alias("close"))
    return rk.evaluate_exits(opened, latest).select("order_ref", "l_orderkey", "entry_price", "price", "move_pct", "exit_reason", "exit_price", "pnl")


QUERIES["position_exits"] = lambda spark, d: rounded(_exits(spark, d), 5)
_SHORT = "action = 'SELL'"
_TK = "round(round_even({} / 0.05, 0) * 0.05, 2)"
SQL["position_exits"] = final(
    TRADES + DAILY.replace(LINE, ",\n" + LINE, 1) + f""",
lp AS (SELECT symbol, arg_max(close, date) AS price FROM bars GROUP BY symbol),
o AS (SELECT *, CASE WHEN action = 'BUY' THEN (price - entry_price) / entry_price ELSE -(price - entry_price) / entry_price END AS move_pct
  FROM trades JOIN lp USING (symbol) WHERE status = 'OPEN'),
e AS (SELECT *, CASE WHEN move_pct >= 0.015 THEN 'take_profit' WHEN move_pct <= -0.008 THEN 'stop_loss' END AS exit_reason FROM o),
f AS (SELECT *, {_TK.format('entry_price')} AS pin, CASE WHEN exit_reason IS NOT NULL THEN {_TK.format('price')} END AS pout FROM e)""",
    f"SELECT order_ref, l_orderkey, entry_price, price, move_pct, exit_reason, pout AS exit_price, {pnl_sql('pin', 'pout', 'quantity', _SHORT)} AS pnl FROM f",
    "order_ref, l_orderkey, exit_reason", 5,
)
SCENARIOS = (("early", "1996-02-01", "1996-06-30"), ("middle", "1998-09-01", "1998-12-31"), ("outside", "2008-09-01", "2008-12-31"))
_ST = DAILY + """,
scn AS (SELECT unnest(['early', 'middle', 'outside']) AS scenario, unnest([DATE '1996-02-01', '1998-09-01', '2008-09-01']) AS s, unnest([DATE '1996-06-30', '1998-12-31', '2008-12-31']) AS e),
x AS (SELECT b.symbol, scenario, b.date, close / lag(close) OVER (PARTITION BY b.symbol, scenario ORDER BY b.date) - 1 AS r FROM bars b JOIN scn ON b.date BETWEEN s AND e),
y AS (SELECT *, product(1 + r) OVER (PARTITION BY symbol, scenario ORDER BY date ROWS UNBOUNDED PRECEDING) AS eq FROM x WHERE r IS NOT NULL),
z AS (SELECT *, max(eq) OVER (PARTITION BY symbol, scenario ORDER BY date ROWS UNBOUNDED PRECEDING) AS top FROM y),
g AS (SELECT symbol, scenario, count(*) + 1 AS n, min(r) AS worst, min(eq / top - 1) AS dd FROM z GROUP BY ALL),
st AS (SELECT p.symbol, scn.scenario, coalesce(n, 0) AS trading_days, coalesce(worst, 0.0) AS worst_day_return_pct, coalesce(dd, 0.0) AS max_drawdown_pct,
  n IS NOT NULL AS data_available, coalesce(abs(worst) * 100000, 0.0) AS capital_at_risk FROM (SELECT DISTINCT symbol FROM bars) p CROSS JOIN scn
  LEFT JOIN g ON g.symbol = p.symbol AND g.scenario = scn.scenario),
res AS (SELECT *, capital_at_risk / 1000000 >= 0.03 AS would_breach_daily_loss_limit,
  NOT (capital_at_risk / 1000000 >= 0.03) AND capital_at_risk / 1000000 >= 0.12 AS would_breach_max_drawdown FROM st)"""
QUERIES["stress_test"] = lambda spark, d: rounded(rk.stress_test(tb.bars_daily(spark, d), SCENARIOS))
SQL["stress_test"] = final(
    _ST, "SELECT * FROM res", "symbol, scenario, trading_days, data_available, would_breach_daily_loss_limit, would_breach_max_drawdown"
)
QUERIES["stress_worst_case"] = lambda spark, d: rounded(rk.worst_case(rk.stress_test(tb.bars_daily(spark, d), SCENARIOS)))
SQL["stress_worst_case"] = final(
    _ST, """SELECT bool_or(data_available) AS data_available, arg_min(symbol, (worst_day_return_pct, scenario, symbol)) FILTER (data_available) AS worst_symbol,
  arg_min(scenario, (worst_day_return_pct, scenario, symbol)) FILTER (data_available) AS worst_scenario, min(worst_day_return_pct) FILTER (data_available) AS worst_return_pct,
  bool_or(data_available AND would_breach_daily_loss_limit) AS any_breach_daily_loss_limit, bool_or(data_available AND would_breach_max_drawdown) AS any_breach_max_drawdown,
  count(DISTINCT symbol) FILTER (NOT data_available) AS n_symbols_with_no_data FROM res""",
    "data_available, worst_symbol, worst_scenario, any_breach_daily_loss_limit, any_breach_max_drawdown, n_symbols_with_no_data",
)
QUERIES["stress_symbols_without_data"] = lambda spark, d: rk.symbols_without_data(rk.stress_test(tb.bars_daily(spark, d), SCENARIOS))
SQL["stress_symbols_without_data"] = f"WITH {_ST} SELECT symbol, scenario FROM res WHERE NOT data_available"
QUERIES["exit_targets"] = lambda spark, d: rounded(
    tb.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        F.expr("CASE l_returnflag WHEN 'A' THEN 'swing' WHEN 'N' THEN 'intraday' END").alias("horizon"), F.col("l_extendedprice").alias("_p"),
    ).withColumn("t", rg.horizon_targets("horizon")).select(
        "l_orderkey", "l_linenumber", "horizon", "l_extendedprice", (F.col("_p") * (1 + F.col("t.profit_target_pct"))).alias("target"),
        (F.col("_p") * (1 - F.col("t.stop_loss_pct"))).alias("stop"), F.col("t.trailing_stop_pct").alias("trailing_stop_pct"),
    ), 4
)
SQL["exit_targets"] = final(
    "h AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 'swing' WHEN 'N' THEN 'intraday' END AS horizon FROM lineitem)",
    """SELECT l_orderkey, l_linenumber, horizon, l_extendedprice, l_extendedprice * (1 + CASE WHEN horizon = 'swing' THEN 0.05::DOUBLE ELSE 0.01::DOUBLE END) AS target,
  l_extendedprice * (1 - CASE WHEN horizon = 'swing' THEN 0.03::DOUBLE ELSE 0.01::DOUBLE END) AS stop, CASE WHEN horizon = 'swing' THEN 0.02 ELSE 0.005 END AS trailing_stop_pct FROM h""",
    "l_orderkey, l_linenumber, horizon", 4,
)
