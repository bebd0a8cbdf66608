"""Queries of positioning flow: features, ranks, the flow rule, its grid and its significance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog.backtest_cat import log_scaled, log_scaled_sql
from tickloom.catalog.sqltext import BENCH, DAILY, LINE, OI, REPORT_KEYS, final, pnl_sql, report_sql, t_p_sql
from tickloom.functions.scalar import rounded
from tickloom.operators import flow as fl
from tickloom.operators import learning as ml
from tickloom.operators.significance import spearman_ic
from tickloom.session import cut_lineage
from tickloom.sources import tables as tb

QUERIES, SQL = {}, {}
CAPITAL = 1_000_000.0


def wide(spark, d):
    return fl.net_positioning(tb.participant_oi(spark, d))


QUERIES["participant_oi"] = lambda spark, d: rounded(tb.participant_oi(spark, d), 4)
SQL["participant_oi"] = final(OI, "SELECT * FROM oi", "date, client_type", 4)
_NET = {
    "net_index_future": "future_index_long - future_index_short",
    "net_stock_future": "future_stock_long - future_stock_short",
    "net_index_option_bias": "(option_index_call_long - option_index_put_long) - (option_index_call_short - option_index_put_short)",
}
_COLS = [f"{c}_{n}" for c in ("client", "dii", "fii", "pro") for n in _NET]
_WIDE = OI + ",\nwide AS MATERIALIZED (SELECT date, " + ", ".join(
    f"max({e}) FILTER (lower(client_type) = '{c}') AS {c}_{n}" for c in ("client", "dii", "fii", "pro") for n, e in _NET.items()
) + " FROM oi GROUP BY date)"
QUERIES["net_positioning"] = lambda spark, d: rounded(wide(spark, d), 4)
SQL["net_positioning"] = final(_WIDE, "SELECT * FROM wide", "date", 4)

_FEAT = _WIDE + ",\nfeat AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT date, '{c}_diff{k}' AS feature, {c} - lag({c}, {k}) OVER (ORDER BY date) AS value FROM wide" for c in _COLS for k in fl.LOOKBACKS
) + ")"
QUERIES["flow_features"] = lambda spark, d: rounded(fl.flow_features(wide(spark, d)), 4)
SQL["flow_features"] = final(_FEAT, "SELECT * FROM feat", "date, feature", 4)
_RANK = _FEAT + """,
fr AS (SELECT feature, date, value, row_number() OVER (PARTITION BY feature ORDER BY date) AS rn FROM feat),
rk0 AS (SELECT feature, date, value, list(value) OVER w AS a, count(value) OVER w AS n FROM feat
  WHERE {where} WINDOW w AS (PARTITION BY feature ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
rk AS MATERIALIZED (SELECT feature, date, value, CASE WHEN n = 252 THEN len(list_filter(a, lambda x: x <= value)) / 252.0 END AS rank FROM rk0)"""
QUERIES["flow_rolling_rank"] = lambda spark, d: rounded(
    fl.rolling_rank(fl.flow_features(wide(spark, d), (5,)), ["feature"], "date", "value", 252, "rank"), 4
)
SQL["flow_rolling_rank"] = final(_RANK.replace("{where}", "feature LIKE '%\\_diff5' ESCAPE '\\'"), "SELECT * FROM rk", "date, feature", 4)


def _rule_sql(thresholds=(0.8,), holds=(5,), start_row=None):
    """Row-by-row walk of the capacity rule as a recursive query over each instrument's rows."""
    q, h = ", ".join(f"{x}::DOUBLE" for x in thresholds), ", ".join(map(str, holds))
    start = f"WHERE idx0 >= {start_row}" if start_row is not None else ""
    where = "feature = 'dii_net_index_future_diff5'"
    return DAILY + ",\n" + _RANK.replace("{where}", where) + f""",
big AS (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) >= {252 + max(holds) + 2}),
pr0 AS (SELECT symbol, b.date, close, rank, row_number() OVER (PARTITION BY symbol ORDER BY b.date) - 1 AS idx0
  FROM bars b SEMI JOIN big USING (symbol) LEFT JOIN rk ON rk.date = b.date),
pr AS MATERIALIZED (SELECT symbol, date, close, rank, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS idx FROM pr0 {start}),
gr AS (SELECT unnest([{q}]) AS quantile_threshold), hd AS (SELECT unnest([{h}])::INTEGER AS hold_days),
walk(symbol, quantile_threshold, hold_days, idx, recent, taken) AS (
  SELECT symbol, quantile_threshold, hold_days, 0::BIGINT, CASE WHEN coalesce(rank >= quantile_threshold, false) THEN [0::BIGINT] ELSE []::BIGINT[] END,
    coalesce(rank >= quantile_threshold, false) FROM pr, gr, hd WHERE idx = 0
  UNION ALL
  SELECT w.symbol, w.quantile_threshold, w.hold_days, p.idx,
    CASE WHEN coalesce(p.rank >= w.quantile_threshold, false) AND len(list_filter(w.recent, lambda x: x >= p.idx - w.hold_days)) < 5
      THEN list_append(list_filter(w.recent, lambda x: x >= p.idx - w.hold_days), p.idx) ELSE list_filter(w.recent, lambda x: x >= p.idx - w.hold_days) END,
    coalesce(p.rank >= w.quantile_threshold, false) AND len(list_filter(w.recent, lambda x: x >= p.idx - w.hold_days)) < 5
  FROM walk w JOIN pr p ON p.symbol = w.symbol AND p.idx = w.idx + 1),
tr0 AS (SELECT w.symbol, quantile_threshold, hold_days, s.date AS signal_date, e.date AS entry_date, x.date AS exit_date, e.close AS entry_price,
  x.close AS exit_price, CASE WHEN e.close > 0 THEN 200000.0 / e.close ELSE 0.0 END AS quantity
  FROM walk w JOIN pr s ON s.symbol = w.symbol AND s.idx = w.idx JOIN pr e ON e.symbol = w.symbol AND e.idx = w.idx + 1
  JOIN pr x ON x.symbol = w.symbol AND x.idx = w.idx + 1 + hold_days WHERE taken),
tr1 AS (SELECT *, {pnl_sql('entry_price', 'exit_price', 'quantity', 'false', True)} AS pnl FROM tr0),
tr AS MATERIALIZED (SELECT *, pnl / (entry_price * quantity) AS pnl_pct, 1.0::DOUBLE AS confidence,
  row_number() OVER (PARTITION BY symbol, quantile_threshold, hold_days ORDER BY exit_date, entry_date) AS pos,
  count(*) OVER (PARTITION BY symbol, quantile_threshold, hold_days) AS n FROM tr1),
sp AS (SELECT * EXCLUDE (pos, n), CASE WHEN pos <= floor(n * 0.7::DOUBLE) THEN 'train' ELSE 'oos' END AS split FROM tr)"""


_K = "symbol, quantile_threshold, hold_days"
_TC = "symbol, hold_days, signal_date, entry_date, exit_date"
QUERIES["flow_trades"] = lambda spark, d: rounded(fl.flow_trades(tb.bars_daily(spark, d), wide(spark, d)))
SQL["flow_trades"] = final(_rule_sql(), "SELECT * EXCLUDE (pos, n) FROM tr", _TC, recursive=True)
QUERIES["flow_trades_late_start"] = lambda spark, d: rounded(fl.flow_trades(tb.bars_daily(spark, d), wide(spark, d), start_row=400))
SQL["flow_trades_late_start"] = final(_rule_sql(start_row=400), "SELECT * EXCLUDE (pos, n) FROM tr", _TC, recursive=True)
QUERIES["flow_backtest"] = lambda spark, d: rounded(
    log_scaled(fl.flow_backtest(tb.bars_daily(spark, d), wide(spark, d), CAPITAL), "calmar_ratio", "total_pnl")
)
SQL["flow_backtest"] = final(
    _rule_sql() + ",\n" + report_sql("sp", _K + ", split", "exit_date", "entry_date", CAPITAL, True),
    f"SELECT {log_scaled_sql('calmar_ratio', 'total_pnl')} FROM rep", "symbol, hold_days, split, " + REPORT_KEYS, recursive=True,
)
QUERIES["flow_parameter_grid"] = lambda spark, d: rounded(fl.flow_parameter_grid(tb.bars_daily(spark, d), wide(spark, d)))
SQL["flow_parameter_grid"] = final(
    _rule_sql((0.70, 0.75, 0.80, 0.85, 0.90), (3, 5, 10, 20)) + ",\n" + report_sql("sp", _K + ", split", "exit_date", "entry_date", CAPITAL, True),
    """SELECT symbol, quantile_threshold, hold_days, total_trades AS oos_n_trades, sharpe_ratio AS oos_sharpe, win_rate AS oos_win_rate,
  avg_trade_return_pct AS oos_avg_trade_return_pct, sharpe_ratio > 0 AS oos_positive_sharpe FROM rep WHERE split = 'oos'""",
    "symbol, hold_days, oos_n_trades, oos_positive_sharpe", recursive=True,
)
QUERIES["flow_significance"] = lambda spark, d: rounded(fl.flow_significance(tb.bars_daily(spark, d), wide(spark, d)))
SQL["flow_significance"] = final(
    _rule_sql() + """,
s AS (SELECT symbol, count(*) AS n, avg(pnl_pct) * 100 AS mean_pct, stddev_samp(pnl_pct) * 100 AS std_pct FROM sp WHERE split = 'oos' GROUP BY 1),
t AS MATERIALIZED (SELECT *, mean_pct / nullif(std_pct / sqrt(n), 0) AS t_stat, CAST(n - 1 AS DOUBLE) AS df FROM s)""",
    "SELECT * EXCLUDE (df), " + t_p_sql("t_stat", "df") + " AS p_value FROM t", "symbol, n", recursive=True,
)


def _index(spark, d):
    return tb.benchmark_daily(spark, d).withColumn("symbol", F.lit("index"))


QUERIES["flow_ic"] = lambda spark, d: rounded(fl.flow_ic(_index(spark, d), wide(spark, d)))
SQL["flow_ic"] = final(
    LINE + ",\n" + BENCH + ",\n" + _FEAT + """,
lb AS (SELECT date, lead(close, 6) OVER (ORDER BY date) / lead(close, 1) OVER (ORDER BY date) - 1 AS label,
  row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM bench),
sg AS (SELECT feature, value, label, unnest(['full', CASE WHEN i < n // 2 THEN 'first_half' ELSE 'second_half' END]) AS segment
  FROM lb JOIN feat USING (date) WHERE value IS NOT NULL AND label IS NOT NULL),
rx AS (SELECT feature, segment, rank() OVER (PARTITION BY feature, segment ORDER BY value) + (count(*) OVER (PARTITION BY feature, segment, value) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY feature, segment ORDER BY label) + (count(*) OVER (PARTITION BY feature, segment, label) - 1) / 2.0 AS b FROM sg)""",
    "SELECT 'index' AS symbol, feature, segment, count(*) AS n, CASE WHEN count(*) >= 10 THEN corr(a, b) END AS ic FROM rx GROUP BY feature, segment",
    "symbol, feature, segment, n",
)
QUERIES["flow_ic_scan"] = lambda spark, d: rounded(fl.ic_scan(_index(spark, d), wide(spark, d)))


# --- all instruments as one account, and features over calendar folds
def _pooled_rules(spark, d):
    """The rule at a threshold of 0.9 against the rule at 0.8, over two months: over all years both p-values are zero."""
    t = fl.flow_trades(tb.bars_daily(spark, d), wide(spark, d), thresholds=(0.8, 0.9))
    t = cut_lineage(t.where("exit_date BETWEEN DATE '1998-01-01' AND DATE '1998-02-28'"))
    part = lambda q: t.where(F.col("quantile_threshold") == q)
    return ml.pooled_comparison(part(0.9), part(0.8))


QUERIES["flow_pooled_comparison"] = lambda spark, d: rounded(_pooled_rules(spark, d))
SQL["flow_pooled_comparison"] = final(
    _rule_sql((0.8, 0.9)) + """,
ag AS (SELECT quantile_threshold AS q, count(*) AS n, avg(pnl_pct) AS m, stddev_samp(pnl_pct) AS s, date_diff('day', min(exit_date), max(exit_date)) AS span FROM tr
  WHERE exit_date BETWEEN DATE '1998-01-01' AND DATE '1998-02-28' GROUP BY 1),
ra AS (SELECT *, CASE WHEN span > 0 THEN n / (span / 365.25) ELSE CAST(n AS DOUBLE) END AS tpy, m * 100 / nullif(s * 100 / sqrt(n), 0) AS t, CAST(n - 1 AS DOUBLE) AS df FROM ag),
pp AS MATERIALIZED (SELECT *, CASE WHEN coalesce(s, 0) > 1e-12 THEN m / s * sqrt(tpy) ELSE 0.0 END AS sharpe, """ + t_p_sql("t", "df") + """ AS p FROM ra),
ab AS (SELECT a.n AS an, a.m AS am, a.tpy AS atp, a.sharpe AS ash, a.p AS ap, b.n AS bn, b.m AS bm, b.tpy AS btp, b.sharpe AS bsh, b.p AS bp FROM pp a, pp b WHERE a.q > 0.85 AND b.q < 0.85)""",
    """SELECT 'all' AS portfolio, ash AS model_oos_sharpe, ap AS model_p_value, bsh AS benchmark_oos_sharpe, bp AS benchmark_p_value, ash > bsh AS beats_sharpe,
  ap <= bp AS beats_significance, CASE WHEN ash > bsh AND ap <= bp THEN 'beats_benchmark' ELSE 'does_not_beat_benchmark' END AS verdict,
  an AS model_total_trades, am AS model_avg_trade_return_pct, atp AS model_trades_per_year, bn AS benchmark_total_trades, bm AS benchmark_avg_trade_return_pct,
  btp AS benchmark_trades_per_year FROM ab""",
    "portfolio, beats_sharpe, beats_significance, verdict, model_total_trades, benchmark_total_trades", recursive=True,
)


def _recurring(spark, d):
    """Per instrument the features with a rank correlation of 0.08 or more in a third of its rows, over the thirds."""
    rows = fl.labelled_flow(tb.bars_daily(spark, d), wide(spark, d), lookbacks=(1, 5)).where("value IS NOT NULL AND label IS NOT NULL")
    rows = rows.withColumn("fold", F.floor(F.col("row") * 3 / F.col("n_rows")).cast("int"))
    ic = spearman_ic(cut_lineage(rows), ["symbol", "feature", "fold"], "value", "label")
    return ml.feature_recurrence(ic.where("abs(ic) >= 0.08"), ["symbol"]).withColumn("folds", F.concat_ws(",", F.transform("folds", lambda x: x.cast("string"))))


QUERIES["flow_feature_recurrence"] = _recurring
SQL["flow_feature_recurrence"] = "WITH " + DAILY + ",\n" + _WIDE + ",\nfeat AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT date, '{c}_diff{k}' AS feature, {c} - lag({c}, {k}) OVER (ORDER BY date) AS value FROM wide" for c in _COLS for k in (1, 5)
) + """),
lb AS (SELECT symbol, date, lead(close, 6) OVER w / lead(close, 1) OVER w - 1 AS label, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY date)),
sg AS (SELECT symbol, feature, value, label, CAST(floor(i * 3 / n) AS INTEGER) AS fold FROM lb JOIN feat USING (date) WHERE value IS NOT NULL AND label IS NOT NULL),
rx AS (SELECT symbol, feature, fold, rank() OVER (PARTITION BY symbol, feature, fold ORDER BY value) + (count(*) OVER (PARTITION BY symbol, feature, fold, value) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY symbol, feature, fold ORDER BY label) + (count(*) OVER (PARTITION BY symbol, feature, fold, label) - 1) / 2.0 AS b FROM sg),
ic AS (SELECT symbol, feature, fold, CASE WHEN count(*) >= 10 THEN corr(a, b) END AS ic FROM rx GROUP BY ALL)
SELECT symbol, feature, count(*) AS n_folds, string_agg(CAST(fold AS VARCHAR), ',' ORDER BY fold) AS folds, count(*) >= 2 AS recurring FROM ic WHERE abs(ic) >= 0.08 GROUP BY ALL"""

# rank correlations of every instrument, whole span and halves
QUERIES["flow_ic_all"] = lambda spark, d: rounded(fl.flow_ic(cut_lineage(tb.bars_daily(spark, d)), wide(spark, d), lookbacks=(5,)))
SQL["flow_ic_all"] = final(
    DAILY + ",\n" + _WIDE + ",\nfeat AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT date, '{c}_diff5' AS feature, {c} - lag({c}, 5) OVER (ORDER BY date) AS value FROM wide" for c in _COLS
    ) + """),
lb AS (SELECT symbol, date, lead(close, 6) OVER w / lead(close, 1) OVER w - 1 AS label, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY date)),
sg AS (SELECT symbol, feature, value, label, unnest(['full', CASE WHEN i < n // 2 THEN 'first_half' ELSE 'second_half' END]) AS segment
  FROM lb JOIN feat USING (date) WHERE value IS NOT NULL AND label IS NOT NULL),
rx AS (SELECT symbol, feature, segment, rank() OVER (PARTITION BY symbol, feature, segment ORDER BY value) + (count(*) OVER (PARTITION BY symbol, feature, segment, value) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY symbol, feature, segment ORDER BY label) + (count(*) OVER (PARTITION BY symbol, feature, segment, label) - 1) / 2.0 AS b FROM sg)""",
    "SELECT symbol, feature, segment, count(*) AS n, CASE WHEN count(*) >= 10 THEN corr(a, b) END AS ic FROM rx GROUP BY ALL",
    "symbol, feature, segment, n",
)
