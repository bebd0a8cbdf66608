"""SQL text shared by the oracles: the same fixture views and formulas, written for DuckDB."""

from __future__ import annotations

from tickloom.functions.costs import DEFAULT_COSTS, CostParams

LINE = """line AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS date,
  l_extendedprice / l_quantity AS px, l_quantity AS qty, l_extendedprice AS value FROM lineitem)"""

_OHLC = """arg_min(px, (l_orderkey, l_linenumber, px)) AS open, max(px) AS high, min(px) AS low,
  arg_max(px, (l_orderkey, l_linenumber, px)) AS close, sum(qty) AS volume, sum(value) AS turnover"""

DAILY = LINE + f""",
bars AS MATERIALIZED (SELECT p_brand AS symbol, date, {_OHLC}
  FROM line JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""

PANEL = LINE + f""",
bars AS MATERIALIZED (SELECT c_mktsegment AS symbol, date, {_OHLC}
  FROM line JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""

BENCH = "bench AS MATERIALIZED (SELECT date, avg(px) AS close FROM line GROUP BY date)"

INTRADAY = """bars AS MATERIALIZED (SELECT event_type AS symbol, CAST(ts AS DATE) AS session_date,
  CAST(hour(ts) AS INTEGER) AS hour, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume, sum(value) AS turnover,
  date_trunc('hour', min(ts)) AS date
  FROM events GROUP BY 1, 2, 3)"""

TRADES = """trades AS (SELECT l_orderkey * 10 + l_linenumber AS order_ref, l_orderkey, l_linenumber, p_brand AS symbol,
  CAST(l_shipdate AS DATE) AS date, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS action,
  l_quantity AS quantity, l_extendedprice / l_quantity AS entry_price, p_retailprice AS exit_price,
  0.5 + l_discount * 5 AS confidence, CASE WHEN l_linestatus = 'F' THEN 'CLOSED' ELSE 'OPEN' END AS status,
  CASE l_returnflag WHEN 'A' THEN 'bull_trend' WHEN 'N' THEN 'sideways' ELSE 'bear_trend' END AS regime,
  l_suppkey % 2 = 0 AS is_paper
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

OI = """oi_raw AS (SELECT CAST(o_orderdate AS DATE) AS date,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Client' WHEN '2-HIGH' THEN 'DII' WHEN '3-MEDIUM' THEN 'FII'
    WHEN '4-NOT SPECIFIED' THEN 'Pro' ELSE 'TOTAL' END AS client_type,
  o_orderkey % 2 = 0 AS lng, o_totalprice AS v, o_orderkey % 5 AS m5 FROM orders),
oi AS MATERIALIZED (SELECT g.date, g.client_type,
  coalesce(sum(v) FILTER (lng), 0.0) AS future_index_long, coalesce(sum(v) FILTER (NOT lng), 0.0) AS future_index_short,
  CAST(count(*) FILTER (lng) AS DOUBLE) AS future_stock_long,
  CAST(count(*) FILTER (NOT lng) AS DOUBLE) AS future_stock_short,
  CAST(count(*) FILTER (lng AND m5 < 2) AS DOUBLE) AS option_index_call_long,
  CAST(count(*) FILTER (lng AND m5 >= 2) AS DOUBLE) AS option_index_put_long,
  CAST(count(*) FILTER (NOT lng AND m5 < 2) AS DOUBLE) AS option_index_call_short,
  CAST(count(*) FILTER (NOT lng AND m5 >= 2) AS DOUBLE) AS option_index_put_short
  FROM (SELECT DISTINCT date, unnest(['Client', 'DII', 'FII', 'Pro']) AS client_type FROM oi_raw) g
  LEFT JOIN oi_raw r ON r.date = g.date AND r.client_type = g.client_type GROUP BY ALL)"""


def final(ctes: str, body: str, keys: str = "", places: int = 6, recursive: bool = False) -> str:
    """WITH ctes, then the body's rows with every column outside `keys` rounded."""
    nudge = repr(10.0**-places / 30)
    pick = f"* EXCLUDE ({keys})" if keys else "*"
    cols = (f"{keys}, " if keys else "") + f"round(COLUMNS({pick}) + {nudge}, {places}) + 0.0"
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes},\nbody AS ({body})\nSELECT {cols} FROM body"


def full(expr: str, col: str, n: int, order: str = "date", part: str = "symbol") -> str:
    """Rolling aggregate over n rows, NULL until n values are present."""
    frame = f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) {frame} = {n} THEN {expr} {frame} END"


def lag(col: str, k: int = 1, part: str = "symbol", order: str = "date") -> str:
    return f"lag({col}, {k}) OVER (PARTITION BY {part} ORDER BY {order})"


def cost_sql(entry: str, exit_: str, qty: str, short: str, delivery: bool, p: CostParams = DEFAULT_COSTS) -> str:
    """Round-trip cost expression; `short` is a boolean expression."""

    def leg(price, opening):
        t = f"({price} * {qty})"
        stt = p.stt_delivery_pct if delivery else p.stt_pct
        sells = f"({short})" if opening else f"(NOT ({short}))"
        b, x = f"least({p.brokerage_per_order}, {t} * {p.brokerage_pct_cap})", f"{t} * {p.transaction_charges_pct!r}"
        return (
            f"({b} + {x} + ({b} + {x}) * {p.gst_pct} + {t} * {p.sebi_charges_pct!r} + {t} * {p.slippage_pct}"
            f" + CASE WHEN {sells} THEN {t} * {stt} ELSE {t} * {p.stamp_duty_pct} END)"
        )

    return f"({leg(entry, True)} + {leg(exit_, False)})"


def pnl_sql(entry: str, exit_: str, qty: str, short: str = "false", delivery: bool = False, p=DEFAULT_COSTS) -> str:
    return (
        f"(CASE WHEN {short} THEN ({entry} - {exit_}) ELSE ({exit_} - {entry}) END * {qty}"
        f" - {cost_sql(entry, exit_, qty, short, delivery, p)})"
    )


def report_sql(src: str, keys: str, block: str, order: str, capital: float, event_time: bool = False) -> str:
    """CTE chain `rep` of one performance report per `keys` over `src` trades, in (block, order) sequence."""
    w = f"(PARTITION BY {keys} ORDER BY {block}, {order} ROWS UNBOUNDED PRECEDING)"
    sharpe = """CASE WHEN count(r) >= 2 THEN coalesce(sqrt(252) * (avg(r) - 0.06 / 252)
    / nullif(stddev_samp(r), 0), 0.0) ELSE 0.0 END AS sharpe_ratio"""
    extra = ""
    if event_time:
        span = f"date_diff('day', min({block}), max({block}))"
        tpy = f"CASE WHEN {span} > 0 THEN count(*) / ({span} / 365.25) ELSE CAST(count(*) AS DOUBLE) END"
        sharpe = f"""CASE WHEN coalesce(stddev_samp(pnl_pct), 0.0) > 1e-12
    THEN avg(pnl_pct) / stddev_samp(pnl_pct) * sqrt({tpy}) ELSE 0.0 END AS sharpe_ratio"""
        extra = f", {tpy} AS trades_per_year"
    return f"""eq AS (SELECT *, {capital} * product(1 + pnl_pct) OVER w AS equity, row_number() OVER w AS rn FROM {src} WINDOW w AS {w}),
pk AS (SELECT *, max(equity) OVER (PARTITION BY {keys} ORDER BY rn ROWS UNBOUNDED PRECEDING) AS peak,
  CASE WHEN rn > 1 THEN pnl_pct END AS r FROM eq),
agg AS (SELECT {keys}, count(*) AS total_trades, count(*) FILTER (pnl >= 0) AS winning_trades,
  count(*) FILTER (pnl < 0) AS losing_trades, sum(pnl) AS total_pnl, avg(pnl_pct) AS avg_trade_return_pct,
  coalesce(avg(pnl_pct) FILTER (pnl >= 0), 0.0) AS avg_win_pct, coalesce(abs(avg(pnl_pct) FILTER (pnl < 0)), 0.0) AS avg_loss_pct,
  avg(confidence) AS avg_confidence, min(equity / peak - 1) AS max_drawdown_pct,
  arg_min(rn, (equity / peak - 1, rn)) AS trough_rn,
  coalesce(sum(pnl) FILTER (pnl > 0), 0.0) AS gain, abs(coalesce(sum(pnl) FILTER (pnl < 0), 0.0)) AS loss,
  avg(r) AS ar, count(r) AS nr, {sharpe}{extra} FROM pk GROUP BY {keys}),
dates AS (SELECT {', '.join('p.' + k.strip() for k in keys.split(','))}, arg_max({block}, (equity, -rn)) AS peak_at, max_by({block}, rn) AS trough_at
  FROM pk p JOIN (SELECT {keys}, trough_rn FROM agg) a USING ({keys}) WHERE rn <= trough_rn GROUP BY ALL),
rep AS (SELECT * EXCLUDE (trough_rn, gain, loss, ar, nr, peak_at, trough_at), winning_trades / total_trades AS win_rate,
  CASE WHEN loss <> 0 THEN gain / loss WHEN gain > 0 THEN 'inf'::DOUBLE ELSE 0.0 END AS profit_factor,
  winning_trades / total_trades * avg_win_pct - (1 - winning_trades / total_trades) * avg_loss_pct AS expectancy,
  CASE WHEN avg_loss_pct <= 0 OR avg_win_pct = 0 THEN 0.0 ELSE greatest(least(0.25 *
    ((winning_trades / total_trades) * (avg_win_pct / avg_loss_pct) - (1 - winning_trades / total_trades))
    / (avg_win_pct / avg_loss_pct), 0.5), 0.0) END AS kelly_fraction,
  CASE WHEN nr < 1 THEN 0.0 WHEN max_drawdown_pct <> 0 THEN (power(1 + ar, 252) - 1) / abs(max_drawdown_pct)
    WHEN power(1 + ar, 252) > 1 THEN 'inf'::DOUBLE ELSE 0.0 END AS calmar_ratio,
  strftime(peak_at, '%Y-%m-%d') AS max_dd_peak_date, strftime(trough_at, '%Y-%m-%d') AS max_dd_trough_date
  FROM agg JOIN dates USING ({keys}))"""


REPORT_KEYS = "total_trades, winning_trades, losing_trades, max_dd_peak_date, max_dd_trough_date"


def t_p_sql(t: str, df: str) -> str:
    """Two-sided Student-t probability for integer df as a correlated series sum."""
    c2 = f"({df} / ({df} + {t} * {t}))"
    s = f"(abs({t}) / sqrt({df} + {t} * {t}))"
    even = f"""{s} * (1 + coalesce((SELECT sum(p) FROM (SELECT exp(sum(ln((2 * k - 1) / (2.0 * k)) + ln({c2}))
      OVER (ORDER BY k)) AS p FROM range(1, CAST({df} / 2 AS BIGINT)) g(k))), 0.0))"""
    odd = f"""2 / pi() * (atan(abs({t}) / sqrt({df})) + CASE WHEN {df} = 1 THEN 0.0 ELSE {s} * sqrt({c2}) * (1 +
      coalesce((SELECT sum(p) FROM (SELECT exp(sum(ln((2 * k) / (2.0 * k + 1)) + ln({c2})) OVER (ORDER BY k)) AS p
      FROM range(1, CAST(({df} - 1) / 2 AS BIGINT)) g(k))), 0.0)) END)"""
    return f"CASE WHEN {df} < 1 THEN NULL ELSE greatest(1 - (CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END), 0.0) END"
