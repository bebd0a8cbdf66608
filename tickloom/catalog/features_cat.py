"""Queries of the feature library."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog.sqltext import DAILY, INTRADAY, final, full, lag
from tickloom.functions.scalar import rounded
from tickloom.operators import features as ft
from tickloom.sources import tables as tb

QUERIES, SQL = {}, {}


def _family(name, families, cols):
    def run(spark, d):
        df = ft.add_families(tb.bars_daily(spark, d), families)
        return rounded(df.select("symbol", "date", *cols))

    QUERIES[f"features_{name}"] = run


def _sql(name, ctes, body, keys="symbol, date", recursive=False):
    SQL[f"features_{name}"] = final(ctes, body, keys, recursive=recursive)


_W = "(PARTITION BY symbol ORDER BY date)"
_DIV = "{} / nullif({}, 0)"

# --- returns and volatility
_family(
    "returns", ["returns"],
    ["returns", "log_returns", "returns_5d", "returns_10d", "returns_20d", "volatility_5d", "volatility_20d"],
)
_RET = DAILY + f""",
r AS (SELECT *, close / {lag('close')} - 1 AS returns, ln(close / {lag('close')}) AS log_returns,
  close / {lag('close', 5)} - 1 AS returns_5d, close / {lag('close', 10)} - 1 AS returns_10d,
  close / {lag('close', 20)} - 1 AS returns_20d FROM bars)"""
_sql(
    "returns", _RET,
    f"""SELECT symbol, date, returns, log_returns, returns_5d, returns_10d, returns_20d,
  {full('stddev_samp(returns)', 'returns', 5)} * sqrt(252) AS volatility_5d,
  {full('stddev_samp(returns)', 'returns', 20)} * sqrt(252) AS volatility_20d FROM r""",
)


def _smoothed(src: str, cols: dict[str, tuple[str, float]], out: str = "sm") -> str:
    """Row-by-row recursion over `src(symbol, date, ...)`."""
    first = ", ".join(f"{x} AS {o}" for o, (x, _) in cols.items())
    step = ", ".join(f"{a!r} * n.{x} + (1 - {a!r}) * p.{o}" for o, (x, a) in cols.items())
    return f"""{out}_n AS MATERIALIZED (SELECT *, row_number() OVER {_W} AS rn FROM {src}),
{out}(symbol, date, rn, {', '.join(cols)}) AS (
  SELECT symbol, date, rn, {first} FROM {out}_n WHERE rn = 1
  UNION ALL
  SELECT n.symbol, n.date, n.rn, {step} FROM {out} p JOIN {out}_n n ON n.symbol = p.symbol AND n.rn = p.rn + 1)"""


# --- moving averages
_family(
    "averages", ["averages"],
    [f"{p}_{n}" for n in (5, 10, 20, 50) for p in ("sma", "ema", "close_to_sma")] + ["golden_cross", "ma_alignment"],
)
_AVG = DAILY + ",\n" + _smoothed("bars", {f"ema_{n}": ("close", ft.span_alpha(n)) for n in (5, 10, 20, 50)}) + f""",
m AS (SELECT symbol, date, close, {', '.join(full('avg(close)', 'close', n) + f' AS sma_{n}' for n in (5, 10, 20, 50))} FROM bars)"""
_sql(
    "averages", _AVG,
    f"""SELECT m.symbol, m.date, {', '.join(f'sma_{n}, ema_{n}, close / sma_{n} - 1 AS close_to_sma_{n}' for n in (5, 10, 20, 50))},
  coalesce(sma_20 > sma_50, false)::INT AS golden_cross,
  (coalesce(sma_5 > sma_10, false)::INT + coalesce(sma_10 > sma_20, false)::INT
   + coalesce(sma_20 > sma_50, false)::INT) / 3.0 AS ma_alignment
  FROM m JOIN sm ON m.symbol = sm.symbol AND m.date = sm.date""",
    "symbol, date, golden_cross", True,
)

# --- relative strength
_family("rsi", ["rsi"], ["rsi_14", "rsi_slope", "rsi_overbought", "rsi_oversold"])
_RSI = DAILY + f""",
d AS (SELECT symbol, date, close - {lag('close')} AS d FROM bars),
g AS (SELECT symbol, date, CASE WHEN d > 0 THEN d ELSE 0.0 END AS gain, CASE WHEN d < 0 THEN -d ELSE 0.0 END AS loss FROM d),
{_smoothed('g', {'ag': ('gain', 1 / 14), 'al': ('loss', 1 / 14)})},
x AS (SELECT symbol, date, CASE WHEN al <> 0 THEN 100 - 100 / (1 + ag / al) WHEN ag > 0 THEN 100.0 END AS rsi_14 FROM sm)"""
_sql(
    "rsi", _RSI,
    f"""SELECT symbol, date, rsi_14, rsi_14 - {lag('rsi_14', 3)} AS rsi_slope,
  coalesce(rsi_14 > 70, false)::INT AS rsi_overbought, coalesce(rsi_14 < 30, false)::INT AS rsi_oversold FROM x""",
    "symbol, date, rsi_overbought, rsi_oversold", True,
)

# --- MACD
_family(
    "macd", ["macd"],
    ["macd", "macd_signal", "macd_histogram", "macd_cross", "macd_norm", "macd_signal_norm", "macd_hist_norm"],
)
_MACD = DAILY + ",\n" + _smoothed("bars", {"f": ("close", ft.span_alpha(12)), "s": ("close", ft.span_alpha(26))}) + """,
x0 AS MATERIALIZED (SELECT symbol, date, f - s AS macd FROM sm),
""" + _smoothed("x0", {"macd_signal": ("macd", ft.span_alpha(9))}, "sg") + """,
x AS (SELECT b.symbol, b.date, close, macd, macd_signal, (macd > macd_signal)::INT AS up
  FROM bars b JOIN x0 USING (symbol, date) JOIN sg USING (symbol, date))"""
_sql(
    "macd", _MACD,
    f"""SELECT symbol, date, macd, macd_signal, macd - macd_signal AS macd_histogram,
  coalesce(up - {lag('up')}, 0)::DOUBLE AS macd_cross, macd / close AS macd_norm,
  macd_signal / close AS macd_signal_norm, (macd - macd_signal) / close AS macd_hist_norm FROM x""",
    recursive=True,
)

# --- Bollinger bands
_family("bollinger", ["bollinger"], ["bb_upper", "bb_lower", "bb_middle", "bb_width", "bb_position", "bb_squeeze"])
_BB = DAILY + f""",
a AS (SELECT symbol, date, close, {full('avg(close)', 'close', 20)} AS m, {full('stddev_pop(close)', 'close', 20)} AS sd FROM bars),
b AS (SELECT symbol, date, close, m AS bb_middle, m + 2.0 * sd AS bb_upper, m - 2.0 * sd AS bb_lower FROM a),
c AS (SELECT *, (bb_upper - bb_lower) / nullif(bb_middle, 0) AS bb_width FROM b)"""
_sql(
    "bollinger", _BB,
    f"""SELECT symbol, date, bb_upper, bb_lower, bb_middle, bb_width,
  (close - bb_lower) / nullif(bb_upper - bb_lower, 0) AS bb_position,
  coalesce(bb_width < 1.05 * {full('min(bb_width)', 'bb_width', 20)}, false)::INT AS bb_squeeze FROM c""",
    "symbol, date, bb_squeeze",
)

# --- true range and directional movement
_family("atr", ["atr"], ["atr_14", "atr_pct", "atr_stop_long", "atr_stop_short"])
_ATR = DAILY + f""",
tr AS (SELECT symbol, date, close, high, low, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr FROM bars),
{_smoothed('tr', {'atr_14': ('tr', 1 / 14)})}"""
_sql(
    "atr", _ATR,
    """SELECT b.symbol, b.date, atr_14, atr_14 / close AS atr_pct, close - 2 * atr_14 AS atr_stop_long,
  close + 2 * atr_14 AS atr_stop_short FROM bars b JOIN sm USING (symbol, date)""",
    recursive=True,
)
_family("adx", ["adx"], ["adx", "plus_di", "minus_di", "di_cross"])
_ADX = _ATR + f""",
u AS (SELECT symbol, date, high - {lag('high')} AS up, {lag('low')} - low AS dn FROM bars),
v AS (SELECT symbol, date, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS p,
  CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS m FROM u),
w AS (SELECT symbol, date, {full('avg(p)', 'p', 14)} AS p, {full('avg(m)', 'm', 14)} AS m FROM v),
x AS (SELECT w.symbol, w.date, 100 * p / nullif(atr_14, 0) AS plus_di, 100 * m / nullif(atr_14, 0) AS minus_di
  FROM w JOIN sm USING (symbol, date)),
y AS (SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx FROM x)"""
_sql(
    "adx", _ADX,
    f"""SELECT symbol, date, {full('avg(dx)', 'dx', 14)} AS adx, plus_di, minus_di,
  coalesce(plus_di > minus_di, false)::INT AS di_cross FROM y""",
    "symbol, date, di_cross", True,
)

# --- volume
_family(
    "volume", ["volume"],
    ["volume_sma_20", "volume_ratio", "volume_trend", "obv", "obv_slope", "obv_roc", "mfi"],
)
_VOL = DAILY + f""",
a AS (SELECT *, (high + low + close) / 3 AS tp, coalesce(sign(close - {lag('close')}) * volume, 0.0) AS sv,
  {full('avg(volume)', 'volume', 20)} AS v20, {full('avg(volume)', 'volume', 5)} AS v5 FROM bars),
b AS (SELECT *, {lag('tp')} AS tp1, sum(sv) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS obv FROM a),
c AS (SELECT *, CASE WHEN tp > tp1 THEN tp * volume ELSE 0.0 END AS pf, CASE WHEN tp < tp1 THEN tp * volume ELSE 0.0 END AS nf FROM b),
e AS (SELECT *, {full('sum(pf)', 'pf', 14)} AS ps, {full('sum(nf)', 'nf', 14)} AS ns,
  {full('sum(volume)', 'volume', 5)} AS vs5 FROM c)"""
_sql(
    "volume", _VOL,
    f"""SELECT symbol, date, v20 AS volume_sma_20, volume / v20 AS volume_ratio, v5 / v20 AS volume_trend, obv,
  obv - {lag('obv', 5)} AS obv_slope, (obv - {lag('obv', 5)}) / (vs5 + 1) AS obv_roc,
  CASE WHEN ns <> 0 THEN 100 - 100 / (1 + ps / ns) WHEN ps > 0 THEN 100.0 END AS mfi FROM e""",
)

# --- VWAP, rolling and by session
_family("vwap", ["vwap"], ["vwap", "vwap_deviation", "above_vwap"])
_VW = DAILY + f""",
a AS (SELECT symbol, date, close, (high + low + close) / 3 * volume AS tpv, volume FROM bars),
b AS (SELECT symbol, date, close, {full('sum(tpv)', 'tpv', 14)} / nullif({full('sum(volume)', 'volume', 14)}, 0) AS vwap FROM a)"""
_sql(
    "vwap", _VW,
    """SELECT symbol, date, vwap, (close - vwap) / vwap AS vwap_deviation, coalesce(close > vwap, false)::INT AS above_vwap FROM b""",
    "symbol, date, above_vwap",
)


HOURLY = ((60.0, 2.0), (5.0, 1.0), (15.0, 2.0))


def _intraday(spark, d):
    bars = tb.bars_intraday(spark, d)
    df = ft.add_families(bars, ["intraday"], bar_sizes=HOURLY)
    return rounded(df.select("symbol", "session_date", "hour", *ft.INTRADAY_COLUMNS))


QUERIES["features_intraday"] = _intraday
SQL["features_intraday"] = final(
    INTRADAY + f""",
g AS (SELECT *, (high + low + close) / 3 * volume AS tpv,
  epoch(date - {lag('date')}) / 60.0 AS gap, hour * 60.0 AS minute FROM bars),
h AS (SELECT *, median(gap) OVER (PARTITION BY symbol) AS mg FROM g),
k AS (SELECT *, CASE WHEN abs(mg - 60) < 2 THEN 60.0 WHEN abs(mg - 5) < 1 THEN 5.0 WHEN abs(mg - 15) < 2 THEN 15.0 END AS size,
  sum(tpv) OVER (PARTITION BY symbol, session_date ORDER BY date ROWS UNBOUNDED PRECEDING)
  / sum(volume) OVER (PARTITION BY symbol, session_date ORDER BY date ROWS UNBOUNDED PRECEDING) AS vw FROM h)""",
    """SELECT symbol, session_date, hour, CASE WHEN size IS NOT NULL THEN vw END AS intraday_vwap,
  CASE WHEN size IS NOT NULL THEN (close - vw) / vw END AS intraday_vwap_dev,
  CASE WHEN size IS NOT NULL THEN least(greatest((minute - 555) / 375.0, 0.0), 1.0) END AS session_progress,
  CASE WHEN size IS NOT NULL THEN greatest((930 - minute) / size, 0.0) END AS bars_to_close FROM k""",
    "symbol, session_date, hour",
)

# --- candles
_CANDLE = ["price_impact", "intraday_range", "body_size", "upper_shadow", "lower_shadow", "doji", "hammer", "shooting_star"]
_family("candles", ["candle"], _CANDLE)
_sql(
    "candles", _RET + """,
a AS (SELECT symbol, date, abs(returns) / nullif(ln(volume + 1), 0) AS price_impact, (high - low) / close AS intraday_range,
  abs(close - open) / close AS body_size, (high - greatest(close, open)) / close AS upper_shadow,
  (least(close, open) - low) / close AS lower_shadow FROM r)""",
    """SELECT *, (body_size < 0.001)::INT AS doji,
  (lower_shadow > 2 * body_size AND upper_shadow < body_size)::INT AS hammer,
  (upper_shadow > 2 * body_size AND lower_shadow < body_size)::INT AS shooting_star FROM a""",
    "symbol, date, doji, hammer, shooting_star",
)

# --- order-flow proxies
_family(
    "order_flow", ["order_flow"],
    ["chaikin_money_flow", "volume_zscore", "gap_pct", "directional_streak", "return_autocorr_10"],
)
_F10 = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
_OF = DAILY + f""",
a AS (SELECT *, coalesce(((close - low) - (high - close)) / nullif(high - low, 0) * volume, 0.0) AS clv,
  {lag('close')} AS c1, coalesce(sign(close - {lag('close')}), 0) AS dir, close / {lag('close')} - 1 AS r,
  {full('avg(volume)', 'volume', 20)} AS vm, {full('stddev_pop(volume)', 'volume', 20)} AS vs FROM bars),
b AS (SELECT *, {lag('r')} AS r1, CASE WHEN dir <> {lag('dir')} THEN 1 ELSE 0 END AS turn FROM a),
c AS (SELECT *, sum(turn) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS island FROM b)"""
_sql(
    "order_flow", _OF,
    f"""SELECT symbol, date, {full('sum(clv)', 'clv', 20)} / {full('sum(volume)', 'volume', 20)} AS chaikin_money_flow,
  (volume - vm) / nullif(vs, 0) AS volume_zscore, (open - c1) / c1 AS gap_pct,
  sum(dir) OVER (PARTITION BY symbol, island ORDER BY date ROWS UNBOUNDED PRECEDING)::DOUBLE AS directional_streak,
  CASE WHEN count(r + r1) {_F10} = 10 THEN covar_pop(r, r1) {_F10}
    / nullif(stddev_pop(CASE WHEN r1 IS NOT NULL THEN r END) {_F10} * stddev_pop(CASE WHEN r IS NOT NULL THEN r1 END) {_F10}, 0) END AS return_autocorr_10
  FROM c""",
)

# --- momentum
_family("momentum", ["momentum"], ["roc_5", "roc_10", "roc_20", "stoch_k", "stoch_d", "williams_r", "cci"])
_MOM = DAILY + f""",
a AS (SELECT *, (high + low + close) / 3 AS tp, {full('min(low)', 'low', 14)} AS lo, {full('max(high)', 'high', 14)} AS hi FROM bars),
b AS (SELECT *, 100 * (close - lo) / nullif(hi - lo, 0) AS stoch_k, {full('avg(tp)', 'tp', 20)} AS tpm,
  row_number() OVER {_W} AS rn FROM a),
mad AS (SELECT x.symbol, x.date, avg(abs(y.tp - x.tpm)) AS mad FROM b x JOIN b y
  ON y.symbol = x.symbol AND y.rn BETWEEN x.rn - 19 AND x.rn WHERE x.rn >= 20 GROUP BY ALL)"""
_sql(
    "momentum", _MOM,
    f"""SELECT symbol, date, {', '.join(f'(close - {lag("close", k)}) / {lag("close", k)} AS roc_{k}' for k in (5, 10, 20))},
  stoch_k, {full('avg(stoch_k)', 'stoch_k', 3)} AS stoch_d, -100 * (hi - close) / nullif(hi - lo, 0) AS williams_r,
  (tp - tpm) / nullif(0.015 * mad, 0) AS cci FROM b LEFT JOIN mad USING (symbol, date)""",
)


# --- whole library, cleaned, and labels
def feature_matrix(spark, d):
    return ft.complete_rows(ft.feature_frame(tb.bars_daily(spark, d)))


def _matrix_summary(spark, d):
    df = feature_matrix(spark, d)
    cols = ft.feature_columns(df.drop(*ft.INTRADAY_COLUMNS))
    aggs = [F.avg(x).alias(f"avg_{x}") for x in cols]
    return rounded(df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), *aggs))


QUERIES["features_all_summary"] = _matrix_summary


def _labels(session):
    def run(spark, d):
        if session:
            df = ft.forward_labels(tb.bars_intraday(spark, d), periods=3, session="session_date")
            return rounded(df.select("symbol", "session_date", "hour", "future_return", F.col("label").cast("double")))
        df = ft.forward_labels(tb.bars_daily(spark, d))
        return rounded(df.select("symbol", "date", "future_return", F.col("label").cast("double")))

    return run


QUERIES["labels_dead_zone"] = _labels(False)
QUERIES["labels_session_aware"] = _labels(True)
_LAB = "CASE WHEN future_return > 0.003 THEN 1.0 WHEN future_return < -0.003 THEN 0.0 END AS label"
SQL["labels_dead_zone"] = final(
    DAILY + ",\nf AS (SELECT symbol, date, lead(close, 5) OVER (PARTITION BY symbol ORDER BY date) / close - 1 AS future_return FROM bars)",
    f"SELECT symbol, date, future_return, {_LAB} FROM f WHERE future_return IS NOT NULL",
    "symbol, date",
)
SQL["labels_session_aware"] = final(
    INTRADAY + """,
f AS (SELECT symbol, session_date, hour, CASE WHEN lead(session_date, 3) OVER (PARTITION BY symbol ORDER BY date) = session_date
  THEN lead(close, 3) OVER (PARTITION BY symbol ORDER BY date) / close - 1 END AS future_return FROM bars)""",
    f"SELECT symbol, session_date, hour, future_return, {_LAB} FROM f WHERE future_return IS NOT NULL",
    "symbol, session_date, hour",
)


def _exec_lag(spark, d):
    df = ft.execution_lag_label(tb.bars_daily(spark, d))
    return rounded(df.select("symbol", "date", "fwd_return"))


QUERIES["label_execution_lag"] = _exec_lag
SQL["label_execution_lag"] = final(
    DAILY,
    "SELECT symbol, date, lead(close, 6) OVER (PARTITION BY symbol ORDER BY date) / lead(close, 1) OVER (PARTITION BY symbol ORDER BY date) - 1 AS fwd_return FROM bars",
    "symbol, date",
)


def _sequences(spark, d):
    df = ft.add_families(tb.bars_daily(spark, d), ["returns"]).filter(F.col("returns_20d").isNotNull())
    df = ft.sequence_windows(df, ["returns", "returns_5d"], 10)
    first, last = F.col("window")[0], F.col("window")[9]
    return rounded(
        df.select(
            "symbol", "date", F.size("window").alias("n_steps"),
            first[0].alias("oldest_return"), last[1].alias("newest_return_5d"),
            F.aggregate("window", F.lit(0.0), lambda a, x: a + x[0]).alias("sum_return"),
        )
    )


QUERIES["feature_sequences"] = _sequences
SQL["feature_sequences"] = final(
    _RET + ",\nk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM r WHERE returns_20d IS NOT NULL)",
    f"""SELECT symbol, date, n_steps, oldest_return, newest_return_5d, sum_return FROM (SELECT symbol, date, rn, 10 AS n_steps,
  {lag('returns', 9)} AS oldest_return, returns_5d AS newest_return_5d, {full('sum(returns)', 'returns', 10)} AS sum_return FROM k) WHERE rn >= 10""",
    "symbol, date, n_steps",
)


# --- flagship slice: bars, average, forward return, per-symbol sums
def flagship(spark, d):
    df = ft.forward_labels(ft.add_families(tb.bars_daily(spark, d), ["returns", "averages"]))
    return rounded(
        df.groupBy("symbol").agg(
            F.count(F.lit(1)).alias("n_bars"),
            F.sum("sma_20").alias("sum_sma_20"),
            F.sum("future_return").alias("sum_future_return"),
            F.count_if(F.col("label") == 1).alias("n_up"),
        )
    )


QUERIES["flagship_symbol_summary"] = flagship
SQL["flagship_symbol_summary"] = final(
    DAILY + f""",
f AS (SELECT symbol, {full('avg(close)', 'close', 20)} AS sma_20,
  lead(close, 5) OVER (PARTITION BY symbol ORDER BY date) / close - 1 AS fr FROM bars)""",
    """SELECT symbol, count(*) AS n_bars, sum(sma_20) AS sum_sma_20, sum(fr) AS sum_future_return,
  count(*) FILTER (fr > 0.003) AS n_up FROM f WHERE fr IS NOT NULL GROUP BY symbol""",
    "symbol, n_bars, n_up",
)
