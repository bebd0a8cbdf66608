"""Technical feature library.

Every family is a set of columns assigned to levels. A level only reads columns of lower levels, so the levels
of any selection of families merge and are planned as one short chain of Window nodes over a single shuffle on
the series key: all windows share (key; chunk, date) order, which Catalyst recognises and sorts once.

Recursive smoothing y_t = a*x_t + (1-a)*y_{t-1} is a scaled prefix sum inside chunks of rows plus the decayed end
value of the previous chunk. The chunk length follows from alpha: the scale factor (1-a)^-length stays below 1e290, and
what lies more than one whole chunk back has a weight under 1e-17, i.e. under double rounding. CHUNK rows satisfy both
for the usual spans, which then share one sort; any other alpha gets a length of its own. So smoothing equals the
row-by-row recursion to rounding for every alpha and needs no per-key array.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalar import clip, div, flag

CHUNK = 1024
UNB, CUR = Window.unboundedPreceding, Window.currentRow
SMA_PERIODS = (5, 10, 20, 50)
MIN_ROWS = 60


class SeriesSpec:
    """Key and order of a bar series, and the window shapes built from them."""

    def __init__(self, keys: Sequence[str] = ("symbol",), order: str = "date"):
        self.keys, self.order = list(keys), order
        self.raw = Window.partitionBy(*self.keys).orderBy(order)
        self.whole = Window.partitionBy(*self.keys)
        self.w = Window.partitionBy(*self.keys).orderBy("_chunk", order)
        self.in_chunk = Window.partitionBy(*self.keys, "_chunk").orderBy(order)

    def lag(self, x, k: int = 1) -> Column:
        return F.lag(x, k).over(self.w)

    def frame(self, n: int):
        return self.w.rowsBetween(-(n - 1), 0)

    def roll(self, fn, x, n: int) -> Column:
        """fn over the last n rows; NULL until n non-missing values are present."""
        f = self.frame(n)
        return F.when(F.count(x).over(f) == n, fn(x).over(f))

    def positions(self, df: DataFrame) -> DataFrame:
        rn = F.row_number().over(self.raw)
        return (
            df.withColumn("_rn", rn)
            .withColumn("_chunk", F.floor((F.col("_rn") - 1) / CHUNK).cast("int"))
            .withColumn("_pos", ((F.col("_rn") - 1) % CHUNK).cast("int"))
        )


Layers = dict[int, dict[str, Column]]


def apply_layers(df: DataFrame, layers: Layers) -> DataFrame:
    for level in sorted(layers):
        df = df.withColumns(layers[level])
    return df


def merge_layers(*parts: Layers) -> Layers:
    out: Layers = {}
    for part in parts:
        for level, cols in part.items():
            out.setdefault(level, {}).update(cols)
    return out


def chunk_length(alpha: float) -> int:
    """Rows per chunk: CHUNK where its decay lies between 1e-290 and 1e-17, else as many as decay to 1e-290."""
    digits = -math.log10(1.0 - alpha)
    return CHUNK if 17.5 <= CHUNK * digits <= 290 else max(1, int(290 / digits))


def smooth(s: SeriesSpec, level: int, wanted: dict[str, tuple[str, float]]) -> Layers:
    """Exponential smoothing {output: (input, alpha)}; inputs live below `level`, outputs at `level` + 2."""
    local, carry, total = {}, {}, {}
    for out, (x, a) in wanted.items():
        if not 0.0 < a <= 1.0:
            raise ValueError(f"alpha {a} is not in (0, 1]")
        if a == 1.0:
            total[out] = F.col(x)
            continue
        q, length = 1.0 - a, chunk_length(a)
        pos, window = F.col("_pos"), s.in_chunk
        if length != CHUNK:
            pos = (F.col("_rn") - 1) % length
            window = Window.partitionBy(*s.keys, F.floor((F.col("_rn") - 1) / length)).orderBy(s.order)
        weight = F.when(F.col("_rn") == 1, F.lit(1.0)).otherwise(F.lit(a))
        scaled = F.sum(F.col(x) * weight * F.pow(F.lit(q), -pos)).over(window.rowsBetween(UNB, CUR))
        local[f"_l_{out}"] = scaled * F.pow(F.lit(q), pos)
        ended = F.when(pos == length - 1, F.col(f"_l_{out}"))
        carry[f"_k_{out}"] = F.last(ended, ignorenulls=True).over(s.w.rowsBetween(UNB, -1))
        total[out] = F.col(f"_l_{out}") + F.coalesce(F.col(f"_k_{out}") * F.pow(F.lit(q), pos + 1), F.lit(0.0))
    return {level: local, level + 1: carry, level + 2: total}


def span_alpha(n: int) -> float:
    return 2.0 / (n + 1)


def _strength(up: str, down: str) -> Column:
    """100 - 100/(1 + up/down); only gains gives 100, no movement at all is missing."""
    u, d = F.col(up), F.col(down)
    return F.when(d != 0, 100 - 100 / (1 + u / F.nullif(d, F.lit(0.0)))).when(u > 0, F.lit(100.0))


# --------------------------------------------------------------------------------------------------
# Families. Level 0 is row-wise; names with a leading underscore are helpers and are dropped at the end.
# Helpers of the same name have the same definition in every family.

def _typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def returns_family(s: SeriesSpec) -> Layers:
    lags = {f"returns_{k}d": div("close", s.lag("close", k)) - 1 for k in (5, 10, 20)}
    return {
        1: {"_c1": s.lag("close")} | lags,
        2: {"returns": div("close", "_c1") - 1, "log_returns": F.ln(div("close", "_c1"))},
        3: {f"volatility_{n}d": s.roll(F.stddev_samp, "returns", n) * math.sqrt(252) for n in (5, 20)},
    }


def averages_family(s: SeriesSpec) -> Layers:
    above = {(a, b): flag(F.col(f"sma_{a}") > F.col(f"sma_{b}")) for a, b in ((5, 10), (10, 20), (20, 50))}
    return merge_layers(
        {1: {f"sma_{n}": s.roll(F.avg, "close", n) for n in SMA_PERIODS}},
        smooth(s, 1, {f"ema_{n}": ("close", span_alpha(n)) for n in SMA_PERIODS}),
        {
            2: {f"close_to_sma_{n}": div("close", f"sma_{n}") - 1 for n in SMA_PERIODS}
            | {"golden_cross": above[(20, 50)], "ma_alignment": sum(above.values(), F.lit(0)) / F.lit(3.0)}
        },
    )


def rsi_family(s: SeriesSpec, period: int = 14) -> Layers:
    move = F.col("close") - F.col("_c1")
    return merge_layers(
        {
            1: {"_c1": s.lag("close")},
            2: {"_gain": F.when(move > 0, move).otherwise(0.0), "_loss": F.when(move < 0, -move).otherwise(0.0)},
        },
        smooth(s, 3, {"_ag": ("_gain", 1.0 / period), "_al": ("_loss", 1.0 / period)}),
        {
            6: {"rsi_14": _strength("_ag", "_al")},
            7: {
                "rsi_slope": F.col("rsi_14") - s.lag("rsi_14", 3),
                "rsi_overbought": flag(F.col("rsi_14") > 70),
                "rsi_oversold": flag(F.col("rsi_14") < 30),
            },
        },
    )


def macd_family(s: SeriesSpec, fast: int = 12, slow: int = 26, signal: int = 9) -> Layers:
    return merge_layers(
        smooth(s, 1, {"_fast": ("close", span_alpha(fast)), "_slow": ("close", span_alpha(slow))}),
        {4: {"macd": F.col("_fast") - F.col("_slow")}},
        smooth(s, 5, {"macd_signal": ("macd", span_alpha(signal))}),
        {
            8: {
                "macd_histogram": F.col("macd") - F.col("macd_signal"),
                "_over": flag(F.col("macd") > F.col("macd_signal")),
                "macd_norm": div("macd", "close"),
                "macd_signal_norm": div("macd_signal", "close"),
                "macd_hist_norm": div(F.col("macd") - F.col("macd_signal"), "close"),
            },
            9: {"macd_cross": F.coalesce(F.col("_over") - s.lag("_over"), F.lit(0)).cast("double")},
        },
    )


def bollinger_family(s: SeriesSpec, n: int = 20, k: float = 2.0) -> Layers:
    mid, sd = F.col("bb_middle"), F.col("_sd")
    return {
        1: {"bb_middle": s.roll(F.avg, "close", n), "_sd": s.roll(F.stddev_pop, "close", n)},
        2: {
            "bb_upper": mid + sd * k,
            "bb_lower": mid - sd * k,
            "bb_width": div((mid + sd * k) - (mid - sd * k), mid),
            "bb_position": div(F.col("close") - (mid - sd * k), (mid + sd * k) - (mid - sd * k)),
        },
        3: {"_narrow": s.roll(F.min, "bb_width", 20)},
        4: {"bb_squeeze": flag(F.col("bb_width") < F.col("_narrow") * 1.05)},
    }


def atr_family(s: SeriesSpec, period: int = 14) -> Layers:
    h, l, c1 = F.col("high"), F.col("low"), F.col("_c1")
    return merge_layers(
        {1: {"_c1": s.lag("close")}, 2: {"_tr": F.greatest(h - l, F.abs(h - c1), F.abs(l - c1))}},
        smooth(s, 3, {"atr_14": ("_tr", 1.0 / period)}),
        {
            6: {
                "atr_pct": div("atr_14", "close"),
                "atr_stop_long": F.col("close") - F.col("atr_14") * 2,
                "atr_stop_short": F.col("close") + F.col("atr_14") * 2,
            }
        },
    )


def adx_family(s: SeriesSpec, n: int = 14) -> Layers:
    up, dn = F.col("_up"), F.col("_dn")
    p, m = F.col("plus_di"), F.col("minus_di")
    return merge_layers(
        atr_family(s),
        {
            1: {"_up": F.col("high") - s.lag("high"), "_dn": s.lag("low") - F.col("low")},
            2: {
                "_pdm": F.when((up > dn) & (up > 0), up).otherwise(0.0),
                "_mdm": F.when((dn > up) & (dn > 0), dn).otherwise(0.0),
            },
            3: {"_pdm_n": s.roll(F.avg, "_pdm", n), "_mdm_n": s.roll(F.avg, "_mdm", n)},
            6: {
                "plus_di": div(F.col("_pdm_n") * 100, "atr_14"),
                "minus_di": div(F.col("_mdm_n") * 100, "atr_14"),
            },
            7: {"_dx": div(F.abs(p - m) * 100, p + m), "di_cross": flag(p > m)},
            8: {"adx": s.roll(F.avg, "_dx", n)},
        },
    )


def volume_family(s: SeriesSpec) -> Layers:
    tp, tp1, v = F.col("_tp"), F.col("_tp1"), F.col("volume")
    return {
        0: {"_tp": _typical()},
        1: {
            "_c1": s.lag("close"),
            "_tp1": s.lag("_tp"),
            "volume_sma_20": s.roll(F.avg, "volume", 20),
            "_v5": s.roll(F.avg, "volume", 5),
        },
        2: {
            "volume_ratio": div("volume", "volume_sma_20"),
            "volume_trend": div("_v5", "volume_sma_20"),
            "_signed": F.coalesce(F.signum(F.col("close") - F.col("_c1")) * v, F.lit(0.0)),
            "_pf": F.when(tp > tp1, tp * v).otherwise(0.0),
            "_nf": F.when(tp < tp1, tp * v).otherwise(0.0),
        },
        3: {
            "obv": F.sum("_signed").over(s.w.rowsBetween(UNB, CUR)),
            "_ps": s.roll(F.sum, "_pf", 14),
            "_ns": s.roll(F.sum, "_nf", 14),
        },
        4: {"_obv5": s.lag("obv", 5), "mfi": _strength("_ps", "_ns")},
        5: {
            "obv_slope": F.col("obv") - F.col("_obv5"),
            "obv_roc": (F.col("obv") - F.col("_obv5")) / (F.col("_v5") * 5 + 1),
        },
    }


def vwap_family(s: SeriesSpec, n: int = 14) -> Layers:
    return {
        0: {"_tpv": _typical() * F.col("volume")},
        1: {"vwap": div(s.roll(F.sum, "_tpv", n), s.roll(F.sum, "volume", n))},
        2: {
            "vwap_deviation": div(F.col("close") - F.col("vwap"), "vwap"),
            "above_vwap": flag(F.col("close") > F.col("vwap")),
        },
    }


INTRADAY_COLUMNS = ("intraday_vwap", "intraday_vwap_dev", "session_progress", "bars_to_close")
# Fixed bar sizes recognised from the median gap: (minutes, tolerance).
BAR_SIZES = ((5.0, 1.0), (15.0, 2.0))


def intraday_family(
    s: SeriesSpec,
    session: str = "session_date",
    open_minute: int = 555,
    close_minute: int = 930,
    bar_sizes: Sequence[tuple[float, float]] = BAR_SIZES,
) -> Layers:
    """Session-reset VWAP and clock features. The columns always exist; they are NULL where the median gap
    between bars is no recognised intraday bar size."""
    minutes = F.hour(s.order) * 60 + F.minute(s.order) + F.second(s.order) / F.lit(60.0)
    day = Window.partitionBy(*s.keys, session).orderBy("_chunk", s.order).rowsBetween(UNB, CUR)
    size = F.lit(None).cast("double")
    for width, tol in reversed(bar_sizes):
        size = F.when(F.abs(F.col("_mgap") - width) < tol, F.lit(width)).otherwise(size)
    known = F.col("_size").isNotNull()
    span = F.lit(float(close_minute - open_minute))
    return {
        0: {
            "_t": F.unix_micros(F.col(s.order).cast("timestamp")) / F.lit(6.0e7),
            "_tpv": _typical() * F.col("volume"),
        },
        1: {
            "_gap": F.col("_t") - s.lag("_t"),
            "_vw": div(F.sum("_tpv").over(day), F.sum("volume").over(day)),
        },
        2: {"_mgap": F.median("_gap").over(s.whole)},
        3: {"_size": size},
        4: {
            "intraday_vwap": F.when(known, F.col("_vw")),
            "intraday_vwap_dev": F.when(known, div(F.col("close") - F.col("_vw"), "_vw")),
            "session_progress": F.when(known, clip((minutes - open_minute) / span, 0, 1)),
            "bars_to_close": F.when(known, clip((close_minute - minutes) / F.col("_size"), 0, None)),
        },
    }


def candle_family(s: SeriesSpec) -> Layers:
    c, o = F.col("close"), F.col("open")
    body, up, low = F.col("body_size"), F.col("upper_shadow"), F.col("lower_shadow")
    return {
        0: {
            "intraday_range": div(F.col("high") - F.col("low"), c),
            "body_size": div(F.abs(c - o), c),
            "upper_shadow": div(F.col("high") - F.greatest(c, o), c),
            "lower_shadow": div(F.least(c, o) - F.col("low"), c),
        },
        1: {
            "_c1": s.lag("close"),
            "doji": flag(body < 0.001),
            "hammer": flag((low > body * 2) & (up < body)),
            "shooting_star": flag((up > body * 2) & (low < body)),
        },
        2: {"price_impact": div(F.abs(div(c, "_c1") - 1), F.ln(F.col("volume") + 1))},
    }


def order_flow_family(s: SeriesSpec) -> Layers:
    h, l, c, v = (F.col(x) for x in ("high", "low", "close", "volume"))
    f10 = s.frame(10)
    x, y = F.when(F.col("_r1").isNotNull(), F.col("_r")), F.when(F.col("_r").isNotNull(), F.col("_r1"))
    started = (F.col("_dir") != F.col("_dir1")) | (F.col("_rn") == 1)
    return {
        0: {"_clv": F.coalesce(div((c - l) - (h - c), h - l) * v, F.lit(0.0))},
        1: {
            "_c1": s.lag("close"),
            "_vm": s.roll(F.avg, "volume", 20),
            "_vs": s.roll(F.stddev_pop, "volume", 20),
            "chaikin_money_flow": div(s.roll(F.sum, "_clv", 20), s.roll(F.sum, "volume", 20)),
        },
        2: {
            "volume_zscore": div(v - F.col("_vm"), "_vs"),
            "gap_pct": div(F.col("open") - F.col("_c1"), "_c1"),
            "_dir": F.coalesce(F.signum(c - F.col("_c1")), F.lit(0.0)),
            "_r": div(c, "_c1") - 1,
        },
        3: {"_dir1": s.lag("_dir"), "_r1": s.lag("_r")},
        4: {
            # Row number at which the current run of equal direction began.
            "_since": F.last(F.when(started, F.col("_rn")), ignorenulls=True).over(s.w.rowsBetween(UNB, CUR)),
            "_pairs": F.count(x + y).over(f10),
            "_cov": F.covar_pop(x, y).over(f10),
            "_sx": F.stddev_pop(x).over(f10),
            "_sy": F.stddev_pop(y).over(f10),
        },
        5: {
            "directional_streak": F.col("_dir") * (F.col("_rn") - F.col("_since") + 1),
            "return_autocorr_10": F.when(F.col("_pairs") == 10, div("_cov", F.col("_sx") * F.col("_sy"))),
        },
    }


def momentum_family(s: SeriesSpec) -> Layers:
    lo, hi = F.col("_lo14"), F.col("_hi14")
    return {
        0: {"_tp": _typical()},
        1: {f"roc_{k}": div(F.col("close") - s.lag("close", k), s.lag("close", k)) for k in (5, 10, 20)}
        | {
            "_lo14": s.roll(F.min, "low", 14),
            "_hi14": s.roll(F.max, "high", 14),
            "_tpm": s.roll(F.avg, "_tp", 20),
            "_tps": F.collect_list("_tp").over(s.frame(20)),
        },
        2: {
            "stoch_k": div((F.col("close") - lo) * 100, hi - lo),
            "williams_r": div((hi - F.col("close")) * -100, hi - lo),
            # Mean absolute deviation around the frame's own mean: an array of at most 20 values.
            "_mad": F.aggregate("_tps", F.lit(0.0), lambda acc, t: acc + F.abs(t - F.col("_tpm"))) / 20,
        },
        3: {
            "stoch_d": s.roll(F.avg, "stoch_k", 3),
            "cci": div(F.col("_tp") - F.col("_tpm"), F.col("_mad") * 0.015),
        },
    }


FAMILIES = {
    "returns": returns_family,
    "averages": averages_family,
    "rsi": rsi_family,
    "macd": macd_family,
    "bollinger": bollinger_family,
    "atr": atr_family,
    "adx": adx_family,
    "volume": volume_family,
    "vwap": vwap_family,
    "intraday": intraday_family,
    "candle": candle_family,
    "order_flow": order_flow_family,
    "momentum": momentum_family,
}

# Raw and absolute-price columns that are never model inputs.
NOT_FEATURES = frozenset(
    """date open high low close volume turnover symbol label future_return session_date hour
    sma_5 sma_10 sma_20 sma_50 ema_5 ema_10 ema_20 ema_50 bb_upper bb_lower bb_middle
    macd macd_signal macd_histogram atr_14 atr_stop_long atr_stop_short
    volume_sma_20 obv obv_slope vwap""".split()
)


def add_families(
    bars: DataFrame, names: Sequence[str], s: SeriesSpec | None = None, min_rows: int = 0, **intraday
) -> DataFrame:
    s = s or SeriesSpec()
    df = s.positions(bars)
    if min_rows:
        df = df.withColumn("_n", F.count(F.lit(1)).over(s.whole)).filter(F.col("_n") >= min_rows).drop("_n")
    parts = [FAMILIES[n](s, **intraday) if n == "intraday" else FAMILIES[n](s) for n in names]
    layers = merge_layers(*parts)
    wanted = [x for level in layers.values() for x in level if not x.startswith("_")]
    df = apply_layers(df, layers)
    return df.select(*bars.columns, *dict.fromkeys(wanted))


def feature_frame(bars: DataFrame, s: SeriesSpec | None = None, intraday: bool = False, **kw) -> DataFrame:
    """All features; series shorter than 60 bars produce no rows."""
    names = [n for n in FAMILIES if n != "intraday" or intraday]
    df = add_families(bars, names, s, MIN_ROWS, **kw)
    if not intraday:
        df = df.withColumns({n: F.lit(None).cast("double") for n in INTRADAY_COLUMNS})
    return df


def complete_rows(df: DataFrame, optional: Sequence[str] = INTRADAY_COLUMNS) -> DataFrame:
    """Rows with no missing value in any column that applies to the series."""
    return df.dropna("any", subset=[x for x in df.columns if x not in optional])


def feature_columns(df: DataFrame) -> list[str]:
    return [x for x in df.columns if x not in NOT_FEATURES and not x.startswith("_")]


def forward_labels(
    df: DataFrame,
    s: SeriesSpec | None = None,
    periods: int = 5,
    dead_zone: float = 0.003,
    session: str | None = None,
) -> DataFrame:
    """future_return over `periods` bars and a 1/0 label outside the dead zone; rows without a future drop.

    With `session` (a day column) a window that ends in another session has no future return.
    """
    s = s or SeriesSpec()
    fr = div(F.lead("close", periods).over(s.raw), "close") - 1
    if session:
        fr = F.when(F.lead(session, periods).over(s.raw) == F.col(session), fr)
    x = F.col("future_return")
    return (
        df.withColumn("future_return", fr)
        .filter(x.isNotNull())
        .withColumn("label", F.when(x > dead_zone, 1).when(x < -dead_zone, 0))
    )


def execution_lag_label(df: DataFrame, s: SeriesSpec | None = None, hold: int = 5, out: str = "fwd_return") -> DataFrame:
    """Return of buying the next close and selling `hold` bars later."""
    s = s or SeriesSpec()
    return df.withColumn(
        out, div(F.lead("close", 1 + hold).over(s.raw), F.lead("close", 1).over(s.raw)) - 1
    )


def sequence_windows(df: DataFrame, cols: Sequence[str], length: int, s: SeriesSpec | None = None) -> DataFrame:
    """ARRAY<ARRAY<DOUBLE>> of the last `length` feature rows of the same symbol; shorter histories drop."""
    s = s or SeriesSpec()
    f = s.raw.rowsBetween(-(length - 1), 0)
    seq = F.collect_list(F.array(*[F.col(x).cast("double") for x in cols])).over(f)
    return df.withColumn("window", seq).filter(F.size("window") == length)
