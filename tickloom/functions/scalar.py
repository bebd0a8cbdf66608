"""Scalar Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a, b) -> Column:
    """a / b, NULL when b is 0 (ANSI mode would raise)."""
    return c(a) / F.nullif(c(b), F.lit(0.0))


def flag(cond: Column) -> Column:
    """0/1 integer; a comparison with a missing value is 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def finite(x) -> Column:
    """NaN and infinities become NULL, the only missing value downstream."""
    x = c(x)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def clip(x, lo: float | None, hi: float | None) -> Column:
    x = c(x)
    if lo is not None:
        x = F.greatest(x, F.lit(float(lo)))
    return x if hi is None else F.least(x, F.lit(float(hi)))


def to_number(x) -> Column:
    """Text with thousands commas and blanks to DOUBLE; anything unparsable is NULL."""
    return F.regexp_replace(c(x), "[, ]", "").try_cast("double")


def adjustment_factor(purpose) -> Column:
    """Corporate-action sentence to a price factor; unknown sentences give NULL.

    `Bonus a:b` keeps the first number over the sum of both; a face-value split is new over old.
    """
    t = F.trim(c(purpose))
    # Fixed patterns of the two recognised sentence forms.
    bonus = r"(?i)bonus\s+(\d+)\s*:\s*(\d+)"
    split = r"(?is)face\s+value\s+split.*?rs\.?\s*(\d+(?:\.\d+)?).*?rs\.?\s*(\d+(?:\.\d+)?)"
    b1, b2 = (F.regexp_extract(t, bonus, i).try_cast("double") for i in (1, 2))
    s1, s2 = (F.regexp_extract(t, split, i).try_cast("double") for i in (1, 2))
    return F.when(b1.isNotNull(), div(b1, b1 + b2)).when(s1.isNotNull(), div(s2, s1))


def round_to_tick(price, tick: float = 0.05) -> Column:
    """Nearest tick, ties to the even multiple, then two decimals."""
    return F.round(F.bround(c(price) / F.lit(tick)) * F.lit(tick), 2)


def is_frozen(prev_close, price, band_pct: float = 0.20) -> Column:
    """Price sits at or beyond a circuit limit around the previous close; without one it cannot."""
    p, x = c(prev_close), c(price)
    return F.when(p > 0, F.abs(x - p) / p >= band_pct).otherwise(False)


def would_fill(prev_close, high, low, band_pct: float = 0.20) -> Column:
    """The bar traded somewhere inside the circuit band of the previous close."""
    p = c(prev_close)
    locked = (c(low) >= p * (1 + band_pct)) | (c(high) <= p * (1 - band_pct))
    return F.when(p > 0, ~locked).otherwise(True)


def in_session(ts, open_: str = "09:15", close: str = "15:30") -> Column:
    """Weekday and clock time inside the inclusive session bounds (ts already in exchange time)."""
    clock = F.date_format(c(ts), "HH:mm:ss")
    return F.dayofweek(c(ts)).between(2, 6) & clock.between(open_ + ":00", close + ":00")


def composite_confidence(model_probability, agreement, alignment, expectancy, liquidity) -> Column:
    # Fixed blend weights.
    parts = ((model_probability, 0.30), (agreement, 0.25), (alignment, 0.20), (expectancy, 0.15), (liquidity, 0.10))
    total = F.lit(0.0)
    for x, w in parts:
        total = total + c(x) * w
    return clip(total, 0.0, 1.0)


def kelly_fraction(win_rate, avg_win, avg_loss, fraction: float = 0.25) -> Column:
    """Fractional Kelly stake in [0, 0.5]; no losses, or a zero win/loss ratio, means no stake."""
    w, loss = c(win_rate), c(avg_loss)
    ratio = c(avg_win) / F.nullif(loss, F.lit(0.0))
    raw = (w * ratio - (1 - w)) / F.nullif(ratio, F.lit(0.0))
    return F.when((loss <= 0) | raw.isNull(), 0.0).otherwise(clip(raw * fraction, 0.0, 0.5))


def expectancy(win_rate, avg_win, avg_loss) -> Column:
    return c(win_rate) * c(avg_win) - (1 - c(win_rate)) * c(avg_loss)


def squash(x) -> Column:
    """Sign-preserving log scale, for figures that compound without bound."""
    x = c(x)
    return F.signum(x) * F.ln(1 + F.abs(x))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every DOUBLE column to reporting precision; -0.0 becomes 0.0.

    The value is first moved by a thirtieth of the last place, a distance no short decimal has from a rounding
    boundary: two engines that differ in the last bit of an exact half then still agree.
    """
    nudge = F.lit(10.0**-places / 30)
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            col = (F.round(col + nudge, places) + F.lit(0.0)).alias(f.name)
        out.append(col)
    return df.select(*out)
