"""Market regimes: index indicators, rule matching, hysteresis, proxy labels, and signals from probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalar import composite_confidence, div
from tickloom.operators.features import SeriesSpec
from tickloom.plans.ordered import UNB

# Fixed regime rules, first match wins: (indicator, operator, value) conjunctions.
RULES = (
    ("bull_trend", (("nifty_vs_20dma", ">", 1.02), ("nifty_vs_50dma", ">", 1.05), ("india_vix", "<", 15.0))),
    ("bear_trend", (("nifty_vs_50dma", "<", 0.98), ("india_vix", ">", 18.0))),
    ("sideways", (("nifty_vs_20dma", ">", 0.99), ("nifty_vs_50dma", "<", 1.01), ("india_vix", "<", 20.0))),
    ("high_volatility", (("india_vix", ">", 22.0), ("atr_14_pct", ">", 0.02))),
    ("pre_event", (("days_to_major_event", "<=", 3.0),)),
)
DEFAULT_REGIME = "sideways"
# Fixed position multipliers and strategy lists per regime.
MULTIPLIER = {"bull_trend": 1.0, "bear_trend": 0.5, "sideways": 0.7, "high_volatility": 0.4, "pre_event": 0.3}
ALLOWED = {
    "bull_trend": ("momentum_breakout", "trend_following", "ipo_aggressive"),
    "bear_trend": ("short_momentum", "defensive_rotation", "cash_hedge"),
    "sideways": ("mean_reversion", "range_bound", "options_theta"),
    "high_volatility": ("volatility_breakout", "straddle_strangle", "cash_defensive"),
    "pre_event": ("event_volatility", "cash_hedge"),
}
FORBIDDEN = {
    "bull_trend": ("mean_reversion", "short_selling"),
    "bear_trend": ("long_momentum", "ipo_aggressive"),
    "sideways": ("trend_following",),
    "high_volatility": ("mean_reversion", "trend_following"),
    "pre_event": ("directional_bias",),
}
COOLDOWN = 5
# Fixed confidence tiers, highest first: (minimum, tier, execution).
TIERS = ((0.75, "high", "execute_full"), (0.60, "medium", "execute_half"), (0.50, "low", "queue_review"))

_OPS = {
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def index_indicators(index_bars: DataFrame, vix: DataFrame) -> DataFrame:
    """Per date a MAP of indicators; trend entries are absent in the first 49 rows, the vix entry where unknown."""
    s = SeriesSpec(("symbol",))
    close, c1 = F.col("close"), F.lag("close").over(s.raw)

    def roll(x, n):
        f = s.raw.rowsBetween(-(n - 1), 0)
        return F.when(F.count(x).over(f) == n, F.avg(x).over(f))

    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - c1), F.abs(F.col("low") - c1))
    d = index_bars.withColumn("_tr", tr).withColumns({"_a": roll("close", 20), "_b": roll("close", 50), "_c": roll("_tr", 14)})
    d = d.join(vix.select("date", F.col("close").alias("_vix")), "date", "left")
    known = F.col("_b").isNotNull()
    entries = [
        ("nifty_vs_20dma", F.when(known, div(close, "_a"))),
        ("nifty_vs_50dma", F.when(known, div(close, "_b"))),
        ("atr_14_pct", F.when(known, div("_c", close))),
        ("india_vix", F.col("_vix")),
    ]
    m = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in entries]))
    return d.select("symbol", "date", F.map_filter(m, lambda k, v: v.isNotNull()).alias("indicators"))


def match_regime(indicators: Column | str = "indicators", rules=RULES) -> Column:
    """First rule whose every condition holds; an absent indicator makes its condition false."""
    m = F.col(indicators) if isinstance(indicators, str) else indicators
    out = None
    for name, conds in rules:
        ok = F.lit(True)
        for ind, op, value in conds:
            ok = ok & F.coalesce(_OPS[op](F.try_element_at(m, F.lit(ind)), F.lit(value)), F.lit(False))
        out = F.when(ok, name) if out is None else out.when(ok, name)
    return out.otherwise(DEFAULT_REGIME)


def with_hysteresis(df: DataFrame, keys: Sequence[str], order: str, candidate: str, cooldown: int = COOLDOWN, out: str = "regime") -> DataFrame:
    """Regime that changes only after `cooldown` equal consecutive candidates.

    The state is the candidate of the latest run that reached the cooldown (or the first row's), so a run position
    and one last-value window replace the row-by-row automaton. Put the session in `keys` for a daily reset.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    run = w.rowsBetween(UNB, 0)
    i = F.row_number().over(w)
    changed = F.coalesce(F.col(candidate) != F.lag(candidate).over(w), F.lit(True))
    d = df.withColumns({"_i": i, "_new": changed})
    d = d.withColumn("_from", F.last(F.when(F.col("_new"), F.col("_i")), ignorenulls=True).over(run))
    firm = (F.col("_i") - F.col("_from") + 1 >= max(cooldown, 1)) | (F.col("_i") == 1)
    d = d.withColumn(out, F.last(F.when(firm, F.col(candidate)), ignorenulls=True).over(run))
    return d.drop("_i", "_new", "_from")


def _lookup(table: dict, regime: Column, lit) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(regime == k, lit(v)) if out is None else out.when(regime == k, lit(v))
    return out.otherwise(lit(table[DEFAULT_REGIME]))


def size_multiplier(regime: Column) -> Column:
    return _lookup(MULTIPLIER, regime, F.lit)


def infer_strategy(regime: Column, action: Column) -> Column:
    buy = action == "BUY"
    return (
        F.when((regime == "bull_trend") & ~buy, "short_selling")
        .when(regime == "bear_trend", F.when(action == "SELL", "short_momentum").otherwise("long_momentum"))
        .when(regime == "sideways", "mean_reversion")
        .when(regime == "high_volatility", "volatility_breakout")
        .when(regime == "pre_event", "directional_bias")
        .otherwise("trend_following")
    )


def strategy_allowed(regime: Column, strategy: Column) -> Column:
    names = lambda xs: F.array(*[F.lit(x) for x in xs])
    banned = F.array_contains(_lookup(FORBIDDEN, regime, names), strategy)
    return ~banned & F.array_contains(_lookup(ALLOWED, regime, names), strategy)


def regime_thresholds(train: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Volatility and range quantiles of the training rows (exact, linearly interpolated)."""
    return train.groupBy(*keys).agg(
        F.percentile("volatility_20d", F.lit(0.33)).alias("vol_low"),
        F.percentile("volatility_20d", F.lit(0.67)).alias("vol_high"),
        F.percentile("atr_pct", F.lit(0.67)).alias("atr_high"),
    )


def label_regimes(df: DataFrame, thresholds: DataFrame, keys: Sequence[str] = ("symbol",), out: str = "regime") -> DataFrame:
    """Proxy regime per row; bull overrides bear, bear overrides high volatility."""
    c = F.col
    bull = (c("close_to_sma_20") > 0.02) & (c("close_to_sma_50") > 0.05) & (c("volatility_20d") < c("vol_low"))
    bear = (c("close_to_sma_50") < -0.02) & (c("volatility_20d") > c("vol_high"))
    regime = (
        F.when(bull, "bull_trend").when(bear, "bear_trend").when(c("atr_pct") > c("atr_high"), "high_volatility").otherwise("sideways")
    )
    return df.join(thresholds, list(keys)).withColumn(out, regime).drop("vol_low", "vol_high", "atr_high")


def signals(
    df: DataFrame, probabilities: str = "probabilities", sub_models: str | None = None, aligned: str = "aligned",
    expectancy: float = 0.5, liquidity: float = 1.0, min_threshold: float = 0.60,
) -> DataFrame:
    """Action, confidence, tier and execution from class probabilities [down, up].

    Agreement is the share of sub-models (a MAP name -> probabilities) that pick the same class; 0.5 without any.
    """
    p = F.col(probabilities)
    pick = F.array_position(p, F.array_max(p)) - 1
    if sub_models:
        vals = F.map_values(sub_models)
        same = F.size(F.filter(vals, lambda q: F.array_position(q, F.array_max(q)) - 1 == F.col("_pick")))
        agree = F.when(F.size(vals) > 0, same / F.size(vals).cast("double")).otherwise(0.5)
    else:
        agree = F.lit(0.5)
    d = df.withColumn("_pick", pick).withColumns(
        {
            "model_probability": F.array_max(p),
            "ensemble_agreement": agree,
            "regime_alignment": F.when(F.col(aligned), 1.0).otherwise(0.0),
        }
    )
    conf = composite_confidence("model_probability", "ensemble_agreement", "regime_alignment", F.lit(expectancy), F.lit(liquidity))
    d = d.withColumn("confidence", conf)
    tier = execution = None
    for low, name, act in TIERS:
        hit = F.col("confidence") >= low
        tier = F.when(hit, name) if tier is None else tier.when(hit, name)
        execution = F.when(hit, act) if execution is None else execution.when(hit, act)
    action = F.when(F.col("confidence") < min_threshold, "HOLD").when(F.col("_pick") == 0, "SELL").when(
        F.col("_pick") == 1, "BUY"
    ).otherwise("HOLD")
    return d.withColumns({"action": action, "tier": tier.otherwise("none")}).withColumn(
        "execution_action", F.when(F.col("action") == "HOLD", "none").otherwise(execution.otherwise("none"))
    ).drop("_pick")


# Fixed exit levels per trading horizon.
TARGETS = {"intraday": (0.01, 0.01, 0.005), "swing": (0.05, 0.03, 0.02)}


def horizon_targets(horizon: Column | str) -> Column:
    """Profit target, stop and trailing stop of a horizon; of an unknown or missing one the intraday levels."""
    h = F.col(horizon) if isinstance(horizon, str) else horizon
    level = lambda i: F.when(h == "swing", TARGETS["swing"][i]).otherwise(TARGETS["intraday"][i])
    return F.struct(level(0).alias("profit_target_pct"), level(1).alias("stop_loss_pct"), level(2).alias("trailing_stop_pct"))
