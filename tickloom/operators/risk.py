"""Position sizing, allocation, running risk state, exits and crisis stress."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.costs import DEFAULT_COSTS, CostParams, net_pnl
from tickloom.functions.scalar import clip, div, kelly_fraction, round_to_tick
from tickloom.plans.ordered import UNB, running_sum


@dataclass(frozen=True)
class RiskLimits:
    # Fixed defaults of the risk configuration.
    capital: float = 1_000_000.0
    max_risk_per_trade_pct: float = 0.02
    kelly: float = 0.25
    max_position_size_pct: float = 0.10
    daily_loss_limit_pct: float = 0.03
    max_drawdown_pct: float = 0.12
    vix_spike: float = 25.0
    consecutive_losses: int = 3
    max_open_positions: int = 5


def position_size(confidence, win_rate, avg_win, avg_loss, regime_multiplier=1.0, lim: RiskLimits = RiskLimits()) -> Column:
    """Share of capital: the tightest of Kelly, risk cap and maximum, scaled by regime and confidence."""
    loss = F.greatest(F.col(avg_loss) if isinstance(avg_loss, str) else avg_loss, F.lit(1e-6))
    size = F.least(
        kelly_fraction(win_rate, avg_win, avg_loss, lim.kelly),
        F.lit(lim.max_risk_per_trade_pct) / loss,
        F.lit(lim.max_position_size_pct),
    )
    m = F.lit(regime_multiplier) if isinstance(regime_multiplier, (int, float)) else F.col(regime_multiplier)
    return clip(size * m * clip(confidence, 0.0, 1.0), 0.0, lim.max_position_size_pct)


def allocate(
    reports: DataFrame,
    liquidity: DataFrame,
    tradable: DataFrame,
    total_capital: float = 1_000_000.0,
    min_trades: int = 20,
    min_adtv_cr: float = 10.0,
    max_symbols: int = 5,
) -> DataFrame:
    """One row per tradable symbol: allocated capital for the best by Sharpe, else the first reason it is excluded."""
    d = tradable.select("symbol").distinct().join(reports, "symbol", "left").join(liquidity, "symbol", "left")
    adtv = F.coalesce("adtv_cr", F.lit(0.0))
    reason = (
        F.when(F.col("total_trades").isNull(), F.lit("no backtest result"))
        .when(
            F.col("total_trades") < min_trades,
            F.format_string(f"only %d backtest trades (need >= {min_trades})", F.col("total_trades")),
        )
        .when(adtv < min_adtv_cr, F.format_string(f"ADTV Rs.%.1fcr below Rs.{min_adtv_cr}cr minimum", adtv))
        .when(
            F.col("expectancy") <= 0,
            F.format_string("non-positive expectancy (%.5f) after costs", F.col("expectancy")),
        )
    )
    d = d.withColumns({"adtv_cr": adtv, "reason": reason})
    chosen = (
        d.filter(F.col("reason").isNull()).orderBy(F.desc("sharpe_ratio"), "symbol").limit(max_symbols).select("symbol", "expectancy")
    )
    # At most `max_symbols` rows from here on.
    w = F.col("expectancy") / F.sum("expectancy").over(Window.partitionBy(F.lit(0)))
    weights = chosen.withColumn("weight", w).select("symbol", "weight", (F.col("weight") * total_capital).alias("allocated_capital"))
    return d.join(weights, "symbol", "left").select(
        "symbol", "total_trades", "expectancy", "sharpe_ratio", "adtv_cr", "weight", "allocated_capital", "reason"
    )


def risk_state(trades: DataFrame, account: str, day: str, order: list[str], lim: RiskLimits = RiskLimits(), vix: str | None = None) -> DataFrame:
    """Capital, peak, daily P&L, loss streak and circuit breaker after every closed trade of an account.

    Daily figures are windows over (account, day). Capital and peak enter a day through one row per (account, day),
    so an account with a long history is never one task.
    """
    seq = Window.partitionBy(account, day).orderBy(*order)
    run = seq.rowsBetween(UNB, 0)
    d = trades.withColumn("daily_pnl", F.sum("pnl").over(run)).withColumn("_high", F.max("daily_pnl").over(run))
    past = Window.partitionBy(account).orderBy(day).rowsBetween(UNB, -1)
    days = (
        d.groupBy(account, day)
        .agg(F.sum("pnl").alias("_sum"), F.max("_high").alias("_top"))
        .withColumn("_open", F.coalesce(F.sum("_sum").over(past), F.lit(0.0)) + lim.capital)
        .withColumn("_peak", F.greatest(F.max(F.col("_open") + F.col("_top")).over(past), F.lit(lim.capital)))
        .select(account, day, "_open", "_peak")
    )
    won = F.max(F.when(F.col("pnl") >= 0, F.col("_i"))).over(run)
    d = d.join(days, [account, day]).withColumn("_i", F.row_number().over(seq))
    d = d.withColumns(
        {
            "current_capital": F.col("_open") + F.col("daily_pnl"),
            "peak_capital": F.greatest(F.col("_peak"), F.col("_open") + F.col("_high")),
            "consecutive_losses": F.col("_i") - F.coalesce(won, F.lit(0)),
        }
    )
    loss = -F.col("daily_pnl") / lim.capital
    fall = div(F.col("peak_capital") - F.col("current_capital"), "peak_capital")
    trip = F.when(loss >= lim.daily_loss_limit_pct, "daily_loss_limit_breached").when(
        fall >= lim.max_drawdown_pct, "max_drawdown_breached"
    )
    if vix:
        trip = trip.when(F.col(vix) >= lim.vix_spike, "vix_spike")
    d = d.withColumn("_trip", trip)
    # A trip holds for the rest of the day; the latest reason is shown.
    d = d.withColumn("halt_reason", F.last("_trip", ignorenulls=True).over(run)).withColumns(
        {
            "halted": F.col("halt_reason").isNotNull(),
            "size_multiplier": F.when(F.col("consecutive_losses") >= lim.consecutive_losses, 0.5).otherwise(1.0),
        }
    )
    return d.drop("_high", "_open", "_peak", "_i", "_trip")


def open_position_counts(
    trades: DataFrame, account: str, entry: str, exit_: str, order: list[str], lim: RiskLimits = RiskLimits(), halts: DataFrame | None = None
) -> DataFrame:
    """Every order with the positions open just before it, and whether the account may open one more.

    A sweep over the ends of the holding intervals: an entry counts 1, an exit takes 1 away, and on one day exits come
    first. The running sum is scanned by (account, day), so an account of any length is no single task. `halts`
    (account, day, halted) stops entries of a day. A trade without an exit stays open.
    """
    ends = trades.select("*", F.explode(F.array(F.lit(-1), F.lit(1))).alias("_step"))
    ends = ends.withColumn("_at", F.when(F.col("_step") == 1, F.col(entry)).otherwise(F.col(exit_))).where("_at IS NOT NULL")
    swept = running_sum(ends, [account], "_at", ["_step", *order], "_step", "_open").where("_step = 1")
    d = swept.withColumn("open_before", (F.col("_open") - 1).cast("long"))
    if halts is None:
        d = d.withColumn("halted", F.lit(False))
    else:
        h = halts.select(F.col(account), F.col(entry), "halted")
        d = d.join(h, [account, entry], "left").withColumn("halted", F.coalesce("halted", F.lit(False)))
    return d.withColumn("can_open", ~F.col("halted") & (F.col("open_before") < lim.max_open_positions)).drop("_step", "_at", "_open")


def evaluate_exits(
    positions: DataFrame, latest: DataFrame, profit_target: float = 0.015, stop_loss: float = 0.008, halted: Column | bool = False,
    costs: CostParams = DEFAULT_COSTS,
) -> DataFrame:
    """Open positions against the latest prices: which close, why, and the net P&L at tick-rounded prices.

    A halt closes every position that has a price; a symbol without a price is left alone.
    """
    halted = F.lit(halted) if isinstance(halted, bool) else halted
    d = positions.join(latest.select("symbol", F.col("close").alias("price")), "symbol")
    move = (F.col("price") - F.col("entry_price")) / F.col("entry_price")
    pct = F.when(F.col("action") == "BUY", move).otherwise(-move)
    d = d.withColumn("move_pct", pct).withColumn(
        "exit_reason",
        F.when(halted, "circuit_breaker").when(F.col("move_pct") >= profit_target, "take_profit").when(
            F.col("move_pct") <= -stop_loss, "stop_loss"
        ),
    )
    d = d.withColumns({"_in": round_to_tick("entry_price"), "exit_price": F.when(F.col("exit_reason").isNotNull(), round_to_tick("price"))})
    return d.withColumn("pnl", net_pnl("_in", "exit_price", "quantity", F.col("action"), False, costs)).drop("_in")


# Fixed list of crisis windows.
CRISES = (
    ("2008_gfc", "2008-09-01", "2008-12-31"),
    ("2013_taper_tantrum", "2013-05-22", "2013-09-15"),
    ("2020_covid_crash", "2020-02-20", "2020-04-07"),
)


def _scenario_array(scenarios) -> Column:
    return F.array(
        *[
            F.struct(F.lit(n).alias("scenario"), F.lit(a).cast("date").alias("start"), F.lit(b).cast("date").alias("end"))
            for n, a, b in scenarios
        ]
    )


def stress_test(bars: DataFrame, scenarios=CRISES, lim: RiskLimits = RiskLimits(), notional: float | None = None) -> DataFrame:
    """Worst day, drawdown and limit breaches per symbol and scenario; scenarios without two bars say so.

    The scenario list is a handful of literals: a bar is exploded to the scenarios that contain it, no join.
    """
    notional = notional or lim.capital * lim.max_position_size_pct
    arr = _scenario_array(scenarios)
    inside = F.filter(arr, lambda s: (F.col("date") >= s["start"]) & (F.col("date") <= s["end"]))
    w = Window.partitionBy("symbol", "scenario").orderBy("date")
    run = w.rowsBetween(UNB, 0)
    d = (
        bars.select("symbol", "date", "close", F.explode(inside).alias("s"))
        .select("symbol", "date", "close", "s.scenario")
        .withColumn("_r", div("close", F.lag("close").over(w)) - 1)
        .withColumn("_e", F.product(1 + F.coalesce("_r", F.lit(0.0))).over(run))
        .withColumn("_top", F.max(F.when(F.col("_r").isNotNull(), F.col("_e"))).over(run))
    )
    found = (
        d.groupBy("symbol", "scenario")
        .agg(
            F.count(F.lit(1)).alias("trading_days"),
            F.min("_r").alias("worst_day_return_pct"),
            F.min(F.when(F.col("_r").isNotNull(), div("_e", "_top") - 1)).alias("max_drawdown_pct"),
        )
        .filter(F.col("trading_days") >= 2)
    )
    grid = bars.select("symbol").distinct().select("symbol", F.explode(arr).alias("s")).select("symbol", "s.scenario")
    out = grid.join(found, ["symbol", "scenario"], "left")
    at_risk = F.abs("worst_day_return_pct") * notional
    has = F.col("trading_days").isNotNull()
    daily = F.col("capital_at_risk") / lim.capital >= lim.daily_loss_limit_pct
    return out.withColumns({"data_available": has, "capital_at_risk": F.coalesce(at_risk, F.lit(0.0))}).withColumns(
        {
            "trading_days": F.coalesce("trading_days", F.lit(0).cast("long")),
            "worst_day_return_pct": F.coalesce("worst_day_return_pct", F.lit(0.0)),
            "max_drawdown_pct": F.coalesce("max_drawdown_pct", F.lit(0.0)),
            "would_breach_daily_loss_limit": daily,
            # Breakers are tested in order, so the drawdown limit shows only where the daily one does not.
            "would_breach_max_drawdown": ~daily & (F.col("capital_at_risk") / lim.capital >= lim.max_drawdown_pct),
        }
    )


def worst_case(results: DataFrame) -> DataFrame:
    ok = F.col("data_available")
    worst = F.min_by(
        F.struct("symbol", "scenario", "worst_day_return_pct"),
        F.when(ok, F.struct("worst_day_return_pct", "scenario", "symbol")),
    )
    return results.agg(
        F.bool_or(ok).alias("data_available"),
        worst.alias("w"),
        F.bool_or(ok & F.col("would_breach_daily_loss_limit")).alias("any_breach_daily_loss_limit"),
        F.bool_or(ok & F.col("would_breach_max_drawdown")).alias("any_breach_max_drawdown"),
        F.count_distinct(F.when(~ok, F.col("symbol"))).alias("n_symbols_with_no_data"),
    ).select(
        "data_available", F.col("w.symbol").alias("worst_symbol"), F.col("w.scenario").alias("worst_scenario"),
        F.col("w.worst_day_return_pct").alias("worst_return_pct"), "any_breach_daily_loss_limit", "any_breach_max_drawdown",
        "n_symbols_with_no_data",
    )


def symbols_without_data(results: DataFrame) -> DataFrame:
    """(symbol, scenario) rows that no bar covers."""
    return results.filter(~F.col("data_available")).select("symbol", "scenario").distinct()
