"""Factor portfolios: momentum, low volatility and equal weight, plain and in staggered tranches.

A parameter grid is a set of key columns, so every grid point runs in the same job: scores are computed once per
lookback, ranks once per (lookback, date), and only the final selection differs by portfolio size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.costs import DEFAULT_COSTS, CostParams, round_trip_cost_pct
from tickloom.functions.scalar import div
from tickloom.operators.reports import equity_stats

STRATEGIES = ("momentum", "low_vol", "equal_weight_all")
GRID = ["target_n", "lookback_days", "strategy"]


def complete_panel(bars: DataFrame) -> DataFrame:
    """(symbol, date, close, idx, n_symbols) on dates where every symbol trades; idx counts those dates from 0.

    One row per (symbol, date) is assumed, so a date is complete when its row count equals the symbol count.
    """
    closes = bars.select("symbol", "date", "close").dropna()
    n = closes.select(F.count_distinct("symbol")).scalar()
    dates = closes.groupBy("date").agg(F.count(F.lit(1)).alias("n_symbols")).filter(F.col("n_symbols") == n)
    idx = F.row_number().over(Window.partitionBy("symbol").orderBy("date")) - 1
    return closes.join(dates, "date").withColumn("idx", idx)


def month_starts(df: DataFrame, keys: Sequence[str], warmup, every_n: int = 1) -> DataFrame:
    """First date of each month among rows with idx >= warmup, numbered from 0; every n-th is kept.

    Input has one row per key and date (a calendar), so the numbering window is calendar-sized.
    """
    firsts = (
        df.filter(F.col("idx") >= warmup)
        .groupBy(*keys, F.trunc("date", "month").alias("_month"))
        .agg(F.min("date").alias("date"))
    )
    w = Window.partitionBy(*keys).orderBy("date")
    out = firsts.withColumn("period", F.row_number().over(w) - 1).filter(F.col("period") % every_n == 0)
    return out.withColumn("period", (F.col("period") / every_n).cast("int")).drop("_month")


def factor_scores(
    panel: DataFrame, lookbacks: Sequence[int], skip: int = 21, vol_lookback: int = 60
) -> DataFrame:
    """Momentum (skipping the latest rows) per lookback and negated trailing volatility, known before the date."""
    w = Window.partitionBy("symbol").orderBy("date")
    ret = panel.withColumn("_r", div("close", F.lag("close").over(w)) - 1)
    vf = w.rowsBetween(-(vol_lookback - 1), -1)
    low_vol = F.when(
        (F.col("idx") >= vol_lookback) & (F.count("_r").over(vf) >= vol_lookback // 2), -F.stddev_samp("_r").over(vf)
    )
    mom = [
        F.struct(
            F.lit(lb).alias("lookback_days"),
            (div(F.lag("close", skip).over(w), F.lag("close", lb).over(w)) - 1).alias("momentum"),
        )
        for lb in lookbacks
        if lb > skip
    ]
    d = ret.withColumns({"low_vol": low_vol, "_grid": F.array(*mom)})
    return d.select("symbol", "date", "idx", "n_symbols", "close", "low_vol", F.inline("_grid"))


def _target_weights(
    bars: DataFrame, target_ns, lookbacks, skip, vol_lookback, every_n
) -> DataFrame:
    """(target_n, lookback_days, strategy, period, date, symbol, w, fwd): weights chosen at each rebalance and the
    price change to the next one. Unselected symbols stay with weight 0, so turnover needs no outer join."""
    scores = factor_scores(complete_panel(bars), lookbacks, skip, vol_lookback)
    warm = F.greatest(F.col("lookback_days"), F.lit(vol_lookback)) + 5
    calendar = scores.groupBy("lookback_days", "date").agg(F.min("idx").alias("idx"))
    rebal = month_starts(calendar, ["lookback_days"], warm, every_n)
    at = scores.join(rebal, ["lookback_days", "date"])
    by_symbol = Window.partitionBy("symbol", "lookback_days").orderBy("date")
    by_date = Window.partitionBy("lookback_days", "date")
    at = at.withColumns(
        {
            "fwd": div(F.lead("close").over(by_symbol), "close") - 1,
            "_rm": F.row_number().over(by_date.orderBy(F.desc("momentum"), "symbol")),
            "_rv": F.row_number().over(by_date.orderBy(F.desc("low_vol"), "symbol")),
        }
    )
    n = F.col("target_n")
    size = F.least(n, F.col("n_symbols"))

    def pick(name, chosen, count):
        return F.struct(F.lit(name).alias("strategy"), F.when(chosen, 1.0 / count).otherwise(0.0).alias("w"))

    plans = F.array(
        pick("momentum", F.col("_rm") <= n, size),
        pick("low_vol", F.col("_rv") <= n, size),
        pick("equal_weight_all", F.lit(True), F.col("n_symbols")),
    )
    return at.withColumn("target_n", F.explode(F.array(*[F.lit(x) for x in target_ns]))).select(
        "target_n", "lookback_days", "period", "date", "symbol", "fwd", F.inline(plans)
    )


def factor_periods(
    bars: DataFrame,
    target_ns: Sequence[int] = (6,),
    lookbacks: Sequence[int] = (126,),
    skip: int = 21,
    vol_lookback: int = 60,
    every_n: int = 1,
    costs: CostParams = DEFAULT_COSTS,
) -> DataFrame:
    """Net return and turnover per grid point, strategy and rebalance period."""
    cost = round_trip_cost_pct(p=costs)
    w = _target_weights(bars, target_ns, lookbacks, skip, vol_lookback, every_n)
    old = F.lag("w", 1, 0.0).over(Window.partitionBy(*GRID, "symbol").orderBy("date"))
    return (
        w.withColumn("_dw", F.abs(F.col("w") - old))
        .filter(F.col("fwd").isNotNull())
        .groupBy(*GRID, "period", "date")
        .agg(F.sum(F.col("w") * F.col("fwd")).alias("gross_return"), (F.sum("_dw") / 2).alias("turnover"))
        .withColumn("net_return", F.col("gross_return") - F.col("turnover") * cost)
    )


def factor_summary(periods: DataFrame, periods_per_year: float, costs: CostParams = DEFAULT_COSTS) -> DataFrame:
    cost = round_trip_cost_pct(p=costs)
    stats = equity_stats(periods, GRID, "date", "net_return", periods_per_year)
    extra = periods.groupBy(*GRID).agg(
        (F.avg("turnover") * 100).alias("avg_turnover_pct"), (F.sum("turnover") * cost * 100).alias("total_cost_drag_pct")
    )
    return stats.join(extra, GRID)


def factor_backtest(bars: DataFrame, every_n: int = 1, costs: CostParams = DEFAULT_COSTS, **grid) -> DataFrame:
    return factor_summary(factor_periods(bars, every_n=every_n, costs=costs, **grid), 12.0 / every_n, costs)


def staggered_periods(
    bars: DataFrame,
    target_ns: Sequence[int] = (6,),
    lookbacks: Sequence[int] = (126,),
    skip: int = 21,
    vol_lookback: int = 60,
    every_n: int = 3,
    n_tranches: int | None = None,
    costs: CostParams = DEFAULT_COSTS,
) -> DataFrame:
    """Monthly return of a portfolio split into tranches that rebalance `every_n` months apart.

    Tranche t at month i holds the weights chosen at month i - ((i - t) mod every_n), which is a lag of at most
    every_n - 1 months on the symbol's own weight series: no loop state. A tranche before its first rebalance is
    idle cash. Cost is charged in the month a tranche is due.
    """
    k = n_tranches or every_n
    cost = round_trip_cost_pct(p=costs)
    w = _target_weights(bars, target_ns, lookbacks, skip, vol_lookback, 1)
    s = Window.partitionBy(*GRID, "symbol").orderBy("date")
    lags = F.array(*[F.lag("w", j).over(s) if j else F.col("w") for j in range(every_n)])
    old = F.lag("w", every_n).over(s)
    d = (
        w.withColumns({"_lags": lags, "_old": old})
        .filter(F.col("fwd").isNotNull())
        .withColumn("tranche", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        .withColumn("_age", F.pmod(F.col("period") - F.col("tranche"), F.lit(every_n)))
    )
    active = F.col("period") >= F.col("tranche")
    # The first rebalance of a tranche starts from nothing, later ones from its weights every_n months ago.
    first = F.col("period") < F.col("tranche") + every_n
    held = F.when(active, F.get("_lags", F.col("_age"))).otherwise(0.0)
    due = active & (F.col("_age") == 0)
    moved = F.when(due, F.abs(F.col("w") - F.when(first, 0.0).otherwise(F.coalesce("_old", F.lit(0.0)))))
    per_tranche = (
        d.groupBy(*GRID, "period", "date", "tranche")
        .agg(F.sum(held * F.col("fwd")).alias("gross"), (F.sum(moved) / 2).alias("turnover"))
        .withColumn("net", F.col("gross") - F.coalesce(F.col("turnover"), F.lit(0.0)) * cost)
    )
    return per_tranche.groupBy(*GRID, "period", "date").agg(
        (F.sum("net") / k).alias("net_return"),
        F.sum("turnover").alias("turnover"),
        F.count("turnover").alias("rebalances"),
    )


def staggered_backtest(bars: DataFrame, every_n: int = 3, n_tranches: int | None = None, costs=DEFAULT_COSTS, **grid) -> DataFrame:
    k = n_tranches or every_n
    cost = round_trip_cost_pct(p=costs)
    p = staggered_periods(bars, every_n=every_n, n_tranches=n_tranches, costs=costs, **grid)
    stats = equity_stats(p, GRID, "date", "net_return", 12.0)
    extra = p.groupBy(*GRID).agg(
        (F.sum("turnover") / F.sum("rebalances") * 100).alias("avg_turnover_pct"),
        (F.sum("turnover") / k * cost * 100).alias("total_cost_drag_pct"),
    )
    return stats.join(extra, GRID).withColumn("n_tranches", F.lit(k))


def grid_verdicts(summary: DataFrame) -> DataFrame:
    """Momentum against equal weight for every grid point."""
    keys = ["target_n", "lookback_days"]

    def of(strategy, col):
        return F.max(F.when(F.col("strategy") == strategy, F.col(col)))

    return (
        summary.groupBy(*keys)
        .agg(
            of("momentum", "annualized_sharpe").alias("momentum_sharpe"),
            of("momentum", "total_return_pct").alias("momentum_return_pct"),
            of("equal_weight_all", "annualized_sharpe").alias("equal_weight_sharpe"),
            of("equal_weight_all", "total_return_pct").alias("equal_weight_return_pct"),
        )
        .withColumn("momentum_beats_equal_weight_sharpe", F.col("momentum_sharpe") > F.col("equal_weight_sharpe"))
    )
