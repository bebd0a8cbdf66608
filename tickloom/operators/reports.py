"""Performance reports, equity statistics and calibration over trade or return tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalar import c, div, expectancy, kelly_fraction
from tickloom.plans.ordered import UNB, running_equity

INF = float("inf")
RISK_FREE = 0.06
DAYS = 252


def sharpe(avg, sd, n, periods: int = DAYS, rf: float = RISK_FREE) -> Column:
    s = math.sqrt(periods) * (c(avg) - rf / periods) / F.nullif(c(sd), F.lit(0.0))
    return F.when(c(n) >= 2, F.coalesce(s, F.lit(0.0))).otherwise(0.0)


def profit_factor(gain, loss) -> Column:
    """Gross profit over gross loss; only profits give infinity, neither gives 0."""
    g, l = F.coalesce(c(gain), F.lit(0.0)), F.abs(F.coalesce(c(loss), F.lit(0.0)))
    return F.when(l != 0, g / F.nullif(l, F.lit(0.0))).when(g > 0, F.lit(INF)).otherwise(0.0)


def calmar(avg, drawdown, n) -> Column:
    annual = F.pow(1 + c(avg), F.lit(float(DAYS))) - 1
    dd = c(drawdown)
    ratio = F.when(dd != 0, annual / F.abs(F.nullif(dd, F.lit(0.0)))).when(annual > 0, F.lit(INF)).otherwise(0.0)
    return F.when(c(n) >= 1, ratio).otherwise(0.0)


def performance_report(
    trades: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[str],
    capital: float,
    event_time_sharpe: bool = False,
) -> DataFrame:
    """One row of metrics per cohort from trades with `pnl`, `pnl_pct`, `confidence`.

    The equity curve compounds pnl_pct in (block, order) sequence. Period returns of that curve are the pnl_pct
    of every trade but the first, so only the drawdown needs the curve itself, and that is scanned by block.
    `event_time_sharpe` annualises pnl_pct by trades per year of the covered span instead.
    """
    keys = list(keys)
    eq = running_equity(trades, keys, block, order, "pnl_pct", capital)
    pnl, pct = F.col("pnl"), F.col("pnl_pct")
    ret = F.when(~F.col("is_first"), pct)
    won = pnl >= 0
    agg = eq.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.count_if(won).alias("winning_trades"),
        F.count_if(~won).alias("losing_trades"),
        F.sum(pnl).alias("total_pnl"),
        F.avg(pct).alias("avg_trade_return_pct"),
        F.coalesce(F.avg(F.when(won, pct)), F.lit(0.0)).alias("avg_win_pct"),
        F.coalesce(F.abs(F.avg(F.when(~won, pct))), F.lit(0.0)).alias("avg_loss_pct"),
        F.avg("confidence").alias("avg_confidence"),
        F.min("drawdown").alias("max_drawdown_pct"),
        F.min_by(
            F.struct(F.col(block).alias("trough"), F.col("peak_block").alias("peak")),
            F.struct("drawdown", block, *order),
        ).alias("_dd"),
        F.sum(F.when(pnl > 0, pnl)).alias("_gain"),
        F.sum(F.when(pnl < 0, pnl)).alias("_loss"),
        F.avg(ret).alias("_ar"),
        F.stddev_samp(ret).alias("_sr"),
        F.count(ret).alias("_nr"),
        F.stddev_samp(pct).alias("_sp"),
        F.datediff(F.max(block), F.min(block)).alias("_span"),
    )
    rate = F.col("winning_trades") / F.col("total_trades")
    out = agg.withColumn("win_rate", rate).withColumns(
        {
            "sharpe_ratio": sharpe("_ar", "_sr", "_nr"),
            "profit_factor": profit_factor("_gain", "_loss"),
            "expectancy": expectancy("win_rate", "avg_win_pct", "avg_loss_pct"),
            "kelly_fraction": kelly_fraction("win_rate", "avg_win_pct", "avg_loss_pct"),
            "calmar_ratio": calmar("_ar", "max_drawdown_pct", "_nr"),
            "max_dd_peak_date": F.col("_dd.peak").cast("string"),
            "max_dd_trough_date": F.col("_dd.trough").cast("string"),
        }
    )
    if event_time_sharpe:
        n = F.col("total_trades").cast("double")
        per_year = F.when(F.col("_span") > 0, n / (F.col("_span") / 365.25)).otherwise(n)
        s = F.col("avg_trade_return_pct") / F.nullif(F.col("_sp"), F.lit(0.0)) * F.sqrt("trades_per_year")
        out = out.withColumn("trades_per_year", per_year).withColumn(
            "sharpe_ratio", F.when(F.coalesce(F.col("_sp"), F.lit(0.0)) > 1e-12, s).otherwise(0.0)
        )
    return out.drop("_dd", "_gain", "_loss", "_ar", "_sr", "_nr", "_sp", "_span")


def drawdown_of_series(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Maximum drawdown with its peak and trough position for one value per key and date."""
    w = Window.partitionBy(*keys).orderBy(order)
    run = w.rowsBetween(UNB, 0)
    d = df.withColumn("_top", F.max(value).over(run)).withColumn(
        "_high", F.coalesce(F.col(value) > F.lag("_top").over(w), F.lit(True))
    )
    d = d.withColumn("_peak_at", F.last(F.when(F.col("_high"), F.col(order)), ignorenulls=True).over(run)).withColumn(
        "_dd", div(F.col(value) - F.col("_top"), "_top")
    )
    best = F.min_by(F.struct(F.col(order).alias("t"), F.col("_peak_at").alias("p")), F.struct("_dd", order))
    return (
        d.groupBy(*keys)
        .agg(F.min("_dd").alias("max_drawdown"), best.alias("_b"))
        .select(*keys, "max_drawdown", F.col("_b.p").alias("peak_date"), F.col("_b.t").alias("trough_date"))
    )


def equity_stats(df: DataFrame, keys: Sequence[str], order: str, ret: str, periods_per_year: float) -> DataFrame:
    """Total return, Sharpe without risk-free rate, and drawdown of one return per key and period."""
    run = Window.partitionBy(*keys).orderBy(order).rowsBetween(UNB, 0)
    d = df.withColumn("_e", F.product(1 + F.col(ret)).over(run)).withColumn("_top", F.max("_e").over(run))
    sd = F.col("_sd")
    return (
        d.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_periods"),
            ((F.max_by("_e", order) - 1) * 100).alias("total_return_pct"),
            F.avg(ret).alias("_m"),
            F.coalesce(F.stddev_samp(ret), F.lit(0.0)).alias("_sd"),
            (F.min(div(F.col("_e") - F.col("_top"), "_top")) * 100).alias("max_drawdown_pct"),
        )
        .withColumn(
            "annualized_sharpe",
            F.when(sd > 1e-12, F.col("_m") / F.nullif(sd, F.lit(0.0)) * math.sqrt(periods_per_year)).otherwise(0.0),
        )
        .drop("_m", "_sd")
    )


def confidence_calibration(
    df: DataFrame, keys: Sequence[str] = (), n_bins: int = 10, confidence="confidence", predicted="predicted", actual="actual"
) -> DataFrame:
    """Expected and maximum calibration error over right-closed equal-width bins of the observed range.

    The range is one small aggregate joined back as a scalar; bins are then a plain hash aggregate.
    """
    keys = list(keys) or ["_all"]
    if keys == ["_all"]:
        df = df.withColumn("_all", F.lit(0))
    rng = df.groupBy(*keys).agg(F.min(confidence).alias("_lo"), F.max(confidence).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / n_bins
    pos = F.ceil((F.col(confidence) - F.col("_lo")) / F.nullif(width, F.lit(0.0))) - 1
    b = F.least(F.greatest(F.coalesce(pos, F.lit(0)), F.lit(0)), F.lit(n_bins - 1)).cast("int")
    bins = (
        df.join(rng, keys)
        .withColumn("bin", b)
        .groupBy(*keys, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(confidence).alias("conf"),
            F.avg((F.col(predicted) == F.col(actual)).cast("double")).alias("acc"),
        )
        .withColumn("err", F.abs(F.col("acc") - F.col("conf")))
    )
    return (
        bins.groupBy(*keys)
        .agg(
            (F.sum(F.col("err") * F.col("n")) / F.sum("n")).alias("expected_calibration_error"),
            F.max("err").alias("max_calibration_error"),
        )
        .drop("_all")
    )


def confidence_histogram(df: DataFrame, keys: Sequence[str], n_bins: int = 20, confidence: str = "confidence") -> DataFrame:
    """Counts over equal-width bins of [min, max] per key."""
    keys = list(keys)
    rng = df.groupBy(*keys).agg(F.min(confidence).alias("_lo"), F.max(confidence).alias("_hi"))
    b = F.least(F.width_bucket(F.col(confidence), F.col("_lo"), F.col("_hi"), F.lit(n_bins)), F.lit(n_bins))
    b = F.when(F.col("_lo") == F.col("_hi"), F.lit(1)).otherwise(b).cast("int")
    return df.join(rng, keys).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def pooled_report(trades: DataFrame, keys: Sequence[str] = (), date: str = "exit_date") -> DataFrame:
    """Trades of many instruments as one account of trade returns: count, mean and the Sharpe ratio per trade, annualised.

    Trades a year are counted over the span from the first to the last exit of all instruments. One aggregate, so
    overlapping trades of any number of instruments need no order.
    """
    span = F.datediff(F.max(date), F.min(date))
    n = F.count("pnl_pct")
    per_year = F.when(span > 0, n / (span / 365.25)).otherwise(n.cast("double"))
    dev = F.coalesce(F.stddev_samp("pnl_pct"), F.lit(0.0))
    sharpe = F.when(dev > 1e-12, F.avg("pnl_pct") / dev * F.sqrt(per_year)).otherwise(0.0)
    return trades.where("pnl_pct IS NOT NULL").groupBy(*keys).agg(
        n.alias("total_trades"), F.avg("pnl_pct").alias("avg_trade_return_pct"), per_year.alias("trades_per_year"), sharpe.alias("sharpe_ratio")
    )
