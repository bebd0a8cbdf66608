"""Opening-range breakout back-test, set-based: one shuffle on (symbol, session), no row walk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.costs import DEFAULT_COSTS, CostParams, net_pnl
from tickloom.operators.reports import performance_report
from tickloom.plans.ordered import global_rank
from tickloom.session import cut_lineage

def _day():
    return Window.partitionBy("symbol", "session_date")


def _minute(ts: str = "date"):
    return F.hour(ts) * 60 + F.minute(ts) + F.second(ts) / F.lit(60.0)


def opening_range(bars: DataFrame, open_minute: int = 555, range_minutes: int = 15) -> DataFrame:
    """High, low and mean volume of each session's bars before open + range; needs two bars."""
    return (
        bars.filter(_minute() < open_minute + range_minutes)
        .groupBy("symbol", "session_date")
        .agg(
            F.max("high").alias("range_high"),
            F.min("low").alias("range_low"),
            F.avg("volume").alias("range_volume"),
            F.count(F.lit(1)).alias("range_bars"),
        )
        .filter(F.col("range_bars") >= 2)
    )


def breakout_trades(
    bars: DataFrame,
    open_minute: int = 555,
    range_minutes: int = 15,
    volume_multiple: float = 1.5,
    reward_multiple: float = 2.0,
    last_entry_minute: int = 900,
    square_off_minute: int = 915,
) -> DataFrame:
    """First confirmed breakout per symbol-session and its bracket exit.

    The opening range, the first qualifying bar, and the first bar that touches stop or target are minima over
    the session's rows, so each step is a whole-session window over the same partitioning.
    """
    m = _minute()
    in_range = m < open_minute + range_minutes
    d = bars.dropna(subset=["date", "open", "high", "low", "close", "volume"]).withColumns(
        {
            "_m": m,
            "_rh": F.max(F.when(in_range, F.col("high"))).over(_day()),
            "_rl": F.min(F.when(in_range, F.col("low"))).over(_day()),
            "_rv": F.avg(F.when(in_range, F.col("volume"))).over(_day()),
            "_rn": F.count(F.when(in_range, F.lit(1))).over(_day()),
        }
    ).filter((F.col("_rn") >= 2) & (F.col("_rh") > F.col("_rl")))
    confirmed = (F.col("_rv") <= 0) | (F.col("volume") >= F.col("_rv") * volume_multiple)
    outside = (F.col("close") > F.col("_rh")) | (F.col("close") < F.col("_rl"))
    candidate = F.col("_m").between(open_minute + range_minutes, last_entry_minute) & confirmed & outside
    d = d.withColumn("_in", F.min(F.when(candidate, F.struct("date", "close"))).over(_day())).filter(
        F.col("_in").isNotNull() & (F.col("date") > F.col("_in.date"))
    )
    entry = F.col("_in.close")
    long = entry > F.col("_rh")
    stop = F.when(long, F.col("_rl")).otherwise(F.col("_rh"))
    target = entry + (entry - stop) * reward_multiple
    d = d.withColumns({"_long": long, "_stop": stop, "_target": target})
    live = F.col("_m") < square_off_minute
    hit_stop = F.when(F.col("_long"), F.col("low") <= F.col("_stop")).otherwise(F.col("high") >= F.col("_stop"))
    hit_target = F.when(F.col("_long"), F.col("high") >= F.col("_target")).otherwise(F.col("low") <= F.col("_target"))
    hit = F.when(
        live & (hit_stop | hit_target),
        F.struct(
            F.col("date"),
            F.when(hit_stop, F.col("_stop")).otherwise(F.col("_target")).alias("price"),
            F.when(hit_stop, "stop").otherwise("target").alias("reason"),
        ),
    )
    here = F.struct("date", F.col("close").alias("price"))
    first = F.first  # columns constant within the session
    out = d.groupBy("symbol", "session_date").agg(
        first("_in").alias("_in"),
        first("_long").alias("_long"),
        first("_rh").alias("range_high"),
        first("_rl").alias("range_low"),
        F.min(hit).alias("_hit"),
        F.max(F.when(live, here)).alias("_last"),
        F.min(here).alias("_next"),
    )
    return out.select(
        "symbol",
        "session_date",
        F.when(F.col("_long"), "long").otherwise("short").alias("direction"),
        F.col("_in.date").alias("entry_time"),
        F.col("_in.close").alias("entry_price"),
        F.coalesce("_hit.price", "_last.price", "_next.price").alias("exit_price"),
        F.coalesce("_hit.reason", F.lit("square_off")).alias("exit_reason"),
        "range_high",
        "range_low",
    )


def priced_trades(
    trades: DataFrame, capital: float = 1_000_000.0, max_position_pct: float = 0.10, costs: CostParams = DEFAULT_COSTS
) -> DataFrame:
    side = F.when(F.col("direction") == "long", "BUY").otherwise("SELL")
    notional = min(max_position_pct * capital, capital)
    t = (
        trades.filter(F.col("entry_price") > 0)
        .withColumn("quantity", F.floor(F.lit(notional) / F.col("entry_price")))
        .filter(F.col("quantity") > 0)
    )
    return t.withColumn("pnl", net_pnl("entry_price", "exit_price", "quantity", side, False, costs)).withColumns(
        {"pnl_pct": F.col("pnl") / (F.col("entry_price") * F.col("quantity")), "confidence": F.lit(1.0)}
    )


def breakout_backtest(
    bars: DataFrame, capital: float = 1_000_000.0, max_position_pct: float = 0.10, train_frac: float = 0.7, **rules
) -> DataFrame:
    """Reports for train and out-of-sample trades, overall and by direction.

    Trades of all symbols form one pool; their order position is found by session blocks, not by one window.
    """
    t = cut_lineage(priced_trades(breakout_trades(bars, **rules), capital, max_position_pct))
    ranked = global_rank(t.withColumn("_pool", F.lit(0)), ["_pool"], "session_date", ["symbol"])
    split = F.when(F.col("rn") <= F.floor(F.col("n_total") * train_frac), "train").otherwise("oos")
    cohorts = ranked.withColumn("split", split).withColumn("cohort", F.explode(F.array(F.lit("all"), "direction")))
    return performance_report(cohorts, ["split", "cohort"], "session_date", ["symbol"], capital)
