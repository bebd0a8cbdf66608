"""Benchmark-relative returns, abnormal-reaction events, post-event drift and event trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.costs import DEFAULT_COSTS, CostParams, net_pnl
from tickloom.functions.scalar import div
from tickloom.operators.significance import one_sample_t

def _by_date():
    return Window.partitionBy("symbol").orderBy("date")


def excess_returns(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Returns of a symbol over those of the benchmark, both over the dates present in the two tables."""
    b = benchmark.select("date", F.col("close").alias("benchmark_close")).dropna()
    j = bars.select("symbol", "date", "close", "volume").dropna().join(b, "date")
    r = div("close", F.lag("close").over(_by_date())) - 1
    m = div("benchmark_close", F.lag("benchmark_close").over(_by_date())) - 1
    return j.withColumns({"return": r, "benchmark_return": m}).withColumn(
        "excess_return", F.col("return") - F.col("benchmark_return")
    )


def reaction_scores(df: DataFrame, baseline: int = 60) -> DataFrame:
    """z-scores of excess return and volume against the previous `baseline` rows (the current one excluded)."""
    f = _by_date().rowsBetween(-baseline, -1)

    def z(x):
        full = F.count(x).over(f) == baseline
        return F.when(full, div(F.col(x) - F.avg(x).over(f), F.stddev_samp(x).over(f)))

    return df.withColumns(
        {"excess_return_z": z("excess_return"), "volume_z": z("volume"), "idx": F.row_number().over(_by_date()) - 1}
    )


def is_event(return_z: float = 2.5, volume_z: float = 2.0):
    return F.coalesce((F.abs("excess_return_z") > return_z) & (F.col("volume_z") > volume_z), F.lit(False))


def reaction_events(df: DataFrame, baseline: int = 60, return_z: float = 2.5, volume_z: float = 2.0) -> DataFrame:
    return (
        reaction_scores(df, baseline)
        .filter(is_event(return_z, volume_z))
        .withColumn("direction", F.when(F.col("excess_return_z") > 0, "positive").otherwise("negative"))
    )


def forward_drift(x: str, window: int):
    """Compounded value over the `window` rows after the current one; NULL if any is missing."""
    f = _by_date().rowsBetween(1, window)
    return F.when(F.count(x).over(f) == window, F.product(1 + F.col(x)).over(f) - 1)


def event_trades(
    df: DataFrame,
    windows: Sequence[int] = (5, 10, 20),
    capital: float = 1_000_000.0,
    max_position_pct: float = 0.10,
    baseline: int = 60,
    min_rows: int = 150,
    train_frac: float | None = 0.7,
    costs: CostParams = DEFAULT_COSTS,
) -> DataFrame:
    """One trade per event and holding window: in at the next close, out `window` rows after the event.

    All windows' exits and drifts are computed in the one pass over the symbol's rows; only event rows are then
    exploded by window. With `train_frac` only events from the split row's date on are traded.
    """
    scored = reaction_scores(df, baseline).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    scored = scored.withColumns(
        {"_entry": F.lead("close", 1).over(_by_date())}
        | {f"_x{w}": F.lead("close", w).over(_by_date()) for w in windows}
        | {f"_xd{w}": F.lead("date", w).over(_by_date()) for w in windows}
        | {f"_d{w}": forward_drift("excess_return", w) for w in windows}
    ).filter(is_event() & (F.col("_n") >= min_rows))
    if train_frac is not None:
        scored = scored.filter(F.col("idx") >= F.floor(F.col("_n") * train_frac))
    plans = F.array(
        *[
            F.struct(
                F.lit(w).alias("window"), F.col(f"_x{w}").alias("exit_price"), F.col(f"_xd{w}").alias("exit_date"),
                F.col(f"_d{w}").alias("drift"),
            )
            for w in windows
        ]
    )
    side = F.when(F.col("excess_return_z") > 0, "BUY").otherwise("SELL")
    notional = min(max_position_pct * capital, capital)
    t = (
        scored.select("symbol", "date", "idx", F.col("_entry").alias("entry_price"), side.alias("side"), F.inline(plans))
        .filter((F.col("entry_price") > 0) & F.col("exit_price").isNotNull())
        .withColumn("quantity", F.floor(F.lit(notional) / F.col("entry_price")))
        .filter(F.col("quantity") > 0)
        .withColumn("pnl", net_pnl("entry_price", "exit_price", "quantity", F.col("side"), True, costs))
    )
    return t.withColumns(
        {
            "pnl_pct": F.col("pnl") / (F.col("entry_price") * F.col("quantity")),
            "continuation_pct": F.when(F.col("side") == "BUY", F.col("drift")).otherwise(-F.col("drift")),
            "direction": F.when(F.col("side") == "BUY", "positive").otherwise("negative"),
            "confidence": F.lit(1.0),
        }
    ).drop("drift")


def event_counts(df: DataFrame, train_frac: float = 0.7, min_rows: int = 150, **thresholds) -> DataFrame:
    """Per symbol how many events stand before and from its split date on; symbols without events have zeros.

    The split date is that of row int(n * train_frac). Symbols with fewer than min_rows rows are left out.
    """
    every = Window.partitionBy("symbol")
    d = reaction_scores(df, thresholds.pop("baseline", 60)).withColumn("_n", F.count(F.lit(1)).over(every)).where(F.col("_n") >= min_rows)
    late = F.col("idx") >= F.floor(F.col("_n") * train_frac)
    hit = is_event(**thresholds)
    return d.groupBy("symbol").agg(
        F.min(F.when(late, F.col("date"))).alias("split_date"), F.count_if(hit & ~late).alias("train_events"), F.count_if(hit & late).alias("oos_events")
    )


def continuation_summary(trades: DataFrame, keys: Sequence[str], family_alpha: float = 0.05, n_tests: int = 6) -> DataFrame:
    """t-test of pooled continuation per cohort with a Bonferroni verdict."""
    out = one_sample_t(trades, keys, "continuation_pct", with_median=True)
    alpha = family_alpha / n_tests
    return out.withColumn("corrected_alpha", F.lit(alpha)).withColumn(
        "significant", F.coalesce(F.col("p_value") < alpha, F.lit(False))
    )
