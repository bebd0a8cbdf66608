"""Ingest cleaning, liquidity, listing continuity and corporate-action adjustment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CRORE = 1e7


def dedupe(df: DataFrame, keys: Sequence[str], order: str, keep: str = "last") -> DataFrame:
    """One row per key: the one with the highest (or lowest) load order. Duplicates of a hot key are reduced on the
    map side and never meet in one window. The row travels as a struct, so Spark aggregates over sorted rows: the
    input is deduplicated once when it is loaded, and every column is needed."""
    keys = list(keys)
    rest = [x for x in df.columns if x not in keys]
    pick = (F.max_by if keep == "last" else F.min_by)(F.struct(*rest), F.col(order))
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, "_r.*")


def prefer_source(df: DataFrame, key: str = "symbol", priority: str = "priority") -> DataFrame:
    """Rows of the best (lowest priority number) provider that has any row for the key."""
    best = df.groupBy(key).agg(F.min(priority).alias(priority))
    return df.join(best, [key, priority], "left_semi")


def liquidity(bars: DataFrame, day) -> DataFrame:
    """Average daily traded value in crore per symbol."""
    value = F.coalesce(F.col("turnover"), F.col("close") * F.col("volume"))
    daily = bars.groupBy("symbol", F.to_date(day).alias("_day")).agg(F.sum(value).alias("_v"))
    return daily.groupBy("symbol").agg((F.avg("_v") / CRORE).alias("adtv_cr"))


def liquidity_daily(bars: DataFrame, floor_cr: float | None = None) -> DataFrame:
    out = bars.groupBy("symbol").agg((F.avg(F.col("close") * F.col("volume")) / CRORE).alias("adtv_cr"))
    return out if floor_cr is None else out.withColumn("liquid", F.col("adtv_cr") >= floor_cr)


def listing_continuity(
    bars: DataFrame, min_coverage: float = 0.90, max_gap: float = 5.0, max_zero_volume: float = 0.05
) -> DataFrame:
    """Coverage of weekdays, longest gap and zero-volume share per symbol, with a verdict and reasons."""
    days = bars.groupBy("symbol", F.to_date("date").alias("day")).agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(F.col("volume") <= 0).alias("_zero")
    )
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy("symbol").orderBy("day")))
    s = (
        days.withColumn("_gap", gap)
        .groupBy("symbol")
        .agg(
            F.count(F.lit(1)).alias("n_days"),
            F.min("day").alias("_lo"),
            F.max("day").alias("_hi"),
            F.max("_gap").cast("double").alias("_gap"),
            (F.sum("_zero") / F.sum("_rows")).alias("_zero"),
        )
    )
    # Weekdays of the closed range: full weeks plus the remainder walked from the first day's weekday.
    span = F.datediff("_hi", "_lo") + 1
    weekdays = F.floor(span / 7) * 5 + F.size(
        F.filter(
            F.sequence(F.lit(0), F.lit(6)),
            lambda k: (k < span % 7) & ((F.weekday("_lo") + k) % 7 < 5),
        )
    )
    many = F.col("n_days") >= 2
    s = s.withColumns(
        {
            "coverage_ratio": F.when(many, F.col("n_days") / F.greatest(weekdays, F.lit(1))).otherwise(0.0),
            "max_gap_days": F.when(many, F.col("_gap")).otherwise(float("inf")),
            "zero_volume_ratio": F.when(many, F.col("_zero")).otherwise(1.0),
        }
    )
    pct = lambda x: F.format_string("%.0f%%", x * 100)
    reasons = F.array_compact(
        F.array(
            F.when(
                F.col("coverage_ratio") < min_coverage,
                F.concat(F.lit("coverage "), pct(F.col("coverage_ratio")), F.lit(f" below {min_coverage:.0%}")),
            ),
            F.when(
                F.col("max_gap_days") > max_gap,
                F.concat(F.lit("longest gap "), F.format_string("%.0fd", F.col("max_gap_days")), F.lit(f" exceeds {max_gap:.0f}d")),
            ),
            F.when(
                F.col("zero_volume_ratio") > max_zero_volume,
                F.concat(pct(F.col("zero_volume_ratio")), F.lit(f" zero-volume bars exceeds {max_zero_volume:.0%}")),
            ),
        )
    )
    reason = F.when(~many, F.lit("fewer than 2 trading days present")).when(F.size(reasons) > 0, F.array_join(reasons, "; "))
    return s.withColumn("reason", reason).select(
        "symbol", "coverage_ratio", "max_gap_days", "zero_volume_ratio", F.col("reason").isNull().alias("is_continuous"), "reason"
    )


def back_adjust(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Multiply prices, and divide volume, by every factor whose ex-date is after the bar.

    A symbol's actions are few (they are corporate events), so they travel as one array per symbol: the join is an
    equi-join that never multiplies bar rows.
    """
    per = actions.groupBy("symbol").agg(F.collect_list(F.struct("ex_date", "factor")).alias("_acts"))
    f = F.aggregate(
        F.coalesce("_acts", F.expr("cast(array() as array<struct<ex_date:date,factor:double>>)")),
        F.lit(1.0),
        lambda acc, a: acc * F.when(F.col("date") < a["ex_date"], a["factor"]).otherwise(1.0),
    )
    d = bars.join(per, "symbol", "left").withColumn("adjustment", f).drop("_acts")
    return d.withColumns(
        {p: F.col(p) * F.col("adjustment") for p in ("open", "high", "low", "close")}
        | {"volume": F.col("volume") / F.col("adjustment")}
    )
