"""Monthly investment plan: units, value curve, totals, drawdown and money-weighted return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.reports import drawdown_of_series
from tickloom.plans.ordered import UNB

RATE_LOW, RATE_HIGH, BISECTIONS = -0.9999, 10.0, 80


def xirr(flows: Column | str) -> Column:
    """Annual rate at which an array of (t: years from the first flow, amount) nets to zero; NULL without a sign
    change on the searched interval. Bisection as a fold, so any number of plans is solved side by side."""
    flows = F.col(flows) if isinstance(flows, str) else flows

    def npv(rate: Column) -> Column:
        return F.aggregate(flows, F.lit(0.0), lambda acc, f: acc + f["amount"] * F.pow(1 + rate, -f["t"]))

    lo0, hi0 = F.lit(RATE_LOW), F.lit(RATE_HIGH)

    def half(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        left = F.signum(npv(mid)) == acc["side"]
        return F.struct(
            F.when(left, mid).otherwise(acc["lo"]).alias("lo"),
            F.when(left, acc["hi"]).otherwise(mid).alias("hi"),
            acc["side"].alias("side"),
        )

    start = F.struct(lo0.alias("lo"), hi0.alias("hi"), F.signum(npv(lo0)).alias("side"))
    root = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, half, lambda a: (a["lo"] + a["hi"]) / 2)
    return F.when(npv(lo0) * npv(hi0) <= 0, root)


def plan_curve(prices: DataFrame, monthly: float, keys=("symbol",)) -> DataFrame:
    """Value of the plan on every date; the first trading day of each month invests."""
    keys = list(keys)
    month = Window.partitionBy(*keys, F.trunc("date", "month")).orderBy("date")
    invests = (F.row_number().over(month) == 1) & (F.col("close") > 0)
    d = prices.select(*keys, "date", "close").dropna().withColumn("invested", F.when(invests, monthly).otherwise(0.0))
    run = Window.partitionBy(*keys).orderBy("date").rowsBetween(UNB, 0)
    units = F.sum(F.when(F.col("invested") > 0, F.col("invested") / F.col("close")).otherwise(0.0)).over(run)
    return d.withColumn("units", units).withColumn("value", F.col("units") * F.col("close"))


def plan_summary(prices: DataFrame, monthly: float = 10_000.0, keys=("symbol",)) -> DataFrame:
    """Totals per instrument. A plan has one cash flow per month, so its flow array is a few hundred entries."""
    keys = list(keys)
    curve = plan_curve(prices, monthly, keys)
    flow = F.when(F.col("invested") > 0, F.struct("date", (-F.col("invested")).alias("amount")))
    s = curve.groupBy(*keys).agg(
        F.array_sort(F.collect_list(flow)).alias("_f"),
        F.count_if(F.col("invested") > 0).alias("n_contributions"),
        F.sum("invested").alias("total_invested"),
        F.max_by("value", "date").alias("final_value"),
        F.max("date").alias("_end"),
    )
    with_end = F.concat("_f", F.array(F.struct(F.col("_end").alias("date"), F.col("final_value").alias("amount"))))
    flows = F.transform(
        with_end,
        lambda f: F.struct((F.datediff(f["date"], F.get("_f", F.lit(0))["date"]) / 365.0).alias("t"), f["amount"].alias("amount")),
    )
    dd = drawdown_of_series(curve, keys, "date", "value").select(*keys, (F.col("max_drawdown") * 100).alias("max_drawdown_pct"))
    return (
        s.withColumn("_flows", flows)
        .withColumn("absolute_gain", F.col("final_value") - F.col("total_invested"))
        .withColumn("xirr_pct", xirr("_flows") * 100)
        .drop("_f", "_end", "_flows")
        .join(dd, keys)
    )
