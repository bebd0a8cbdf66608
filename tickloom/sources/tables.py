"""Engine inputs derived from the warehouse tables (one parquet per table)."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _price_code(price: Column) -> Column:
    """A whole number in the order of the prices: sign, exponent and the 52 bits after the first of the mantissa.

    Below 2^62 and exact for prices of 0 or of 1e-150 to 1e150.
    """
    size = F.abs(price)
    e = F.greatest(F.lit(-510.0), F.least(F.lit(510.0), F.floor(F.log2(size)).cast("double")))
    # the logarithm rounds, so next to a power of two it can name the exponent beside the right one
    e = e + F.when(size < F.pow(F.lit(2.0), e), -1.0).when(size >= F.pow(F.lit(2.0), e + 1), 1.0).otherwise(0.0)
    part = F.greatest(F.lit(0.0), F.least(size / F.pow(F.lit(2.0), e) - 1, F.lit(1 - 2.0**-52)))
    code = (e + 511).cast("long") * (1 << 52) + (part * float(1 << 52)).cast("long")
    return F.when(size > 0, F.when(price < 0, -code).otherwise(code)).when(size == 0, 0)


def _tick_order(price: Column, seq: Column) -> Column:
    """(seq, price) as one number of at most 38 digits."""
    return seq.cast("decimal(19,0)") * F.lit(Decimal(1 << 63)) + _price_code(price).cast("decimal(19,0)")


def bars_from_ticks(
    ticks: DataFrame, keys: Sequence[str], price: str, volume: str, seq: str = "seq", turnover: str | None = None
) -> DataFrame:
    """OHLCV bars: one hash aggregate with map-side combine, so a hot symbol is reduced before the shuffle.

    `seq` is a BIGINT that orders the ticks of a key; of ticks with one `seq` the lowest price opens and the highest
    closes. With both as one decimal the buffers of open and close are updated in place; a struct there would make
    Spark sort all ticks first. The output holds at most one row per key, which bounds every later per-symbol window
    by the calendar.
    """
    at = _tick_order(F.col(price), F.col(seq))
    return ticks.groupBy(*keys).agg(
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
        F.sum(volume).alias("volume"),
        (F.sum(turnover) if turnover else F.sum(F.col(price) * F.col(volume))).alias("turnover"),
    )


def _line_ticks(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("seq"),
        "l_partkey",
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("value"),
    )


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    ticks = _line_ticks(spark, sf_dir).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return bars_from_ticks(ticks, ["symbol", "date"], "px", "qty", turnover="value")


def bars_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("symbol"))
    ticks = (
        _line_ticks(spark, sf_dir)
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
    )
    return bars_from_ticks(ticks, ["symbol", "date"], "px", "qty", turnover="value")


def benchmark_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_ticks(spark, sf_dir).groupBy("date").agg(F.avg("px").alias("close"))


def bars_intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars; `date` is a zone-free clock time, `session_date` its calendar day."""
    ev = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("date").alias("session_date"),
        F.hour("ts").alias("hour"),
        # microseconds within the hour, then the event's number
        (
            (F.minute("ts").cast("long") * 60_000_000 + (F.expr("extract(SECOND FROM ts)") * 1_000_000)).cast("long") * (1 << 31)
            + F.pmod("event_id", F.lit(1 << 31))
        ).alias("seq"),
        "value",
        F.lit(1.0).alias("one"),
    )
    bars = bars_from_ticks(ev, ["symbol", "session_date", "hour"], "value", "one", turnover="value")
    at = F.col("session_date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("hour"))
    return bars.withColumn("date", at)


def participant_oi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily contract counts per participant, on the full date x category grid."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("date").alias("date"),
        F.element_at(
            F.create_map(
                *[F.lit(x) for kv in CLIENT_OF_PRIORITY.items() for x in kv],
            ),
            F.col("o_orderpriority"),
        ).alias("client_type"),
        (F.col("o_orderkey") % 2 == 0).alias("is_long"),
        F.col("o_totalprice").alias("v"),
        (F.col("o_orderkey") % 5).alias("m5"),
    )
    lng, sht = F.col("is_long"), ~F.col("is_long")

    def n(cond):
        return F.count_if(cond).cast("double")

    def s(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("v"))), F.lit(0.0))

    sums = (
        o.filter(F.col("client_type") != "TOTAL")
        .groupBy("date", "client_type")
        .agg(
            s(lng).alias("future_index_long"),
            s(sht).alias("future_index_short"),
            n(lng).alias("future_stock_long"),
            n(sht).alias("future_stock_short"),
            n(lng & (F.col("m5") < 2)).alias("option_index_call_long"),
            n(lng & (F.col("m5") >= 2)).alias("option_index_put_long"),
            n(sht & (F.col("m5") < 2)).alias("option_index_call_short"),
            n(sht & (F.col("m5") >= 2)).alias("option_index_put_short"),
        )
    )
    # Four categories per date: the grid is an explode of a fixed array, not a cross join.
    grid = o.select("date").distinct().select(
        "date", F.explode(F.array(*[F.lit(x) for x in CLIENT_TYPES])).alias("client_type")
    )
    return grid.join(sums, ["date", "client_type"], "left").na.fill(0.0)


# Fixed mapping of order priority to participant category; the fifth plays the dropped total row.
CLIENT_OF_PRIORITY = {
    "1-URGENT": "Client",
    "2-HIGH": "DII",
    "3-MEDIUM": "FII",
    "4-NOT SPECIFIED": "Pro",
    "5-LOW": "TOTAL",
}
CLIENT_TYPES = ("Client", "DII", "FII", "Pro")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal-shaped trades: one per order line."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"), "p_retailprice")
    li = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_ref"),
        "l_orderkey",
        "l_linenumber",
        "symbol",
        F.col("l_shipdate").cast("date").alias("date"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("action"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("entry_price"),
        F.col("p_retailprice").alias("exit_price"),
        (F.lit(0.5) + F.col("l_discount") * 5).alias("confidence"),
        F.when(F.col("l_linestatus") == "F", "CLOSED").otherwise("OPEN").alias("status"),
        F.when(F.col("l_returnflag") == "A", "bull_trend").when(F.col("l_returnflag") == "N", "sideways")
        .otherwise("bear_trend").alias("regime"),
        (F.col("l_suppkey") % 2 == 0).alias("is_paper"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_tax") > 0.04).cast("int").alias("predicted"),
        (F.col("l_returnflag") == "R").cast("int").alias("actual"),
        (F.lit(0.5) + F.col("l_discount") * 5).alias("confidence"),
    )
