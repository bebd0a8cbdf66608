"""Trade journal: append-only change rows, latest state per trade, and the journal's queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed column types of the three journal tables.
TRADE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("version", T.LongType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("symbol", T.StringType(), False),
        T.StructField("action", T.StringType(), False),
        T.StructField("quantity", T.LongType()),
        T.StructField("entry_price", T.DoubleType()),
        T.StructField("exit_price", T.DoubleType()),
        T.StructField("pnl", T.DoubleType()),
        T.StructField("pnl_pct", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("regime", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("quantum_depth", T.LongType()),
        T.StructField("strategy", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("is_paper", T.BooleanType()),
        T.StructField("metadata_json", T.StringType()),
    ]
)
METRICS_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("model_version", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    ]
)
DAILY_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType(), False),
        T.StructField("total_trades", T.LongType()),
        T.StructField("winning_trades", T.LongType()),
        T.StructField("losing_trades", T.LongType()),
        T.StructField("total_pnl", T.DoubleType()),
        T.StructField("regime", T.StringType()),
    ]
)


def append(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def latest(changes: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """Current journal: a field keeps its newest non-NULL value over the change rows of its trade."""
    rest = [x for x in changes.columns if x not in (key, version)]
    aggs = [F.max_by(x, F.when(F.col(x).isNotNull(), F.col(version))).alias(x) for x in rest]
    return changes.groupBy(key).agg(*aggs, F.max(version).alias(version))


def find_trades(
    trades: DataFrame, symbol=None, start=None, end=None, status=None, is_paper=None, time: str = "timestamp"
) -> DataFrame:
    """Journal rows matching the given predicates, newest first."""
    for cond in (
        symbol and (F.col("symbol") == symbol),
        start and (F.col(time) >= F.lit(start)),
        end and (F.col(time) <= F.lit(end)),
        status and (F.col("status") == status),
        (F.col("is_paper") == is_paper) if is_paper is not None else None,
    ):
        if cond is not None and not isinstance(cond, str):
            trades = trades.filter(cond)
    return trades.orderBy(F.desc(time))


def latest_rows(trades: DataFrame, n: int = 50, time: str = "timestamp", tie: str = "id", **where) -> DataFrame:
    """Newest n matching rows (a report page)."""
    return find_trades(trades, time=time, **where).orderBy(F.desc(time), F.desc(tie)).limit(n)


def trade_statistics(trades: DataFrame, as_of, lookback_days: int = 90, time: str = "timestamp") -> DataFrame:
    """Win rate and mean win and loss of recent closed trades, with defaults where there are none."""
    # Fixed defaults used before there is any history.
    d = {"win_rate": 0.5, "avg_win_pct": 0.015, "avg_loss_pct": 0.008}
    pnl, pct = F.col("pnl"), F.col("pnl_pct")
    since = F.date_sub(F.lit(as_of).cast("date"), lookback_days)
    recent = trades.filter((F.col("status") == "CLOSED") & (F.col(time) >= since) & pnl.isNotNull() & pct.isNotNull())
    return recent.agg(
        F.coalesce(F.count_if(pnl > 0) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(d["win_rate"])).alias("win_rate"),
        F.coalesce(F.avg(F.when(pnl > 0, pct)), F.lit(d["avg_win_pct"])).alias("avg_win_pct"),
        F.coalesce(F.abs(F.avg(F.when(pnl < 0, pct))), F.lit(d["avg_loss_pct"])).alias("avg_loss_pct"),
    )


def performance_summary(trades: DataFrame, as_of, days: int = 30, time: str = "timestamp") -> DataFrame:
    pnl = F.col("pnl")
    since = F.date_sub(F.lit(as_of).cast("date"), days)
    recent = trades.filter((F.col("status") == "CLOSED") & (F.col(time) >= since))
    zero = F.lit(0.0)
    return recent.agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.coalesce(F.count_if(pnl > 0) / F.nullif(F.count(F.lit(1)), F.lit(0)), zero).alias("win_rate"),
        F.coalesce(F.sum(pnl), zero).alias("total_pnl"),
        F.coalesce(F.avg("pnl_pct"), zero).alias("avg_return_pct"),
        F.coalesce(F.avg("confidence"), zero).alias("avg_confidence"),
    )


def daily_summary(trades: DataFrame, date: str = "date") -> DataFrame:
    """Rows of the daily table from closed trades: counts, P&L and the day's most frequent regime (ties by name)."""
    pnl = F.col("pnl")
    closed = trades.where((F.col("status") == "CLOSED") & pnl.isNotNull())
    by_regime = closed.groupBy(F.col(date).alias("date"), "regime").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(pnl > 0).alias("w"), F.count_if(pnl < 0).alias("l"), F.sum("pnl").alias("p")
    )
    # of equally frequent regimes the one first by name: the greatest of (count, reversed order) over a bounded set of names
    first = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "regime")))[0]["regime"]
    return by_regime.groupBy("date").agg(
        F.sum("n").alias("total_trades"), F.sum("w").alias("winning_trades"), F.sum("l").alias("losing_trades"), F.sum("p").alias("total_pnl"), first.alias("regime")
    )


def metric_rows(metrics: DataFrame, model_version: str, at) -> DataFrame:
    """One row of the metrics table from a one-row frame of numbers: every numeric column is an entry of its map."""
    numbers = [f.name for f in metrics.schema.fields if isinstance(f.dataType, T.NumericType)]
    entries = F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("double").alias("value")) for c in numbers]))
    return metrics.select(F.lit(at).cast("timestamp").alias("timestamp"), F.lit(model_version).alias("model_version"), entries.alias("metrics"))
