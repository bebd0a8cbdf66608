"""Order-dependent computations that stay parallel when one key is hot.

A window over (key) puts a whole key into one task. The helpers here split an ordered group into blocks
(a date, or any other monotone bucket), work inside (key, block), reduce each block to a few numbers,
scan those numbers, and join them back. The scan sees one row per (key, block) and is bounded by the
calendar, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNB, CUR = Window.unboundedPreceding, Window.currentRow


def global_rank(
    df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], rank: str = "rn", total: str = "n_total"
) -> DataFrame:
    """1-based position of every row within its key, ordered by (block, order), and the key's row count."""
    keys = list(keys)
    scan = Window.partitionBy(*keys).orderBy(block)
    blocks = (
        df.groupBy(*keys, block)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            *keys,
            block,
            F.coalesce(F.sum("_rows").over(scan.rowsBetween(UNB, -1)), F.lit(0)).alias("_before"),
            F.sum("_rows").over(Window.partitionBy(*keys)).alias(total),
        )
    )
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    return (
        df.join(blocks, [*keys, block])
        .withColumn(rank, F.row_number().over(inside) + F.col("_before"))
        .drop("_before")
    )


def running_equity(
    df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], ret: str, start: float = 1.0
) -> DataFrame:
    """Adds `equity` (compounded), `equity_peak`, `drawdown` and `peak_block` per key in (block, order) sequence.

    `is_first` marks the key's first row. Any sign of 1 + ret is handled: a block carries its product,
    maximum and minimum, which together determine what an earlier multiplier does to it.
    """
    keys = list(keys)
    run = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(UNB, CUR)
    rows = (
        df.withColumn("_e", F.product(1 + F.col(ret)).over(run))
        .withColumn("_pos", F.row_number().over(Window.partitionBy(*keys, block).orderBy(*order)))
        .withColumn("_hi", F.max("_e").over(run))
        .withColumn("_lo", F.min("_e").over(run))
    )
    past = Window.partitionBy(*keys).orderBy(block).rowsBetween(UNB, -1)
    blocks = (
        rows.groupBy(*keys, block)
        .agg(F.max_by("_e", "_pos").alias("_p"), F.max("_e").alias("_bhi"), F.min("_e").alias("_blo"))
        .withColumn("_carry", F.coalesce(F.product("_p").over(past), F.lit(1.0)))
        .withColumn("_top", F.greatest(F.col("_carry") * F.col("_bhi"), F.col("_carry") * F.col("_blo")))
        .withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(block)))
        .withColumn("_prev", F.max(F.struct("_top", -F.col("_i"), F.col(block).alias("at"))).over(past))
        .select(*keys, block, "_carry", F.col("_prev._top").alias("_prev_top"), F.col("_prev.at").alias("_prev_at"))
    )
    local_top = F.greatest(F.col("_carry") * F.col("_hi"), F.col("_carry") * F.col("_lo"))
    return (
        rows.join(blocks, [*keys, block])
        .withColumn("equity", F.col("_carry") * F.col("_e") * start)
        .withColumn("equity_peak", F.greatest(F.col("_prev_top"), local_top) * start)
        .withColumn(
            "peak_block", F.when(local_top <= F.col("_prev_top"), F.col("_prev_at")).otherwise(F.col(block))
        )
        .withColumn("drawdown", F.col("equity") / F.nullif(F.col("equity_peak"), F.lit(0.0)) - 1)
        .withColumn("is_first", F.col("_prev_top").isNull() & (F.col("_pos") == 1))
        .drop("_e", "_pos", "_hi", "_lo", "_carry", "_prev_top", "_prev_at")
    )


def running_sum(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Cumulative sum per key in (block, order) sequence."""
    keys = list(keys)
    past = Window.partitionBy(*keys).orderBy(block).rowsBetween(UNB, -1)
    blocks = (
        df.groupBy(*keys, block)
        .agg(F.sum(value).alias("_s"))
        .select(*keys, block, F.coalesce(F.sum("_s").over(past), F.lit(0.0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(UNB, CUR)
    return df.join(blocks, [*keys, block]).withColumn(out, F.col("_before") + F.sum(value).over(inside)).drop("_before")


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash the rows over the session's full shuffle width. For CPU-heavy steps on few bytes, which adaptive
    coalescing (driven by bytes) would otherwise pack into one task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)


def mix(*terms: tuple[Column | str, int], seed: int = 0) -> Column:
    """Uniform integer in [0, 2^31 - 1) from integer columns, by arithmetic any engine can repeat.

    Two quadratic rounds modulo the Mersenne prime; every product stays below 2^63.
    """
    p = 2147483647
    h = F.lit(seed).cast("long")
    for x, w in terms:
        h = h + (F.col(x) if isinstance(x, str) else x).cast("long") * F.lit(w).cast("long")
    h = h % p
    for a, b in ((48271, 11), (16807, 7)):
        h = (h * h + h * F.lit(a).cast("long") + F.lit(b).cast("long")) % p
    return h
