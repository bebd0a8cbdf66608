"""Significance tests over return tables: t-tests, bootstrap, subperiods, rank correlation, permutations."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.distributions import t_two_sided_p
from tickloom.functions.scalar import div
from tickloom.plans.ordered import running_sum, spread
from tickloom.session import cut_lineage, ship_package


def one_sample_t(df: DataFrame, keys: Sequence[str], value: str, with_median: bool = False) -> DataFrame:
    """t-test of the mean against 0 with descriptives in percent; fewer than 2 values give NULL statistics."""
    aggs = [
        F.count(value).alias("n"),
        F.coalesce(F.avg(value) * 100, F.lit(0.0)).alias("mean_pct"),
        (F.stddev_samp(value) * 100).alias("std_pct"),
    ]
    if with_median:
        aggs.append(F.when(F.count(value) >= 2, F.median(value) * 100).alias("median_pct"))
    out = df.groupBy(*keys).agg(*aggs)
    se = F.col("std_pct") / F.sqrt(F.col("n").cast("double"))
    out = out.withColumn("t_stat", F.when(F.col("n") >= 2, F.col("mean_pct") / F.nullif(se, F.lit(0.0))))
    return out.withColumn("p_value", t_two_sided_p("t_stat", F.col("n") - 1))


def paired_t(a: DataFrame, b: DataFrame, on: Sequence[str], keys: Sequence[str], value: str) -> DataFrame:
    """t-test of per-period differences between two return series sharing the columns `on`."""
    diff = a.select(*on, F.col(value).alias("_a")).join(b.select(*on, F.col(value).alias("_b")), list(on))
    return one_sample_t(diff.withColumn("diff", F.col("_a") - F.col("_b")), keys, "diff")


def bootstrap_sharpe(
    df: DataFrame, keys: Sequence[str], order: str, value: str, n_boot: int = 5000, periods_per_year: int = 12, seed: int = 42
) -> DataFrame:
    """5/50/95 % quantiles of the annualised Sharpe ratio over resamples with replacement.

    A period return series has one value per rebalance date, so each cohort travels as one short array; the
    replicates are exploded in slices and spread over the cluster. Draw j of replicate r is an arithmetic hash of (r, j), so reruns and lost tasks give the same resample.
    """
    keys = list(keys)
    pair = F.struct(F.col(order), F.col(value).alias("v"))
    arr = (
        df.groupBy(*keys)
        .agg(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["v"]).alias("a"))
        .withColumn("n", F.size("a"))
    )
    slices = arr.filter(F.col("n") >= 2).withColumn(
        "first_rep", F.explode(F.sequence(F.lit(1), F.lit(n_boot), F.lit(REPS_PER_TASK_ROW)))
    )

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for i, (a, first) in enumerate(zip(pdf["a"], pdf["first_rep"])):
                a = np.asarray(a)
                reps = np.arange(first, min(first + REPS_PER_TASK_ROW, n_boot + 1), dtype=np.int64)
                draw = a[hash_grid(reps[:, None], np.arange(len(a), dtype=np.int64)[None, :], seed) % len(a)]
                sd = draw.std(axis=1, ddof=1)
                ok = sd >= 1e-12
                ratio = draw.mean(axis=1)[ok] / sd[ok] * math.sqrt(periods_per_year)
                parts.append(pdf[keys].iloc[[i] * int(ok.sum())].assign(sharpe=ratio))
            yield pd.concat(parts) if parts else pdf[keys].iloc[:0].assign(sharpe=[])

    schema = arr.select(*keys).schema.add("sharpe", "double")
    ship_package()
    per = spread(slices, *keys, "first_rep").mapInPandas(resample, schema)
    q = F.percentile("sharpe", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    stats = per.groupBy(*keys).agg(q.alias("q"))
    return arr.select(*keys, F.col("n").alias("n_periods")).join(stats, keys, "left").select(
        *keys,
        "n_periods",
        F.col("q")[1].alias("sharpe_median"),
        F.col("q")[0].alias("ci_low_5pct"),
        F.col("q")[2].alias("ci_high_95pct"),
    )


def subperiods(df: DataFrame, keys: Sequence[str], order: str, value: str, n_splits: int = 2) -> DataFrame:
    """Mean, plain Sharpe and win rate in `n_splits` chronological buckets of near-equal length.

    Bucket i holds positions [floor(i*n/k), floor((i+1)*n/k)); series shorter than two rows per bucket drop.
    """
    keys = list(keys)
    n, i = F.col("_n"), F.col("_i")
    d = df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))
    )
    bucket = F.floor(((i + 1) * n_splits - 1) / n).cast("int")
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return (
        d.filter(n >= 2 * n_splits)
        .withColumn("bucket", bucket)
        .groupBy(*keys, "bucket")
        .agg(
            F.min(order).alias("start_date"),
            F.max(order).alias("end_date"),
            F.count(F.lit(1)).alias("n_periods"),
            (F.avg(value) * 100).alias("mean_return_pct"),
            F.when(sd > 1e-12, F.avg(value) / F.nullif(sd, F.lit(0.0))).otherwise(0.0).alias("naive_sharpe"),
            F.avg((F.col(value) > 0).cast("double")).alias("win_rate"),
        )
    )


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Rank with ties averaged, within keys. Callers keep a feature or segment in the keys, and a group has one
    row per date."""
    w = Window.partitionBy(*keys).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    return df.withColumn(out, F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def pooled_rank(df: DataFrame, keys: Sequence[str], value: str, out: str, n_blocks: int = 64) -> DataFrame:
    """Average-tie rank within keys for groups of any size.

    Rows are first reduced to distinct values with counts (map-side, so a value that fills a third of the group is
    one row), the distinct values are cut into blocks at approximate quantiles, and positions are counted by block.
    Any cut points give the same ranks; they only decide how evenly the work is spread.
    """
    keys = list(keys)
    vals = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    cuts = vals.groupBy(*keys).agg(
        F.percentile_approx(value, F.array(*[F.lit(i / n_blocks) for i in range(1, n_blocks)]), F.lit(1000)).alias("_q")
    )
    placed = vals.join(cuts, keys).withColumn("_b", F.size(F.filter("_q", lambda q: q < F.col(value)))).drop("_q")
    placed = cut_lineage(placed)
    upto = running_sum(placed, keys, "_b", [value], "_c", "_upto")
    ranks = upto.select(*keys, value, (F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / 2.0).alias(out))
    return df.join(ranks, [*keys, value])


def pooled_ic(df: DataFrame, keys: Sequence[str], x: str, y: str, min_points: int = 10, y_is_rank: bool = False) -> DataFrame:
    """Rank correlation per key when a key's rows are pooled over many series and have no size bound.

    Where many keys share one y, its rank can be given instead (`y_is_rank`), taken once over all rows that have y.
    """
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = pooled_rank(d, keys, x, "_rx")
    d = d.withColumn("_ry", F.col(y)) if y_is_rank else pooled_rank(d, keys, y, "_ry")
    ic = div(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry"))
    return (
        d.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), ic.alias("ic"))
        .withColumn("ic", F.when(F.col("n") >= min_points, F.col("ic")))
    )


def spearman_ic(df: DataFrame, keys: Sequence[str], x: str, y: str, min_points: int = 10) -> DataFrame:
    """Rank correlation per key over rows where both values are present; NULL below `min_points` or when flat."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = average_rank(average_rank(d, keys, x, "_rx"), keys, y, "_ry")
    ic = div(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry"))
    return (
        d.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), ic.alias("ic"))
        .withColumn("ic", F.when(F.col("n") >= min_points, F.col("ic")))
    )


REPS_PER_TASK_ROW = 50


def hash_grid(r: np.ndarray, j: np.ndarray, seed: int) -> np.ndarray:
    """The arithmetic hash of tickloom.plans.ordered.mix over a grid of (replicate, position)."""
    p = 2147483647
    h = (seed + r * 1000003 + j * 8191) % p
    for a, b in ((48271, 11), (16807, 7)):
        h = (h * h + h * a + b) % p
    return h


def permutation_p(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    x: str,
    y: str,
    n_perm: int = 1000,
    block_size: int = 1,
    seed: int = 42,
    min_points: int = 10,
) -> DataFrame:
    """Share of label shuffles whose |rank correlation| reaches the observed one, with add-one smoothing.

    Ranks do not change under a shuffle, so a key ships its two rank arrays once (one value per date) and the
    replicates are spread over the cluster in slices of REPS_PER_TASK_ROW; inside a task a slice is one matrix
    product. Blocks of `block_size` consecutive labels move together, in the order of an arithmetic hash.
    """
    keys = list(keys)
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = average_rank(average_rank(d, keys, x, "_rx"), keys, y, "_ry")
    arrays = (
        d.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct(order, "_rx", "_ry"))).alias("s"))
        .select(*keys, F.col("s._rx").alias("rx"), F.col("s._ry").alias("ry"))
    )
    slices = arrays.filter(F.size("rx") >= min_points).withColumn(
        "first_rep", F.explode(F.sequence(F.lit(1), F.lit(n_perm), F.lit(REPS_PER_TASK_ROW)))
    )

    def count_ge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hits, obs = [], []
            for rx, ry, first in zip(pdf["rx"], pdf["ry"], pdf["first_rep"]):
                a, b = np.asarray(rx), np.asarray(ry)
                a, b = a - a.mean(), b - b.mean()
                scale = math.sqrt((a @ a) * (b @ b))
                n = len(a)
                if scale == 0:
                    hits.append(0)
                    obs.append(0.0)
                    continue
                reps = np.arange(first, min(first + REPS_PER_TASK_ROW, n_perm + 1), dtype=np.int64)
                blocks = np.arange(-(-n // block_size), dtype=np.int64)
                h = hash_grid(reps[:, None], blocks[None, :], seed)
                seq = np.argsort(h, axis=1, kind="stable")
                pos = seq[:, :, None] * block_size + np.arange(block_size)[None, None, :]
                pos = pos.reshape(len(reps), -1)
                moved = b[pos[pos < n].reshape(len(reps), n)]
                ic, seen = np.abs(moved @ a) / scale, abs(a @ b) / scale
                hits.append(int((ic >= seen - 1e-12).sum()))
                obs.append(seen)
            yield pdf[keys].assign(hits=np.asarray(hits, dtype="int64"), obs=obs)

    schema = d.select(*keys).schema.add("hits", "long").add("obs", "double")
    ship_package()
    per = spread(slices, *keys, "first_rep").mapInPandas(count_ge, schema)
    p = F.when(F.max("obs") > 0, (F.sum("hits") + 1) / (n_perm + 1.0)).otherwise(1.0)
    found = per.groupBy(*keys).agg(p.alias("p_value"))
    return arrays.select(*keys, F.size("rx").alias("n")).join(found, keys, "left").na.fill(1.0, ["p_value"])


def pooled_permutation_p(
    df: DataFrame, keys: Sequence[str], series: Sequence[str], order: str, x: str, y: str,
    n_perm: int = 1000, block_size: int = 1, seed: int = 42, min_points: int = 10,
) -> DataFrame:
    """p_value per key when its rows are pooled over many series: labels are shuffled inside each series.

    Ranks are taken over the pool. A series ships its two rank arrays and gives, per replicate, its share of the sum
    of products; the shares of all series are added per replicate, so no task sees more than one series.
    """
    keys, series = list(keys), list(series)
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = cut_lineage(pooled_rank(pooled_rank(d, keys, x, "_rx"), keys, y, "_ry"))
    pool = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_rx").alias("_mx"), F.avg("_ry").alias("_my"),
        (F.stddev_pop("_rx") * F.stddev_pop("_ry") * F.count(F.lit(1))).alias("_scale"),
    )
    arrays = d.groupBy(*keys, *series).agg(F.array_sort(F.collect_list(F.struct(order, "_rx", "_ry"))).alias("s")).join(pool, keys)
    slices = arrays.filter(F.col("_n") >= min_points).select(
        *keys, *series, F.col("s._rx").alias("rx"), F.col("s._ry").alias("ry"), "_mx", "_my",
        F.explode(F.sequence(F.lit(0), F.lit(n_perm), F.lit(REPS_PER_TASK_ROW))).alias("first_rep"),
    )

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Replicate 0 is the order as it is."""
        for pdf in batches:
            out = []
            for rx, ry, mx, my, first in zip(pdf["rx"], pdf["ry"], pdf["_mx"], pdf["_my"], pdf["first_rep"], strict=True):
                a, b = np.asarray(rx) - mx, np.asarray(ry) - my
                reps = np.arange(first, min(first + REPS_PER_TASK_ROW, n_perm + 1), dtype=np.int64)
                blocks = np.arange(-(-len(a) // block_size), dtype=np.int64)
                turn = np.argsort(hash_grid(reps[:, None], blocks[None, :], seed), axis=1, kind="stable")
                turn[reps == 0] = blocks
                pos = (turn[:, :, None] * block_size + np.arange(block_size)).reshape(len(reps), -1)
                out.append((b[pos[pos < len(a)].reshape(len(reps), len(a))] @ a).tolist())
            yield pdf[[*keys, "first_rep"]].assign(part=out)

    ship_package()
    parts = spread(slices, *keys, *series, "first_rep").mapInPandas(shares, slices.select(*keys, "first_rep").schema.add("part", T.ArrayType(T.DoubleType())))
    sums = parts.select(*keys, "first_rep", F.posexplode("part").alias("i", "v")).groupBy(*keys, (F.col("first_rep") + F.col("i")).alias("rep")).agg(F.sum("v").alias("v"))
    seen = sums.where("rep = 0").select(*keys, F.abs("v").alias("_seen"))
    reached = F.count_if((F.col("rep") > 0) & (F.abs("v") >= F.col("_seen") - F.col("_scale") * 1e-12))
    share = sums.join(seen, keys).join(pool, keys).groupBy(*keys).agg(reached.alias("_hits"), F.first("_scale").alias("_scale"))
    p = F.when(F.col("_scale") > 0, (F.col("_hits") + 1) / (n_perm + 1.0)).otherwise(1.0)
    return pool.select(*keys).join(share.select(*keys, p.alias("p_value")), keys, "left").na.fill(1.0, ["p_value"])
