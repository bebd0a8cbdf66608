"""Participant positioning features, causal ranks, and the concurrent-tranche flow rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.costs import DEFAULT_COSTS, CostParams, net_pnl
from tickloom.functions.scalar import div
from tickloom.operators.reports import performance_report
from tickloom.operators.significance import one_sample_t, permutation_p, spearman_ic
from tickloom.session import cut_lineage
from tickloom.sources.tables import CLIENT_TYPES

NETS = ("net_index_future", "net_stock_future", "net_index_option_bias")
LOOKBACKS = (3, 5, 10, 20)
MIN_WINDOW = 60


def net_positioning(panel: DataFrame) -> DataFrame:
    """Wide table, one row per date, 3 net figures for each of the 4 participant types."""
    c = F.col
    net = panel.select(
        "date",
        F.lower("client_type").alias("client"),
        (c("future_index_long") - c("future_index_short")).alias(NETS[0]),
        (c("future_stock_long") - c("future_stock_short")).alias(NETS[1]),
        (
            (c("option_index_call_long") - c("option_index_put_long"))
            - (c("option_index_call_short") - c("option_index_put_short"))
        ).alias(NETS[2]),
    )
    return net.groupBy("date").pivot("client", [x.lower() for x in CLIENT_TYPES]).agg(
        *[F.first(n).alias(n) for n in NETS]
    )


def flow_features(wide: DataFrame, lookbacks: Sequence[int] = LOOKBACKS, columns: Sequence[str] | None = None) -> DataFrame:
    """Long (date, feature, value): change of every net column over each lookback, in rows of the panel's calendar.

    The unpivot puts `feature` in the window key, so 12 series are processed side by side.
    """
    cols = list(columns or [x for x in wide.columns if x != "date"])
    long = wide.unpivot("date", cols, "source", "level")
    w = Window.partitionBy("source").orderBy("date")
    diffs = [
        F.struct(
            F.concat(F.col("source"), F.lit(f"_diff{k}")).alias("feature"),
            (F.col("level") - F.lag("level", k).over(w)).alias("value"),
        )
        for k in lookbacks
    ]
    return long.withColumn("_d", F.array(*diffs)).select("date", F.inline("_d"))


def rolling_rank(df: DataFrame, keys: Sequence[str], order: str, value: str, window: int, out: str) -> DataFrame:
    """Share of the last `window` values (current included) that are <= the current one; NULL until full.

    The frame is an array of `window` numbers per row, inside one task's sorted run; meant for windows of a few
    hundred rows.
    """
    if window < MIN_WINDOW:
        raise ValueError(f"window must be at least {MIN_WINDOW}")
    f = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), 0)
    d = df.withColumn("_a", F.collect_list(value).over(f))
    share = F.size(F.filter("_a", lambda v: v <= F.col(value))) / float(window)
    return d.withColumn(out, F.when(F.size("_a") == window, share)).drop("_a")


def concurrent_trades(
    prices: DataFrame,
    keys: Sequence[str],
    entry_ok: Column | str,
    hold: Column | int = 5,
    holds: Sequence[int] = (5,),
    max_positions: int = 5,
    capital: float = 1_000_000.0,
    costs: CostParams = DEFAULT_COSTS,
    count_on_entry_day: bool = False,
    grid: Column | None = None,
    candidate: Column | None = None,
) -> DataFrame:
    """Long trades: in at the close after the signal row, out `hold` rows later, at most `max_positions` at once.

    A signal is taken if fewer than `max_positions` signals were taken in the `hold` rows before it, which is all
    the state there is. Signals further apart than `hold` rows cannot affect each other, so each run of signals is
    folded on its own; the fold reads only signal rows and looks back exactly `max_positions` taken signals.
    With `count_on_entry_day` capacity is counted on the execution day, as a daily stepping account does, so a
    position that closes that day has already freed its slot: the look-back is one row shorter.

    A `grid` (array of structs) makes each of its points a key: the price rows are scanned once, and only rows that are a
    `candidate` at some point are exploded.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("date")
    hold = F.lit(hold) if isinstance(hold, int) else hold
    exits = {f"_x{h}": F.lead(F.struct("date", "close"), 1 + h).over(w) for h in holds}
    d = prices.withColumns({"idx": F.row_number().over(w) - 1, "_e": F.lead(F.struct("date", "close"), 1).over(w)} | exits)
    out = F.lit(None)
    for h in holds:
        out = F.when(hold == h, F.col(f"_x{h}")).otherwise(out)
    ok = F.coalesce(F.col(entry_ok) if isinstance(entry_ok, str) else entry_ok, F.lit(False))
    if grid is not None:
        d = (d if candidate is None else d.filter(candidate)).select("*", F.inline(grid))
        keys += [c for c in d.columns if c not in prices.columns and c not in ("idx", "_e", *exits)]
        w = Window.partitionBy(*keys).orderBy("date")
    d = d.filter(ok).withColumns({"_hold": hold, "_x": out})
    far = F.coalesce(F.col("idx") - F.lag("idx").over(w) > F.col("_hold"), F.lit(True))
    d = d.withColumn("_run", F.sum(far.cast("int")).over(w))
    signal = F.struct("idx", F.col("date").alias("signal_date"), F.col("_e").alias("e"), F.col("_x").alias("x"))
    runs = d.groupBy(*keys, "_run").agg(
        F.array_sort(F.collect_list(signal)).alias("s"), F.first("_hold").alias("_hold")
    )

    early = int(count_on_entry_day)

    def take(acc, x):
        free = F.coalesce(F.get(acc, F.size(acc) - max_positions)["idx"] < x["idx"] - F.col("_hold") + early, F.lit(True))
        return F.when(free, F.concat(acc, F.array(x))).otherwise(acc)

    taken = runs.withColumn("t", F.aggregate("s", F.slice("s", 1, 0), take)).select(*keys, F.inline("t"))
    notional = capital / max_positions
    t = taken.filter(F.col("e").isNotNull() & F.col("x").isNotNull()).select(
        *keys,
        "signal_date",
        F.col("e.date").alias("entry_date"),
        F.col("x.date").alias("exit_date"),
        F.col("e.close").alias("entry_price"),
        F.col("x.close").alias("exit_price"),
    )
    qty = F.when(F.col("entry_price") > 0, F.lit(notional) / F.col("entry_price")).otherwise(0.0)
    t = t.withColumn("quantity", qty).withColumn("pnl", net_pnl("entry_price", "exit_price", "quantity", "BUY", True, costs))
    return t.withColumns(
        {
            "pnl_pct": F.coalesce(div("pnl", F.col("entry_price") * F.col("quantity")), F.lit(0.0)),
            "confidence": F.lit(1.0),
        }
    )


def flow_signals(
    prices: DataFrame, wide: DataFrame, column: str, lookback: int = 5, window: int = 252, max_hold: int = 5
) -> DataFrame:
    """Price rows with the causal rank of the flow change, ranked on the panel's own calendar and looked up by date.

    Instruments with too few rows for one warm-up and one trade drop out.
    """
    feat = flow_features(wide, (lookback,), (column,))
    rank = rolling_rank(feat, ["feature"], "date", "value", window, "rank").select("date", "rank")
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    enough = prices.select("symbol", "date", "close").dropna().withColumn("_n", n)
    return enough.filter(F.col("_n") >= window + max_hold + 2).drop("_n").join(rank, "date", "left")


def flow_trades(
    prices: DataFrame,
    wide: DataFrame,
    column: str = "dii_net_index_future",
    lookback: int = 5,
    window: int = 252,
    thresholds: Sequence[float] = (0.8,),
    holds: Sequence[int] = (5,),
    max_positions: int = 5,
    capital: float = 1_000_000.0,
    start_row: int | None = None,
    start_date=None,
    costs: CostParams = DEFAULT_COSTS,
) -> DataFrame:
    """Trades of the flow rule for every (symbol, threshold, hold) in one pass; the rank is computed once."""
    s = flow_signals(prices, wide, column, lookback, window, max(holds))
    if start_row is not None:
        w = Window.partitionBy("symbol").orderBy("date")
        s = s.withColumn("_i", F.row_number().over(w) - 1).filter(F.col("_i") >= start_row).drop("_i")
    if start_date is not None:
        s = s.filter(F.col("date") >= F.lit(start_date))
    grid = F.array(
        *[
            F.struct(F.lit(float(q)).alias("quantile_threshold"), F.lit(h).alias("hold_days"))
            for q in thresholds
            for h in holds
        ]
    )
    return concurrent_trades(
        s, ["symbol"], F.col("rank") >= F.col("quantile_threshold"), F.col("hold_days"), holds, max_positions, capital, costs,
        grid=grid, candidate=F.col("rank") >= float(min(thresholds)),
    )


def split_by_order(trades: DataFrame, keys: Sequence[str], train_frac: float = 0.7) -> DataFrame:
    """`split`: the first int(n * frac) trades by exit date are train. One instrument's trades are calendar-sized."""
    w = Window.partitionBy(*keys)
    pos = F.row_number().over(w.orderBy("exit_date", "entry_date"))
    n = F.count(F.lit(1)).over(w)
    return trades.withColumn("split", F.when(pos <= F.floor(n * F.lit(train_frac)), "train").otherwise("oos"))


_KEYS = ["symbol", "quantile_threshold", "hold_days"]


def flow_backtest(prices: DataFrame, wide: DataFrame, capital: float = 1_000_000.0, train_frac: float = 0.7, **rule) -> DataFrame:
    t = split_by_order(flow_trades(prices, wide, capital=capital, **rule), _KEYS, train_frac)
    return performance_report(cut_lineage(t), [*_KEYS, "split"], "exit_date", ["entry_date"], capital, event_time_sharpe=True)


def flow_parameter_grid(
    prices: DataFrame,
    wide: DataFrame,
    thresholds: Sequence[float] = (0.70, 0.75, 0.80, 0.85, 0.90),
    holds: Sequence[int] = (3, 5, 10, 20),
    **rule,
) -> DataFrame:
    rep = flow_backtest(prices, wide, thresholds=thresholds, holds=holds, **rule).filter(F.col("split") == "oos")
    return rep.select(
        *_KEYS,
        F.col("total_trades").alias("oos_n_trades"),
        F.col("sharpe_ratio").alias("oos_sharpe"),
        F.col("win_rate").alias("oos_win_rate"),
        F.col("avg_trade_return_pct").alias("oos_avg_trade_return_pct"),
        (F.col("sharpe_ratio") > 0).alias("oos_positive_sharpe"),
    )


def flow_significance(prices: DataFrame, wide: DataFrame, **rule) -> DataFrame:
    """t-test of the out-of-sample trade returns per symbol."""
    t = split_by_order(flow_trades(prices, wide, **rule), _KEYS).filter(F.col("split") == "oos")
    return one_sample_t(t, ["symbol"], "pnl_pct")


def labelled_flow(prices: DataFrame, wide: DataFrame, hold: int = 5, lookbacks: Sequence[int] = LOOKBACKS) -> DataFrame:
    """(symbol, date, row, n_rows, feature, value, label): features of the panel on each instrument's own calendar."""
    w = Window.partitionBy("symbol").orderBy("date")
    lab = div(F.lead("close", 1 + hold).over(w), F.lead("close", 1).over(w)) - 1
    p = prices.select("symbol", "date", "close").dropna().withColumns(
        {"label": lab, "row": F.row_number().over(w) - 1, "n_rows": F.count(F.lit(1)).over(Window.partitionBy("symbol"))}
    )
    return p.drop("close").join(flow_features(wide, lookbacks), "date")


def _segments(d: DataFrame) -> DataFrame:
    half = F.floor(F.col("n_rows") / 2)
    seg = F.array(F.lit("full"), F.when(F.col("row") < half, "first_half").otherwise("second_half"))
    return d.filter(F.col("value").isNotNull() & F.col("label").isNotNull()).withColumn("segment", F.explode(seg))


def flow_ic(prices: DataFrame, wide: DataFrame, hold: int = 5, lookbacks: Sequence[int] = LOOKBACKS) -> DataFrame:
    """Rank correlation of every flow feature with the tradable forward return, whole span and halves."""
    return spearman_ic(_segments(labelled_flow(prices, wide, hold, lookbacks)), ["symbol", "feature", "segment"], "value", "label")


def ic_scan(
    prices: DataFrame, wide: DataFrame, hold: int = 5, lookbacks: Sequence[int] = LOOKBACKS, alpha: float = 0.05, n_perm: int = 1000
) -> DataFrame:
    """IC and block-permutation p per feature over the full span and both halves, with the Bonferroni verdict."""
    keys = ["symbol", "feature", "segment"]
    segs = cut_lineage(_segments(labelled_flow(prices, wide, hold, lookbacks)))
    ic = spearman_ic(segs, keys, "value", "label")
    p = permutation_p(segs, keys, "date", "value", "label", n_perm, hold).drop("n")
    both = ic.join(p, keys)

    def of(seg, col):
        return F.max(F.when(F.col("segment") == seg, F.col(col)))

    out = both.groupBy("symbol", "feature").agg(
        of("full", "ic").alias("ic_full"),
        of("full", "p_value").alias("p_full"),
        F.coalesce(of("first_half", "ic"), F.lit(0.0)).alias("ic_first_half"),
        of("first_half", "p_value").alias("p_first_half"),
        F.coalesce(of("second_half", "ic"), F.lit(0.0)).alias("ic_second_half"),
        of("second_half", "p_value").alias("p_second_half"),
        of("full", "n").alias("_n"),
        of("first_half", "n").alias("_n1"),
        of("second_half", "n").alias("_n2"),
    )
    out = out.filter((F.col("_n") >= 30) & (F.col("_n1") >= 15) & (F.col("_n2") >= 15) & F.col("ic_full").isNotNull())
    corrected = alpha / F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    same_sign = F.col("ic_first_half") * F.col("ic_second_half") > 0
    return (
        out.drop("_n", "_n1", "_n2")
        .withColumn("corrected_alpha", corrected)
        .withColumn(
            "passes_bonferroni_both_halves",
            (F.col("p_full") <= F.col("corrected_alpha"))
            & same_sign
            & (F.col("p_first_half") < alpha)
            & (F.col("p_second_half") < alpha),
        )
    )


def compare_to_benchmark(model: DataFrame, bench: DataFrame, on: Sequence[str]) -> DataFrame:
    """Adoption gate: a model must have the higher Sharpe and be at least as significant as the rule.

    An instrument that only one of them trades has a row too, and the model is not adopted for it.

    Both inputs carry sharpe_ratio and p_value of their out-of-sample trades.
    """
    m = model.select(*on, F.col("sharpe_ratio").alias("model_oos_sharpe"), F.col("p_value").alias("model_p_value"))
    b = bench.select(*on, F.col("sharpe_ratio").alias("benchmark_oos_sharpe"), F.col("p_value").alias("benchmark_p_value"))
    better = F.coalesce(F.col("model_oos_sharpe") > F.col("benchmark_oos_sharpe"), F.lit(False))
    sig = F.coalesce(F.col("model_p_value") <= F.col("benchmark_p_value"), F.lit(False))
    return m.join(b, list(on), "full").withColumns(
        {
            "beats_sharpe": better,
            "beats_significance": sig,
            "verdict": F.when(better & sig, "beats_benchmark").otherwise("does_not_beat_benchmark"),
        }
    )
