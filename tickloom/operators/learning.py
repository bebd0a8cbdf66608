"""Model-facing data operators and distributed training on Spark ML.

The only values that reach the driver are fold cut-off dates, row counts and fitted models.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from tickloom.functions.costs import DEFAULT_COSTS, CostParams, net_pnl
from tickloom.functions.scalar import div, is_frozen, round_to_tick
from tickloom.operators.flow import LOOKBACKS, compare_to_benchmark, concurrent_trades, flow_trades
from tickloom.operators.genes import Evolver, apply_genes
from tickloom.operators.reports import performance_report, pooled_report
from tickloom.operators.significance import one_sample_t
from tickloom.session import cut_lineage


def date_cuts(df: DataFrame, fractions: Sequence[float], date: str = "date") -> list:
    """Dates at which the sorted distinct dates reach int(n * fraction). The calendar is one row per date."""
    days = df.select(date).distinct()
    n = days.count()
    at = [int(n * f) for f in fractions]
    rn = F.row_number().over(Window.orderBy(date)) - 1
    rows = days.withColumn("_i", rn).filter(F.col("_i").isin(at)).collect()
    by = {r["_i"]: r[date] for r in rows}
    return [by.get(i) for i in at]


def with_split(df: DataFrame, cuts: Sequence[float] = (0.8, 0.85, 0.9), date: str = "date") -> DataFrame:
    """`split` by date quantile: train, es (early stopping), meta (for models over models), oos (traded, never fitted)."""
    a, b, c = date_cuts(df, cuts, date)
    day = F.col(date)
    split = F.when(day < F.lit(a), "train").when(day < F.lit(b), "es").when(day < F.lit(c), "meta").otherwise("oos")
    return df.withColumn("split", split)


def scaling_stages(cols: Sequence[str]) -> list:
    return [
        VectorAssembler(inputCols=list(cols), outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
    ]


def fill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing columns and missing values become 0 (columns the model knows but this frame lacks included)."""
    absent = {c: F.lit(0.0) for c in cols if c not in df.columns}
    df = df.withColumns(absent) if absent else df
    return df.na.fill(0.0, list(cols))


def class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """n / (2 * class count) as `weight`; the two counts come from one small aggregate."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    total = F.sum("_c").over(Window.partitionBy(F.lit(0)))
    return df.join(counts.withColumn("weight", total / (F.col("_c") * 2.0)).drop("_c"), label)


# Fixed defaults of the boosted model: rounds at most, depth, step.
ROUNDS, DEPTH, STEP = 500, 5, 0.02


def gbt(max_iter: int = ROUNDS, max_depth: int = DEPTH, step: float = STEP, seed: int = 42, tolerance: float = 0.0) -> GBTClassifier:
    """Boosted trees that stop at the first round in which the held rows' error does not fall by `tolerance` of itself."""
    return GBTClassifier(
        labelCol="label", featuresCol="features", weightCol="weight", maxIter=max_iter, maxDepth=max_depth, stepSize=step, seed=seed, validationTol=tolerance
    )


def hold_out(train: DataFrame, share: float = 0.15, date: str = "date") -> tuple[DataFrame, DataFrame]:
    """Earlier and later rows: the last `share` of the dates decide when boosting stops."""
    (cut,) = date_cuts(train, [1 - share], date)
    return train.filter(F.col(date) < F.lit(cut)), train.filter(F.col(date) >= F.lit(cut))


def fit_stopping(train: DataFrame, cols: Sequence[str], estimator=None) -> PipelineModel:
    """Fitted on the earlier rows, stopped by the later ones; all rows are used where the estimator does not stop early."""
    est = estimator or gbt()
    if not est.hasParam("validationIndicatorCol"):
        return fit_classifier(train, cols, est)
    early, late = hold_out(train.filter(F.col("label").isNotNull()))
    return fit_classifier(early, cols, est, late)


#: Rows below which a further task costs more than it saves: a round of boosting is about 14 stages.
ROWS_A_TASK = 20_000


def few_tasks(data: DataFrame) -> DataFrame:
    """Small partitions merged, one for every ROWS_A_TASK rows; all rows stay, and large partitions stay as they are."""
    return data.coalesce(max(1, -(-data.count() // ROWS_A_TASK)))


def fit_classifier(train: DataFrame, cols: Sequence[str], estimator=None, early_stop: DataFrame | None = None) -> PipelineModel:
    """Scaling fitted on `train` alone, then the estimator; boosted trees stop when `early_stop` rows no longer improve."""
    ready = lambda d: fill(d.filter(F.col("label").isNotNull()), cols).withColumn("label", F.col("label").cast("double"))
    data, est = class_weight(ready(train)), estimator or gbt()
    scaling = Pipeline(stages=scaling_stages(cols)).fit(data)
    data = scaling.transform(data).select("label", "weight", "features")
    if early_stop is not None and est.hasParam("validationIndicatorCol"):
        held = scaling.transform(ready(early_stop)).select("label", F.lit(1.0).alias("weight"), "features")
        data = data.withColumn("_held", F.lit(False)).unionByName(held.withColumn("_held", F.lit(True)))
        est = est.copy({est.getParam("validationIndicatorCol"): "_held"})
    return PipelineModel([*scaling.stages, est.fit(few_tasks(data))])


def fit_split(rows: DataFrame, cols: Sequence[str], estimator=None) -> PipelineModel:
    """Train on the train rows of `with_split`, stop early on its es rows."""
    part = lambda name: rows.filter(F.col("split") == name)
    return fit_classifier(part("train"), cols, estimator, part("es"))


def score(model, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Adds `p_up`, the probability of an up move."""
    out = model.transform(fill(df, cols)).withColumn("p_up", vector_to_array("probability")[1])
    return out.drop("_raw", "features", "rawPrediction", "probability", "prediction")


def classification_metrics(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy and class-weighted precision, recall and F1 from one aggregate of the confusion counts."""
    pred = (F.col("p_up") >= 0.5).cast("int")
    y = F.col("label").cast("int")
    c = {f"_{a}{b}": F.count_if((y == a) & (pred == b)).cast("double") for a in (0, 1) for b in (0, 1)}
    d = scored.filter(y.isNotNull()).groupBy(*keys).agg(*[v.alias(k) for k, v in c.items()])
    n = F.col("_00") + F.col("_01") + F.col("_10") + F.col("_11")

    def cls(tp, fp, fn):
        p = F.coalesce(div(F.col(tp), F.col(tp) + F.col(fp)), F.lit(0.0))
        r = F.coalesce(div(F.col(tp), F.col(tp) + F.col(fn)), F.lit(0.0))
        return p, r, F.coalesce(div(p * r * 2, p + r), F.lit(0.0)), F.col(tp) + F.col(fn)

    zero, one = cls("_00", "_10", "_01"), cls("_11", "_01", "_10")
    mean = lambda i: (zero[i] * zero[3] + one[i] * one[3]) / n
    return d.select(
        *keys, n.cast("long").alias("n"), ((F.col("_00") + F.col("_11")) / n).alias("accuracy"),
        mean(0).alias("precision"), mean(1).alias("recall"), mean(2).alias("f1"),
    )


def feature_importance(model, cols: Sequence[str], spark) -> DataFrame:
    imp = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(c, float(v)) for c, v in zip(cols, imp)], "feature string, importance double").orderBy(F.desc("importance"))


def oos_trades(
    scored: DataFrame, delivery: bool, min_threshold: float = 0.60, capital: float = 1_000_000.0, max_position_pct: float = 0.10,
    costs: CostParams = DEFAULT_COSTS, prev_close: str | None = None,
) -> DataFrame:
    """Trades of confident predictions, net of costs, in one projection.

    Intraday (`prev_close` given): tick-rounded prices, and nothing is traded at or beyond a circuit limit.
    """
    up = F.col("p_up") > 0.5
    d = scored.withColumns(
        {"confidence": F.greatest("p_up", 1 - F.col("p_up")), "action": F.when(up, "BUY").otherwise("SELL"), "entry_price": F.col("close")}
    ).filter((F.col("confidence") >= min_threshold) & F.col("future_return").isNotNull() & (F.col("close") > 0))
    if prev_close:
        d = d.withColumn("entry_price", round_to_tick("entry_price"))
    d = d.withColumn("exit_price", F.col("entry_price") * (1 + F.col("future_return")))
    if prev_close:
        d = d.withColumn("exit_price", round_to_tick("exit_price"))
        d = d.filter(~(is_frozen(prev_close, "entry_price") | is_frozen(prev_close, "exit_price")) & (F.col("entry_price") > 0))
    notional = min(max_position_pct * capital, capital)
    d = d.withColumn("quantity", F.floor(F.lit(notional) / F.col("entry_price"))).filter(F.col("quantity") > 0)
    d = d.withColumn("pnl", net_pnl("entry_price", "exit_price", "quantity", F.col("action"), delivery, costs))
    return d.withColumn("pnl_pct", F.col("pnl") / (F.col("entry_price") * F.col("quantity")))


#: Folds whose jobs run side by side, as the parallelism of Spark ML's cross-validator.
FOLDS_AT_ONCE = 6


def each_fold(spark, work: Callable, folds: Sequence) -> list:
    """`work` of every fold, in the order of the folds. A round of boosting or of a search is a chain of small jobs that leaves
    most cores idle, so the folds, which need nothing of each other, share them."""
    with ThreadPool(max(1, min(FOLDS_AT_ONCE, len(folds)))) as pool:
        return pool.map(inheritable_thread_target(spark)(work), folds, chunksize=1)


def time_series_cv(df: DataFrame, cols: Sequence[str], n_splits: int = 5, estimator=None) -> DataFrame:
    """Expanding-window validation over date boundaries: one fit per fold, metrics per fold."""
    cuts = date_cuts(df, [i / (n_splits + 1) for i in range(1, n_splits + 1)])

    def fold(i: int) -> DataFrame:
        start, end = cuts[i], cuts[i + 1] if i + 1 < len(cuts) else None
        test = df.filter((F.col("date") >= F.lit(start)) & (F.lit(True) if end is None else F.col("date") < F.lit(end)))
        model = fit_stopping(df.filter(F.col("date") < F.lit(start)), cols, estimator)
        return classification_metrics(score(model, test, cols)).withColumn("fold", F.lit(i))

    return reduce(DataFrame.unionByName, each_fold(df.sparkSession, fold, range(len(cuts))))


def regime_models(train: DataFrame, cols: Sequence[str], min_rows: int = 100, estimator=None) -> dict:
    """One classifier per regime that has enough labelled rows; regimes are a handful of names."""
    labelled = train.filter(F.col("label").isNotNull())
    counts = {r["regime"]: r["n"] for r in labelled.groupBy("regime").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {
        r: fit_stopping(labelled.filter(F.col("regime") == r), cols, estimator) for r, n in sorted(counts.items()) if n >= min_rows
    }


def walk_forward(
    df: DataFrame, cols: Sequence[str], n_windows: int = 6, estimator=None, delivery: bool = True,
    score_oos: Callable[[DataFrame], DataFrame] | None = None, capital: float = 1_000_000.0,
) -> DataFrame:
    """Report per fold: train on all dates before the window, trade the window."""
    cuts = date_cuts(df, [i / (n_windows + 1) for i in range(1, n_windows + 1)])

    def fold(i: int) -> DataFrame:
        test = df.filter(F.col("date") >= F.lit(cuts[i]))
        if i + 1 < len(cuts):
            test = test.filter(F.col("date") < F.lit(cuts[i + 1]))
        model = fit_stopping(df.filter(F.col("date") < F.lit(cuts[i])), cols, estimator)
        scored = score(model, test, cols)
        t = (score_oos or (lambda s: oos_trades(s, delivery, capital=capital)))(scored)
        return t.select("symbol", "date", "pnl", "pnl_pct", "confidence").withColumn("fold", F.lit(i))

    out = reduce(DataFrame.unionByName, each_fold(df.sparkSession, fold, range(len(cuts))))
    return performance_report(cut_lineage(out), ["fold"], "date", ["symbol"], capital)


def fold_summary(reports: DataFrame, cols=("sharpe_ratio", "win_rate", "expectancy", "max_drawdown_pct")) -> DataFrame:
    """Mean and population deviation of the fold reports."""
    return reports.agg(
        F.count(F.lit(1)).alias("n_folds"),
        *[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_pop))],
    )


# --------------------------------------------------------------------------------------------------
# Flow classifiers

MIN_TRAIN_DAYS = 252


def flow_model_frame(prices: DataFrame, wide: DataFrame, hold: int = 5, lookbacks: Sequence[int] = LOOKBACKS) -> tuple[DataFrame, list[str]]:
    """One row per (symbol, date) with every flow change as a column and the tradable forward return."""
    w = Window.orderBy("date")  # the panel: one row per date
    nets = [x for x in wide.columns if x != "date"]
    cols = [f"{c}_diff{k}" for c in nets for k in lookbacks]
    panel = wide.select("date", *[(F.col(c) - F.lag(c, k).over(w)).alias(f"{c}_diff{k}") for c in nets for k in lookbacks])
    s = Window.partitionBy("symbol").orderBy("date")
    ret = div(F.lead("close", 1 + hold).over(s), F.lead("close", 1).over(s)) - 1
    rows = prices.select("symbol", "date", "close").dropna().withColumn("future_return", ret)
    return rows.join(panel, "date", "left"), cols


class FlowRun(NamedTuple):
    """A nested walk-forward run: its trades, the rule's over the same days, the recipes each fold trusted, and its folds."""

    trades: DataFrame
    rule_trades: DataFrame
    recipes: DataFrame
    folds: DataFrame


_RECIPES = "fold int, gene string, op string, a string, b string, validation_ic double, p_value double"
_FOLDS = "fold int, start_date date, end_date date, n_train long, n_genes int, threshold double, n_signals long"


def flow_ml_run(
    prices: DataFrame, wide: DataFrame, n_folds: int = 3, hold: int = 5, max_positions: int = 5, quantile: float = 0.8,
    capital: float = 1_000_000.0, evolver: Evolver | None = None, classifier=None, inner_val: float = 0.25, c_inverse_reg: float = 0.1,
    n_permutations: int = 1000,
) -> FlowRun:
    """Nested walk-forward classifier, pooled over the given instruments, and the flow rule on the same window.

    Folds are equal ranges of the longest instrument's calendar after the warm-up. A fold's model, genes and decision threshold use
    earlier rows only; the threshold is the exact quantile over all training rows.
    """
    spark = prices.sparkSession
    df, cols = flow_model_frame(prices, wide, hold)
    df = cut_lineage(df)
    longest = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "symbol").limit(1)
    reference = df.join(longest, "symbol", "left_semi").select("date").orderBy("date")
    days = [r["date"] for r in reference.collect()]  # fold cut-offs: the calendar of the longest instrument
    start = max(MIN_TRAIN_DAYS, max(LOOKBACKS) + 30)
    span = len(days) - start
    if span < n_folds * 20:
        raise ValueError(f"{span} eligible days, need {n_folds * 20}")
    bounds = [start + span * i // n_folds for i in range(n_folds + 1)]

    def fold(i: int) -> tuple[list, tuple, DataFrame | None]:
        """The recipes the fold trusted, its row of the fold table, and its entries."""
        a, b = days[bounds[i]], days[bounds[i + 1]] if bounds[i + 1] < len(days) else None
        train = df.filter((F.col("date") < F.lit(a)) & F.col("future_return").isNotNull())
        test = df.filter((F.col("date") >= F.lit(a)) & (F.lit(True) if b is None else F.col("date") < F.lit(b)))
        found = []
        if evolver:
            cut = int(bounds[i] * (1 - inner_val))
            inner = train.filter(F.col("date") < F.lit(days[max(cut - hold, 0)]))  # embargo of one holding period
            val = train.filter(F.col("date") >= F.lit(days[cut]))
            search = replace(evolver, seed=evolver.seed + i)  # every fold searches anew
            found = search.validated(inner, val, cols, n_permutations=n_permutations, block_size=hold)
        genes = [g for g, _, _ in found]
        recipes = [(i, g.label, g.op, *(*g.sources, None)[:2], float(ic), float(p)) for g, ic, p in found]
        names = [*cols, *[g.label for g in genes]]
        train = apply_genes(train, genes).withColumn("label", (F.col("future_return") > 0).cast("double"))
        n, ups = train.agg(F.count(F.lit(1)), F.sum("label")).first()
        if not n or ups in (0, n):
            return recipes, (i, a, b, n, len(genes), None, 0), None  # one class only
        clf = classifier or LogisticRegression(
            labelCol="label", featuresCol="features", weightCol="weight", elasticNetParam=1.0, regParam=1.0 / (c_inverse_reg * n), standardization=False, maxIter=30
        )
        model = fit_classifier(train, names, clf)
        threshold = score(model, train, names).select(F.percentile("p_up", F.lit(quantile))).first()[0]
        scored = score(model, apply_genes(test, genes), names)
        e = cut_lineage(scored.select("symbol", "date", (F.col("p_up") >= threshold).alias("enter")))
        return recipes, (i, a, b, n, len(genes), threshold, e.where("enter").count()), e

    done = each_fold(spark, fold, range(n_folds))
    recipes, folds = [r for f in done for r in f[0]], [f[1] for f in done]
    parts = [f[2] for f in done if f[2] is not None]
    base = df.select("symbol", "date", "close")
    none = base.limit(0).select("symbol", "date", F.lit(False).alias("enter"))  # every fold may have had one class only
    signals = base.join(reduce(DataFrame.unionByName, parts, none), ["symbol", "date"], "left")
    trades = cut_lineage(concurrent_trades(signals, ["symbol"], "enter", hold, (hold,), max_positions, capital))
    rule = cut_lineage(flow_trades(prices, wide, holds=(hold,), thresholds=(quantile,), max_positions=max_positions, capital=capital, start_date=days[start]))
    return FlowRun(trades, rule, spark.createDataFrame(recipes, _RECIPES), spark.createDataFrame(folds, _FOLDS))


def flow_comparison(run: FlowRun, capital: float = 1_000_000.0) -> DataFrame:
    """Per symbol the model's report, the rule's report and the adoption verdict."""

    def tested(t: DataFrame) -> DataFrame:
        rep = performance_report(t, ["symbol"], "exit_date", ["entry_date"], capital, event_time_sharpe=True)
        return rep.join(one_sample_t(t, ["symbol"], "pnl_pct").select("symbol", "p_value"), "symbol")

    model_rep = tested(run.trades)
    verdict = compare_to_benchmark(model_rep, tested(run.rule_trades), ["symbol"])
    return verdict.join(model_rep.select("symbol", "total_trades", "win_rate", "avg_trade_return_pct"), "symbol", "left")


def pooled_comparison(trades: DataFrame, rule_trades: DataFrame) -> DataFrame:
    """One row: all instruments' model trades as one account against all rule trades, with the adoption verdict."""
    one = lambda t: t.withColumn("portfolio", F.lit("all"))

    def tested(t: DataFrame) -> DataFrame:
        return pooled_report(one(t), ["portfolio"]).join(one_sample_t(one(t), ["portfolio"], "pnl_pct").select("portfolio", "p_value"), "portfolio")

    a, b = tested(trades), tested(rule_trades)
    out = compare_to_benchmark(a, b, ["portfolio"])
    counts = lambda d, p: d.select("portfolio", *[F.col(c).alias(f"{p}_{c}") for c in ("total_trades", "avg_trade_return_pct", "trades_per_year")])
    return out.join(counts(a, "model"), "portfolio", "left").join(counts(b, "benchmark"), "portfolio", "left")


def feature_recurrence(chosen: DataFrame, keys: Sequence[str] = (), fold: str = "fold", feature: str = "feature") -> DataFrame:
    """In how many folds a feature was chosen, and whether it recurs: a real signal does not appear once and vanish."""
    once = chosen.where(F.col(feature).isNotNull()).select(*keys, fold, feature).distinct()
    n = F.count(F.lit(1))
    return once.groupBy(*keys, feature).agg(n.alias("n_folds"), F.array_sort(F.collect_list(fold)).alias("folds"), (n >= 2).alias("recurring"))


def recipe_features(recipes: DataFrame) -> DataFrame:
    """(fold, feature): the raw columns of the recipes that a fold trusted."""
    return recipes.select("fold", F.explode(F.array("a", "b")).alias("feature")).where("feature IS NOT NULL")


def flow_ml_backtest(prices: DataFrame, wide: DataFrame, capital: float = 1_000_000.0, **options) -> DataFrame:
    """The comparison per symbol of a run with these options of `flow_ml_run`."""
    return flow_comparison(flow_ml_run(prices, wide, capital=capital, **options), capital)


# --------------------------------------------------------------------------------------------------
# Ensembles and the listing-return model

CLASSICAL, OTHER = ("lstm", "xgboost"), ("qkernel", "vqc")


def ensemble_weights(df: DataFrame, models: Sequence[str], label: str = "label", classical: float = 0.6) -> DataFrame:
    """(model, weight): accuracy floored at 0.1, shared out inside each model group by the group's fixed weight."""
    acc = [
        F.struct(F.lit(m).alias("model"), F.avg(((F.col(m) > 0.5).cast("int") == F.col(label)).cast("double")).alias("acc")) for m in models
    ]
    d = df.agg(F.array(*acc).alias("a")).select(F.inline("a")).withColumn("acc", F.greatest("acc", F.lit(0.1)))
    group = F.when(F.col("model").isin(*CLASSICAL), classical).otherwise(1 - classical)
    return d.select("model", (F.col("acc") / F.sum("acc").over(Window.partitionBy(group)) * group).alias("weight"))


def combine(df: DataFrame, models: Sequence[str], weights: dict[str, float] | None = None) -> dict[str, Column]:
    """Ensemble probabilities of an up move: weighted average, vote share and plain mean of the sub-models."""
    n = float(len(models))
    weights = weights or {m: 1.0 / n for m in models}
    total = sum(weights.values())
    weighted = sum((F.col(m) * weights[m] for m in models), F.lit(0.0)) / total
    votes = sum(((F.col(m) > 0.5).cast("double") for m in models), F.lit(0.0)) / n
    mean = sum((F.col(m) for m in models), F.lit(0.0)) / n
    return {"p_weighted": weighted, "p_vote": votes, "p_mean": mean, "signal_confidence": F.greatest(weighted, 1 - weighted)}


def linear(max_iter: int = 50, reg: float = 0.01) -> LogisticRegression:
    return LogisticRegression(labelCol="label", featuresCol="features", weightCol="weight", maxIter=max_iter, regParam=reg)


def score_table(rows: DataFrame, probabilities: dict[str, Column | str], key: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """One row per (row, model) with p_up, label and split: what ensembles are fitted on, stored once for all of them."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), (F.col(c) if isinstance(c, str) else c).alias("p_up")) for m, c in probabilities.items()]))
    return rows.select(*key, "split", "label", each.alias("_s")).select(*key, "split", "label", "_s.*")


def side_by_side(scores: DataFrame, models: Sequence[str], key: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """A score table with one column per model; a model that did not score a row counts as undecided."""
    wide = scores.groupBy(*key, "split", "label").agg(*[F.max(F.when(F.col("model") == m, F.col("p_up"))).alias(m) for m in models])
    return wide.na.fill(0.5, list(models))


class Ensemble(NamedTuple):
    """Weights per model from the early-stopping rows, a stacker fitted on the meta rows, and the traded rows' probabilities."""

    weights: DataFrame
    stacker: PipelineModel
    scored: DataFrame


def ensemble(scores: DataFrame, models: Sequence[str], key: Sequence[str] = ("symbol", "date")) -> Ensemble:
    """Every step reads rows that no earlier one has fitted: models on train, weights on es, stacker on meta, trades on oos."""
    wide = cut_lineage(side_by_side(scores, models, key))
    part = lambda name: wide.where((F.col("split") == name) & F.col("label").isNotNull())
    weights = cut_lineage(ensemble_weights(part("es"), models))
    shares = {r["model"]: r["weight"] for r in weights.collect()}  # one row per model
    stack = stacker(part("meta"), models)
    out = stack.transform(wide.where("split = 'oos'")).withColumn("p_stacked", vector_to_array("probability")[1])
    columns = combine(out, models, shares)
    kept = [*key, "split", "label", *models, "p_stacked"]
    return Ensemble(weights, stack, out.withColumns(columns).select(*kept, *columns))


def stacker(train: DataFrame, models: Sequence[str]):
    """Logistic regression on the sub-models' probabilities; a missing one counts as 0.5."""
    data = train.na.fill(0.5, list(models)).withColumn("label", F.col("label").cast("double"))
    return Pipeline(
        stages=[VectorAssembler(inputCols=list(models), outputCol="features"), LogisticRegression(labelCol="label", maxIter=50)]
    ).fit(data)


def listing_return_model(df: DataFrame, cols: Sequence[str], target: str, max_iter: int = 200) -> PipelineModel:
    return Pipeline(
        stages=[*scaling_stages(cols), GBTRegressor(labelCol=target, featuresCol="features", maxIter=max_iter, maxDepth=3, stepSize=0.05, subsamplingRate=0.8, seed=42)]
    ).fit(fill(df, cols))


def predict_listing_return(model, df: DataFrame, cols: Sequence[str], min_confidence: float = 0.65) -> DataFrame:
    """Prediction, confidence 1/(1 + spread of the residual trees' predictions) and an actionable flag.

    The first tree predicts the target itself and the later ones what is left of it, so it is no part of the spread.
    """
    out = model.transform(fill(df, cols)).withColumnRenamed("prediction", "predicted_return_pct")
    kept = out.columns
    trees = model.stages[-1].trees[1:]
    out = out.withColumns({"_s": F.lit(0.0), "_q": F.lit(0.0)})
    for tree in trees:
        out = tree.setPredictionCol("_t").transform(out)
        out = out.withColumns({"_s": F.col("_s") + F.col("_t"), "_q": F.col("_q") + F.col("_t") * F.col("_t")}).drop("_t")
    n = float(max(1, len(trees)))
    spread = F.sqrt(F.greatest(F.col("_q") / n - F.pow(F.col("_s") / n, 2), F.lit(0.0)))
    return out.select(*kept, (1.0 / (1.0 + spread)).alias("prediction_confidence")).drop("_raw", "features").withColumn(
        "actionable", F.col("prediction_confidence") >= min_confidence
    )
