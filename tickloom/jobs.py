"""The named jobs: each composes operators over the caller's tables and returns named result frames.

Inputs are DataFrames: `bars` (symbol, date, open, high, low, close, volume, turnover), `intraday` (the same with
session_date and a zone-free clock `date`), `index_bars`, `vix`, `benchmark` (date, close), `oi` (participant open
interest), `signals` (account decision rows), `days` (symbol, date, close, signal). Nothing runs until a result
is used, except where a job stores a table it reads several times.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.costs import CONFIGURED_COSTS, DEFAULT_COSTS, round_trip_cost_pct
from tickloom.artifacts import Store, score_by_regime
from tickloom.operators.genes import Evolver, apply_genes
from tickloom.operators import events, factors, features, flow, learning, orb, pairs, quality, regimes, reports, risk, savings, significance
from tickloom.session import cut_lineage
from tickloom.sources import files
from tickloom.streaming import stateful, trading

CAPITAL = 1_000_000.0
#: Smaller companies move against an order: 0.6 % of slippage a side.
MIDCAP_COSTS = replace(DEFAULT_COSTS, slippage_pct=0.006)
Frames = dict[str, DataFrame]


def dead_zone(floor: float = 0.01) -> float:
    """A move has to clear twice the delivery round trip before it is worth a label."""
    return max(2.0 * round_trip_cost_pct(p=CONFIGURED_COSTS), floor)


def model_rows(bars: DataFrame, periods: int = 10, session: str | None = None) -> tuple[DataFrame, list[str]]:
    df = features.feature_frame(bars)
    cols = [c for c in features.feature_columns(df) if c not in features.INTRADAY_COLUMNS]
    df = features.forward_labels(df, periods=periods, dead_zone=dead_zone(), session=session).dropna(subset=cols)
    return cut_lineage(df), cols


def swing_test(t: Frames) -> Frames:
    rows, cols = model_rows(t["bars"])
    rows = learning.with_split(rows)
    scored = cut_lineage(learning.score(learning.fit_split(rows, cols), rows, cols))
    trades = cut_lineage(learning.oos_trades(scored.filter("split = 'oos'"), delivery=True))
    return {
        "metrics": learning.classification_metrics(scored, ["split"]),
        "reports": reports.performance_report(trades, ["symbol"], "date", ["action"], CAPITAL),
    }


SUB_MODELS = ("xgboost", "linear", "regime")


def train(t: Frames, store: Store | None = None, evolver: Evolver | None = None) -> Frames:
    """General, linear and per-regime models, derived features, the ensemble over them, reports, and the allocation.

    Derived features are searched on train rows and tested on early-stopping rows. Regimes are labelled with thresholds
    of train rows. Each model scores the rows after train once, into one table, which the ensemble is fitted on. With a
    store all of it is published as one version.
    """
    rows, cols = model_rows(t["bars"])
    rows = learning.with_split(rows)
    part = lambda d, name: d.filter(F.col("split") == name)
    found = (evolver or Evolver(generations=3)).validated(part(rows, "train"), part(rows, "es"), cols, n_permutations=1000)
    recipes = [g for g, _, _ in found]
    rows = apply_genes(rows, recipes)
    rows = cut_lineage(regimes.label_regimes(rows, regimes.regime_thresholds(part(rows, "train"))))
    cols = [*cols, *[g.label for g in recipes]]
    models = {"general": learning.fit_split(rows, cols), "linear": learning.fit_split(rows, cols, learning.linear())}
    by_regime = learning.regime_models(part(rows, "train"), cols)
    later = rows.filter("split <> 'train'")
    scored = score_by_regime({"general": models["general"]} | by_regime, later, cols, learning.score)
    scored = cut_lineage(learning.score(models["linear"], scored.withColumnRenamed("p_up", "p_regime"), cols).withColumnRenamed("p_up", "p_linear"))
    scores = cut_lineage(learning.score_table(scored, {"xgboost": "p_general", "linear": "p_linear", "regime": "p_regime"}))
    voted = learning.ensemble(scores, SUB_MODELS)
    oos = part(scored, "oos").join(cut_lineage(voted.scored.select("symbol", "date", F.col("p_weighted").alias("p_up"))), ["symbol", "date"])
    trades = cut_lineage(learning.oos_trades(oos, delivery=True))
    out = {
        "recipes": t["bars"].sparkSession.createDataFrame([(g.label, g.op, *(*g.sources, None)[:2], float(ic), float(p)) for g, ic, p in found], "gene string, op string, a string, b string, ic double, p_value double"),
        "scores": scores,
        "weights": voted.weights,
        "metrics": learning.classification_metrics(scores, ["model", "split"]),
        "reports": reports.performance_report(trades, ["symbol"], "date", ["action"], CAPITAL),
    }
    out["allocation"] = cut_lineage(
        risk.allocate(
            out["reports"].select("symbol", "total_trades", "expectancy", "sharpe_ratio"),
            quality.liquidity_daily(t["bars"]),
            quality.listing_continuity(t["bars"]).filter("is_continuous"),
            CAPITAL,
        )
    )
    if store:
        kept = {k: out[k] for k in ("recipes", "weights", "allocation")}
        store.publish("swing", models | {f"regime:{r}": m for r, m in by_regime.items()} | {"stacker": voted.stacker}, kept, {"columns": cols})
    return out


def swing_walk_forward(t: Frames) -> Frames:
    rows, cols = model_rows(t["bars"])
    folds = cut_lineage(learning.walk_forward(rows, cols))
    return {"folds": folds, "summary": learning.fold_summary(folds)}


def intraday_baseline(t: Frames) -> Frames:
    """Session labels, intraday costs, prices on the tick, nothing traded at or beyond the previous session's circuit limits."""
    rows, cols = model_rows(t["intraday"], periods=1, session="session_date")
    rows = learning.with_split(rows)
    day = Window.partitionBy("symbol").orderBy("session_date")
    closes = t["intraday"].groupBy("symbol", "session_date").agg(F.max_by("close", "date").alias("_close"))
    closes = closes.select("symbol", "session_date", F.lag("_close").over(day).alias("prev_close"))
    scored = cut_lineage(learning.score(learning.fit_split(rows, cols), rows, cols))
    oos = scored.filter("split = 'oos'").join(closes, ["symbol", "session_date"])
    trades = cut_lineage(learning.oos_trades(oos, delivery=False, prev_close="prev_close"))
    return {
        "metrics": learning.classification_metrics(scored, ["split"]),
        "reports": reports.performance_report(trades, ["symbol"], "date", ["action"], CAPITAL),
    }


def regime_gated_test(t: Frames) -> Frames:
    rows, cols = model_rows(t["bars"])
    rows = learning.with_split(rows)
    oos = regimes.label_regimes(rows.filter("split = 'oos'"), regimes.regime_thresholds(rows.filter("split <> 'oos'")))
    model = learning.fit_split(rows, cols)
    scored = learning.score(model, oos.filter(F.col("regime").isin("bull_trend", "bear_trend")), cols)
    trades = cut_lineage(learning.oos_trades(scored, delivery=True))
    return {
        "reports": reports.performance_report(trades, ["regime"], "date", ["symbol"], CAPITAL),
        "by_symbol": reports.performance_report(trades, ["symbol"], "date", ["action"], CAPITAL),
    }


def pairs_trading_test(t: Frames, session: str = "session_date") -> Frames:
    bars = cut_lineage(t["intraday"])
    found = cut_lineage(pairs.cointegrated_pairs(pairs.train_slice(bars)))
    trades = cut_lineage(pairs.pair_trades(pairs.spread_scores(bars, found, session), session))
    return {"pairs": found, "reports": reports.performance_report(trades, ["symbol_a", "symbol_b"], "exit_date", ["entry_date"], CAPITAL)}


def event_drift_test(t: Frames) -> Frames:
    excess = cut_lineage(events.excess_returns(t["bars"], t["benchmark"]))
    trades = cut_lineage(events.event_trades(excess, capital=CAPITAL))
    keys = ["window", "direction"]
    return {
        "event_counts": events.event_counts(excess),
        "continuation": events.continuation_summary(trades, keys),
        "reports": reports.performance_report(trades, keys, "exit_date", ["symbol", "idx"], CAPITAL),
    }


def passive_benchmarks_test(t: Frames) -> Frames:
    bars = cut_lineage(t["bars"])
    return {"savings_plan": savings.plan_summary(bars), "factors": factors.factor_backtest(bars)}


def orb_test(t: Frames) -> Frames:
    return {"reports": orb.breakout_backtest(t["intraday"], CAPITAL)}


def _momentum_tests(periods: DataFrame, grid: DataFrame) -> Frames:
    p = cut_lineage(periods)
    a, b = (p.filter(F.col("strategy") == s) for s in ("momentum", "equal_weight_all"))
    keys = ["target_n", "lookback_days"]
    return {
        "paired": significance.paired_t(a, b, [*keys, "period"], keys, "net_return"),
        "bootstrap": significance.bootstrap_sharpe(p, factors.GRID, "date", "net_return"),
        "subperiods": significance.subperiods(p, factors.GRID, "date", "net_return"),
        "grid": factors.grid_verdicts(grid),
    }


def factor_stress_test(t: Frames) -> Frames:
    bars = cut_lineage(t["bars"])
    grid = factors.factor_backtest(bars, target_ns=(3, 6, 9), lookbacks=(63, 126, 189, 252))
    return _momentum_tests(factors.factor_periods(bars), grid)


def liquid_bars(bars: DataFrame, floor_cr: float = 10.0) -> DataFrame:
    keep = quality.liquidity_daily(bars, floor_cr).filter("liquid")
    return cut_lineage(bars.join(keep, "symbol", "left_semi"))


def midcap_momentum_test(t: Frames) -> Frames:
    return {"summary": factors.staggered_backtest(liquid_bars(t["bars"]), costs=MIDCAP_COSTS)}


def midcap_momentum_stress_test(t: Frames) -> Frames:
    bars = liquid_bars(t["bars"])
    grid = factors.staggered_backtest(bars, costs=MIDCAP_COSTS, target_ns=(3, 6, 9), lookbacks=(63, 126, 189, 252))
    return _momentum_tests(factors.staggered_periods(bars, costs=MIDCAP_COSTS), grid)


def flow_test(t: Frames) -> Frames:
    return {"reports": flow.flow_backtest(t["bars"], flow.net_positioning(t["oi"]), CAPITAL)}


def flow_stress_test(t: Frames) -> Frames:
    bars, wide = cut_lineage(t["bars"]), cut_lineage(flow.net_positioning(t["oi"]))
    keys = ["symbol", "quantile_threshold", "hold_days"]
    oos = cut_lineage(flow.split_by_order(flow.flow_trades(bars, wide, capital=CAPITAL), keys).filter("split = 'oos'"))
    return {
        "one_sample": significance.one_sample_t(oos, ["symbol"], "pnl_pct"),
        "bootstrap": significance.bootstrap_sharpe(oos, ["symbol"], "exit_date", "pnl_pct"),
        "subperiods": significance.subperiods(oos, ["symbol"], "exit_date", "pnl_pct"),
        "grid": flow.flow_parameter_grid(bars, wide, capital=CAPITAL),
    }


def _model_frames(run: learning.FlowRun) -> Frames:
    recurrence = learning.feature_recurrence(learning.recipe_features(run.recipes))
    return {"comparison": learning.flow_comparison(run), "recipes": run.recipes, "recurrence": recurrence, "folds": run.folds}


def flow_classical_ml_test(t: Frames, evolver: Evolver | None = None) -> Frames:
    """One instrument: its rows are searched for derived features as one series."""
    run = learning.flow_ml_run(t["index_bars"], cut_lineage(flow.net_positioning(t["oi"])), evolver=evolver or Evolver(pooled=False))
    return _model_frames(run)


def flow_pooled_ml_test(t: Frames, evolver: Evolver | None = None) -> Frames:
    """All instruments pooled, the derived features searched and tested over the pool."""
    run = learning.flow_ml_run(t["bars"], cut_lineage(flow.net_positioning(t["oi"])), evolver=evolver or Evolver())
    return _model_frames(run) | {"pooled": learning.pooled_comparison(run.trades, run.rule_trades)}


def flow_recalibration_check(
    t: Frames, current: str = "dii_net_index_future_diff5", evolver: Evolver | None = None, as_of: str | None = None, every_days: int = 30
) -> Frames:
    """IC scan, whether the live feature still passes, the best passing candidate, and whether a model beats the rule.

    With `as_of` and a saved `state` the check is only made when it is due: else the one result says that it is not. The
    models are the pooled one with derived features over `bars` and, where `index_bars` are given, the single-series one.
    """
    if as_of and "state" in t:
        due = cut_lineage(files.is_due(t["state"], as_of, every_days))
        if not due.first()["due"]:
            return {"due": due}
    bars, wide = cut_lineage(t["bars"]), cut_lineage(flow.net_positioning(t["oi"]))
    scan = cut_lineage(flow.ic_scan(bars, wide))
    run = learning.flow_ml_run(bars, wide, evolver=evolver or Evolver())
    candidates = learning.pooled_comparison(run.trades, run.rule_trades).withColumn("model", F.lit("pooled"))
    if "index_bars" in t:
        single = learning.flow_ml_run(t["index_bars"], wide, evolver=replace(evolver or Evolver(), pooled=False))
        candidates = candidates.unionByName(learning.pooled_comparison(single.trades, single.rule_trades).withColumn("model", F.lit("single")))
    candidates = cut_lineage(candidates)
    ok = F.col("passes_bonferroni_both_halves")
    best = F.max_by("feature", F.when(ok, F.abs("ic_full")))
    verdict = scan.groupBy("symbol").agg(
        F.coalesce(F.bool_or((F.col("feature") == current) & ok), F.lit(False)).alias("current_still_valid"), best.alias("best_candidate")
    )
    winner = candidates.agg(F.max_by("model", F.when(F.col("verdict") == "beats_benchmark", F.col("model_oos_sharpe"))).alias("winning_model")).first()[0]
    verdict = verdict.withColumn("winning_model", F.lit(winner).cast("string"))
    change = F.col("best_candidate").isNotNull() & (F.col("best_candidate") != current) & ~F.col("current_still_valid")
    text = (
        F.when(F.col("winning_model").isNotNull(), "consider the model")
        .when(F.col("current_still_valid"), "no change needed")
        .otherwise("review candidates")
    )
    verdict = verdict.withColumns({"recommend_feature_change": change, "recommendation": text})
    recurrence = learning.feature_recurrence(learning.recipe_features(run.recipes))
    return {"scan": scan, "models": candidates, "recipes": run.recipes, "recurrence": recurrence, "verdict": verdict}


def stress_test(t: Frames) -> Frames:
    res = cut_lineage(risk.stress_test(t["bars"]))
    return {"results": res, "worst_case": risk.worst_case(res)}


def paper(t: Frames) -> Frames:
    """Decision cycle over a stream (or a finished table) of account rows.

    `market` rows (trading.ROWS: prices, model outputs, indicators) run through regime, signal, breakers and session end;
    `signals` are rows whose signal is ready.
    """
    if "market" in t:
        return {"journal": trading.stream_trading(t["market"])}
    s = t["signals"]
    return {"trades": stateful.stream_decisions(s) if s.isStreaming else stateful.batch_decisions(s)}


def flow_paper(t: Frames) -> Frames:
    d = t["days"]
    if d.isStreaming:
        return {"closed_trades": stateful.stream_tranches(d)}
    return {"closed_trades": flow.concurrent_trades(d, ["symbol"], "signal", count_on_entry_day=True)}


JOBS: dict[str, Callable[[Frames], Frames]] = {
    "train": train,
    "paper": paper,
    "stress-test": stress_test,
    "swing-test": swing_test,
    "swing-walk-forward": swing_walk_forward,
    "xgboost-baseline": intraday_baseline,
    "regime-gated-test": regime_gated_test,
    "pairs-trading-test": pairs_trading_test,
    "event-drift-test": event_drift_test,
    "passive-benchmarks-test": passive_benchmarks_test,
    "orb-test": orb_test,
    "factor-stress-test": factor_stress_test,
    "midcap-momentum-test": midcap_momentum_test,
    "midcap-momentum-stress-test": midcap_momentum_stress_test,
    "fii-dii-flow-test": flow_test,
    "fii-dii-flow-stress-test": flow_stress_test,
    "fii-dii-flow-paper": flow_paper,
    "fii-dii-flow-classical-ml-test": flow_classical_ml_test,
    "fii-dii-flow-pooled-classical-ml-test": flow_pooled_ml_test,
    "fii-dii-flow-recalibration-check": flow_recalibration_check,
}
