"""Queries of derived features and model training."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import jobs
from tickloom.catalog.features_cat import _RET
from tickloom.catalog.flow_cat import _index, wide
from tickloom.catalog.sqltext import final
from tickloom.functions.scalar import rounded
from tickloom.operators import features as ft
from tickloom.operators import genes as gn
from tickloom.operators import learning as ml
from tickloom.operators import regimes as rg
from tickloom.operators.reports import performance_report
from tickloom.session import cut_lineage
from tickloom.sources import tables as tb

QUERIES, SQL = {}, {}
CAPITAL = 1_000_000.0


def matrix(spark, d):
    """Labelled model rows with the whole feature library and the names of the features, stored once."""
    return jobs.model_rows(tb.bars_daily(spark, d))


GENES = [
    gn.Recipe("ratio", "returns_5d", "volatility_20d"), gn.Recipe("diff", "returns", "returns_10d"), gn.Recipe("product", "returns_5d", "returns_20d"),
    gn.Recipe("rolling_mean_5", "returns"), gn.Recipe("rolling_std_5", "returns_5d"),
]


def _genes(spark, d):
    f = ft.add_families(tb.bars_daily(spark, d), ["returns"])
    f = ft.forward_labels(f).filter(F.col("volatility_20d").isNotNull())
    return rounded(gn.fitness(cut_lineage(f), GENES))


QUERIES["gene_fitness"] = _genes
SQL["gene_fitness"] = final(
    _RET + """,
v AS (SELECT *, CASE WHEN count(returns) OVER w = 20 THEN stddev_samp(returns) OVER w * sqrt(252) END AS v20, lead(close, 5) OVER (PARTITION BY symbol ORDER BY date) / close - 1 AS label
  FROM r WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
f AS (SELECT * FROM v WHERE v20 IS NOT NULL AND label IS NOT NULL),
g AS (SELECT label, avg(returns) OVER w AS m5, coalesce(stddev_samp(returns_5d) OVER w, 0.0) AS s5, returns_5d / nullif(v20, 0) AS a, returns - returns_10d AS b, returns_5d * returns_20d AS c
  FROM f WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
l AS (SELECT 'evolved_returns_5d_ratio_volatility_20d' AS gene, a AS value, label FROM g UNION ALL SELECT 'evolved_returns_diff_returns_10d', b, label FROM g
  UNION ALL SELECT 'evolved_returns_5d_product_returns_20d', c, label FROM g UNION ALL SELECT 'evolved_rolling_mean_5_returns', m5, label FROM g
  UNION ALL SELECT 'evolved_rolling_std_5_returns_5d', s5, label FROM g),
k AS (SELECT gene, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS x,
  rank() OVER (PARTITION BY gene ORDER BY label) + (count(*) OVER (PARTITION BY gene, label) - 1) / 2.0 AS y FROM l WHERE value IS NOT NULL)""",
    "SELECT gene, count(*) AS n, corr(x, y) AS ic FROM k GROUP BY gene", "gene, n",
)


def _search(spark, d):
    rows, cols = matrix(spark, d)
    best = gn.Evolver().evolve(rows, cols)
    return spark.createDataFrame([(g.label, g.op, float(s)) for g, s in best], "gene string, op string, fitness double")


QUERIES["gene_search"] = _search


def _split_matrix(spark, d):
    rows, cols = matrix(spark, d)
    return ml.with_split(rows), cols


QUERIES["training_split"] = lambda spark, d: _split_matrix(spark, d)[0].groupBy("split").agg(
    F.count(F.lit(1)).alias("n"), F.count("label").alias("n_labelled"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
)


def _regime_matrix(spark, d):
    """Rows per split and regime of the training matrix, with thresholds from its train rows."""
    rows, _ = _split_matrix(spark, d)
    rows = cut_lineage(rows)
    labelled = rg.label_regimes(rows, rg.regime_thresholds(rows.filter("split = 'train'")))
    return labelled.groupBy("split", "regime").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("n_up"))


QUERIES["training_regimes"] = _regime_matrix


def _baseline(spark, d):
    """The model fitted on train rows with early stopping, all rows scored, and the feature names."""
    rows, cols = _split_matrix(spark, d)
    model = ml.fit_split(rows, cols)
    return model, ml.score(model, rows, cols), cols


def _importance(spark, d):
    model, _, cols = _baseline(spark, d)
    return rounded(ml.feature_importance(model, cols, spark))


def _oos_report(spark, d):
    trades = cut_lineage(ml.oos_trades(_baseline(spark, d)[1].filter("split = 'oos'"), True))
    return rounded(performance_report(trades, ["symbol"], "date", ["action"], CAPITAL))


QUERIES["boosted_baseline_metrics"] = lambda spark, d: rounded(ml.classification_metrics(_baseline(spark, d)[1], ["split"]))
QUERIES["boosted_feature_importance"] = _importance
QUERIES["boosted_oos_report"] = _oos_report


def _labelled(rows):
    """Regimes of all rows, with thresholds from the rows before the traded ones."""
    return rg.label_regimes(rows, rg.regime_thresholds(rows.filter("split <> 'oos'")))


def _gated(spark, d):
    """Out-of-sample trades only in trending regimes."""
    rows, cols = _split_matrix(spark, d)
    oos = _labelled(rows).filter(F.col("regime").isin("bull_trend", "bear_trend") & (F.col("split") == "oos"))
    t = cut_lineage(ml.oos_trades(ml.score(ml.fit_split(rows, cols), oos, cols), True))
    return rounded(performance_report(t, ["regime"], "date", ["symbol"], CAPITAL))


QUERIES["regime_gated_report"] = _gated


def _regime_models(spark, d):
    rows, cols = _split_matrix(spark, d)
    rows = cut_lineage(_labelled(rows))
    out = None
    for regime, model in ml.regime_models(rows.filter("split = 'train'"), cols).items():
        oos = rows.filter((F.col("regime") == regime) & (F.col("split") == "oos"))
        r = ml.classification_metrics(ml.score(model, oos, cols)).withColumn("regime", F.lit(regime))
        out = r if out is None else out.unionByName(r)
    return rounded(out)


QUERIES["regime_submodels"] = _regime_models
QUERIES["time_series_cv"] = lambda spark, d: rounded(ml.time_series_cv(*matrix(spark, d)))
QUERIES["walk_forward"] = lambda spark, d: rounded(ml.walk_forward(*matrix(spark, d)))
QUERIES["walk_forward_summary"] = lambda spark, d: rounded(ml.fold_summary(ml.walk_forward(*matrix(spark, d))))
QUERIES["flow_classical_ml"] = lambda spark, d: rounded(
    ml.flow_ml_backtest(cut_lineage(_index(spark, d)), cut_lineage(wide(spark, d)), evolver=gn.Evolver(pooled=False))
)
QUERIES["flow_pooled_classical_ml"] = lambda spark, d: rounded(
    ml.flow_ml_backtest(cut_lineage(tb.bars_daily(spark, d)), cut_lineage(wide(spark, d)), evolver=gn.Evolver())
)

# --- ensembles over sub-model probabilities derived from order lines
MODELS = ("lstm", "xgboost", "qkernel", "vqc")


def _sub(spark, d):
    return tb.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", (F.col("l_discount") * 10).alias("lstm"), (F.col("l_tax") * 12).alias("xgboost"),
        (F.col("l_quantity") / 51).alias("qkernel"), (1 - F.col("l_discount") * 9).alias("vqc"), (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )


def _weights(spark, d):
    return ml.ensemble_weights(_sub(spark, d), MODELS)


_SUB = """s AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount * 10 AS lstm, l_tax * 12 AS xgboost, l_quantity / 51 AS qkernel, 1 - l_discount * 9 AS vqc,
  (l_returnflag = 'R')::INT AS label FROM lineitem),
a AS (SELECT unnest(['lstm', 'xgboost', 'qkernel', 'vqc']) AS model, unnest([avg(((lstm > 0.5)::INT = label)::INT), avg(((xgboost > 0.5)::INT = label)::INT),
  avg(((qkernel > 0.5)::INT = label)::INT), avg(((vqc > 0.5)::INT = label)::INT)]) AS acc FROM s),
b AS (SELECT model, greatest(acc, 0.1) AS acc, CASE WHEN model IN ('lstm', 'xgboost') THEN 0.6 ELSE 0.4 END AS g FROM a)"""
QUERIES["ensemble_weights"] = lambda spark, d: rounded(_weights(spark, d))
SQL["ensemble_weights"] = final(_SUB, "SELECT model, acc / sum(acc) OVER (PARTITION BY g) * g AS weight FROM b", "model")
QUERIES["ensemble_combine"] = lambda spark, d: rounded(
    _sub(spark, d).withColumns(ml.combine(_sub(spark, d), MODELS, {"lstm": 0.3, "xgboost": 0.3, "qkernel": 0.2, "vqc": 0.2}))
    .select("l_orderkey", "l_linenumber", "l_extendedprice", "p_weighted", "p_vote", "p_mean", "signal_confidence")
)
_WAVG = "(lstm * 0.3 + xgboost * 0.3 + qkernel * 0.2 + vqc * 0.2)"
SQL["ensemble_combine"] = final(
    _SUB, f"""SELECT l_orderkey, l_linenumber, l_extendedprice, {_WAVG} AS p_weighted,
  ((lstm > 0.5)::INT + (xgboost > 0.5)::INT + (qkernel > 0.5)::INT + (vqc > 0.5)::INT) / 4.0 AS p_vote, (lstm + xgboost + qkernel + vqc) / 4 AS p_mean,
  greatest({_WAVG}, 1 - {_WAVG}) AS signal_confidence FROM s""", "l_orderkey, l_linenumber",
)


def _stack(spark, d):
    """Fitted on the even orders and scored on the odd ones, which it has not seen."""
    s = cut_lineage(_sub(spark, d))
    held = F.col("l_orderkey") % 2 == 1
    out = ml.stacker(s.filter(~held), MODELS).transform(s.filter(held))
    return rounded(out.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n")))


QUERIES["ensemble_stacking"] = _stack
LISTING = ["size", "avg_discount", "avg_tax", "avg_quantity"]


def _listing(spark, d):
    part = tb.table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    li = tb.table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.avg("l_discount").alias("avg_discount"), F.avg("l_tax").alias("avg_tax"), F.avg("l_quantity").alias("avg_quantity")
    )
    t = cut_lineage(
        li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
            "p_partkey", F.col("p_size").cast("double").alias("size"), *LISTING[1:], ((F.col("px") / F.col("p_retailprice") - 1)).alias("listing_return_pct")
        )
    )
    model = ml.listing_return_model(t, LISTING, "listing_return_pct")
    return rounded(ml.predict_listing_return(model, t, LISTING))


QUERIES["listing_return_model"] = _listing


# --- the ensemble over a score table: sub-model probabilities of order lines, split by order number
_PART = "CASE l_orderkey % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'es' WHEN 2 THEN 'meta' ELSE 'oos' END"


def _score_rows(spark, d):
    rows = _sub(spark, d).dropDuplicates(["l_orderkey", "l_linenumber"]).withColumn("split", F.expr(_PART))
    return cut_lineage(ml.score_table(rows, {m: m for m in MODELS}, ["l_orderkey", "l_linenumber"]))


def _voted(spark, d):
    out = ml.ensemble(_score_rows(spark, d), MODELS, ["l_orderkey", "l_linenumber"]).scored
    return out.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p_weighted").alias("p_weighted"), F.avg("p_vote").alias("p_vote"), F.avg("p_mean").alias("p_mean"),
        F.avg(((F.col("p_weighted") > 0.5).cast("int") == F.col("label")).cast("double")).alias("accuracy"),
    )


_UNIQUE = "(SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_orderkey) = 1)"
QUERIES["ensemble_over_scores"] = lambda spark, d: rounded(_voted(spark, d))
SQL["ensemble_over_scores"] = final(
    _SUB.replace("FROM lineitem)", f"FROM {_UNIQUE})").replace("FROM s)", "FROM s WHERE l_orderkey % 4 = 1)", 1) + f""",
w AS (SELECT model, acc / sum(acc) OVER (PARTITION BY g) * g AS weight FROM b),
o AS (SELECT *, (SELECT sum(weight * CASE model WHEN 'lstm' THEN lstm WHEN 'xgboost' THEN xgboost WHEN 'qkernel' THEN qkernel ELSE vqc END) / sum(weight) FROM w) AS pw,
  ((lstm > 0.5)::INT + (xgboost > 0.5)::INT + (qkernel > 0.5)::INT + (vqc > 0.5)::INT) / 4.0 AS pv, (lstm + xgboost + qkernel + vqc) / 4 AS pm FROM s WHERE l_orderkey % 4 = 3)""",
    "SELECT 'oos' AS split, count(*) AS n, avg(pw) AS p_weighted, avg(pv) AS p_vote, avg(pm) AS p_mean, avg(((pw > 0.5)::INT = label)::INT) AS accuracy FROM o",
    "split, n",
)
