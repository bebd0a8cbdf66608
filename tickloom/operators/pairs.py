"""Pair selection by cointegration over all symbol pairs, and the mean-reversion back-test of selected pairs."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.costs import DEFAULT_COSTS, CostParams, net_pnl
from tickloom.functions.scalar import div
from tickloom.session import ship_package

MIN_ROWS = 200


def _normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


# Fixed response-surface values of the published tables for two variables with a constant.
TAU_MIN, TAU_STAR, TAU_MAX = -18.86, -2.62, 0.92
SMALL_P = (2.92, 1.5012, 0.039796)
LARGE_P = (2.1945, 0.64695, -0.29198, -0.042377)


def cointegration_p(tau: float) -> float:
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    coef = SMALL_P if tau <= TAU_STAR else LARGE_P
    return _normal_cdf(sum(c * tau**k for k, c in enumerate(coef)))


def unit_root_tau(resid: np.ndarray) -> float:
    """Augmented Dickey-Fuller t value without deterministic terms, lag order by AIC on a common sample.

    The cross-product matrix of the longest model is formed once; every shorter model is a leading block of it.
    """
    n = len(resid)
    longest = max(min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 1), 0)
    step = np.diff(resid)

    def design(p):
        rows = len(step) - p
        cols = [resid[p : p + rows]] + [step[p - k : p - k + rows] for k in range(1, p + 1)]
        return np.column_stack(cols), step[p:]

    x, y = design(longest)
    xx, xy, yy, m = x.T @ x, x.T @ y, float(y @ y), len(y)
    best, chosen = math.inf, 0
    for k in range(1, longest + 2):
        beta = np.linalg.solve(xx[:k, :k], xy[:k])
        ssr = max(yy - float(beta @ xy[:k]), 1e-300)
        aic = m * (math.log(2 * math.pi * ssr / m) + 1) + 2 * k
        if aic < best:
            best, chosen = aic, k - 1
    x, y = design(chosen)
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ (x.T @ y)
    err = y - x @ beta
    s2 = float(err @ err) / (len(y) - x.shape[1])
    return float(beta[0] / math.sqrt(s2 * inv[0, 0]))


def unit_root_taus(resid: np.ndarray, lags: int | None = None) -> np.ndarray:
    """`unit_root_tau` of every row of a matrix of equally long residuals at once; NaN where a system is singular.

    Cross products of all rows are formed for the longest model, and every lag order is one batch of small systems.
    With `lags` given that order is used, without selection.
    """
    count, n = resid.shape
    longest = max(min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 1), 0) if lags is None else lags
    step = np.diff(resid, axis=1)

    def design(p: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = step.shape[1] - p
        cols = [resid[rows, p : p + m]] + [step[rows, p - k : p - k + m] for k in range(1, p + 1)]
        return np.stack(cols, axis=2), step[rows, p:]

    every = np.arange(count)
    x, y = design(longest, every)
    xx, xy, yy, m = np.einsum("pti,ptj->pij", x, x), np.einsum("pti,pt->pi", x, y), np.einsum("pt,pt->p", y, y), y.shape[1]

    def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        try:
            return np.linalg.solve(a, b[:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:  # at least one is singular: one by one
            out = np.full(b.shape, np.nan)
            for i in range(len(b)):
                try:
                    out[i] = np.linalg.solve(a[i], b[i])
                except np.linalg.LinAlgError:
                    continue
            return out

    chosen = np.full(count, longest)
    if lags is None:
        best = np.full(count, math.inf)
        for k in range(1, longest + 2):
            beta = solve(xx[:, :k, :k], xy[:, :k])
            ssr = np.maximum(yy - np.einsum("pi,pi->p", beta, xy[:, :k]), 1e-300)
            aic = m * (np.log(2 * math.pi * ssr / m) + 1) + 2 * k
            better = aic < best
            best[better], chosen[better] = aic[better], k - 1
    tau = np.full(count, np.nan)
    for p in np.unique(chosen):
        rows = np.flatnonzero(chosen == p)
        x, y = design(int(p), rows)
        xx = np.einsum("pti,ptj->pij", x, x)
        beta = solve(xx, np.einsum("pti,pt->pi", x, y))
        err = y - np.einsum("pti,pi->pt", x, beta)
        first = np.zeros(beta.shape)
        first[:, 0] = 1.0
        with np.errstate(invalid="ignore", divide="ignore"):
            s2 = np.einsum("pt,pt->p", err, err) / (y.shape[1] - p - 1)
            tau[rows] = beta[:, 0] / np.sqrt(s2 * solve(xx, first)[:, 0])
    return tau


#: Symbols of a tile's side; residuals of a tile are tested in batches of about so many values.
SIDE, BATCH_VALUES = 32, 4_000_000


def _tile_pairs(names: list[str], t: list[np.ndarray], x: list[np.ndarray], pick: np.ndarray, with_p: bool, min_rows: int, lags: int | None):
    """Statistics of the picked pairs (rows of two indices) of a tile: slopes of all as matrix products over one calendar."""
    calendar = np.unique(np.concatenate(t))
    level, held = np.zeros((len(names), len(calendar))), np.zeros((len(names), len(calendar)))
    centre = np.array([v.mean() for v in x])
    for i, (at, v) in enumerate(zip(t, x, strict=True)):
        where = np.searchsorted(calendar, at)
        level[i, where], held[i, where] = v - centre[i], 1.0
    i, j = pick.T
    product = lambda u, v: (u @ v.T)[i, j]
    n, sa, sb = product(held, held), product(level, held), product(held, level)
    sab, sbb, saa = product(level, level), product(held, level**2), product(level**2, held)
    enough = n >= min_rows
    i, j, n, sa, sb, sab, sbb, saa = (v[enough] for v in (i, j, n, sa, sb, sab, sbb, saa))
    var_b, var_a, cov = sbb - sb * sb / n, saa - sa * sa / n, sab - sa * sb / n
    flat = var_b <= 1e-13 * np.maximum(sbb, 1e-300)
    i, j, n, sa, sb, cov, var_a, var_b = (v[~flat] for v in (i, j, n, sa, sb, cov, var_a, var_b))
    slope = cov / var_b
    icpt = sa / n - slope * sb / n
    p_value = np.full(len(i), np.nan)
    if with_p and len(i):
        # pairs with one set of common dates are tested together
        common = [np.packbits((held[u] * held[v]).astype(bool)).tobytes() for u, v in zip(i, j, strict=True)]
        groups: dict[bytes, list[int]] = {}
        for k, key in enumerate(common):
            groups.setdefault(key, []).append(k)
        limit = 100 * math.sqrt(np.finfo(float).eps)
        for ks in groups.values():
            size = max(1, BATCH_VALUES // max(1, int(n[ks[0]])))
            for at in range(0, len(ks), size):
                part = np.array(ks[at : at + size])
                days = np.flatnonzero(held[i[part[0]]] * held[j[part[0]]])
                resid = level[i[part]][:, days] - icpt[part, None] - slope[part, None] * level[j[part]][:, days]
                total = var_a[part]
                alike = (total <= 0) | (np.einsum("pt,pt->p", resid, resid) < limit * total)
                p_value[part[alike]] = 0.0
                if (~alike).any():
                    taus = unit_root_taus(resid[~alike], lags)
                    p_value[part[~alike]] = [math.nan if math.isnan(x) else (x if lags is not None else cointegration_p(x)) for x in taus]
    intercept = icpt + centre[i] - slope * centre[j]
    return [(names[u], names[v], int(c), s, o, p) for u, v, c, s, o, p in zip(i, j, n, slope, intercept, p_value, strict=True)]


def pair_statistics(prices: DataFrame, tiles: int | None = None, with_p: bool = True, min_rows: int = MIN_ROWS, lags: int | None = None) -> DataFrame:
    """One row per unordered symbol pair with enough common dates: hedge ratio, intercept and cointegration p.

    Every pair is an output of the operator, but no (pair, date) row is ever built. A symbol's log prices travel
    as one calendar-length array; symbols are dealt to groups of about SIDE by hash and each unordered pair of groups is
    one task that holds two groups of series, so tasks grow in number with the universe and not in size. Inside a tile
    all slopes are matrix products over one calendar, and unit-root tests are batches. With `lags` the p_value column
    holds the test's t value at that lag order instead.
    """
    p = prices.filter(F.col("close") > 0).select(
        "symbol", F.unix_micros(F.col("date").cast("timestamp")).alias("t"), F.ln("close").alias("x")
    )
    if tiles is None:
        tiles = max(4, -(-prices.select("symbol").distinct().count() // SIDE))
    series = (
        p.groupBy("symbol")
        .agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("s"))
        .select("symbol", F.col("s.t").alias("t"), F.col("s.x").alias("x"), F.pmod(F.hash("symbol"), F.lit(tiles)).alias("g"))
    )
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    placed = series.withColumn("o", other).select(
        "symbol", "t", "x", "g", F.least("g", "o").alias("gi"), F.greatest("g", "o").alias("gj")
    )

    def tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("symbol")
        names, g = pdf["symbol"].tolist(), pdf["g"].to_numpy()
        t, x = ([np.asarray(v) for v in pdf[c]] for c in ("t", "x"))
        a, b = np.triu_indices(len(names), 1)
        mine = (np.minimum(g[a], g[b]) == key[0]) & (np.maximum(g[a], g[b]) == key[1])
        out = _tile_pairs(names, t, x, np.stack([a[mine], b[mine]], 1), with_p, min_rows, lags) if mine.any() else []
        cols = ["symbol_a", "symbol_b", "n_rows", "hedge_ratio", "intercept", "p_value"]
        return pd.DataFrame(out, columns=cols).astype({"n_rows": "int64", "hedge_ratio": "float64", "intercept": "float64", "p_value": "float64"})

    schema = "symbol_a string, symbol_b string, n_rows long, hedge_ratio double, intercept double, p_value double"
    ship_package()
    found = placed.groupBy("gi", "gj").applyInPandas(tile, schema)
    return found.withColumn("p_value", F.nullif(F.nanvl("p_value", F.lit(-1.0)), F.lit(-1.0))) if lags is None else found


def cointegrated_pairs(prices: DataFrame, family_alpha: float = 0.05, tiles: int | None = None) -> DataFrame:
    """Pairs whose p clears the Bonferroni level over all possible pairs, best first."""
    n = prices.select(F.count_distinct("symbol")).scalar()
    alpha = F.lit(family_alpha) / F.greatest(n * (n - 1) / 2, F.lit(1))
    return pair_statistics(prices, tiles).filter(F.col("p_value") < alpha).orderBy("p_value", "symbol_a", "symbol_b")


def spread_scores(bars: DataFrame, pairs: DataFrame, session: str, window: int = 20, train_frac: float | None = 0.8) -> DataFrame:
    """Joined out-of-sample rows of each pair with the z-score of the hedged log spread.

    The first part of each symbol is warm-up: it feeds the rolling window and is then dropped. Selected pairs are
    few; bars join them by symbol and each other by (pair, date).
    """
    d = bars.select("symbol", "date", session, "close")
    if train_frac is not None:
        w = Window.partitionBy("symbol")
        cut = F.floor(F.count(F.lit(1)).over(w) * F.lit(train_frac))
        d = d.withColumn("oos", F.row_number().over(w.orderBy("date")) > cut)
    else:
        d = d.withColumn("oos", F.lit(True))
    a = d.select(F.col("symbol").alias("symbol_a"), "date", session, F.col("close").alias("close_a"), F.col("oos").alias("_oa"))
    b = d.select(F.col("symbol").alias("symbol_b"), "date", F.col("close").alias("close_b"), F.col("oos").alias("_ob"))
    j = pairs.select("symbol_a", "symbol_b", "hedge_ratio", "intercept").join(a, "symbol_a").join(b, ["symbol_b", "date"])
    # A row is warm-up only when both legs are in their own training part; mixed rows belong to neither slice.
    j = j.filter(F.col("_oa") == F.col("_ob"))
    f = Window.partitionBy("symbol_a", "symbol_b").orderBy("date").rowsBetween(-(window - 1), 0)
    spread = F.ln("close_a") - (F.col("intercept") + F.col("hedge_ratio") * F.ln("close_b"))
    j = j.withColumn("spread", spread)
    full = F.count("spread").over(f) == window
    z = F.when(full, div(F.col("spread") - F.avg("spread").over(f), F.stddev_samp("spread").over(f)))
    return j.withColumn("z", z).filter("_oa").drop("_oa", "_ob")


def pair_trades(
    scores: DataFrame,
    session: str,
    capital: float = 1_000_000.0,
    max_position_pct: float = 0.10,
    entry_z: float = 2.0,
    exit_z: float = 0.5,
    stop_z: float = 4.0,
    costs: CostParams = DEFAULT_COSTS,
) -> DataFrame:
    """Closed trades of the three-state automaton (flat, long spread, short spread) per pair.

    A row without z is skipped even at a session end, and entry is possible on a session's last bar; both are part
    of the rule. The automaton reads one pair's calendar-length series; prices and costs are columns again.
    """
    w = Window.partitionBy("symbol_a", "symbol_b").orderBy("date")
    last = F.coalesce(F.lead(session).over(w) != F.col(session), F.lit(True))
    d = scores.withColumn("last_bar", last).filter(F.col("z").isNotNull())

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        held, out = None, []
        for date, z, ca, cb, end in zip(pdf["date"], pdf["z"], pdf["close_a"], pdf["close_b"], pdf["last_bar"]):
            if held is None:
                if abs(z) > entry_z:
                    held = ("short_spread" if z > 0 else "long_spread", date, ca, cb)
            elif abs(z) < exit_z or abs(z) > stop_z or end:
                out.append((*key, *held, date, ca, cb, z))
                held = None
        return pd.DataFrame(
            out,
            columns=["symbol_a", "symbol_b", "position", "entry_date", "entry_a", "entry_b", "exit_date", "exit_a", "exit_b", "exit_z"],
        )

    ship_package()
    dt = scores.schema["date"].dataType.simpleString()
    trades = d.groupBy("symbol_a", "symbol_b").applyInPandas(
        walk,
        f"symbol_a string, symbol_b string, position string, entry_date {dt}, entry_a double, entry_b double, "
        f"exit_date {dt}, exit_a double, exit_b double, exit_z double",
    )
    leg = min(max_position_pct * capital, capital) / 2.0
    t = trades.withColumns(
        {"qty_a": F.floor(F.lit(leg) / F.col("entry_a")), "qty_b": F.floor(F.lit(leg) / F.col("entry_b"))}
    ).filter((F.col("qty_a") > 0) & (F.col("qty_b") > 0))
    long = F.col("position") == "long_spread"
    side_a, side_b = F.when(long, "BUY").otherwise("SELL"), F.when(long, "SELL").otherwise("BUY")
    t = t.withColumn(
        "pnl",
        net_pnl("entry_a", "exit_a", "qty_a", side_a, False, costs) + net_pnl("entry_b", "exit_b", "qty_b", side_b, False, costs),
    )
    return t.withColumns(
        {
            "pnl_pct": F.col("pnl") / (F.col("entry_a") * F.col("qty_a") + F.col("entry_b") * F.col("qty_b")),
            "confidence": F.least(F.lit(1.0), F.abs("exit_z") / entry_z),
        }
    )


def train_slice(bars: DataFrame, frac: float = 0.8, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    w = Window.partitionBy(*keys)
    keep = F.row_number().over(w.orderBy("date")) <= F.floor(F.count(F.lit(1)).over(w) * F.lit(frac))
    return bars.withColumn("_k", keep).filter("_k").drop("_k")
