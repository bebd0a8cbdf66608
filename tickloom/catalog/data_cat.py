"""Queries of ingest cleaning, liquidity, journal, calibration and the scalar library."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog.sqltext import DAILY, INTRADAY, LINE, TRADES, final, pnl_sql
from tickloom.functions import costs as co
from tickloom.functions import scalar as sc
from tickloom.functions.scalar import rounded
from tickloom.operators.asof import asof_join
from tickloom.operators import journal as jn
from tickloom.operators import quality as ql
from tickloom.operators import reports as rp
from tickloom.plans import ordered
from tickloom.sources import tables as tb

QUERIES, SQL = {}, {}

# --- bars and cleaning
QUERIES["bars_daily"] = lambda spark, d: rounded(tb.bars_daily(spark, d))
SQL["bars_daily"] = final(DAILY, "SELECT * FROM bars", "symbol, date")
QUERIES["bars_intraday"] = lambda spark, d: rounded(tb.bars_intraday(spark, d).drop("date"))
SQL["bars_intraday"] = final(INTRADAY, "SELECT * EXCLUDE (date) FROM bars", "symbol, session_date, hour")


def _dedupe(keep):
    def run(spark, d):
        t = tb.trades(spark, d).withColumn("load", F.struct("order_ref", "entry_price"))
        out = ql.dedupe(t.select("symbol", "date", "load", "entry_price", "quantity"), ["symbol", "date"], "load", keep)
        return rounded(out.drop("load"))

    return run


for _keep, _fn in (("last", "arg_max"), ("first", "arg_min")):
    QUERIES[f"dedupe_keep_{_keep}"] = _dedupe(_keep)
    SQL[f"dedupe_keep_{_keep}"] = final(
        TRADES,
        f"""SELECT symbol, date, {_fn}(entry_price, (order_ref, entry_price)) AS entry_price,
  {_fn}(quantity, (order_ref, entry_price)) AS quantity FROM trades GROUP BY ALL""",
        "symbol, date",
    )


def _prefer(spark, d):
    t = tb.trades(spark, d).select(
        "symbol", "order_ref", "entry_price", F.when(F.col("is_paper"), 2).otherwise(F.when(F.col("quantity") > 45, 0).otherwise(1)).alias("priority")
    )
    t = t.withColumn("symbol", F.concat_ws("/", "symbol", (F.col("order_ref") % 997).cast("string")))
    return ql.prefer_source(t).groupBy("symbol", "priority").agg(F.count(F.lit(1)).alias("n"))


QUERIES["source_fallback"] = _prefer
SQL["source_fallback"] = "WITH " + TRADES + """,
t AS (SELECT symbol || '/' || CAST(order_ref % 997 AS VARCHAR) AS symbol, CASE WHEN is_paper THEN 2 WHEN quantity > 45 THEN 0 ELSE 1 END AS priority FROM trades),
m AS (SELECT symbol, min(priority) AS priority FROM t GROUP BY symbol)
SELECT t.symbol, t.priority, count(*) AS n FROM t JOIN m USING (symbol, priority) GROUP BY ALL"""

QUERIES["liquidity_intraday"] = lambda spark, d: rounded(ql.liquidity(tb.bars_intraday(spark, d), "session_date"))
SQL["liquidity_intraday"] = final(
    INTRADAY, "SELECT symbol, avg(v) / 1e7 AS adtv_cr FROM (SELECT symbol, session_date, sum(turnover) AS v FROM bars GROUP BY ALL) GROUP BY symbol",
    "symbol",
)
QUERIES["liquidity_daily"] = lambda spark, d: rounded(ql.liquidity_daily(tb.bars_daily(spark, d), 0.05))
SQL["liquidity_daily"] = final(
    DAILY, "SELECT symbol, avg(close * volume) / 1e7 AS adtv_cr, avg(close * volume) / 1e7 >= 0.05 AS liquid FROM bars GROUP BY symbol", "symbol, liquid"
)
QUERIES["listing_continuity"] = lambda spark, d: rounded(ql.listing_continuity(tb.bars_daily(spark, d)))
SQL["listing_continuity"] = final(
    DAILY + """,
g AS (SELECT *, date - lag(date) OVER (PARTITION BY symbol ORDER BY date) AS gap FROM bars),
s AS (SELECT symbol, count(*) AS n, max(gap)::DOUBLE AS max_gap_days, avg((volume <= 0)::INT) AS zero_volume_ratio,
  len(list_filter(generate_series(min(date), max(date), INTERVAL 1 DAY), lambda x: isodow(x) < 6)) AS wd FROM g GROUP BY symbol),
t AS (SELECT symbol, n / greatest(wd, 1) AS coverage_ratio, max_gap_days, zero_volume_ratio FROM s),
r AS (SELECT *, concat_ws('; ', CASE WHEN coverage_ratio < 0.9 THEN printf('coverage %.0f%% below 90%%', coverage_ratio * 100) END,
  CASE WHEN max_gap_days > 5 THEN printf('longest gap %.0fd exceeds 5d', max_gap_days) END,
  CASE WHEN zero_volume_ratio > 0.05 THEN printf('%.0f%% zero-volume bars exceeds 5%%', zero_volume_ratio * 100) END) AS txt FROM t)""",
    "SELECT symbol, coverage_ratio, max_gap_days, zero_volume_ratio, txt = '' AS is_continuous, nullif(txt, '') AS reason FROM r",
    "symbol, is_continuous, reason",
)


def corporate_actions(spark, d):
    """One sentence per brand and year, alternately a bonus and a face-value split with numbers from p_size."""
    part = tb.table(spark, d, "part").groupBy(F.col("p_brand").alias("symbol")).agg(
        (F.min("p_size") + 1).cast("string").alias("a"), F.max("p_size").cast("string").alias("b")
    )
    y = part.withColumn("year", F.explode(F.sequence(F.lit(1995), F.lit(2001))))
    split = F.concat(F.lit("Face Value Split (Sub-Division) - From Rs "), "b", F.lit("/- Per Share To Rs "), "a", F.lit("/- Per Share"))
    text = F.when(F.col("year") % 3 == 0, F.concat(F.lit("BONUS "), "a", F.lit(":"), "b")).when(
        F.col("year") % 3 == 1, split
    ).otherwise("Interim Dividend - Rs 5 Per Share")
    return y.select("symbol", F.make_date("year", F.lit(7), F.lit(1)).alias("ex_date"), text.alias("purpose"))


def _actions(spark, d):
    return corporate_actions(spark, d).withColumn("factor", sc.adjustment_factor("purpose")).filter(F.col("factor").isNotNull())


_ACT = """act AS (SELECT p_brand AS symbol, make_date(year, 7, 1) AS ex_date, CASE year % 3 WHEN 0 THEN a / (a + b) WHEN 1 THEN a / b END AS factor
  FROM (SELECT p_brand, (min(p_size) + 1)::DOUBLE AS a, max(p_size)::DOUBLE AS b FROM part GROUP BY 1), (SELECT CAST(unnest(range(1995, 2002)) AS INTEGER) AS year) WHERE year % 3 <> 2)"""
QUERIES["corporate_action_factors"] = lambda spark, d: rounded(_actions(spark, d).select("symbol", "ex_date", "factor"))
SQL["corporate_action_factors"] = final(_ACT, "SELECT * FROM act", "symbol, ex_date")
QUERIES["back_adjusted_bars"] = lambda spark, d: rounded(
    ql.back_adjust(tb.bars_daily(spark, d), _actions(spark, d)).select("symbol", "date", "adjustment", "close", "volume"), 5
)
SQL["back_adjusted_bars"] = final(
    DAILY + ",\n" + _ACT + """,
f AS (SELECT b.symbol, b.date, coalesce(product(factor), 1.0) AS adjustment FROM bars b LEFT JOIN act a ON a.symbol = b.symbol AND b.date < a.ex_date GROUP BY ALL)""",
    "SELECT symbol, date, adjustment, close * adjustment AS close, volume / adjustment AS volume FROM bars JOIN f USING (symbol, date)",
    "symbol, date", 5,
)


# --- previous session's close (as-of backwards) and first date on or after (as-of forwards)
def prev_session_close(bars):
    from pyspark.sql import Window

    daily = bars.groupBy("symbol", "session_date").agg(F.max_by("close", "date").alias("last"))
    daily = daily.withColumn("prev_close", F.lag("last").over(Window.partitionBy("symbol").orderBy("session_date"))).drop("last")
    return bars.join(daily, ["symbol", "session_date"])


QUERIES["previous_session_close"] = lambda spark, d: rounded(
    prev_session_close(tb.bars_intraday(spark, d)).select(
        "symbol", "session_date", "hour", "close", "prev_close",
        sc.is_frozen("prev_close", "close").alias("frozen"), sc.would_fill("prev_close", "high", "low").alias("fills"),
        sc.round_to_tick("close").alias("tick_close"),
    )
)
SQL["previous_session_close"] = final(
    INTRADAY + """,
dl AS (SELECT symbol, session_date, arg_max(close, date) AS last FROM bars GROUP BY ALL),
pv AS (SELECT symbol, session_date, lag(last) OVER (PARTITION BY symbol ORDER BY session_date) AS p FROM dl)""",
    """SELECT symbol, session_date, hour, close, p AS prev_close, CASE WHEN p > 0 THEN abs(close - p) / p >= 0.2 ELSE false END AS frozen,
  CASE WHEN p > 0 THEN NOT (low >= p * (1 + 0.2) OR high <= p * (1 - 0.2)) ELSE true END AS fills,
  round(round_even(close / 0.05, 0) * 0.05, 2) AS tick_close FROM bars JOIN pv USING (symbol, session_date)""",
    "symbol, session_date, hour, frozen, fills",
)


def _forward_asof(spark, d):
    """To every bar the first bar of its symbol at least sixty days later."""
    bars = tb.bars_daily(spark, d).select("symbol", "date")
    due = bars.select("symbol", F.col("date").alias("from_date"), F.date_add("date", 60).alias("date"))
    later = asof_join(due, bars.withColumn("first_on_or_after", F.col("date")), ["symbol"], "date", ["first_on_or_after"], "forward")
    return later.select("symbol", F.col("from_date").alias("date"), "first_on_or_after")


QUERIES["asof_forward"] = _forward_asof
SQL["asof_forward"] = "WITH " + DAILY + """
SELECT b.symbol, b.date, n.date AS first_on_or_after FROM bars b ASOF LEFT JOIN bars n ON n.symbol = b.symbol AND b.date + 60 <= n.date"""


# --- costs
def _costs(spark, d):
    t = tb.trades(spark, d)
    e = co.entry_cost("entry_price", "quantity", F.col("action"), True, co.CONFIGURED_COSTS)
    out = t.withColumns(
        {
            "e": e,
            "net_pnl": co.net_pnl("entry_price", "exit_price", "quantity", F.col("action")),
            "net_pnl_delivery": co.net_pnl("entry_price", "exit_price", "quantity", F.col("action"), True, co.CONFIGURED_COSTS),
        }
    )
    return rounded(
        out.select("order_ref", "l_orderkey", "entry_price", "e.brokerage", "e.stt", "e.gst", "e.stamp_duty", F.col("e.total").alias("entry_total"), "net_pnl", "net_pnl_delivery"), 5
    )


QUERIES["trade_costs"] = _costs
_T, _CC = "(entry_price * quantity)", co.CONFIGURED_COSTS
_SH = "action = 'SELL'"
SQL["trade_costs"] = final(
    TRADES + f""",
c AS (SELECT *, least(20.0, {_T} * 0.0003) AS brokerage, {_T} * 0.0000345 AS txn,
  CASE WHEN {_SH} THEN {_T} * 0.001 ELSE 0.0 END AS stt, CASE WHEN {_SH} THEN 0.0 ELSE {_T} * 0.00015 END AS stamp_duty FROM trades)""",
    f"""SELECT order_ref, l_orderkey, entry_price, brokerage, stt, (brokerage + txn) * 0.18 AS gst, stamp_duty,
  brokerage + txn + stt + (brokerage + txn) * 0.18 + stamp_duty + {_T} * 0.000001 + {_T} * 0.0005 AS entry_total,
  {pnl_sql('entry_price', 'exit_price', 'quantity', _SH)} AS net_pnl,
  {pnl_sql('entry_price', 'exit_price', 'quantity', _SH, True, _CC)} AS net_pnl_delivery FROM c""",
    "order_ref, l_orderkey", 5,
)


# --- journal
def journal(spark, d):
    t = tb.trades(spark, d)
    pnl = co.net_pnl("entry_price", "exit_price", "quantity", F.col("action"))
    return t.withColumn("pnl", F.when(F.col("status") == "CLOSED", pnl)).withColumn(
        "pnl_pct", F.col("pnl") / (F.col("entry_price") * F.col("quantity"))
    )


_J = TRADES + f""",
j0 AS (SELECT *, CASE WHEN status = 'CLOSED' THEN {pnl_sql('entry_price', 'exit_price', 'quantity', _SH)} END AS pnl FROM trades),
j AS (SELECT *, pnl / (entry_price * quantity) AS pnl_pct FROM j0)"""
AS_OF = "2001-11-04"


def _latest(spark, d):
    j = journal(spark, d).withColumn("id", F.col("l_orderkey"))
    opened = j.select("id", F.col("l_linenumber").cast("long").alias("version"), "symbol", "entry_price", F.lit(None).cast("double").alias("pnl"))
    closed = j.filter(F.col("status") == "CLOSED").select(
        "id", (F.col("l_linenumber") + 10).cast("long").alias("version"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("double").alias("entry_price"), "pnl"
    )
    # Several lines may share (order, line number): the change log keeps one row per version first.
    changes = opened.unionByName(closed).groupBy("id", "version").agg(*[F.max(x).alias(x) for x in ("symbol", "entry_price", "pnl")])
    return rounded(jn.latest(changes))


QUERIES["journal_latest_state"] = _latest
SQL["journal_latest_state"] = final(
    _J + """,
ch0 AS (SELECT l_orderkey AS id, l_linenumber::BIGINT AS version, symbol, entry_price, NULL::DOUBLE AS pnl FROM j
  UNION ALL SELECT l_orderkey, l_linenumber::BIGINT + 10, NULL, NULL, pnl FROM j WHERE status = 'CLOSED'),
ch AS (SELECT id, version, max(symbol) AS symbol, max(entry_price) AS entry_price, max(pnl) AS pnl FROM ch0 GROUP BY ALL)""",
    """SELECT id, arg_max(symbol, version) FILTER (symbol IS NOT NULL) AS symbol, arg_max(entry_price, version) FILTER (entry_price IS NOT NULL) AS entry_price,
  arg_max(pnl, version) FILTER (pnl IS NOT NULL) AS pnl, max(version) AS version FROM ch GROUP BY id""",
    "id, symbol, version",
)
QUERIES["journal_find_trades"] = lambda spark, d: rounded(
    jn.find_trades(journal(spark, d), symbol="Brand#7", start="1998-01-01", end="2000-12-31", status="CLOSED", is_paper=True, time="date")
    .select("order_ref", "l_orderkey", "date", "entry_price", "pnl")
)
SQL["journal_find_trades"] = final(
    _J, """SELECT order_ref, l_orderkey, date, entry_price, pnl FROM j WHERE symbol = 'Brand#7' AND date BETWEEN '1998-01-01' AND '2000-12-31'
  AND status = 'CLOSED' AND is_paper""", "order_ref, l_orderkey, date",
)
QUERIES["journal_latest_50"] = lambda spark, d: rounded(
    jn.latest_rows(journal(spark, d).withColumn("tie", F.struct("order_ref", "entry_price")), 50, "date", "tie", status="CLOSED").select("order_ref", "date", "entry_price", "pnl")
)
SQL["journal_latest_50"] = final(
    _J, "SELECT order_ref, date, entry_price, pnl FROM j WHERE status = 'CLOSED' ORDER BY date DESC, order_ref DESC, entry_price DESC LIMIT 50", "order_ref, date"
)
QUERIES["journal_statistics"] = lambda spark, d: rounded(jn.trade_statistics(journal(spark, d), AS_OF, 90, "date"))
SQL["journal_statistics"] = final(
    _J + f",\nr AS (SELECT * FROM j WHERE status = 'CLOSED' AND date >= DATE '{AS_OF}' - 90)",
    """SELECT coalesce(count(*) FILTER (pnl > 0) / nullif(count(*), 0), 0.5) AS win_rate, coalesce(avg(pnl_pct) FILTER (pnl > 0), 0.015) AS avg_win_pct,
  coalesce(abs(avg(pnl_pct) FILTER (pnl < 0)), 0.008) AS avg_loss_pct FROM r""",
)
QUERIES["journal_performance_summary"] = lambda spark, d: rounded(jn.performance_summary(journal(spark, d), AS_OF, 365, "date"), 4)
SQL["journal_performance_summary"] = final(
    _J + f",\nr AS (SELECT * FROM j WHERE status = 'CLOSED' AND date >= DATE '{AS_OF}' - 365)",
    """SELECT count(*) AS total_trades, count(*) FILTER (pnl > 0) / nullif(count(*), 0) AS win_rate, coalesce(sum(pnl), 0.0) AS total_pnl,
  coalesce(avg(pnl_pct), 0.0) AS avg_return_pct, coalesce(avg(confidence), 0.0) AS avg_confidence FROM r""",
    "total_trades", 4,
)
QUERIES["journal_cumulative_pnl"] = lambda spark, d: rounded(
    ordered.running_sum(
        journal(spark, d).filter(F.col("pnl").isNotNull()), ["symbol"], "date", ["order_ref", "entry_price"], "pnl", "cumulative_pnl"
    ).select("symbol", "date", "order_ref", "entry_price", "cumulative_pnl"), 3
)
SQL["journal_cumulative_pnl"] = final(
    _J, """SELECT symbol, date, order_ref, entry_price, sum(pnl) OVER (PARTITION BY symbol ORDER BY date, order_ref, entry_price ROWS UNBOUNDED PRECEDING) AS cumulative_pnl
  FROM j WHERE pnl IS NOT NULL""", "symbol, date, order_ref", 3,
)

# --- calibration
QUERIES["confidence_calibration"] = lambda spark, d: rounded(rp.confidence_calibration(tb.predictions(spark, d).withColumn("k", F.col("l_linenumber")), ["k"]))
_PR = """p AS (SELECT l_linenumber AS k, (l_tax > 0.04)::INT AS predicted, (l_returnflag = 'R')::INT AS actual, 0.5 + l_discount * 5 AS c FROM lineitem),
g AS (SELECT k, min(c) AS lo, max(c) AS hi FROM p GROUP BY k),
b AS (SELECT k, least(greatest(coalesce(ceil((c - lo) / nullif((hi - lo) / 10, 0)) - 1, 0), 0), 9) AS bin, c, predicted = actual AS ok FROM p JOIN g USING (k)),
e AS (SELECT k, bin, count(*) AS n, abs(avg(ok::INT) - avg(c)) AS err FROM b GROUP BY ALL)"""
SQL["confidence_calibration"] = final(
    _PR, "SELECT k, sum(err * n) / sum(n) AS expected_calibration_error, max(err) AS max_calibration_error FROM e GROUP BY k", "k"
)
QUERIES["confidence_histogram"] = lambda spark, d: rp.confidence_histogram(tb.trades(spark, d), ["symbol"])
SQL["confidence_histogram"] = "WITH " + TRADES + """,
g AS (SELECT symbol, min(confidence) AS lo, max(confidence) AS hi FROM trades GROUP BY symbol)
SELECT symbol, CAST(least(floor(20 * (confidence - lo) / (hi - lo)) + 1, 20) AS INTEGER) AS bin, count(*) AS n FROM trades JOIN g USING (symbol) GROUP BY ALL"""

# --- sets and latest rows
QUERIES["all_trading_dates"] = lambda spark, d: tb.bars_daily(spark, d).select("date").union(tb.benchmark_daily(spark, d).select("date")).distinct()
SQL["all_trading_dates"] = "WITH " + LINE + " SELECT DISTINCT date FROM line"
def _missing_dates(spark, d):
    """Symbols by calendar years: a symbol meets the dates of each year and drops those that it has."""
    bars = tb.bars_daily(spark, d).select("symbol", "date")
    years = tb.benchmark_daily(spark, d).select("date", F.year("date").alias("y"))
    ys = sorted(r["y"] for r in years.select("y").distinct().collect())  # a number per calendar year
    want = bars.select("symbol").distinct().select("symbol", F.explode(F.lit(ys)).alias("y")).join(years, "y").select("symbol", "date")
    return want.join(bars, ["symbol", "date"], "left_anti")


QUERIES["missing_symbol_dates"] = _missing_dates
SQL["missing_symbol_dates"] = (
    "WITH " + DAILY + " SELECT s.symbol, c.date FROM (SELECT DISTINCT symbol FROM bars) s, (SELECT DISTINCT date FROM line) c EXCEPT SELECT symbol, date FROM bars"
)
QUERIES["latest_price"] = lambda spark, d: rounded(tb.bars_daily(spark, d).groupBy("symbol").agg(F.max_by("close", "date").alias("close"), F.max("date").alias("date")))
SQL["latest_price"] = final(DAILY, "SELECT symbol, arg_max(close, date) AS close, max(date) AS date FROM bars GROUP BY symbol", "symbol, date")
QUERIES["event_properties"] = lambda spark, d: (
    tb.table(spark, d, "events").select("event_type", F.from_json("props", "k BIGINT").alias("p")).groupBy("event_type")
    .agg(F.sum("p.k").alias("sum_k"), F.count_if(F.col("p.k").isNull()).alias("n_missing"))
)
SQL["event_properties"] = """SELECT event_type, CAST(sum(CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS sum_k,
  count(*) FILTER (props ->> '$.k' IS NULL) AS n_missing FROM events GROUP BY event_type"""
QUERIES["session_filter"] = lambda spark, d: (
    tb.table(spark, d, "events").filter(sc.in_session("ts")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
)
SQL["session_filter"] = """SELECT event_type, count(*) AS n FROM events WHERE isodow(ts) < 6
  AND date_trunc('second', ts)::TIME BETWEEN TIME '09:15:00' AND TIME '15:30:00' GROUP BY event_type"""
QUERIES["daily_summary"] = lambda spark, d: rounded(jn.daily_summary(journal(spark, d)), 3)
SQL["daily_summary"] = final(
    _J + """,
g AS (SELECT date, regime, count(*) AS n, count(*) FILTER (pnl > 0) AS w, count(*) FILTER (pnl < 0) AS l, sum(pnl) AS p FROM j WHERE status = 'CLOSED' AND pnl IS NOT NULL GROUP BY ALL)""",
    """SELECT date, CAST(sum(n) AS BIGINT) AS total_trades, CAST(sum(w) AS BIGINT) AS winning_trades, CAST(sum(l) AS BIGINT) AS losing_trades, sum(p) AS total_pnl,
  arg_min(regime, (-n, regime)) AS regime FROM g GROUP BY date""", "date, total_trades, winning_trades, losing_trades, regime", 3,
)
