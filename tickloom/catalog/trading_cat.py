"""The trading stream over hourly prices of user groups, and what its journal says, against a recursive query."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog.flow_cat import _rule_sql
from tickloom.catalog.sqltext import INTRADAY, final, pnl_sql
from tickloom.catalog.streaming_cat import _signal_days
from tickloom.functions.scalar import rounded
from tickloom.session import cut_lineage
from tickloom.sources import tables as tb
from tickloom.streaming import bars as sb
from tickloom.streaming import paper, runner
from tickloom.streaming import trading as tr

QUERIES, SQL = {}, {}


def trading_rows(spark, d):
    """Hourly prices of four accounts (user groups), with model outputs, indicators and caps from the bars' own numbers."""
    at = F.col("ts").cast("timestamp")
    ev = tb.table(spark, d, "events").select(
        F.concat(F.lit("acct"), F.col("user_id") % 4).alias("account"), F.date_trunc("hour", at).alias("ts"), F.col("event_type").alias("symbol"),
        F.struct(F.unix_micros(at), "event_id").alias("seq"), "value",
    )
    bars = ev.groupBy("account", "ts", "symbol").agg(F.max_by("value", "seq").alias("v"), F.count(F.lit(1)).alias("n"))
    hour, day = F.hour("ts"), F.dayofmonth("ts")
    k = F.pmod(F.floor(F.col("v") * 100).cast("long") + F.col("n") * 7, F.lit(100)) / 100.0
    two = lambda p: F.array(1 - p, p)
    block = F.floor(hour / 6).cast("int") + day
    entries = lambda kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)])
    return bars.select(
        "account", "ts", "symbol", (100 + F.col("v") / 50).alias("price"), two(k).alias("probabilities"),
        entries({"sideways": two((k + 0.2) / 1.4), "bear_trend": two(1 - k)}).alias("by_regime"),
        entries({"a": two((k + 0.1) / 1.2), "b": two(F.pmod(F.col("n") * 3 + hour, F.lit(10)) / 10.0)}).alias("sub_models"),
        entries(
            {
                "nifty_vs_20dma": 0.95 + (block % 7) / 50.0, "nifty_vs_50dma": 0.94 + (block % 5) / 25.0,
                "india_vix": 11.0 + (block % 16), "atr_14_pct": 0.01 + (block % 3) / 100.0,
            }
        ).alias("indicators"),
        F.when(F.col("symbol") != "view", 40000.0 + hour * 1000).alias("capital_cap"),
    )


def journal(spark, d):
    return runner.drain_in_turn(trading_rows(spark, d), "ts", tr.stream_trading)


_C = 1_000_000.0
_POS = "STRUCT(symbol VARCHAR, action VARCHAR, qty BIGINT, entry DOUBLE, last DOUBLE)"
_LOG = (
    "STRUCT(ms BIGINT, kind VARCHAR, symbol VARCHAR, action VARCHAR, qty BIGINT, price DOUBLE, reason VARCHAR, entry DOUBLE, pnl DOUBLE,"
    " capital DOUBLE, held INTEGER, regime VARCHAR)"
)
_TICK = "round(round_even({0} / 0.05, 0) * 0.05, 2)"


def _row(ms, kind, capital, held, regime, symbol="NULL", action="NULL", qty="NULL", price="NULL", reason="NULL", entry="NULL", pnl="NULL") -> str:
    return (
        f"{{ms: {ms}, kind: '{kind}', symbol: {symbol}, action: {action}, qty: {qty}, price: {price}, reason: {reason}, entry: {entry},"
        f" pnl: {pnl}, capital: {capital}, held: {held}, regime: {regime}}}::{_LOG}"
    )


def _why(day_pnl: str, capital: str, peak: str) -> str:
    """Name of the limit that is broken, or NULL."""
    return f"CASE WHEN -({day_pnl}) / {_C} >= 0.03 THEN 'daily_loss' WHEN (({peak}) - ({capital})) / ({peak}) >= 0.12 THEN 'max_drawdown' END"


def _fold(closes: str, ms: str, reason: str, regime: str) -> str:
    """The figures after closing positions one by one at their last price."""
    out = _TICK.format("p.last")
    x = f"{{capital: 0.0::DOUBLE, peak: 0.0::DOUBLE, day_pnl: 0.0::DOUBLE, losses: 0, halted: false, held: 0, log: []::{_LOG}[], p: p, pnl: ({pnl_sql('p.entry', out, 'p.qty', 'p.action = ' + chr(39) + 'SELL' + chr(39))})::DOUBLE}}"
    capital = "(s.capital + x.pnl)"
    peak, loss = f"greatest(s.peak, {capital})", "(s.day_pnl + x.pnl)"
    why = _why(loss, capital, peak)
    close = _row(ms, "CLOSE", capital, "s.held - 1", regime, "x.p.symbol", "x.p.action", "x.p.qty", _TICK.format("x.p.last"), reason, "x.p.entry", "x.pnl")
    halt = _row(ms, "HALT", capital, "s.held - 1", regime, reason=f"({why})")
    after = (
        f"{{capital: {capital}, peak: {peak}, day_pnl: {loss}, losses: CASE WHEN x.pnl < 0 THEN s.losses + 1 ELSE 0 END, halted: s.halted OR ({why}) IS NOT NULL,"
        f" held: s.held - 1, log: s.log || [{close}] || CASE WHEN ({why}) IS NOT NULL AND NOT s.halted THEN [{halt}] ELSE []::{_LOG}[] END, p: x.p, pnl: 0.0::DOUBLE}}"
    )
    first = f"{{capital: capital, peak: peak, day_pnl: day_pnl, losses: losses, halted: halted, held: len(book)::INTEGER, log: log, p: NULL::{_POS}, pnl: 0.0::DOUBLE}}"
    return f"list_reduce(list_prepend({first}, list_transform({closes}, lambda p : {x})), lambda s, x : {after})"


_FIG = "f.capital AS capital, f.peak AS peak, f.day_pnl AS day_pnl, f.losses AS losses, f.halted AS halted, f.log AS log"
_SIGNALS = """e AS (SELECT 'acct' || (user_id % 4) AS account, date_trunc('hour', ts) AS ts, event_type AS symbol,
  arg_max(value, (ts, event_id)) AS v, count(*) AS n FROM events GROUP BY ALL),
b AS (SELECT *, hour(ts) AS h, CAST(floor(hour(ts) / 6) AS INTEGER) + day(ts) AS blk, ((CAST(floor(v * 100) AS BIGINT) + n * 7) % 100) / 100.0::DOUBLE AS k FROM e),
i AS (SELECT *, 0.95 + (blk % 7) / 50.0::DOUBLE AS d20, 0.94 + (blk % 5) / 25.0::DOUBLE AS d50, 11.0 + blk % 16 AS vix, 0.01 + (blk % 3) / 100.0::DOUBLE AS atr,
  epoch_ms(ts) AS ms FROM b),
r AS MATERIALIZED (SELECT account, row_number() OVER (PARTITION BY account ORDER BY ms, symbol) AS n, ms, ms - ms % 86400000 AS d, (ms % 86400000) / 60000 AS minute, symbol,
  100 + v / 50 AS price, CASE WHEN symbol <> 'view' THEN 40000.0::DOUBLE + h * 1000 END AS cap, vix, k, (k + 0.1::DOUBLE) / 1.2::DOUBLE AS qa, ((n * 3 + h) % 10) / 10.0::DOUBLE AS qb,
  CASE WHEN d20 > 1.02 AND d50 > 1.05 AND vix < 15 THEN 'bull_trend' WHEN d50 < 0.98 AND vix > 18 THEN 'bear_trend'
    WHEN d20 > 0.99 AND d50 < 1.01 AND vix < 20 THEN 'sideways' WHEN vix > 22 AND atr > 0.02 THEN 'high_volatility' ELSE 'sideways' END AS cand FROM i),
g AS (SELECT r.account, r.n, x.regime, x.buys, x.sells, r.k, r.qa, r.qb,
  CASE x.regime WHEN 'sideways' THEN (k + 0.2::DOUBLE) / 1.4::DOUBLE WHEN 'bear_trend' THEN 1 - k END AS q
  FROM r, (VALUES ('bull_trend', true, false), ('bear_trend', false, true), ('sideways', true, true), ('high_volatility', true, true), ('pre_event', false, false)) x(regime, buys, sells)),
p AS (SELECT *, CASE WHEN q IS NULL THEN 1 - k ELSE ((1 - k) + (1 - q)) / 2 END AS down, CASE WHEN q IS NULL THEN k ELSE (k + q) / 2 END AS up FROM g),
a AS (SELECT *, up > down AS upward, ((1 - qa < qa) = (up > down))::INTEGER + ((1 - qb < qb) = (up > down))::INTEGER + coalesce(((1 - q < q) = (up > down))::INTEGER, 0) AS same,
  CASE WHEN q IS NULL THEN 2 ELSE 3 END AS subs FROM p),
c AS (SELECT *, least(greatest(0.0::DOUBLE + greatest(up, down) * 0.30::DOUBLE + same / subs * 0.25::DOUBLE
  + CASE WHEN CASE WHEN up >= down THEN buys ELSE sells END THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * 0.20::DOUBLE + 0.5::DOUBLE * 0.15::DOUBLE + 1.0::DOUBLE * 0.10::DOUBLE, 0.0), 1.0) AS conf FROM a),
ch AS MATERIALIZED (SELECT account, n, regime, conf, CASE WHEN conf < 0.6 THEN 'HOLD' WHEN upward THEN 'BUY' ELSE 'SELL' END AS act,
  CASE WHEN conf >= 0.75 THEN 'execute_full' WHEN conf >= 0.6 THEN 'execute_half' WHEN conf >= 0.5 THEN 'queue_review' ELSE 'none' END AS exe FROM c)"""

_TRIP = f"coalesce({_why('day_pnl', 'capital', 'peak')}, CASE WHEN vix >= 25 THEN 'vix_spike' END)"
_OWN = "list_filter({0}, lambda p : p.symbol = sym)"
_EDGE = "(own.last - own.entry) / own.entry * CASE WHEN own.action = 'BUY' THEN 1 ELSE -1 END"
_KELLY = "least(greatest((0.5::DOUBLE * (0.015::DOUBLE / 0.008::DOUBLE) - 0.5::DOUBLE) / (0.015::DOUBLE / 0.008::DOUBLE) * 0.25::DOUBLE, 0.0), 0.5)"
_SIZE = f"""greatest(least(least({_KELLY}, 0.02::DOUBLE / 0.008::DOUBLE, 0.10::DOUBLE)
  * (CASE regime WHEN 'bull_trend' THEN 1.0::DOUBLE WHEN 'bear_trend' THEN 0.5::DOUBLE WHEN 'sideways' THEN 0.7::DOUBLE WHEN 'high_volatility' THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END
     * CASE WHEN losses >= 3 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) * conf, 0.10::DOUBLE), 0.0) * CASE WHEN exe = 'execute_half' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END"""
_FREE = "greatest(0.0, capital - list_sum(list_prepend(0.0::DOUBLE, list_transform(book, lambda p : p.entry * p.qty))))"
_QTY = f"CAST(floor(({_SIZE}) * least({_FREE}, CASE WHEN cap IS NULL THEN 'inf'::DOUBLE ELSE greatest(cap, 0.0) END) / price) AS BIGINT)"
_KEEP = "account, n, d, ms, sym, price, cap, cand, vix, minute"

_STATES = f"""st AS (
SELECT account, 0::BIGINT AS n, NULL::BIGINT AS d, {_C}::DOUBLE AS capital, {_C}::DOUBLE AS peak, 0.0::DOUBLE AS day_pnl, 0 AS losses, false AS halted,
  NULL::VARCHAR AS regime, NULL::VARCHAR AS pending, 0 AS streak, []::{_POS}[] AS book, []::{_LOG}[] AS log FROM (SELECT DISTINCT account FROM r)
UNION ALL
SELECT account, n, d, capital, peak, day_pnl, losses, halted, regime, pending, streak,
  CASE WHEN opens > 0 THEN list_sort(list_append(book, {{symbol: sym, action: act, qty: opens, entry: {_TICK.format('price')}, last: price}}::{_POS})) ELSE book END,
  CASE WHEN opens > 0 THEN list_append(log, {_row('ms', 'OPEN', 'capital', 'len(book) + 1', 'regime', 'sym', 'act', 'opens', _TICK.format('price'))}) ELSE log END
FROM (SELECT *, CASE WHEN may AND NOT stay AND NOT halted AND len(book) < 5 AND price > 0 THEN {_QTY} ELSE 0 END AS opens
FROM (SELECT {_KEEP}, regime, pending, streak, act, exe, conf, may, stay, {_FIG}, CASE WHEN flip THEN list_filter(book, lambda p : p.symbol <> sym) ELSE book END AS book
FROM (SELECT *, {_fold("CASE WHEN flip THEN " + _OWN.format("book") + f" ELSE []::{_POS}[] END", "ms", "'reversal'", "regime")} AS f
FROM (SELECT *, may AND own IS NOT NULL AND own.action = act AS stay, may AND own IS NOT NULL AND own.action <> act AS flip
FROM (SELECT w.*, ch.act, ch.exe, ch.conf, minute < 900 AND ch.act <> 'HOLD' AND ch.exe NOT IN ('none', 'queue_review') AS may, {_OWN.format("book")}[1] AS own
FROM (SELECT {_KEEP}, regime, pending, streak, {_FIG}, CASE WHEN len(closes) = 0 THEN book WHEN trip IS NOT NULL THEN []::{_POS}[] ELSE list_filter(book, lambda p : p.symbol <> sym) END AS book
FROM (SELECT *, {_fold("closes", "ms", "why", "regime")} AS f
FROM (SELECT * REPLACE (halted OR trip IS NOT NULL AS halted, CASE WHEN trip IS NOT NULL AND NOT halted THEN list_append(log, {_row('ms', 'HALT', 'capital', 'len(book)', 'regime', reason='trip')}) ELSE log END AS log),
  CASE WHEN trip IS NOT NULL THEN book WHEN own IS NOT NULL AND ({_EDGE} >= 0.015 OR {_EDGE} <= -0.008) THEN [own] ELSE []::{_POS}[] END AS closes,
  CASE WHEN trip IS NOT NULL THEN 'circuit_breaker' WHEN {_EDGE} >= 0.015 THEN 'take_profit' ELSE 'stop_loss' END AS why
FROM (SELECT *, {_TRIP} AS trip, {_OWN.format("book")}[1] AS own
FROM (SELECT * REPLACE (CASE WHEN regime IS NULL OR cand = regime OR run >= 5 THEN cand ELSE regime END AS regime,
  CASE WHEN regime IS NULL OR cand = regime OR run >= 5 THEN NULL ELSE cand END AS pending, CASE WHEN regime IS NULL OR cand = regime OR run >= 5 THEN 0 ELSE run END AS streak,
  list_transform(book, lambda p : {{symbol: p.symbol, action: p.action, qty: p.qty, entry: p.entry, last: CASE WHEN p.symbol = sym THEN price ELSE p.last END}}::{_POS}) AS book)
FROM (SELECT *, CASE WHEN cand = pending THEN streak + 1 ELSE 1 END AS run
FROM (SELECT {_KEEP}, f.capital AS capital, f.peak AS peak, CASE WHEN fresh THEN 0.0 ELSE f.day_pnl END AS day_pnl, CASE WHEN fresh THEN 0 ELSE f.losses END AS losses,
  CASE WHEN fresh THEN false ELSE f.halted END AS halted, f.log AS log, CASE WHEN fresh THEN NULL ELSE regime END AS regime, CASE WHEN fresh THEN NULL ELSE pending END AS pending,
  CASE WHEN fresh THEN 0 ELSE streak END AS streak, CASE WHEN due THEN []::{_POS}[] ELSE book END AS book
FROM (SELECT *, {_fold(f"CASE WHEN due THEN book ELSE []::{_POS}[] END", "was + 54900000", "'square_off'", "regime")} AS f
FROM (SELECT st.* REPLACE (r.n AS n, r.d AS d, []::{_LOG}[] AS log), st.d AS was, r.d IS DISTINCT FROM st.d AS fresh, coalesce(len(st.book) > 0 AND r.ms >= st.d + 54900000, false) AS due,
  r.ms, r.symbol AS sym, r.price, r.cap, r.cand, r.vix, r.minute FROM st JOIN r ON r.account = st.account AND r.n = st.n + 1))))))))) w JOIN ch ON ch.account = w.account AND ch.n = w.n AND ch.regime = w.regime)))))),
ends AS (SELECT account, n + 1 AS n, {_fold("book", "d + 54900000", "'square_off'", "regime")}.log AS log
  FROM (SELECT * REPLACE ([]::{_LOG}[] AS log) FROM st) WHERE (account, n) IN (SELECT account, max(n) FROM r GROUP BY account)),
lines AS (SELECT account, n, unnest(log) AS j, generate_subscripts(log, 1) AS i FROM (SELECT account, n, log FROM st UNION ALL SELECT * FROM ends)),
journal AS (SELECT account, row_number() OVER (PARTITION BY account ORDER BY n, i) AS seq, j.ms AS ms, j.kind AS kind, j.symbol AS symbol, j.action AS action, j.qty AS quantity,
  j.price AS price, j.reason AS reason, j.entry AS entry_price, j.pnl AS pnl, j.capital AS capital, j.held AS open_positions, j.regime AS regime FROM lines)"""

_KEYS = "account, seq, ms, kind, symbol, action, reason, open_positions, regime"
QUERIES["stream_trading_journal"] = lambda spark, d: rounded(journal(spark, d).withColumn("quantity", F.col("quantity").cast("double")))
SQL["stream_trading_journal"] = final(f"{_SIGNALS},\n{_STATES}", "SELECT * FROM journal", _KEYS, recursive=True)
QUERIES["stream_trading_accounts"] = lambda spark, d: rounded(tr.account_figures(journal(spark, d)))
SQL["stream_trading_accounts"] = final(
    f"{_SIGNALS},\n{_STATES}",
    """SELECT account, arg_max(capital, seq) AS capital, arg_max(open_positions, seq) AS open_positions, count(*) FILTER (kind = 'CLOSE') AS trades,
  count(*) FILTER (kind = 'CLOSE' AND pnl > 0) AS wins, count(*) FILTER (kind = 'HALT') AS halts, sum(pnl) AS pnl FROM journal GROUP BY account""",
    "account, open_positions, trades, wins, halts", recursive=True,
)


# --- the paper account: half of the symbols resume a saved account with an open tranche, the others are new
EDGES = ("1996-12-31", "1998-06-30", "2000-03-31")
#: The book is shown as of this day, on which tranches are open.
AS_OF = "2001-07-31"


def _saved(days):
    """Accounts saved at the first edge, for symbols of even number, with one tranche entered on the last processed day."""
    old = days.where(f"date <= DATE '{EDGES[0]}' AND CAST(substring(symbol, 7, 2) AS INT) % 2 = 0")
    last = old.groupBy("symbol").agg(F.max_by(F.struct("date", "close", "signal"), "date").alias("d"))
    tranche = F.struct(F.lit(0).cast("long").alias("n"), F.col("d.date").alias("signal_date"), F.col("d.date").alias("entry_date"), F.col("d.close").alias("price"))
    return last.select("symbol", F.lit(0).cast("long").alias("n"), F.col("d.date").alias("last_date"), F.col("d.signal").alias("signal"), F.array(tranche).alias("tranches"))


def _paper_events(spark, d, until="9999-12-31"):
    days = cut_lineage(_signal_days(spark, d).where(f"date <= DATE '{until}'"))
    saved = cut_lineage(_saved(days))
    edges = [F.lit(e).cast("date") for e in EDGES]
    return runner.drain_in_turn(days, "date", lambda s: paper.stream_paper(s, saved), edges=edges)


_TR = "STRUCT(n BIGINT, signal_date DATE, entry_date DATE, price DOUBLE)"
_EV = "STRUCT(kind VARCHAR, t STRUCT(n BIGINT, signal_date DATE, entry_date DATE, price DOUBLE), exit_date DATE, exit_price DOUBLE, open_tranches INTEGER)"
_PAPER = _rule_sql() + f""",
dy AS (SELECT symbol, date, close, coalesce(rank >= 0.8, false) AS signal, CAST(substring(symbol, 7, 2) AS INTEGER) % 2 = 0 AS saved FROM pr WHERE date <= DATE '9999-12-31'),
lt AS (SELECT symbol, max(date) AS last_old, arg_max(close, date) AS last_close FROM dy WHERE date <= DATE '{EDGES[0]}' GROUP BY symbol),
sq AS MATERIALIZED (SELECT dy.*, last_old, row_number() OVER q AS i, lag(signal) OVER q AS fired, lag(date) OVER q AS before
  FROM dy LEFT JOIN lt USING (symbol) WINDOW q AS (PARTITION BY symbol ORDER BY date)),
fi AS MATERIALIZED (SELECT symbol, min(i) FILTER (CASE WHEN saved THEN date > last_old ELSE date = coalesce(last_old, date) END) AS i0 FROM sq GROUP BY symbol),
ac(symbol, i, held, ev) AS (
  SELECT symbol, i0 - 1, CASE WHEN saved THEN [{{n: i0 - 1, signal_date: last_old, entry_date: last_old, price: last_close}}::{_TR}] ELSE []::{_TR}[] END, []::{_EV}[]
  FROM fi JOIN lt USING (symbol) JOIN (SELECT DISTINCT symbol, saved FROM dy) USING (symbol)
  UNION ALL
  SELECT symbol, i, CASE WHEN enters THEN list_append(kept, new) ELSE kept END,
    list_transform(due, lambda t, k : {{kind: 'close', t: t, exit_date: date, exit_price: close, open_tranches: len(kept) + len(due) - k}}::{_EV})
    || CASE WHEN enters THEN [{{kind: 'open', t: new, exit_date: NULL, exit_price: NULL, open_tranches: len(kept) + 1}}::{_EV}] ELSE []::{_EV}[] END
  FROM (SELECT *, coalesce(fired, false) AND len(kept) < 5 AS enters, {{n: i, signal_date: before, entry_date: date, price: close}}::{_TR} AS new
    FROM (SELECT sq.*, list_filter(ac.held, lambda t : sq.i - t.n >= 5) AS due, list_filter(ac.held, lambda t : sq.i - t.n < 5) AS kept
      FROM ac JOIN sq ON sq.symbol = ac.symbol AND sq.i = ac.i + 1))),
ln AS (SELECT symbol, unnest(ev) AS e FROM ac),
pe AS (SELECT symbol, e.kind AS kind, 't-' || e.t.signal_date AS tranche_id, e.t.signal_date AS signal_date, e.t.entry_date AS entry_date, e.t.price AS entry_price,
  CASE WHEN e.t.price > 0 THEN 200000.0 / e.t.price ELSE 0.0 END AS quantity, e.exit_date AS exit_date, e.exit_price AS exit_price, e.open_tranches AS open_tranches FROM ln),
pq AS (SELECT *, CASE WHEN kind = 'close' THEN {pnl_sql("entry_price", "exit_price", "quantity", "false", True)} END AS pnl FROM pe)"""
_PK = "symbol, kind, tranche_id, signal_date, entry_date, exit_date, open_tranches"
QUERIES["stream_paper_account"] = lambda spark, d: rounded(_paper_events(spark, d))
SQL["stream_paper_account"] = final(_PAPER, "SELECT *, pnl / (entry_price * quantity) AS pnl_pct FROM pq", _PK, recursive=True)
QUERIES["paper_open_tranches"] = lambda spark, d: rounded(paper.open_tranches(_paper_events(spark, d, AS_OF)))
SQL["paper_open_tranches"] = final(
    _PAPER.replace("9999-12-31", AS_OF), """SELECT symbol, tranche_id, signal_date, entry_date, entry_price, quantity FROM pq o WHERE kind = 'open'
  AND NOT EXISTS (SELECT 1 FROM pq c WHERE c.kind = 'close' AND c.symbol = o.symbol AND c.tranche_id = o.tranche_id)""",
    "symbol, tranche_id, signal_date, entry_date", recursive=True,
)


# --- volume-weighted price of the session so far, bar by bar
def _running_vwap(spark, d):
    bars = tb.bars_intraday(spark, d).select("symbol", F.col("date").cast("timestamp").alias("date"), "high", "low", "close", "volume")
    out = runner.drain_in_turn(bars, "date", sb.stream_running_vwap)
    return rounded(out.withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm")))


QUERIES["stream_running_vwap"] = _running_vwap
SQL["stream_running_vwap"] = final(
    INTRADAY,
    """SELECT symbol, strftime(date, '%Y-%m-%d %H:%M') AS date, close, volume,
  sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0) AS session_vwap FROM bars
  WINDOW w AS (PARTITION BY symbol, session_date ORDER BY date ROWS UNBOUNDED PRECEDING)""",
    "symbol, date",
)
