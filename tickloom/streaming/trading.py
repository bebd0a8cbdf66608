"""The decision cycle of trading accounts as a stream: regime, blended signal, breakers, exits, sizing, orders, session end.

What does not depend on earlier rows is columns: the regime candidate, and for each regime the signal that it would give.
The keyed processor keeps what does: the account's figures, its regime with hysteresis, and its book of open positions.
Every change of that state is a journal row, so the book and the figures can be read from the journal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.functions.scalar import composite_confidence
from tickloom.operators import regimes as rg
from tickloom.session import ship_package
from tickloom.streaming.accounts import AccountRules, _leg

ROWS = (
    "account string, ts timestamp, symbol string, price double, probabilities array<double>, "
    "by_regime map<string, array<double>>, sub_models map<string, array<double>>, indicators map<string, double>, capital_cap double"
)
JOURNAL = (
    "account string, seq long, ms long, kind string, symbol string, action string, quantity long, price double, "
    "reason string, entry_price double, pnl double, capital double, open_positions int, regime string"
)
_FIGURES = (
    "ms long, last_symbol string, day long, capital double, peak double, day_pnl double, losses int, halted boolean, "
    "regime string, pending string, streak int, seq long, held int"
)
_POSITION = "action string, quantity long, entry double, last double"
MINUTE, DAY = 60_000, 86_400_000


def _pick(p: Column) -> Column:
    return F.array_position(p, F.array_max(p)) - 1


def regime_choice(regime: str, min_threshold: float = 0.60) -> Column:
    """Signal of a row if this regime holds: the regime's own model is averaged in and counts as a sub-model."""
    own = F.try_element_at("by_regime", F.lit(regime))
    p = F.when(own.isNull(), F.col("probabilities")).otherwise(F.zip_with("probabilities", own, lambda x, y: (x + y) / 2))
    subs = F.coalesce(F.map_values("sub_models"), F.array().cast("array<array<double>>"))
    subs = F.when(own.isNull(), subs).otherwise(F.array_append(subs, own))
    same = F.size(F.filter(subs, lambda q: _pick(q) == _pick(p)))
    agreement = F.when(F.size(subs) > 0, same / F.size(subs)).otherwise(0.5)
    leaning = F.when(F.try_element_at(p, F.lit(-1)) >= F.try_element_at(p, F.lit(1)), "BUY").otherwise("SELL")
    aligned = rg.strategy_allowed(F.lit(regime), rg.infer_strategy(F.lit(regime), leaning))
    conf = composite_confidence(F.array_max(p), agreement, F.when(aligned, 1.0).otherwise(0.0), F.lit(0.5), F.lit(1.0))
    action = F.when(conf < min_threshold, "HOLD").when(_pick(p) == 0, "SELL").when(_pick(p) == 1, "BUY").otherwise("HOLD")
    execution = F.lit("none")
    for low, _, act in reversed(rg.TIERS):
        execution = F.when(conf >= low, act).otherwise(execution)
    return F.struct(F.coalesce(action, F.lit("HOLD")).alias("action"), execution.alias("execution"), conf.alias("confidence"))


def decision_rows(rows: DataFrame) -> DataFrame:
    """What the processor reads of a row: clock, price, regime candidate, volatility index and one choice per regime."""
    return rows.select(
        "account", "ts", F.unix_millis("ts").alias("ms"), "symbol", "price", "capital_cap",
        rg.match_regime("indicators").alias("candidate"), F.try_element_at("indicators", F.lit("india_vix")).alias("vix"),
        *(regime_choice(r).alias(r) for r in rg.MULTIPLIER),
    )


class Cycle:
    """One account between rows; `book` is symbol -> [action, quantity, entry, last price]."""

    def __init__(self, account: str, rules: AccountRules, figures: tuple | None, book: dict[str, list], vix_limit: float, cooldown: int):
        self.account, self.r, self.book, self.vix_limit, self.cooldown = account, rules, book, vix_limit, cooldown
        f = figures or (None, None, None, rules.capital, rules.capital, 0.0, 0, False, None, None, 0, 0, 0)
        self.ms, self.last_symbol, self.day, self.capital, self.peak, self.day_pnl, self.losses, self.halted = f[:8]
        self.regime, self.pending, self.streak, self.seq = f[8:12]
        self.journal: list[tuple] = []

    def figures(self) -> tuple:
        return (
            self.ms, self.last_symbol, self.day, self.capital, self.peak, self.day_pnl, self.losses, self.halted,
            self.regime, self.pending, self.streak, self.seq, len(self.book),
        )

    def _tick(self, x: float) -> float:
        return round(round(x / self.r.tick) * self.r.tick, 2)

    def _log(self, ms, kind, symbol=None, action=None, quantity=None, price=None, reason=None, entry=None, pnl=None) -> None:
        self.seq += 1
        self.journal.append((self.account, self.seq, ms, kind, symbol, action, quantity, price, reason, entry, pnl, self.capital, len(self.book), self.regime))

    def square_off_at(self) -> int:
        return self.day + self.r.square_off_minute * MINUTE

    def _trips(self, vix: float | None) -> str | None:
        fall = (self.peak - self.capital) / self.peak if self.peak > 0 else 0.0
        if -self.day_pnl / self.r.capital >= self.r.daily_loss:
            return "daily_loss"
        if fall >= self.r.max_drawdown:
            return "max_drawdown"
        return "vix_spike" if vix is not None and vix >= self.vix_limit else None

    def _check(self, ms: int, vix: float | None) -> str | None:
        why = self._trips(vix)
        if why and not self.halted:
            self.halted = True
            self._log(ms, "HALT", reason=why)
        return why

    def _close(self, ms: int, symbol: str, price: float, reason: str) -> None:
        action, qty, entry, _ = self.book.pop(symbol)
        out, buy = self._tick(price), action == "BUY"
        gross = (out - entry if buy else entry - out) * qty
        pnl = gross - _leg(entry * qty, not buy, self.r.costs) - _leg(out * qty, buy, self.r.costs)
        self.capital += pnl
        self.day_pnl += pnl
        self.peak = max(self.peak, self.capital)
        self.losses = self.losses + 1 if pnl < 0 else 0
        self._log(ms, "CLOSE", symbol, action, qty, out, reason, entry, pnl)
        self._check(ms, None)

    def close_all(self, ms: int, reason: str) -> None:
        for symbol in sorted(self.book):
            self._close(ms, symbol, self.book[symbol][3], reason)

    def expire(self, now: int) -> None:
        """The clock has reached `now` without a row: what is open at the square-off time is closed then."""
        if self.book and now >= self.square_off_at():
            self.close_all(self.square_off_at(), "square_off")

    def _see_regime(self, candidate: str) -> None:
        if self.regime is None or candidate == self.regime:
            self.regime, self.pending, self.streak = candidate, None, 0
            return
        self.streak = self.streak + 1 if candidate == self.pending else 1
        self.pending = candidate
        if self.streak >= self.cooldown:
            self.regime, self.pending, self.streak = candidate, None, 0

    def step(self, ms: int, symbol: str, price: float, candidate: str, vix: float | None, cap: float | None, choices: dict) -> None:
        if self.ms is not None and (ms, symbol) <= (self.ms, self.last_symbol):
            return  # seen before, or older than what has been decided
        r, day = self.r, ms - ms % DAY
        if self.day is not None:
            self.expire(ms)
        if day != self.day:
            self.day, self.day_pnl, self.losses, self.halted = day, 0.0, 0, False
            self.regime, self.pending, self.streak = None, None, 0
        self.ms, self.last_symbol = ms, symbol
        self._see_regime(candidate)
        if symbol in self.book:
            self.book[symbol][3] = price
        if self._check(ms, vix):
            self.close_all(ms, "circuit_breaker")
        elif symbol in self.book:
            held, _, entry, _ = self.book[symbol]
            move = (price - entry) / entry * (1 if held == "BUY" else -1)
            if move >= r.profit_target or move <= -r.stop_loss:
                self._close(ms, symbol, price, "take_profit" if move >= r.profit_target else "stop_loss")
        minute = (ms - day) / MINUTE
        action, execution, confidence = choices[self.regime]
        if minute >= min(r.last_entry_minute, r.square_off_minute) or action == "HOLD" or execution in ("none", "queue_review"):
            return
        if symbol in self.book:
            if self.book[symbol][0] == action:
                return
            self._close(ms, symbol, price, "reversal")
        if self.halted or len(self.book) >= r.max_open or price <= 0:
            return
        ratio = r.avg_win / r.avg_loss
        kelly = max(0.0, min((r.win_rate * ratio - (1 - r.win_rate)) / ratio * r.kelly_part, 0.5))
        size = min(kelly, r.max_risk_pct / max(r.avg_loss, 1e-6), r.max_position_pct)
        size *= rg.MULTIPLIER[self.regime] * (0.5 if self.losses >= r.loss_streak else 1.0)
        size = max(0.0, min(size * max(0.0, min(confidence, 1.0)), r.max_position_pct))
        size *= 0.5 if execution == "execute_half" else 1.0
        free = max(0.0, self.capital - sum(e * q for _, q, e, _ in self.book.values()))
        if cap is not None:
            free = min(free, max(0.0, cap))
        qty = math.floor(size * free / price)
        if qty > 0:
            self.book[symbol] = [action, qty, self._tick(price), price]
            self._log(ms, "OPEN", symbol, action, qty, self._tick(price))


class TradingProcessor(StatefulProcessor):
    def __init__(self, rules: AccountRules = AccountRules(), vix_limit: float = 25.0, cooldown: int = rg.COOLDOWN):
        self.rules, self.vix_limit, self.cooldown = rules, vix_limit, max(cooldown, 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("figures", _FIGURES)
        self.positions = handle.getMapState("book", "symbol string", _POSITION)

    def _load(self, key) -> Cycle:
        figures = tuple(self.state.get()) if self.state.exists() else None
        # an account without positions has an empty book; reading it is not worth a round trip
        book = {k[0]: list(v) for k, v in self.positions.iterator()} if figures and figures[12] else {}
        self.before = {k: list(v) for k, v in book.items()}
        return Cycle(key[0], self.rules, figures, book, self.vix_limit, self.cooldown)

    def _store(self, c: Cycle) -> pd.DataFrame:
        for symbol in self.before.keys() - c.book.keys():
            self.positions.removeKey((symbol,))
        for symbol, p in c.book.items():
            if self.before.get(symbol) != p:
                self.positions.updateValue((symbol,), tuple(p))
        self.state.update(c.figures())
        # one timer while anything is open, at the day's square-off
        wanted = {c.square_off_at()} if c.book else set()
        known = set(self.handle.listTimers())
        for t in known - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - known:
            self.handle.registerTimer(t)
        return pd.DataFrame(c.journal, columns=[f.split()[0] for f in JOURNAL.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        c = self._load(key)
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["ms", "symbol"])
        regimes = list(rg.MULTIPLIER)
        known = lambda x: None if pd.isna(x) else float(x)
        for row in pdf.to_dict("records"):
            choices = {r: (row[r]["action"], row[r]["execution"], row[r]["confidence"]) for r in regimes}
            c.step(int(row["ms"]), row["symbol"], float(row["price"]), row["candidate"], known(row["vix"]), known(row["capital_cap"]), choices)
        yield self._store(c)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        c = self._load(key)
        c.expire(expiredTimerInfo.getExpiryTimeInMs())
        yield self._store(c)

    def close(self) -> None:
        pass


def stream_trading(
    rows: DataFrame, rules: AccountRules = AccountRules(), vix_limit: float = 25.0, cooldown: int = rg.COOLDOWN, lateness: str = "10 minutes"
) -> DataFrame:
    """Journal of a stream of ROWS; a row later than the watermark, or not after its account's last one, is not traded.

    Positions open at the square-off time are closed at that time and at their last price: by the next row of their
    account, or by a timer once the watermark has passed it. Null prices and null accounts are not traded.
    """
    ship_package()
    good = rows.where("price IS NOT NULL AND account IS NOT NULL AND symbol IS NOT NULL AND ts IS NOT NULL")
    read = decision_rows(good.withWatermark("ts", lateness))
    return read.groupBy("account").transformWithStateInPandas(TradingProcessor(rules, vix_limit, cooldown), JOURNAL, "Append", "EventTime")


def open_positions(journal: DataFrame) -> DataFrame:
    """The book that a journal leaves: orders that nothing closed. One aggregate, no state."""
    signed = F.when(F.col("kind") == "OPEN", F.col("quantity")).otherwise(-F.col("quantity"))
    last = F.max_by(F.when(F.col("kind") == "OPEN", F.struct("action", "quantity", "price", "ms")), "seq")
    held = journal.where("symbol IS NOT NULL").groupBy("account", "symbol").agg(F.sum(signed).alias("_left"), last.alias("_o"))
    return held.where("_left > 0").select("account", "symbol", "_o.action", "_o.quantity", F.col("_o.price").alias("entry_price"), F.col("_o.ms").alias("ms"))


def account_figures(journal: DataFrame) -> DataFrame:
    """Per account the figures after its last journal row, with trades, wins and halts."""
    last = lambda c: F.max_by(c, "seq").alias(c)
    closed = F.col("kind") == "CLOSE"
    return journal.groupBy("account").agg(
        last("capital"), last("open_positions"), F.count_if(closed).alias("trades"), F.count_if(closed & (F.col("pnl") > 0)).alias("wins"),
        F.count_if(F.col("kind") == "HALT").alias("halts"), F.sum("pnl").alias("pnl"),
    )


def equity_by_day(journal: DataFrame) -> DataFrame:
    """Per account and day: result, and capital at the day's end."""
    day = F.to_date(F.timestamp_millis("ms")).alias("day")
    w = Window.partitionBy("account").orderBy("day")
    daily = journal.groupBy("account", day).agg(F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("pnl"), F.max_by("capital", "seq").alias("capital"))
    return daily.withColumn("change", F.col("capital") - F.lag("capital").over(w))
