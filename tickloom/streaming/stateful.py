"""Keyed state processors: the daily tranche account, regime hysteresis, and the decision cycle of an account.

Each processor sorts the rows of its key inside a micro-batch by event time and keeps only what later rows need.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.functions.costs import DEFAULT_COSTS, CostParams, net_pnl
from tickloom.session import ship_package
from tickloom.streaming.accounts import Account, AccountRules

TRADE_SCHEMA = "symbol string, signal_date date, entry_date date, entry_price double, quantity double, exit_date date, exit_price double"
REGIME_SCHEMA = "symbol string, date date, candidate string, regime string"
DECISION_SCHEMA = (
    "account string, symbol string, action string, quantity long, entry_time timestamp, entry_price double, "
    "exit_time timestamp, exit_price double, exit_reason string, pnl double"
)


def _frames(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True)


class TrancheProcessor(StatefulProcessor):
    """Steps one instrument day by day: close what is due, then enter on yesterday's signal if a slot is free."""

    def __init__(self, hold: int = 5, max_positions: int = 5, capital: float = 1_000_000.0):
        self.hold, self.max_positions, self.notional = hold, max_positions, capital / max_positions

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.day = handle.getValueState("day", "n long, date date, signal boolean")
        self.open = handle.getListState("open", "n long, signal_date date, entry_date date, price double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, last, signal = self.day.get() if self.day.exists() else (-1, None, False)
        held = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        out = []
        for date, close, fired in _frames(rows).sort_values("date")[["date", "close", "signal"]].itertuples(index=False):
            if last is not None and date <= last:
                continue  # strictly after the last processed day
            n += 1
            for t in [t for t in held if n - t[0] >= self.hold]:
                qty = self.notional / t[3] if t[3] > 0 else 0.0
                out.append((key[0], t[1], t[2], t[3], qty, date, close))
            held = [t for t in held if n - t[0] < self.hold]
            if signal and len(held) < self.max_positions:
                held.append((n, last, date, float(close)))
            last, signal = date, bool(fired)
        self.day.update((n, last, signal))
        if held:
            self.open.put(held)
        else:
            self.open.clear()
        cols = ["symbol", "signal_date", "entry_date", "entry_price", "quantity", "exit_date", "exit_price"]
        yield pd.DataFrame(out, columns=cols)

    def close(self) -> None:
        pass


def stream_tranches(days: DataFrame, hold: int = 5, max_positions: int = 5, capital: float = 1_000_000.0, costs: CostParams = DEFAULT_COSTS) -> DataFrame:
    """Closed trades of a stream of (symbol, date, close, signal)."""
    ship_package()
    t = days.groupBy("symbol").transformWithStateInPandas(
        TrancheProcessor(hold, max_positions, capital), TRADE_SCHEMA, "Append", "None"
    )
    return t.withColumn("pnl", net_pnl("entry_price", "exit_price", "quantity", "BUY", True, costs)).withColumn(
        "pnl_pct", F.col("pnl") / (F.col("entry_price") * F.col("quantity"))
    )


class RegimeProcessor(StatefulProcessor):
    def __init__(self, cooldown: int = 5):
        self.cooldown = max(cooldown, 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "regime string, pending string, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        regime, pending, n = self.state.get() if self.state.exists() else (None, None, 0)
        pdf = _frames(rows).sort_values("date")
        shown = []
        for cand in pdf["candidate"]:
            if regime is None or cand == regime:
                regime, pending, n = cand, None, 0
            else:
                n = n + 1 if cand == pending else 1
                pending = cand
                if n >= self.cooldown:
                    regime, pending, n = cand, None, 0
            shown.append(regime)
        self.state.update((regime, pending, n))
        yield pdf[["symbol", "date", "candidate"]].assign(regime=shown)

    def close(self) -> None:
        pass


def stream_regimes(candidates: DataFrame, cooldown: int = 5) -> DataFrame:
    ship_package()
    return candidates.groupBy("symbol").transformWithStateInPandas(RegimeProcessor(cooldown), REGIME_SCHEMA, "Append", "None")


class DecisionProcessor(StatefulProcessor):
    """Decision cycle of one account; capital is shared by its symbols, so the account is the key."""

    def __init__(self, rules: AccountRules = AccountRules()):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "doc string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        acct = Account(self.rules, json.loads(self.state.get()[0]) if self.state.exists() else None)
        yield decide(key[0], acct, _frames(rows))
        self.state.update((json.dumps(acct.doc()),))

    def close(self) -> None:
        pass


def decide(name: str, acct: Account, pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for r in pdf.sort_values(["ts", "symbol"]).itertuples(index=False):
        out += acct.step(r.ts, r.symbol, float(r.price), float(r.confidence), r.action, r.execution, float(r.multiplier))
    cols = ["symbol", "action", "quantity", "entry_time", "entry_price", "exit_time", "exit_price", "exit_reason", "pnl"]
    done = pd.DataFrame(out, columns=cols)
    done.insert(0, "account", name)
    for c in ("entry_time", "exit_time"):
        done[c] = pd.to_datetime(done[c])
    return done


def stream_decisions(signals: DataFrame, rules: AccountRules = AccountRules()) -> DataFrame:
    """Closed trades of a stream of (account, ts, symbol, price, confidence, action, execution, multiplier)."""
    ship_package()
    return signals.groupBy("account").transformWithStateInPandas(DecisionProcessor(rules), DECISION_SCHEMA, "Append", "None")


def batch_decisions(signals: DataFrame, rules: AccountRules = AccountRules()) -> DataFrame:
    """The same cycle over a finished table of one session per account."""
    ship_package()
    return signals.groupBy("account").applyInPandas(
        lambda key, pdf: decide(key[0], Account(rules), pdf), DECISION_SCHEMA
    )
