"""The daily paper account as a stream that resumes a saved account: open tranches in, opens and closes out.

A symbol without a saved account starts on the latest day of the first micro-batch that has it: the days before are
history, not trades. A symbol with one goes on strictly after its last processed day, with its tranches still open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.functions.costs import DEFAULT_COSTS, CostParams, net_pnl
from tickloom.functions.scalar import div
from tickloom.session import ship_package

DAYS = "symbol string, date date, close double, signal boolean"
#: A saved account: rows processed so far, the last day and whether it signalled, and per tranche the row of its entry.
ACCOUNT = "symbol string, n long, last_date date, signal boolean, tranches array<struct<n: long, signal_date: date, entry_date: date, price: double>>"
EVENTS = (
    "symbol string, kind string, tranche_id string, signal_date date, entry_date date, entry_price double, quantity double, "
    "exit_date date, exit_price double, open_tranches int"
)


class PaperProcessor(StatefulProcessor):
    def __init__(self, hold: int = 5, max_positions: int = 5, capital: float = 1_000_000.0):
        self.hold, self.max_positions, self.notional = hold, max_positions, capital / max_positions

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.day = handle.getValueState("day", "n long, date date, signal boolean")
        self.open = handle.getListState("open", "n long, signal_date date, entry_date date, price double")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        saved = initialState.iloc[0]
        if saved["last_date"] is None or pd.isna(saved["last_date"]):
            return  # never processed: the fresh rule holds
        self.day.update((int(saved["n"]), saved["last_date"], bool(saved["signal"])))
        held = [(int(t["n"]), t["signal_date"], t["entry_date"], float(t["price"])) for t in (saved["tranches"] if saved["tranches"] is not None else [])]
        if held:
            self.open.put(held)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        days = pd.concat(list(rows), ignore_index=True).dropna(subset=["date", "close"]).sort_values("date")
        days = list(days[["date", "close", "signal"]].itertuples(index=False))
        if self.day.exists():
            n, last, signal = self.day.get()
        else:
            # history only sets yesterday's signal; the latest day is the first to be processed
            n, last, signal = -1, None, False
            for date, _, fired in days[:-1]:
                n, last, signal = n + 1, date, bool(fired)
        held = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        out = []
        for date, close, fired in days:
            if last is not None and date <= last:
                continue
            n += 1
            due = [t for t in held if n - t[0] >= self.hold]
            held = [t for t in held if n - t[0] < self.hold]
            for i, t in enumerate(due):
                out.append(self._event(key[0], "close", t, date, float(close), len(held) + len(due) - i - 1))
            if signal and len(held) < self.max_positions:
                held.append((n, last, date, float(close)))
                out.append(self._event(key[0], "open", held[-1], None, None, len(held)))
            last, signal = date, bool(fired)
        if last is not None:
            self.day.update((n, last, signal))
        if held:
            self.open.put(held)
        else:
            self.open.clear()
        yield pd.DataFrame(out, columns=[f.split()[0] for f in EVENTS.split(", ")])

    def _event(self, symbol: str, kind: str, tranche: tuple, exit_date, exit_price, left: int) -> tuple:
        _, signal_date, entry_date, price = tranche
        qty = self.notional / price if price > 0 else 0.0
        return (symbol, kind, f"t-{signal_date}", signal_date, entry_date, price, qty, exit_date, exit_price, left)

    def close(self) -> None:
        pass


def stream_paper(
    days: DataFrame, saved: DataFrame | None = None, hold: int = 5, max_positions: int = 5, capital: float = 1_000_000.0,
    costs: CostParams = DEFAULT_COSTS,
) -> DataFrame:
    """Opens and closes of a stream of DAYS, resuming the saved accounts (at most one row of ACCOUNT a symbol).

    Days may land twice or late: a day not after the symbol's last processed one changes nothing. Rows without a date
    or close are no days; a null signal is none.
    """
    ship_package()
    start = saved.groupBy("symbol") if saved is not None else None
    days = days.withColumn("signal", F.coalesce("signal", F.lit(False)))
    t = days.groupBy("symbol").transformWithStateInPandas(PaperProcessor(hold, max_positions, capital), EVENTS, "Append", "None", initialState=start)
    pnl = F.when(F.col("kind") == "close", net_pnl("entry_price", "exit_price", "quantity", "BUY", True, costs))
    return t.withColumn("pnl", pnl).withColumn("pnl_pct", F.when(pnl.isNotNull(), F.coalesce(div(pnl, F.col("entry_price") * F.col("quantity")), F.lit(0.0))))


def open_tranches(events: DataFrame) -> DataFrame:
    """Tranches that no close has ended yet: what a saved account of these events holds."""
    closed = events.where("kind = 'close'").select("symbol", "tranche_id")
    cols = ["symbol", "tranche_id", "signal_date", "entry_date", "entry_price", "quantity"]
    return events.where("kind = 'open'").select(*cols).join(closed, ["symbol", "tranche_id"], "left_anti")
