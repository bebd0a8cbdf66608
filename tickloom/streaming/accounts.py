"""State of one trading account: what a single decision row does to it."""

from __future__ import annotations

from dataclasses import dataclass

from tickloom.functions.costs import DEFAULT_COSTS, CostParams


@dataclass(frozen=True)
class AccountRules:
    # Fixed defaults of sizing, exits, breakers and session times.
    capital: float = 1_000_000.0
    max_position_pct: float = 0.10
    max_risk_pct: float = 0.02
    kelly_part: float = 0.25
    win_rate: float = 0.5
    avg_win: float = 0.015
    avg_loss: float = 0.008
    profit_target: float = 0.015
    stop_loss: float = 0.008
    daily_loss: float = 0.03
    max_drawdown: float = 0.12
    loss_streak: int = 3
    max_open: int = 5
    last_entry_minute: int = 900
    square_off_minute: int = 915
    tick: float = 0.05
    costs: CostParams = DEFAULT_COSTS


def _leg(t: float, sells: bool, p: CostParams) -> float:
    b, x = min(p.brokerage_per_order, t * p.brokerage_pct_cap), t * p.transaction_charges_pct
    tax = p.stt_pct if sells else p.stamp_duty_pct
    return b + x + (b + x) * p.gst_pct + t * (p.sebi_charges_pct + p.slippage_pct + tax)


class Account:
    """Capital, day figures and open positions, kept as one JSON document between rows."""

    def __init__(self, rules: AccountRules, doc: dict | None = None):
        self.r = rules
        d = doc or {}
        self.capital, self.peak = d.get("capital", rules.capital), d.get("peak", rules.capital)
        self.day, self.day_pnl = d.get("day"), d.get("day_pnl", 0.0)
        self.losses, self.halted = d.get("losses", 0), d.get("halted", False)
        self.open: dict[str, list] = d.get("open", {})
        self.prices: dict[str, float] = d.get("prices", {})

    def doc(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "r"}

    def _tick(self, x: float) -> float:
        return round(round(x / self.r.tick) * self.r.tick, 2)

    def _breaker(self) -> bool:
        loss = -self.day_pnl / self.r.capital
        fall = (self.peak - self.capital) / self.peak if self.peak > 0 else 0.0
        self.halted = self.halted or loss >= self.r.daily_loss or fall >= self.r.max_drawdown
        return loss >= self.r.daily_loss or fall >= self.r.max_drawdown

    def _close(self, ts, symbol: str, price: float, reason: str) -> tuple:
        action, qty, entry, since = self.open.pop(symbol)
        out = self._tick(price)
        buy = action == "BUY"
        gross = (out - entry if buy else entry - out) * qty
        pnl = gross - _leg(entry * qty, not buy, self.r.costs) - _leg(out * qty, buy, self.r.costs)
        self.capital += pnl
        self.day_pnl += pnl
        self.peak = max(self.peak, self.capital)
        self.losses = self.losses + 1 if pnl < 0 else 0
        self._breaker()
        return (symbol, action, qty, since, entry, str(ts), out, reason, pnl)

    def step(self, ts, symbol: str, price: float, confidence: float, action: str, execution: str, multiplier: float) -> list[tuple]:
        """Closed trades caused by one row: daily reset, breaker, exits, square-off, then a possible entry."""
        done, r = [], self.r
        day, minute = str(ts.date()), ts.hour * 60 + ts.minute
        self.prices[symbol] = price
        if day != self.day:
            self.day, self.day_pnl, self.losses, self.halted = day, 0.0, 0, False
        if self._breaker():
            done += [self._close(ts, s, self.prices[s], "circuit_breaker") for s in list(self.open) if s in self.prices]
        elif symbol in self.open:
            held, _, entry, _ = self.open[symbol]
            move = (price - entry) / entry * (1 if held == "BUY" else -1)
            if move >= r.profit_target or move <= -r.stop_loss:
                done.append(self._close(ts, symbol, price, "take_profit" if move >= r.profit_target else "stop_loss"))
        if minute >= r.square_off_minute:
            return done + [self._close(ts, s, self.prices[s], "square_off") for s in list(self.open)]
        if minute > r.last_entry_minute or action == "HOLD" or execution not in ("execute_full", "execute_half"):
            return done
        if symbol in self.open:
            if self.open[symbol][0] == action:
                return done
            done.append(self._close(ts, symbol, price, "reversal"))
        if self.halted or len(self.open) >= r.max_open or price <= 0:
            return done
        ratio = r.avg_win / r.avg_loss
        kelly = max(0.0, min((r.win_rate * ratio - (1 - r.win_rate)) / ratio * r.kelly_part, 0.5))
        streak = 0.5 if self.losses >= r.loss_streak else 1.0
        size = min(kelly, r.max_risk_pct / max(r.avg_loss, 1e-6), r.max_position_pct) * multiplier * streak
        size = max(0.0, min(size * max(0.0, min(confidence, 1.0)), r.max_position_pct))
        size *= 0.5 if execution == "execute_half" else 1.0
        committed = sum(e * q for _, q, e, _ in self.open.values())
        qty = int(size * max(0.0, self.capital - committed) // price)
        if qty > 0:
            self.open[symbol] = [action, qty, self._tick(price), str(ts)]
        return done
