"""Transaction-cost model as Column arithmetic: every component stays inside codegen."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CostParams:
    # Fixed rates of the cost schedule.
    brokerage_per_order: float = 20.0
    brokerage_pct_cap: float = 0.0003
    stt_pct: float = 0.001
    stt_delivery_pct: float = 0.001
    gst_pct: float = 0.18
    transaction_charges_pct: float = 0.0000345
    sebi_charges_pct: float = 0.0001
    stamp_duty_pct: float = 0.00015
    slippage_pct: float = 0.0005


DEFAULT_COSTS = CostParams()
# Intraday rate and regulator fee as a deployed configuration sets them.
CONFIGURED_COSTS = CostParams(stt_pct=0.00025, sebi_charges_pct=0.000001)

COMPONENTS = ("brokerage", "stt", "transaction_charges", "gst", "sebi_charges", "stamp_duty", "slippage")


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x)) if isinstance(x, (int, float)) else F.col(x)


def _is_short(side) -> Column:
    return F.lit(side in ("SELL", "SHORT")) if isinstance(side, str) else side.isin("SELL", "SHORT")


def _is_buy(side) -> Column:
    return F.lit(side == "BUY") if isinstance(side, str) else side == F.lit("BUY")


def _leg(price, qty, side, delivery: bool, opening: bool, p: CostParams) -> dict[str, Column]:
    turnover = _col(price) * _col(qty)
    brokerage = F.least(F.lit(p.brokerage_per_order), turnover * p.brokerage_pct_cap)
    charges = turnover * p.transaction_charges_pct
    stt = turnover * (p.stt_delivery_pct if delivery else p.stt_pct)
    stamp = turnover * p.stamp_duty_pct
    short = _is_short(side)
    # The selling leg pays the transaction tax, the buying leg the stamp duty.
    sells = short if opening else ~short
    zero = F.lit(0.0)
    return {
        "brokerage": brokerage,
        "stt": F.when(sells, stt).otherwise(zero),
        "transaction_charges": charges,
        "gst": (brokerage + charges) * p.gst_pct,
        "sebi_charges": turnover * p.sebi_charges_pct,
        "stamp_duty": F.when(sells, zero).otherwise(stamp),
        "slippage": turnover * p.slippage_pct,
    }


def _total(parts: dict[str, Column]) -> Column:
    out = parts[COMPONENTS[0]]
    for name in COMPONENTS[1:]:
        out = out + parts[name]
    return out


def entry_cost(price, qty, side="BUY", delivery=False, p: CostParams = DEFAULT_COSTS) -> Column:
    parts = _leg(price, qty, side, delivery, True, p)
    return F.struct(*[parts[c].alias(c) for c in COMPONENTS], _total(parts).alias("total"))


def exit_cost(price, qty, side="BUY", delivery=False, p: CostParams = DEFAULT_COSTS) -> Column:
    parts = _leg(price, qty, side, delivery, False, p)
    return F.struct(*[parts[c].alias(c) for c in COMPONENTS], _total(parts).alias("total"))


def round_trip_cost(entry, exit_, qty, side="BUY", delivery=False, p: CostParams = DEFAULT_COSTS) -> Column:
    return _total(_leg(entry, qty, side, delivery, True, p)) + _total(_leg(exit_, qty, side, delivery, False, p))


def net_pnl(entry, exit_, qty, side="BUY", delivery=False, p: CostParams = DEFAULT_COSTS) -> Column:
    """P&L after both legs' costs. Every side other than BUY is a short."""
    move = (_col(exit_) - _col(entry)) * _col(qty)
    gross = F.when(_is_buy(side), move).otherwise(-move)
    return gross - round_trip_cost(entry, exit_, qty, side, delivery, p)


def round_trip_cost_pct(price: float = 1000.0, qty: float = 5.0, p: CostParams = DEFAULT_COSTS) -> float:
    """Cost of a representative delivery round trip as a share of its notional (a plan-time constant)."""
    t = price * qty
    brokerage = min(p.brokerage_per_order, t * p.brokerage_pct_cap)
    charges = t * p.transaction_charges_pct
    shared = brokerage + charges + (brokerage + charges) * p.gst_pct + t * (p.sebi_charges_pct + p.slippage_pct)
    return (2 * shared + t * (p.stamp_duty_pct + p.stt_delivery_pct)) / t
