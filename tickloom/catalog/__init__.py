"""Registry: every query with its Spark callable and, where SQL can say it, its oracle text."""

from importlib import import_module

MODULES = ("features_cat", "data_cat", "backtest_cat", "flow_cat", "risk_cat", "learning_cat", "streaming_cat", "trading_cat", "sources_cat")


def collect(attr: str) -> dict:
    out: dict = {}
    for m in MODULES:
        part = getattr(import_module(f"tickloom.catalog.{m}"), attr)
        clash = set(out) & set(part)
        if clash:
            raise ValueError(f"duplicate query names: {sorted(clash)}")
        out |= part
    return out
