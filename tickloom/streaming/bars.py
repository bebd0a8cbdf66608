"""Bars and session VWAP from a tick stream, closed by the watermark; later rows are dropped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.session import ship_package

TICK_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def ticks(stream: DataFrame) -> DataFrame:
    """symbol, ts, value, size, and seq: the order of all ticks, by time and then id, as one number of 38 digits."""
    ts = F.col("ts").cast("timestamp")
    wide = lambda c: c.cast("decimal(19,0)")
    seq = (wide(F.unix_micros(ts)) * F.lit(10**18).cast("decimal(19,0)") * 10 + wide(F.col("event_id"))).cast("decimal(38,0)")
    size = (F.col("user_id") % 7 + 1).cast("double")
    return stream.select(ts.alias("ts"), F.col("event_type").alias("symbol"), "value", size.alias("size"), seq.alias("seq"))


def stream_bars(stream: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """OHLC per symbol and window; state per open window is five numbers."""
    return (
        ticks(stream)
        .withWatermark("ts", lateness)
        .groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("value", "seq").alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", "seq").alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("date"), "open", "high", "low", "close", "volume")
    )


def stream_session_vwap(stream: DataFrame, price: str = "value", size: str = "size", lateness: str = "10 minutes") -> DataFrame:
    """Price weighted by traded size per symbol and calendar session, emitted when the session is over."""
    return (
        ticks(stream)
        .withWatermark("ts", lateness)
        .groupBy("symbol", F.window("ts", "1 day").alias("w"))
        .agg((F.sum(F.col(price) * F.col(size)) / F.nullif(F.sum(size), F.lit(0.0))).alias("session_vwap"), F.count(F.lit(1)).alias("n_ticks"))
        .select("symbol", F.to_date("w.start").alias("session_date"), "session_vwap", "n_ticks")
    )


class VwapProcessor(StatefulProcessor):
    """Running sums of one session of a symbol; a timer drops them when the watermark has passed the session's day."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "ms long, value double, volume double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, value, volume = self.sums.get() if self.sums.exists() else (None, 0.0, 0.0)
        bars = pd.concat(list(rows), ignore_index=True).sort_values("ms")
        if last is not None:
            bars = bars[bars["ms"] > last]  # a bar that lands again changes nothing
        vwap = np.empty(0)
        if len(bars):
            size = bars["volume"].fillna(0.0).to_numpy()
            money = np.cumsum(np.append(value, bars["typical"].fillna(0.0).to_numpy() * size))
            traded = np.cumsum(np.append(volume, size))
            self.sums.update((int(bars["ms"].iloc[-1]), float(money[-1]), float(traded[-1])))
            end = (int(bars["ms"].iloc[-1]) // 86_400_000 + 1) * 86_400_000
            if end not in set(self.handle.listTimers()):
                self.handle.registerTimer(end)
            vwap = np.divide(money[1:], traded[1:], out=np.full(len(bars), np.nan), where=traded[1:] != 0)
        yield self._rows(key[0], bars["ms"].to_numpy(np.int64), bars["close"].to_numpy(float), bars["volume"].to_numpy(float), vwap)

    @staticmethod
    def _rows(symbol: str, *columns: np.ndarray) -> pd.DataFrame:
        names = ("ms", "close", "volume", "session_vwap")
        return pd.DataFrame({"symbol": np.full(len(columns[0]), symbol, object)} | dict(zip(names, columns, strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.sums.clear()
        yield self._rows(key[0], np.empty(0, np.int64), *[np.empty(0)] * 3)

    def close(self) -> None:
        pass


def stream_running_vwap(bars: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Per bar the volume-weighted typical price of its session so far, as each bar arrives.

    Bars have symbol, date (their time), high, low, close, volume. Bars of a session arrive in order of time over the
    micro-batches; a session's state is two sums and lives until the watermark has left its day.
    """
    ship_package()
    ts = F.col("date").cast("timestamp")
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    read = bars.select("symbol", ts.alias("ts"), F.to_date(ts).alias("session"), F.unix_millis(ts).alias("ms"), "close", "volume", typical.alias("typical"))
    read = read.withWatermark("ts", lateness)
    out = read.groupBy("symbol", "session").transformWithStateInPandas(
        VwapProcessor(), "symbol string, ms long, close double, volume double, session_vwap double", "Append", "EventTime"
    )
    return out.select("symbol", F.timestamp_millis("ms").alias("date"), "close", "volume", F.nullif(F.nanvl("session_vwap", F.lit(float("-inf"))), F.lit(float("-inf"))).alias("session_vwap"))
