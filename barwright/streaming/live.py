"""Live bars: ticks to bars under a watermark, indicators with state by series, and an idempotent upsert sink.

A bar that is not later than the last one its series has seen is late and dropped; state is a few numbers a series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bars_from_ticks(ticks: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """instrument, ts, open, high, low, close, volume from ticks (instrument, ts, tick_id, price); ticks later than late are dropped."""
    key = F.struct("ts", "tick_id")
    g = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("instrument", F.window("ts", width).alias("w"))
    out = g.agg(F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.count(F.lit(1)).alias("volume"))
    return out.select("instrument", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


OUT = "instrument string, ts timestamp, mid double, ema double, rsi double, signal string"
STATE = "last_ts timestamp, seen long, last double, seed double, ema double, gain double, loss double, rsi double"


def _step(state: list, ts, mid: float, n: int, low: float, high: float) -> tuple:
    """One bar: state is [last_ts, seen, last, seed, ema, gain, loss, rsi]; the same recursions as those of the batch indicators."""
    _, seen, last, seed, ema, gain, loss, rsi = state
    seen += 1
    seed += mid if seen <= n else 0.0
    ema = None if seen < n else seed / n if seen == n else ema + 2 / (n + 1) * (mid - ema)
    before = rsi
    if seen > 1:
        up, down = max(mid - last, 0.0), max(last - mid, 0.0)
        if seen <= n + 1:
            gain, loss = gain + up, loss + down
            if seen == n + 1:
                gain, loss = gain / n, loss / n
        else:
            gain, loss = (gain * (n - 1) + up) / n, (loss * (n - 1) + down) / n
        if seen > n:
            rsi = 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)
    signal = None
    if before is not None and rsi is not None:
        signal = "BUY" if before <= low < rsi else "SELL" if before >= high > rsi else None
    state[:] = [ts, seen, mid, seed, ema, gain, loss, rsi]
    return ts, mid, ema, rsi, signal


def live_indicators(bars: DataFrame, n: int = 14, low: float = 30.0, high: float = 70.0) -> DataFrame:
    """A stream of instrument, ts, mid to OUT: EMA and Wilder's RSI over n bars and the RSI reversal signal."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else [None, 0, None, 0.0, None, 0.0, 0.0, None]
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")  # a series' bars of one micro-batch
        out = []
        for ts, mid in zip(rows["ts"], rows["mid"]):
            if now[0] is None or ts > now[0]:
                out.append((key[0], *_step(now, ts, float(mid), n, low, high)))
        state.update(tuple(now))
        yield pd.DataFrame(out, columns=["instrument", "ts", "mid", "ema", "rsi", "signal"])

    b = bars.select("instrument", F.col("ts").cast("timestamp").alias("ts"), "mid")
    return b.groupBy("instrument").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def upsert_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch has a folder of its own, so that a batch which is repeated replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_upserted(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last batch's row of each key."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")
