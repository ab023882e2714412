"""Indicators over series of bars. Averages of a window are window functions; smoothers run along each series in Arrow batches.

A series (the rows of one key) is ordered by ts. The smoothers EMA, RSI and MACD depend on every earlier value, so a series
is handled by one task; a series is one instrument with one parameter set, some ten thousand bars a year at most.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import ln, quotient


def in_order(by: Sequence[str], ts: str = "ts"):
    return Window.partitionBy(*by).orderBy(ts)


def sma(bars: DataFrame, n: int, by: Sequence[str], value: str = "mid", out: str = "sma") -> DataFrame:
    """Mean of the last n values; null until there are n."""
    w = in_order(by)
    full = F.row_number().over(w) >= n
    return bars.withColumn(out, F.when(full, F.avg(value).over(w.rowsBetween(-(n - 1), 0))))


def bollinger(bars: DataFrame, n: int, width: float, by: Sequence[str], value: str = "mid") -> DataFrame:
    """middle, upper, lower: mean of the last n values, this one included, and width population deviations to either side."""
    w = in_order(by)
    frame, full = w.rowsBetween(-(n - 1), 0), F.row_number().over(w) >= n
    out = bars.withColumn("middle", F.when(full, F.avg(value).over(frame))).withColumn("__sd", F.when(full, F.stddev_pop(value).over(frame)))
    return out.withColumn("upper", F.col("middle") + width * F.col("__sd")).withColumn("lower", F.col("middle") - width * F.col("__sd")).drop("__sd")


def smooth(x: np.ndarray, n: int, alpha: float | None = None) -> np.ndarray:
    """Exponential smoothing seeded by the mean of the first n values; NaN before. alpha: 2 / (n + 1) by default."""
    out = np.full(len(x), np.nan)
    if len(x) < n:
        return out
    a = 2 / (n + 1) if alpha is None else alpha
    s = out[n - 1] = float(np.mean(x[:n]))
    for i in range(n, len(x)):
        s = out[i] = a * x[i] + (1 - a) * s
    return out


def rsi_of(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's relative strength index; NaN for the first n values."""
    change = np.diff(x)
    gain, loss = smooth(np.maximum(change, 0), n, 1 / n), smooth(np.maximum(-change, 0), n, 1 / n)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss))
    return np.concatenate([[np.nan], np.where(np.isnan(gain), np.nan, out)])[: len(x)]


def macd_of(x: np.ndarray, fast: int, slow: int, signal: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, signal line); the signal line is seeded by the first values of the line."""
    line = smooth(x, fast) - smooth(x, slow)
    return line, np.concatenate([np.full(min(slow - 1, len(x)), np.nan), smooth(line[slow - 1 :], signal)])


def along(bars: DataFrame, by: Sequence[str], columns: Sequence[str], run: Callable[[pd.DataFrame], dict[str, np.ndarray]]) -> DataFrame:
    """bars with double columns that run makes from each series in order; NaN becomes null."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields] + [f"{c} double" for c in columns])

    def of(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("ts", kind="stable")
        return series.assign(**run(series))

    out = bars.groupBy(*by).applyInPandas(of, schema)
    return out.withColumns({c: F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)) for c in columns})


def ema(bars: DataFrame, n: int, by: Sequence[str], value: str = "mid", out: str = "ema") -> DataFrame:
    return along(bars, by, [out], lambda s: {out: smooth(s[value].to_numpy(float), n)})


def rsi(bars: DataFrame, n: int, by: Sequence[str], value: str = "mid", out: str = "rsi") -> DataFrame:
    return along(bars, by, [out], lambda s: {out: rsi_of(s[value].to_numpy(float), n)})


def macd(bars: DataFrame, by: Sequence[str], fast: int = 12, slow: int = 26, signal: int = 9, value: str = "mid") -> DataFrame:
    def run(s: pd.DataFrame) -> dict[str, np.ndarray]:
        line, sig = macd_of(s[value].to_numpy(float), fast, slow, signal)
        return {"macd": line, "macd_signal": sig, "macd_hist": line - sig}

    return along(bars, by, ["macd", "macd_signal", "macd_hist"], run)


def bar_ranges(bars: DataFrame, by: Sequence[str]) -> DataFrame:
    """Ranges of a bar's mid prices, in bps: r2 high to low, r3 bid side, r4 open to close, r5 true range (with the close before), r6 Parkinson.

    A price of 0 makes a range infinite, or NaN between two of them.
    """
    mid = lambda s: (F.col(f"bid_{s}") + F.col(f"ask_{s}")) / 2
    before = F.lag(mid("close")).over(in_order(by))
    span = ln(quotient(mid("high"), mid("low")))
    high, low = F.greatest(mid("high"), before), F.least(mid("low"), before)
    return bars.withColumns({
        "r2": span * 1e4, "r3": ln(quotient("bid_high", "bid_low")) * 1e4, "r4": F.abs(ln(quotient(mid("close"), mid("open")))) * 1e4,
        "r5": F.when(before.isNull(), span).otherwise(ln(quotient(high, low))) * 1e4, "r6": span * 1e4 / (2 * F.sqrt(F.log(F.lit(2.0)))),
    })


def hourly_log_return(bars: DataFrame, by: Sequence[str], value: str = "mid") -> DataFrame:
    """ret: log return, in bps, where the bar an hour before exists."""
    w = in_order(by)
    near = F.col("ts") == F.lag("ts").over(w) + F.expr("INTERVAL 1 HOUR")
    return bars.withColumn("ret", F.when(near, ln(quotient(value, F.lag(value).over(w))) * 1e4))


def simple_return(bars: DataFrame, by: Sequence[str], value: str = "mid") -> DataFrame:
    """ret: simple return from the row before; null where that is 0 or missing."""
    before = F.lag(value).over(in_order(by))
    return bars.withColumn("ret", F.try_divide(F.col(value) - before, before))


def crossed(above: Column, w) -> tuple[Column, Column]:
    """(rises, falls) where a state (true, false, null before it is defined) differs from the row before; its first row never does."""
    before = F.lag(above).over(w)
    return F.coalesce(above & ~before, F.lit(False)), F.coalesce(~above & before, F.lit(False))
