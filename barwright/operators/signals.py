"""Strategies: bars of series to a column signal (BUY, SELL, CLOSE or null for hold)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .indicators import bollinger, crossed, in_order, macd, rsi, sma


def _signal(buy: Column, sell: Column, go_short: bool = True) -> Column:
    return F.when(buy, "BUY").when(sell, "SELL" if go_short else "CLOSE")


def sma_cross(bars: DataFrame, fast: int, slow: int, by: Sequence[str], go_short: bool = True) -> DataFrame:
    """The fast mean rises over the slow one, or falls to it or below; equal counts as not above."""
    if fast >= slow:
        raise ValueError("fast must be less than slow")
    out = sma(sma(bars, fast, by, out="sma_fast"), slow, by, out="sma_slow")
    out = out.withColumn("__above", F.when(F.col("sma_slow").isNotNull(), F.col("sma_fast") > F.col("sma_slow")))
    buy, sell = crossed(F.col("__above"), in_order(by))
    return out.withColumn("signal", _signal(buy, sell, go_short)).drop("__above")


def bollinger_reversal(bars: DataFrame, by: Sequence[str], n: int = 20, width: float = 2.0, go_short: bool = True) -> DataFrame:
    """zone: below_lower, above_upper or inside; leaving below_lower buys, leaving above_upper sells."""
    out = bollinger(bars, n, width, by)
    zone = F.when(F.col("mid") < F.col("lower"), "below_lower").when(F.col("mid") > F.col("upper"), "above_upper")
    out = out.withColumn("zone", F.when(F.col("middle").isNotNull(), F.coalesce(zone, F.lit("inside"))))
    before = F.lag("zone").over(in_order(by))
    buy = (before == "below_lower") & (F.col("zone") != "below_lower")
    sell = (before == "above_upper") & (F.col("zone") != "above_upper")
    return out.withColumn("signal", _signal(buy, sell, go_short))


def _rsi_sides(w, low: float, high: float) -> tuple[Column, Column]:
    before = F.lag("rsi").over(w)
    return (before <= low) & (F.col("rsi") > low), (before >= high) & (F.col("rsi") < high)


def rsi_reversal(bars: DataFrame, by: Sequence[str], n: int = 14, low: float = 30.0, high: float = 70.0, go_short: bool = True) -> DataFrame:
    out = rsi(bars, n, by)
    return out.withColumn("signal", _signal(*_rsi_sides(in_order(by), low, high), go_short))


def macd_cross(bars: DataFrame, by: Sequence[str], fast: int = 12, slow: int = 26, signal: int = 9, veto: bool = True, n: int = 14, low: float = 30.0, high: float = 70.0, go_short: bool = True) -> DataFrame:
    """The line crosses its signal line; with veto, an RSI at high or above blocks buying, at low or below selling."""
    out = macd(rsi(bars, n, by) if veto else bars, by, fast, slow, signal)
    out = out.withColumn("__above", F.col("macd") > F.col("macd_signal"))
    buy, sell = crossed(F.col("__above"), in_order(by))
    if veto:
        buy, sell = buy & ~F.coalesce(F.col("rsi") >= high, F.lit(False)), sell & ~F.coalesce(F.col("rsi") <= low, F.lit(False))
    return out.withColumn("signal", _signal(buy, sell, go_short)).drop("__above")


def confluence(bars: DataFrame, by: Sequence[str], within: int = 5, n: int = 14, low: float = 30.0, high: float = 70.0, fast: int = 12, slow: int = 26, signal: int = 9, go_short: bool = True) -> DataFrame:
    """RSI reversal and MACD cross (without veto) agree within so many bars; fires on the bar that completes the pair."""
    w = in_order(by)
    out = macd(rsi(bars, n, by), by, fast, slow, signal).withColumn("__above", F.col("macd") > F.col("macd_signal"))
    rsi_up, rsi_down = _rsi_sides(w, low, high)
    macd_up, macd_down = crossed(F.col("__above"), w)
    flags = {"__ru": rsi_up, "__rd": rsi_down, "__mu": macd_up, "__md": macd_down}
    out = out.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in flags.items()})
    recent = lambda c: F.max(c).over(w.rowsBetween(-within, 0))
    buy = (F.col("__ru") | F.col("__mu")) & recent("__ru") & recent("__mu")
    sell = (F.col("__rd") | F.col("__md")) & recent("__rd") & recent("__md")
    return out.withColumn("signal", _signal(buy, sell, go_short)).drop("__above", *flags)
