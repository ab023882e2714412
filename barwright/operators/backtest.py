"""Backtests as gaps and islands: signals to positions, positions to trades and an equity curve, all series at once.

A position is the last signal that wasn't hold; a run of one position is an island, and an island of a long or short position
is a trade. It opens on the island's first bar and closes on the first bar after it, or on the series' last bar.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .indicators import in_order


@dataclass(frozen=True)
class Costs:
    commission_per_unit: float = 0.0
    commission_flat: float = 0.0
    slippage_pips: float = 0.0
    pip_size: float = 0.0001
    commission_pct: float = 0.0
    slippage_pct: float = 0.0
    min_order_size: float | None = None
    lot_step: float | None = None

    def slippage(self, price: Column) -> Column:
        return self.slippage_pips * self.pip_size + price * self.slippage_pct

    def commission(self, price: Column, units: Column) -> Column:
        return self.commission_flat + self.commission_per_unit * units + self.commission_pct * price * units

    def entry(self, side: Column, bid: Column, ask: Column) -> Column:
        """Price of opening or adding: a long (side > 0) buys at the ask, a short sells at the bid, slippage against it."""
        return F.when(side > 0, ask + self.slippage(ask)).otherwise(bid - self.slippage(bid))

    def exit(self, side: Column, bid: Column, ask: Column) -> Column:
        return F.when(side > 0, bid - self.slippage(bid)).otherwise(ask + self.slippage(ask))

    def lot(self, units: Column) -> Column:
        """Signed units after the lot rules: 0 under the least size, else a multiple of the step, halves to even."""
        size = F.abs(units)
        steps = F.bround(size / self.lot_step) * self.lot_step if self.lot_step else size
        least = F.when(size < self.min_order_size, 0.0) if self.min_order_size is not None else F.when(F.lit(False), 0.0)
        return least.otherwise(F.signum(units) * steps)


FREE = Costs()

#: Units of a trade: a number for all series, or the name of a column of the signals (see sized).
Units = float | str


def _units(units: Units) -> tuple[Column, list[str]]:
    """(units as a column, the columns that it needs)."""
    return (F.col(units), [units]) if isinstance(units, str) else (F.lit(units), [])


def sized(bars: DataFrame, by: Sequence[str], notional: float) -> DataFrame:
    """by, units: how many units of each series the notional buys at its first mid price. Null where that isn't positive."""
    first = F.min_by("mid", "ts")
    return bars.groupBy(*by).agg(F.when(first > 0, notional / first).alias("units"))


def positions(signals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds pos (1, -1 or 0 after the bar's signal), was (before it) and trade_no (null when flat)."""
    w = in_order(by)
    say = F.when(F.col("signal") == "BUY", 1).when(F.col("signal") == "SELL", -1).when(F.col("signal") == "CLOSE", 0)
    out = signals.withColumn("pos", F.coalesce(F.last(say, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    out = out.withColumn("was", F.lag("pos", 1, 0).over(w))
    opens = ((F.col("pos") != F.col("was")) & (F.col("pos") != 0)).cast("long")
    number = F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("trade_no", F.when(F.col("pos") != 0, number))


def trades(signals: DataFrame, by: Sequence[str], costs: Costs = FREE, units: Units = 1000.0) -> DataFrame:
    """by, trade_no, side, units, entry_ts, entry_price, exit_ts, exit_price, commission, pnl, reason_close. A column of units counts as it is when a trade opens."""
    w = in_order(by)
    n, needed = _units(units)
    p = positions(signals.select(*by, "ts", "bid_close", "ask_close", "signal", *needed), by)
    end = F.max(F.struct("ts", "bid_close", "ask_close")).over(Window.partitionBy(*by))
    p = p.withColumn("__end", end).where("pos <> was")
    shut = F.coalesce(F.lead(F.struct("ts", "bid_close", "ask_close")).over(w), F.col("__end"))
    p = p.withColumn("__shut", shut).withColumn("reason_close", F.when(F.lead("ts").over(w).isNull(), "end of backtest").otherwise("signal")).where("pos <> 0")
    side = F.col("pos")
    p = p.withColumn("entry_price", costs.entry(side, F.col("bid_close"), F.col("ask_close"))).withColumn("exit_price", costs.exit(side, F.col("__shut.bid_close"), F.col("__shut.ask_close")))
    paid = costs.commission(F.col("entry_price"), n) + costs.commission(F.col("exit_price"), n)
    p = p.withColumn("commission", paid)
    pnl = (F.col("exit_price") - F.col("entry_price")) * side * n - F.col("commission")
    return p.select(
        *by, "trade_no", F.when(side > 0, "LONG").otherwise("SHORT").alias("side"), n.alias("units"), F.col("ts").alias("entry_ts"), "entry_price",
        F.col("__shut.ts").alias("exit_ts"), "exit_price", "commission", pnl.alias("pnl"), "reason_close",
    )


def equity_curve(signals: DataFrame, by: Sequence[str], costs: Costs = FREE, units: Units = 1000.0, start: float = 10_000.0) -> DataFrame:
    """by, ts, equity, in_market: the balance after closed trades plus what the open trade would bring, exit costs included.

    The last bar's equity marks its open trade to market; closing it adds no further point. A column of units must not
    change along a series.
    """
    w = in_order(by)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    n, needed = _units(units)
    p = positions(signals.select(*by, "ts", "bid_close", "ask_close", "signal", *needed), by)
    opened = (F.col("pos") != 0) & (F.col("pos") != F.col("was"))
    p = p.withColumn("__price", F.when(opened, costs.entry(F.col("pos"), F.col("bid_close"), F.col("ask_close"))))
    p = p.withColumn("__entry", F.last("__price", ignorenulls=True).over(run))
    before = F.lag("__entry").over(w)

    def gain(side: Column, entry: Column) -> Column:
        price = costs.exit(side, F.col("bid_close"), F.col("ask_close"))
        return (price - entry) * side * n - costs.commission(entry, n) - costs.commission(price, n)

    closed = F.when((F.col("was") != 0) & (F.col("pos") != F.col("was")), gain(F.col("was"), before)).otherwise(0.0)
    p = p.withColumn("__closed", closed)
    open_gain = F.when(F.col("pos") != 0, gain(F.col("pos"), F.col("__entry"))).otherwise(0.0)
    return p.select(*by, "ts", (F.lit(start) + F.sum("__closed").over(run) + open_gain).alias("equity"), (F.col("pos") != 0).alias("in_market"))


def replay_fills(fills: Column, side: Column) -> Column:
    """Folds an array of fills (units signed by size, price, commission) into struct(avg_entry, net_units, gross, commission).

    Adding units moves the mean entry price; taking units off realises the difference to it.
    """
    zero = F.struct(F.lit(0.0).alias("avg_entry"), F.lit(0.0).alias("net_units"), F.lit(0.0).alias("gross"), F.lit(0.0).alias("commission"))

    def step(a: Column, f: Column) -> Column:
        more = f["units"] > 0
        net = a["net_units"] + f["units"]
        mean = F.when(more, F.try_divide(a["avg_entry"] * a["net_units"] + f["price"] * f["units"], net)).otherwise(a["avg_entry"])
        gross = a["gross"] + F.when(more, 0.0).otherwise((f["price"] - a["avg_entry"]) * side * -f["units"])
        return F.struct(mean.alias("avg_entry"), net.alias("net_units"), gross.alias("gross"), (a["commission"] + f["commission"]).alias("commission"))

    return F.aggregate(fills, zero, step)


def realized_pnl(fills: Column, side: Column) -> Column:
    r = replay_fills(fills, side)
    return r["gross"] - r["commission"]
