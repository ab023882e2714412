"""The validation hierarchy as one set of joins: gates and plateau on the grid, walk-forward of the survivors, bootstrap of finalists."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import validate
from .backtest import FREE, Costs, Units, equity_curve, sized, trades
from .graph import checkpoints
from .metrics import drawdowns, trade_metrics
from .resample import returns, resample, summary

LOSS_CEILING_PCT = 40.0
#: Share of its base that a strategy weighs by the highest tier it reached.
TIER_MULTIPLIER = (0.0, 0.25, 0.5, 0.75, 1.0)


def _cut(df: DataFrame) -> DataFrame:
    """df, computed and written once to the shared folder: every step of the hierarchy reads the one before several times."""
    checkpoints(df.sparkSession)
    return df.checkpoint()


def _bootstrapped(t: DataFrame, key: Sequence[str], iterations: int, seed: int, start: float) -> DataFrame:
    """key, low, prob_loss of the returns of resampled trades; no row for fewer than two trades."""
    two = t.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where("__n >= 2").drop("__n")
    drawn = resample(t.join(two, list(key), "left_semi").select(*key, "entry_ts", "pnl"), key, ["entry_ts"], iterations, seed)
    return summary(returns(drawn, key, start), key, "total_return_pct").select(*key, "low", F.col("below_zero").alias("prob_loss"))


def tiers(bars: DataFrame, by: Sequence[str], signals_of: Callable[[DataFrame, list[str]], DataFrame], params: DataFrame, axes: Sequence[str], in_sample: int, out_sample: int, costs: Costs = FREE, start: float = 10_000.0, iterations: int = 2_000, seed: int = 42, notional: float | None = None) -> DataFrame:
    """by, param_id, score, return_pct, low, prob_loss, tier: 0 fails the gates, 1 passes them, 2 stands on a plateau, 3 wins a
    walk-forward window of its series (with a positive return over all windows), 4 has a 90 % bootstrap interval over 0 and
    loses in under 40 % of samples. low, the interval's lower end, and prob_loss are there for every candidate of tier 3 and 4.

    signals_of(bars, key) gives the signals of all parameters, with param_id; params, of grid(), has axes and their places.
    notional sizes each series by its first mid price; without it every trade has 1,000 units.
    """
    by = list(by)
    key = [*by, "param_id"]
    bars = _cut(bars)
    units: Units = 1000.0 if notional is None else "units"
    size = None if notional is None else _cut(sized(bars, by, notional))

    def sized_signals(b: DataFrame, k: list[str]) -> DataFrame:
        made = signals_of(b, k)
        return _cut(made if size is None else made.join(size, by))

    s = sized_signals(bars, by)
    scored = _cut(validate.neighbour_gap(validate.sensitivity(s, params, by, costs, start, units=units), by, axes))
    t = trades(s, key, costs, units)
    m = trade_metrics(t, key, start).select(*key, "total_trades", "total_return_pct", "profit_factor")
    dd = drawdowns(equity_curve(s, key, costs, units, start), key).groupBy(*key).agg(F.max("dd").alias("max_drawdown_pct"))
    gated = _cut(validate.gates(m.join(dd, key)))
    one = gated.where("passed").select(*key)
    two = _cut(validate.plateau(scored, by).select(*key).join(one, key, "left_semi"))
    wf = validate.walk_forward(bars, by, sized_signals, params, in_sample, out_sample, costs=costs, start=start, allowed=two, units=units)
    wf = _cut(wf)
    good = wf.groupBy(*by).agg(F.max_by("balance", "window").alias("b")).where(F.col("b") > start).select(*by)
    three = _cut(wf.join(good, by, "left_semi").select(*key).distinct())
    boot = three.join(_bootstrapped(t.join(three, key, "left_semi"), key, iterations, seed, start), key, "left").withColumn("__3", F.lit(1))
    out = scored.where("score IS NOT NULL").select(*key, "score").join(gated.select(*key, F.col("total_return_pct").alias("return_pct"), F.col("passed").cast("int").alias("__1")), key, "left")
    out = out.join(two.withColumn("__2", F.lit(1)), key, "left").join(boot, key, "left")
    four = F.coalesce((F.col("low") > 0) & (F.col("prob_loss") < LOSS_CEILING_PCT), F.lit(False)).cast("int")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(*key, "score", F.coalesce("return_pct", F.lit(0.0)).alias("return_pct"), "low", "prob_loss", (zero("__1") + zero("__2") + zero("__3") + F.when(F.col("__3") == 1, four).otherwise(0)).alias("tier"))


#: Gates of a replay.
LEAST_TRADES, MOST_DRAWDOWN_PCT = 20, 20.0


def replay(signals: DataFrame, key: Sequence[str], costs: Costs = FREE, start: float = 10_000.0, iterations: int = 2_000, seed: int = 42, units: Units = 1000.0) -> DataFrame:
    """key, trades, return_pct, drawdown_pct, low, prob_loss, verdict, reason of frozen candidates on windows they weren't chosen on.

    The first gate that fails is the reason: trades, return, drawdown, bootstrap.
    """
    key, signals = list(key), _cut(signals)
    t = _cut(trades(signals, key, costs, units))
    m = trade_metrics(t, key, start).select(*key, F.col("total_trades").alias("trades"), F.col("total_return_pct").alias("return_pct"))
    dd = drawdowns(equity_curve(signals, key, costs, units, start), key).groupBy(*key).agg(F.max("dd").alias("drawdown_pct"))
    x = dd.join(m, key, "left").withColumns({"trades": F.coalesce("trades", F.lit(0)), "return_pct": F.coalesce("return_pct", F.lit(0.0))})
    gate = F.when(F.col("trades") < LEAST_TRADES, "trades").when(F.col("return_pct") <= 0, "return").when(F.col("drawdown_pct") >= MOST_DRAWDOWN_PCT, "drawdown")
    x = x.withColumn("__gate", gate)
    open_ = t.join(x.where("__gate IS NULL").select(*key), key, "left_semi")
    boot = _bootstrapped(open_, key, iterations, seed, start)
    out = x.join(boot, key, "left")
    passed = F.col("__gate").isNull() & F.coalesce((F.col("low") > 0) & (F.col("prob_loss") < LOSS_CEILING_PCT), F.lit(False))
    return out.select(*key, "trades", "return_pct", "drawdown_pct", "low", "prob_loss", F.when(passed, "PASS").otherwise("FAIL").alias("verdict"), F.when(passed, "").otherwise(F.coalesce("__gate", F.lit("bootstrap"))).alias("reason"))


def sweep(bars: DataFrame, by: Sequence[str], strategies: dict[str, tuple], in_sample: int, out_sample: int, costs: Costs = FREE, start: float = 10_000.0, iterations: int = 2_000, notional: float | None = None) -> DataFrame:
    """strategy, by, grid_size, tier1..tier4, tier, base, weight: a row for each strategy and series. strategies: name to (signals_of, params, axes), as tiers takes them."""
    out = None
    for name, (signals_of, params, axes) in strategies.items():
        t = weigh(tiers(bars, by, signals_of, params, axes, in_sample, out_sample, costs, start, iterations, notional=notional), by).withColumn("strategy", F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out.select("strategy", *by, "grid_size", *[f"tier{n}" for n in (1, 2, 3, 4)], "tier", "base", "weight")


def weigh(reached: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, grid_size, tier1..tier4 (candidates that reached it), tier (the highest), base, weight, from what tiers gives.

    The base is the best lower end of a finalist's interval from tier 3 on, whether or not that finalist passes the last
    gate, and below that the best return of those that pass the gates. weight: the base, 0 at least, times the multiplier
    of the highest tier; without a base it is 0.
    """
    at = lambda n: F.count_if(F.col("tier") >= n).alias(f"tier{n}")
    g = reached.groupBy(*by).agg(
        F.count(F.lit(1)).alias("grid_size"), *[at(n) for n in (1, 2, 3, 4)], F.max("tier").alias("tier"),
        F.max(F.when(F.col("tier") >= 3, F.col("low"))).alias("__low"), F.max(F.when(F.col("tier") >= 1, F.col("return_pct"))).alias("__return"),
    )
    g = g.withColumn("base", F.when(F.col("tier") >= 3, F.col("__low")).otherwise(F.col("__return"))).drop("__low", "__return")
    return g.withColumn("weight", F.greatest(F.coalesce("base", F.lit(0.0)), F.lit(0.0)) * F.get(F.array(*map(F.lit, TIER_MULTIPLIER)), F.col("tier")))


#: Labels of the windows before and after a training span begin so; a side has so many windows at most.
PRE, POST, MAX_WINDOWS = "pre_", "post_", 200


def month_windows(bars: DataFrame, by: Sequence[str], months: int, training: tuple[datetime, datetime], least_days: int = 30) -> DataFrame:
    """by, window, start, end: windows of so many months from each series' first bar up to the training span, and from the span's end to its last bar.

    A window ends a second before the next one begins, or where its side ends, and is kept if it has least_days whole days;
    numbers count the dropped ones too. training: the span's first and last second. Days are cut to a month's last as the
    windows go on, each from the one before.
    """
    first, last = (F.lit(x).cast("timestamp_ntz") for x in training)
    second = F.expr("INTERVAL 1 SECOND")
    after = last + second
    side = lambda name, a, b, there: F.struct(F.lit(name).alias("side"), a.alias("a"), b.alias("b"), there.alias("there"))
    low, high = F.col("low"), F.col("high")
    sides = F.array(side(PRE, low, F.least(first, high), low < first), side(POST, F.greatest(after, low), high, high > after))
    x = bars.groupBy(*by).agg(F.min("ts").alias("low"), F.max("ts").alias("high")).select(*by, F.explode(sides).alias("s")).select(*by, "s.*").where(F.col("there") & (F.col("a") < F.col("b")))
    month = lambda c: F.year(c) * 12 + F.month(c)
    steps = F.least(F.floor((month("b") - month("a")) / months) + 1, F.lit(MAX_WINDOWS)).cast("int")
    on = lambda acc, _: F.array_append(acc, F.element_at(acc, -1) + F.make_ym_interval(F.lit(0), F.lit(months)))
    x = x.withColumn("cursors", F.aggregate(F.sequence(F.lit(1), steps), F.array("a"), on))
    x = x.select(*by, "side", "b", "cursors", F.posexplode(F.slice("cursors", 1, F.size("cursors") - 1)).alias("at", "start")).where(F.col("start") < F.col("b"))
    x = x.withColumn("end", F.least(F.get("cursors", F.col("at") + 1) - second, F.col("b")))
    x = x.where(F.floor(F.timestamp_diff("SECOND", F.col("start"), F.col("end")) / 86_400) >= least_days)
    return x.select(*by, F.concat("side", F.col("at").cast("string")).alias("window"), "start", "end")


def in_windows(bars: DataFrame, windows: DataFrame, by: Sequence[str]) -> DataFrame:
    """bars with the window that they lie in, both ends inclusive; a window names its months, so that the join is by equality."""
    month = F.date_trunc("month", "start").cast("timestamp_ntz")
    w = windows.withColumn("__month", F.explode(F.sequence(month, F.col("end"), F.expr("INTERVAL 1 MONTH"))))
    b = bars.withColumn("__month", F.date_trunc("month", "ts").cast("timestamp_ntz"))
    return b.join(w, [*by, "__month"]).where((F.col("ts") >= F.col("start")) & (F.col("ts") <= F.col("end"))).drop("__month", "start", "end")


def out_of_time(bars: DataFrame, by: Sequence[str], candidates: dict[str, Callable[[DataFrame, list[str]], DataFrame]], windows: DataFrame, notional: float, costs: Costs = FREE, start: float = 10_000.0, iterations: int = 2_000, seed: int = 42) -> DataFrame:
    """candidate, by, window and what replay gives of frozen candidates (name to signals of bars and a key) run afresh on each window, sized by the window's first mid price."""
    key = [*by, "window"]
    b = in_windows(bars, windows, by)
    size, out = sized(b, key, notional), None
    for name, signals_of in candidates.items():
        s = signals_of(b, key).select(*key, "ts", "bid_close", "ask_close", "signal").withColumn("candidate", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return replay(out.join(size, key), ["candidate", *key], costs, start, iterations, seed, "units")
