"""Validation of strategies: parameter grids, plateaus, walk-forward windows, gates. All parameters of a grid run in one job."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .backtest import FREE, Costs, Units, equity_curve, trades
from .indicators import crossed, in_order
from .metrics import curve_metrics, trade_metrics

#: A grid has so many combinations at most.
MAX_GRID = 5_000


def grid(spark, **values: Sequence[float]) -> DataFrame:
    """param_id (place in the order of the lists), the parameters, and for each its place <name>_ix in its list."""
    out, names = None, list(values)
    if math.prod(map(len, values.values())) > MAX_GRID:
        raise ValueError(f"more than {MAX_GRID} combinations")
    for name, given in values.items():
        kind = "int" if all(isinstance(v, int) for v in given) else "double"
        one = spark.createDataFrame([(i, v if kind == "int" else float(v)) for i, v in enumerate(given)], f"{name}_ix int, {name} {kind}")
        out = one if out is None else out.crossJoin(one)
    number = F.lit(0).cast("long")
    for n in names:
        number = number * len(values[n]) + F.col(f"{n}_ix")
    return out.withColumn("param_id", number)


def strategy_grid(bars: DataFrame, by: Sequence[str], strategy: Callable[..., DataFrame], **values: Sequence[float]) -> DataFrame:
    """Signals of any strategy (bars, by=..., and the parameters) for every combination that it takes: by, param_id, ts, bid_close, ask_close, signal.

    A combination that the strategy refuses with a ValueError is left out. The branches of all combinations start from the
    same exchange of bars by series, which Spark makes once.
    """
    if math.prod(map(len, values.values())) > MAX_GRID:
        raise ValueError(f"more than {MAX_GRID} combinations")
    out = None
    for k, combo in enumerate(itertools.product(*values.values())):
        try:
            s = strategy(bars, by=list(by), **dict(zip(values, combo)))
        except ValueError:
            continue
        s = s.select(*by, F.lit(k).cast("long").alias("param_id"), "ts", "bid_close", "ask_close", "signal")
        out = s if out is None else out.unionByName(s)
    if out is None:
        raise ValueError("the strategy takes none of the combinations")
    return out


def sma_grid(bars: DataFrame, by: Sequence[str], fast: Sequence[int], slow: Sequence[int]) -> DataFrame:
    """Signals of the crossover for every fast < slow: bars with param_id, fast, slow, signal.

    The means of all periods come from one window pass; bars are multiplied only after it.
    """
    w = in_order(by)
    periods = sorted({*fast, *slow})
    row = F.row_number().over(w)
    means = bars.select(*by, "ts", "bid_close", "ask_close", *[F.when(row >= p, F.avg("mid").over(w.rowsBetween(-(p - 1), 0))).alias(f"__{p}") for p in periods])
    combos = [(i * len(slow) + j, f, s) for i, f in enumerate(fast) for j, s in enumerate(slow) if f < s]
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("param_id"), F.lit(f).alias("fast"), F.lit(s).alias("slow"), F.col(f"__{f}").alias("x"), F.col(f"__{s}").alias("y")) for k, f, s in combos]))
    out = means.select(*by, "ts", "bid_close", "ask_close", each.alias("p")).select(*by, "ts", "bid_close", "ask_close", "p.*")
    out = out.withColumn("above", F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.col("x") > F.col("y")))
    buy, sell = crossed(F.col("above"), in_order([*by, "param_id"]))
    return out.withColumn("signal", F.when(buy, "BUY").when(sell, "SELL")).drop("x", "y", "above")


def scores(signals: DataFrame, key: Sequence[str], costs: Costs = FREE, start: float = 10_000.0, metric: Column | None = None, units: Units = 1000.0) -> DataFrame:
    """key, trades, score of the series that trade. score: total return in percent, or metric, a column over what trade_metrics and curve_metrics give."""
    t = trades(signals, key, costs, units)
    if metric is None:
        return t.groupBy(*key).agg(F.count(F.lit(1)).alias("trades"), (F.sum("pnl") / start * 100).alias("score"))
    c = curve_metrics(equity_curve(signals, key, costs, units, start), key, start=start).drop("total_return_pct")
    return trade_metrics(t, key, start).join(c, list(key)).select(*key, F.col("total_trades").alias("trades"), metric.alias("score"))


def sensitivity(signals: DataFrame, params: DataFrame, by: Sequence[str], costs: Costs = FREE, start: float = 10_000.0, metric: Column | None = None, units: Units = 1000.0) -> DataFrame:
    """by, param_id and its columns, trades, score; combinations without signals' rows keep a row with a null score.

    Trades of a combination that never trades are 0, and so is its score where that is the total return.
    """
    key = [*by, "param_id"]
    valid = signals.groupBy(*key).agg(F.lit(True).alias("__valid"))  # the scan and the exchange are those of the trades
    done = valid.join(scores(signals, key, costs, start, metric, units), key, "left")
    none = F.lit(0.0) if metric is None else F.lit(None).cast("double")
    done = done.select(*key, F.coalesce("trades", F.lit(0)).alias("trades"), F.coalesce("score", none).alias("score"))
    every = valid.select(*by).distinct().crossJoin(F.broadcast(params))  # params has MAX_GRID rows at most
    return every.join(done, key, "left")


def neighbour_gap(scored: DataFrame, by: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """scored with gap: score less the mean score of the valid points one step away along one axis; null without any.

    Every point names its neighbours, two an axis, so that the join is by equality.
    """
    places = [f"{a}_ix" for a in axes]
    steps = [F.struct(*[(F.col(p) + (d if p == q else 0)).alias(f"__{p}") for p in places]) for q in places for d in (1, -1)]
    to = scored.where("score IS NOT NULL").select(*by, F.explode(F.array(*steps)).alias("x"), F.col("score").alias("__s")).select(*by, "x.*", "__s")
    near = to.groupBy(*by, *[f"__{p}" for p in places]).agg(F.avg("__s").alias("__m"), F.count(F.lit(1)).alias("neighbours"))
    near = near.withColumnsRenamed({f"__{p}": p for p in places})
    return scored.join(near, [*by, *places], "left").withColumn("gap", F.col("score") - F.col("__m")).drop("__m")


def plateau(gapped: DataFrame, by: Sequence[str]) -> DataFrame:
    """Points whose gap is at most the population deviation of all scores (two at least)."""
    w = Window.partitionBy(*by)
    out = gapped.withColumn("sd", F.stddev_pop("score").over(w)).withColumn("__n", F.count("score").over(w))
    return out.where((F.col("__n") >= 2) & (F.col("gap") <= F.col("sd"))).drop("__n")


def gates(results: DataFrame) -> DataFrame:
    """results with passed: 20 trades or more, a positive return, a profit factor over 1 or none, a drawdown under 20 percent."""
    ok = (F.col("total_trades") >= 20) & (F.col("total_return_pct") > 0) & F.coalesce(F.col("profit_factor") > 1, F.lit(True)) & (F.col("max_drawdown_pct") < 20)
    return results.withColumn("passed", F.coalesce(ok, F.lit(False)))


def marginal(scored: DataFrame, by: Sequence[str], axis: str) -> DataFrame:
    """by, value, mean score, points with a score, for every value of an axis."""
    return scored.groupBy(*by, F.col(axis).alias("value")).agg(F.avg("score").alias("mean_score"), F.count("score").alias("points"))


def heatmap(scored: DataFrame, by: Sequence[str], x: str, y: str, columns: Sequence[int]) -> DataFrame:
    """A row for each value of y and a column for each of x."""
    return scored.groupBy(*by, y).pivot(x, list(columns)).agg(F.first("score"))


def best(scored: DataFrame, by: Sequence[str], n: int = 1, worst: bool = False) -> DataFrame:
    """The n points of the greatest (or least) score, ties in grid order; points without a score never."""
    order = F.col("score").asc() if worst else F.col("score").desc()
    return scored.where("score IS NOT NULL").withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(order, "param_id"))).where(F.col("rank") <= n)


def walk_forward(bars: DataFrame, by: Sequence[str], signals_of: Callable[[DataFrame, list[str]], DataFrame], params: DataFrame, in_sample: int, out_sample: int, step: int | None = None, costs: Costs = FREE, start: float = 10_000.0, allowed: DataFrame | None = None, metric: Column | None = None, units: Units = 1000.0) -> DataFrame:
    """by, window, param_id and the parameters, score (in-sample return, percent), oos_return_pct, balance (compounded over windows).

    signals_of(bars, key) gives the signals of all parameters, with param_id, as sma_grid and strategy_grid do; params is of
    grid(). Windows of in_sample + out_sample bars slide by step (out_sample by default). In each, the parameters of the best
    in-sample return are chosen, ties in grid order; they run on into the out-of-sample part with their state and open position.
    metric, a column over curve_metrics of the in-sample part, is chosen by instead; null counts as least. allowed (by,
    param_id) leaves other parameters out.
    """
    step = step or out_sample
    span = in_sample + out_sample
    w = in_order(by)
    b = bars.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    first = F.greatest(F.ceil((F.col("__i") - span + 1) / step), F.lit(0))
    last = F.least(F.floor(F.col("__i") / step), F.floor((F.col("__n") - span) / step))
    b = b.where(first <= last).withColumn("window", F.explode(F.sequence(first, last)))
    b = b.withColumn("__oos", F.col("__i") - F.col("window") * step >= in_sample)
    key = [*by, "window"]
    s = signals_of(b, key)
    if allowed is not None:
        s = s.join(allowed, [*by, "param_id"], "left_semi")
    p = [*key, "param_id"]
    begin = b.where("__oos").groupBy(*key).agg(F.min("ts").alias("__begin"))
    curve = equity_curve(s, p, costs, units, start).join(begin, key).where(F.col("ts") < F.col("__begin"))
    if metric is None:
        score = curve.groupBy(*p).agg(((F.max_by("equity", "ts") / start - 1) * 100).alias("score"))
    else:
        score = curve_metrics(curve, p, start=start).select(*p, metric.alias("score"))
    pick = score.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc_nulls_last("score"), "param_id"))).where("__r = 1").drop("__r")
    t = trades(s, p, costs, units).join(begin, key).where(F.col("exit_ts") >= F.col("__begin")).groupBy(*p).agg((F.sum("pnl") / start * 100).alias("oos_return_pct"))
    names = params.drop(*[c for c in params.columns if c.endswith("_ix")])
    out = pick.join(t, p, "left").withColumn("oos_return_pct", F.coalesce("oos_return_pct", F.lit(0.0))).join(F.broadcast(names), "param_id")  # MAX_GRID rows at most
    grown = F.exp(F.sum(F.log(F.greatest(1 + F.col("oos_return_pct") / 100, F.lit(1e-12)))).over(Window.partitionBy(*by).orderBy("window").rowsBetween(Window.unboundedPreceding, 0)))
    return out.select(*key, "param_id", *[c for c in names.columns if c != "param_id"], "score", "oos_return_pct", (start * grown).alias("balance"))


def cost_adjusted(magnitude, drag_pct):
    """A metric (column) less the share of it that costs take, never turned negative; null if either is."""
    return magnitude * F.greatest(1 - drag_pct / 100, F.lit(0.0))


#: The least service tier that shows a metric; one that isn't named shows from GOLD on.
TIERS = {"BRONZE": 0, "SILVER": 1, "GOLD": 2}
TIER_METRICS = {
    "BRONZE": (
        "total_return_pct",
        "total_trades",
        "win_rate_pct",
        "profit_factor",
        "max_drawdown_pct",
        "total_commission_paid",
        "avg_win",
        "avg_loss",
    ),
    "SILVER": (
        "sharpe_ratio",
        "sortino_ratio",
        "calmar_ratio",
        "recovery_factor",
        "max_drawdown_duration",
        "avg_drawdown_duration",
        "still_in_drawdown_at_end",
        "trade_expectancy",
        "trade_expectancy_pct",
        "payoff_ratio",
        "exposure_pct",
        "buy_hold_return_pct",
        "alpha_vs_buy_hold_pct",
    ),
    "GOLD": (
        "omega_ratio",
        "ulcer_index",
        "downside_deviation",
        "max_consecutive_wins",
        "max_consecutive_losses",
        "avg_trade_duration_hours",
        "cost_drag_pct",
        "var_95",
        "cvar_95",
        "tail_ratio",
        "skewness",
        "kurtosis",
        "kelly_fraction",
    ),
}
METRIC_TIER = {m: tier for tier, names in TIER_METRICS.items() for m in names}


def visible_by_tier(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """tier, by, metric, value: the metrics (double columns) that each tier shows, in one pass; one without an entry counts as GOLD."""
    names = [c for c, t in metrics.dtypes if c not in by]
    long = metrics.select(*by, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(list(by), names, "metric", "value")
    need = F.create_map(*[F.lit(x) for k, v in METRIC_TIER.items() for x in (k, TIERS[v])])
    tiers = F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(have).alias("have")) for t, have in TIERS.items()])
    shown = long.withColumn("need", F.coalesce(F.try_element_at(need, F.col("metric")), F.lit(TIERS["GOLD"])))
    return shown.withColumn("__t", F.explode(F.filter(tiers, lambda t: F.col("need") <= t["have"]))).select(F.col("__t.tier").alias("tier"), *by, "metric", "value")


def visible(metrics: DataFrame, by: Sequence[str], tier: str) -> DataFrame:
    """by, metric, value of the metrics that a tier shows."""
    if tier not in TIERS:
        raise ValueError(f"tier must be one of {', '.join(TIERS)}")
    return visible_by_tier(metrics, by).where(F.col("tier") == tier).drop("tier")
