"""Bootstraps as joins: draws are hashes of (seed, iteration, draw), so a run repeats itself on any cluster.

A draw is the first 48 bits of an MD5, mod n; samples of all iterations are rows, and their metrics are grouped aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import ratio
from . import metrics


#: Rows that a bootstrap sends to all its tasks at most; more are joined by shuffle.
BROADCAST_ROWS = 500_000


def draw(seed: int, *parts: Column) -> Column:
    """A number of 48 bits that follows from the seed and the parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with ix, their place from 0, and n."""
    return rows.withColumn("ix", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))


def _draws(rows: DataFrame, by: Sequence[str], iterations: int, place: str, size: int | None = None) -> DataFrame:
    """by, n, iter and place (0 up to n or size) of numbered rows, dealt by group and iteration: metrics of an iteration need no other exchange."""
    groups = rows.groupBy(*by).agg(F.max("n").alias("n")).withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number: rows are few before the explode, and would be coalesced
    many = F.lit(size).cast("long") if size else F.col("n")
    return groups.repartition(parts, *by, "iter").withColumn(place, F.explode(F.sequence(F.lit(0).cast("long"), many - 1)))


def _picked(draws: DataFrame, rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows that draws name by ix; up to BROADCAST_ROWS rows (counted) go to the draws, so that draws stay where they are dealt."""
    rows = rows.drop("n")
    return draws.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows.hint("shuffle_hash"), [*by, "ix"])


def resample(rows: DataFrame, by: Sequence[str], order: Sequence[str], iterations: int, seed: int = 42, size: int | None = None) -> DataFrame:
    """iter, k and the columns of rows: in each iteration n (or size) draws with replacement from each group."""
    rows = numbered(rows, by, order)
    ix = F.coalesce(F.pmod(draw(seed, F.col("iter"), F.col("k")), F.col("n")), F.lit(0))  # never null: the join needn't hash once more to see that
    d = _draws(rows, by, iterations, "k", size).withColumn("ix", ix).drop("n")
    return _picked(d, rows, by)


def shuffle(rows: DataFrame, by: Sequence[str], order: Sequence[str], iterations: int, seed: int = 42) -> DataFrame:
    """iter, k and the columns of rows: in each iteration all rows of each group in another order k."""
    rows = numbered(rows, by, order)
    k = F.row_number().over(Window.partitionBy(*by, "iter").orderBy(draw(seed, F.col("iter"), F.col("ix")), "ix")) - 1
    return _picked(_draws(rows, by, iterations, "ix"), rows, by).withColumn("k", k)


def returns(samples: DataFrame, by: Sequence[str], start: float = 10_000.0) -> DataFrame:
    """by, iter, total_return_pct of samples with pnl: all that an interval of returns needs, without an order of the draws."""
    return samples.groupBy(*by, "iter").agg((F.sum("pnl") / start * 100).alias("total_return_pct"))


def sampled_metrics(samples: DataFrame, by: Sequence[str], start: float = 10_000.0) -> DataFrame:
    """by, iter, total_return_pct, win_rate_pct, profit_factor, max_drawdown_pct (over the curve that begins with start) of samples with pnl."""
    w = Window.partitionBy(*by, "iter").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    c = samples.withColumn("equity", F.lit(start) + F.sum("pnl").over(w))
    c = c.withColumn("peak", F.greatest(F.lit(start), F.max("equity").over(w)))
    win = F.col("pnl") > 0
    gain, loss = F.sum(F.when(win, F.col("pnl")).otherwise(0.0)), F.abs(F.sum(F.when(win, 0.0).otherwise(F.col("pnl"))))
    return c.groupBy(*by, "iter").agg(
        (F.sum("pnl") / start * 100).alias("total_return_pct"), (F.count_if(win) * 100.0 / F.count(F.lit(1))).alias("win_rate_pct"), F.try_divide(gain, loss).alias("profit_factor"),
        F.max((F.col("peak") - F.col("equity")) / F.col("peak") * 100).alias("max_drawdown_pct"),
    )


#: The metrics that a bootstrap follows.
TRACKED = [
    "total_return_pct",
    "max_drawdown_pct",
    "win_rate_pct",
    "profit_factor",
    "ending_balance",
    "trade_expectancy",
    "trade_expectancy_pct",
    "payoff_ratio",
    "recovery_factor",
    "ulcer_index",
    "max_drawdown_duration",
    "avg_drawdown_duration",
    "var_95",
    "cvar_95",
    "tail_ratio",
    "skewness",
    "kurtosis",
    "kelly_fraction",
    "cost_drag_pct",
    "avg_trade_duration_hours",
    "max_consecutive_wins",
    "max_consecutive_losses",
]
#: Iterations of a bootstrap are no more.
MAX_ITERATIONS = 50_000


def tracked_metrics(samples: DataFrame, by: Sequence[str], start: float = 10_000.0) -> DataFrame:
    """by, iter and all TRACKED metrics of samples (k, pnl, commission, entry_ts, exit_ts): the equity curve has a point a trade, after one of the start."""
    key = [*by, "iter"]
    w = Window.partitionBy(*key).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    after = samples.select(*key, (F.col("k") + 1).alias("ts"), (F.lit(start) + F.sum("pnl").over(w)).alias("equity"))
    curve = after.unionByName(samples.select(*key).distinct().select(*key, F.lit(0).cast("long").alias("ts"), F.lit(start).alias("equity")))
    t = metrics.trade_metrics(samples, key, start, small=True).withColumnsRenamed({"expectancy": "trade_expectancy", "expectancy_pct": "trade_expectancy_pct", "avg_hours": "avg_trade_duration_hours"})
    c = metrics.drawdowns(curve, key).groupBy(*key).agg(F.max("dd").alias("max_drawdown_pct"), F.sqrt(F.avg(F.col("dd") * F.col("dd"))).alias("ulcer_index"), F.max_by("equity", "ts").alias("ending_balance"))
    d = metrics.drawdown_durations(curve, key).select(*key, F.col("max_duration").alias("max_drawdown_duration"), F.col("avg_duration").alias("avg_drawdown_duration"))
    runs = metrics.streaks(samples, key, ["k"], small=True).withColumnsRenamed({"max_wins": "max_consecutive_wins", "max_losses": "max_consecutive_losses"})
    out = t.join(c, key).join(d, key).join(runs, key)
    return out.withColumn("recovery_factor", ratio("total_return_pct", "max_drawdown_pct")).select(*key, *TRACKED)


def bootstrap(trades: DataFrame, by: Sequence[str], order: Sequence[str], method: str = "resample", iterations: int = 5_000, seed: int = 42, start: float = 10_000.0, size: int | None = None) -> DataFrame:
    """by, metric, observed, rank (percent of iterations under the observed value), low, high, median, mean, sd, below_zero of every TRACKED metric.

    Groups of fewer than two trades have no row. rank is null where the observed metric isn't defined.
    """
    if not 0 < iterations <= MAX_ITERATIONS:
        raise ValueError(f"iterations must be 1..{MAX_ITERATIONS}")
    if method not in ("resample", "shuffle"):
        raise ValueError("method must be resample or shuffle")
    enough = trades.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where("__n >= 2").drop("__n")
    rows = trades.join(enough, list(by), "left_semi")
    drawn = resample(rows, by, order, iterations, seed, size) if method == "resample" else shuffle(rows, by, order, iterations, seed)
    own = tracked_metrics(numbered(rows, by, order).withColumnRenamed("ix", "k").withColumn("iter", F.lit(-1)), by, start).drop("iter")
    long = lambda df, *keep: df.select(*by, *keep, *[F.col(c).cast("double").alias(c) for c in TRACKED]).unpivot([*by, *keep], TRACKED, "metric", "value")
    observed = long(own).withColumnRenamed("value", "observed")
    draws = long(tracked_metrics(drawn, by, start), "iter").join(observed, [*by, "metric"])
    key = [*by, "metric"]
    rank = draws.groupBy(*key).agg(F.when(F.max("observed").isNotNull(), F.count_if(F.col("value") < F.col("observed")) * 100.0 / F.nullif(F.count("value"), F.lit(0))).alias("rank"))
    return observed.join(rank, key).join(summary(draws, key, "value"), key)


def summary(samples: DataFrame, by: Sequence[str], metric: str, level: float = 0.9) -> DataFrame:
    """by, low, high (percentile interval), median, mean, sd (population), below_zero (percent under 0) of a metric over iterations; nulls don't count, and all are null if no iteration has the metric."""
    m = F.col(metric)
    tail = (1 - level) / 2
    p = F.percentile(m, F.array(F.lit(tail), F.lit(0.5), F.lit(1 - tail)))
    g = samples.groupBy(*by).agg(p.alias("p"), F.avg(m).alias("mean"), F.stddev_pop(m).alias("sd"), ratio(F.count_if(m < 0) * 100.0, F.count(m)).alias("below_zero"))
    return g.select(*by, F.col("p")[0].alias("low"), F.col("p")[2].alias("high"), F.col("p")[1].alias("median"), "mean", "sd", "below_zero")


def block_bootstrap(rows: DataFrame, by: Sequence[str], block: str, value: str, iterations: int, seed: int = 7) -> DataFrame:
    """by, iter, mean of value over blocks (days, segments) drawn with replacement. Blocks are summed before they are drawn."""
    blocks = rows.groupBy(*by, block).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    d = resample(blocks, by, [block], iterations, seed)
    return d.groupBy(*by, "iter").agg((F.sum("s") / F.sum("c")).alias("mean"))


def clustered_intervals(trials: DataFrame, by: Sequence[str], cells: Sequence[str], cluster: str, first: str, iterations: int, seed: int = 31337, level: float = 0.95) -> DataFrame:
    """by, cells, rate, rate_low, rate_high, latency, latency_low, latency_high of trials (first: how long until detection, null if never).

    Clusters (stretches) are drawn with replacement, as many as the group by has, the same draws for all its cells. They
    are summed once, and an iteration has a row for each cluster it draws, with how often, not one for each draw. The
    latency is the mean over detected trials; iterations without any don't count for its interval.
    """
    key = [*by, *cells]
    sums = trials.groupBy(*key, cluster).agg(F.count(F.lit(1)).alias("__n"), F.count(first).alias("__d"), F.coalesce(F.sum(first), F.lit(0)).alias("__l"))
    drawn = resample(sums.select(*by, cluster).distinct(), by, [cluster], iterations, seed).groupBy(*by, "iter", cluster).agg(F.count(F.lit(1)).alias("__times"))
    total = lambda c: F.sum(F.col(c) * F.col("__times"))
    each = drawn.join(sums, [*by, cluster]).groupBy(*key, "iter").agg((total("__d") / total("__n")).alias("r"), ratio(total("__l"), total("__d")).alias("t"))
    tail = F.array(F.lit((1 - level) / 2), F.lit(1 - (1 - level) / 2))
    ends = each.groupBy(*key).agg(F.percentile("r", tail).alias("r"), F.percentile("t", tail).alias("t"))
    own = sums.groupBy(*key).agg((F.sum("__d") / F.sum("__n")).alias("rate"), ratio(F.sum("__l"), F.sum("__d")).alias("latency"))
    return own.join(ends, key).select(*key, "rate", F.col("r")[0].alias("rate_low"), F.col("r")[1].alias("rate_high"), "latency", F.get("t", F.lit(0)).alias("latency_low"), F.get("t", F.lit(1)).alias("latency_high"))


def truncated_interval(means: DataFrame, by: Sequence[str], value: str, level: float = 0.9) -> DataFrame:
    """by, low, high at the places floor(q * (n - 1)) of the sorted values, without interpolation."""
    v = F.array_sort(F.collect_list(value))
    tail = (1 - level) / 2
    g = means.groupBy(*by).agg(v.alias("v"))
    at = lambda q: F.get("v", F.floor(F.lit(q) * (F.size("v") - 1)).cast("int"))
    return g.select(*by, at(tail).alias("low"), at(1 - tail).alias("high"))


def per_key(rows: DataFrame, by: Sequence[str], key: Sequence[str], n: int, seed: int = 11) -> DataFrame:
    """n rows of each group, drawn by the hash of their key: the same for any order of the input."""
    w = Window.partitionBy(*by).orderBy(draw(seed, *[F.col(k) for k in key]), *key)
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def drawdown_verdict(observed_rank: Column) -> Column:
    """What the place of an observed drawdown among shuffled ones says, in percent."""
    return F.when(observed_rank < 25, "better than most orders").when(observed_rank > 75, "worse than most orders").otherwise("typical")
