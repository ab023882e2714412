"""Investigations of cycle residuals: what they go with on thin bars, whether they are biased, which leg's side says so."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import ratio
from . import correlate
from .graph import BPS, cycle_numbers, tier
from .resample import resample

#: Kinds of a leg's range, how legs are put together, groups of a sorted column, level of intervals.
RANGES = ("R2", "R3", "R4", "R5", "R6")
PUT_TOGETHER = ("max", "sum")
COLUMNS = tuple(f"{r}_{a}" for r in RANGES for a in PUT_TOGETHER) + ("volume_min",)
DECILES = 10
LEVEL = 0.95


def frame(quotes: DataFrame, legs: DataFrame) -> DataFrame:
    """cycle, ts, resid, size (its absolute value), spread, ratio (null without a spread), tier and COLUMNS of the bars that all legs of a cycle have.

    quotes: ts, a, b, bid, ask, volume and R2..R6. The least volume is null if a leg has none. All columns come from one
    aggregate beside the residual's.
    """
    n = cycle_numbers(quotes.select("ts", "a", "b", "bid", "ask"), legs).select("cycle", "ts", "resid", "spread")
    put = {"max": F.max, "sum": F.sum}
    least = F.when(F.count("volume") == F.count(F.lit(1)), F.min("volume"))
    g = quotes.join(legs, ["a", "b"]).groupBy("cycle", "ts").agg(*[put[a](r).alias(f"{r}_{a}") for r in RANGES for a in PUT_TOGETHER], least.alias("volume_min"))
    size = F.abs("resid")
    return n.join(g, ["cycle", "ts"]).withColumns({"size": size, "ratio": F.when(F.col("spread") > 0, size / F.col("spread")), "tier": tier(F.col("resid"), F.col("spread"))})


def thin_bars(bars: DataFrame, by: Sequence[str] = ("cycle",), columns: Sequence[str] = COLUMNS) -> DataFrame:
    """by, column, n, rho_size, rho_ratio, p99s: how each column goes with the residual's size and its ratio to the spread (Spearman), and the 99th percentile of the size in each tenth of the column's sorted values.

    Null values don't count, for the ratio neither null ratios. Fewer than DECILES values: n alone; fewer than three pairs:
    no rho. All columns become one long table, so that the ranks of all of them are one exchange.
    """
    key = [*by, "column"]
    long = bars.select(*by, "ts", "size", "ratio", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([*by, "ts", "size", "ratio"], list(columns), "column", "x").where("x IS NOT NULL")
    sizes = correlate.spearman(long, key, "x", "size").select(*key, F.col("n"), F.when(F.col("n") >= 3, F.col("rho")).alias("rho_size"))
    ratios = correlate.spearman(long, key, "x", "ratio").select(*key, F.when(F.col("n") >= 3, F.col("rho")).alias("rho_ratio"))
    tenth = correlate.deciles(long, key, "x", ["ts"]).groupBy(*key, "decile").agg(F.percentile("size", 0.99).alias("p"))
    tenths = tenth.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("decile", "p"))), lambda s: s["p"]).alias("p99s"))  # ten entries
    enough = F.col("n") >= DECILES
    out = sizes.join(ratios, key, "left").join(tenths, key)
    return out.select(*key, "n", *[F.when(enough, F.col(c)).alias(c) for c in ("rho_size", "rho_ratio", "p99s")])


def intervals(bars: DataFrame, by: Sequence[str], iterations: int, seed: int = 7) -> DataFrame:
    """by, mean_low, mean_high, median_low, median_high of resid by drawing days with replacement.

    An iteration has a row for each day that it draws, with how often: means come from the days' sums, medians from values
    counted that often.
    """
    day = bars.select(*by, F.to_date("ts").alias("day"), "resid")
    sums = day.groupBy(*by, "day").agg(F.sum("resid").alias("s"), F.count("resid").alias("c"))
    drawn = resample(sums, by, ["day"], iterations, seed).groupBy(*by, "iter", "day").agg(F.count(F.lit(1)).alias("times"), F.first("s").alias("s"), F.first("c").alias("c"))
    means = drawn.groupBy(*by, "iter").agg((F.sum(F.col("s") * F.col("times")) / F.sum(F.col("c") * F.col("times"))).alias("mean"))
    medians = drawn.select(*by, "iter", "day", "times").join(day, [*by, "day"]).groupBy(*by, "iter").agg(F.percentile("resid", F.lit(0.5), F.col("times")).alias("median"))
    ends = F.array(F.lit((1 - LEVEL) / 2), F.lit(1 - (1 - LEVEL) / 2))
    g = means.join(medians, [*by, "iter"]).groupBy(*by).agg(F.percentile("mean", ends).alias("m"), F.percentile("median", ends).alias("d"))
    return g.select(*by, F.col("m")[0].alias("mean_low"), F.col("m")[1].alias("mean_high"), F.col("d")[0].alias("median_low"), F.col("d")[1].alias("median_high"))


def bias(bars: DataFrame, by: Sequence[str] = ("cycle",), iterations: int = 1_000, seed: int = 7) -> DataFrame:
    """by, n, n_days, mean, median, mean_rated (suspect bars left out; null without others), winsorised, intervals, mean_has_zero, median_has_zero, slope, intercept and r on the spread."""
    key = list(by)
    rated = F.when(F.col("tier") != "suspect", F.col("resid"))
    g = bars.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.to_date("ts")).alias("n_days"), F.avg("resid").alias("mean"), F.percentile("resid", 0.5).alias("median"), F.avg(rated).alias("mean_rated"))
    w = correlate.winsorised_mean(bars, key, "resid").select(*key, F.col("mean").alias("winsorised"))
    r = correlate.regression(bars, key, "resid", "spread").drop("n")
    out = g.join(w, key).join(intervals(bars, key, iterations, seed), key).join(r, key, "left")
    zero = lambda c: ((F.col(f"{c}_low") <= 0) & (F.col(f"{c}_high") >= 0)).alias(f"{c}_has_zero")
    return out.select("*", zero("mean"), zero("median"))


def designations(biases: DataFrame, legs: DataFrame) -> DataFrame:
    """cycle, leg, d, mean, mean_low, mean_high, mean_has_zero and the same of the median: what the rest of the cycle says of each leg called direct, -d times the residual, in the leg's own orientation."""
    d = -F.col("d")
    end = lambda c: (F.when(d > 0, F.col(f"{c}_low") * d).otherwise(F.col(f"{c}_high") * d).alias(f"{c}_low"), F.when(d > 0, F.col(f"{c}_high") * d).otherwise(F.col(f"{c}_low") * d).alias(f"{c}_high"))
    x = biases.join(legs.select("cycle", "leg", "d"), "cycle")
    return x.select("cycle", "leg", "d", (F.col("mean") * d).alias("mean"), *end("mean"), "mean_has_zero", (F.col("median") * d).alias("median"), *end("median"), "median_has_zero")


def sign_combinations(designated: DataFrame) -> DataFrame:
    """cycles, combinations, all_same_sign: of the choices of one leg a cycle, how many have means of one sign (0 counts as negative).

    A choice of one sign takes one of the positive legs of every cycle, or one of the others of every cycle, so the numbers
    are products of counts: no choice is written out.
    """
    g = designated.groupBy("cycle").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("mean") > 0).alias("up"))
    many = lambda c: F.product(c).cast("long")
    return g.agg(F.count(F.lit(1)).alias("cycles"), many("n").alias("combinations"), (many("up") + many(F.col("n") - F.col("up"))).alias("all_same_sign"))


def rounding_floor(decimals: DataFrame, legs: DataFrame, bars: DataFrame) -> DataFrame:
    """cycle, floor, floor_of_mean (bps): the deviation of a residual, and of its mean, that rounding bid and ask to a leg's decimals gives alone.

    decimals: a, b, decimals, mid (the leg's median). The error of a mid price has the variance unit^2 / 24. Null if a
    leg's decimals aren't known.
    """
    part = F.pow(F.lit(10.0), -2 * F.col("decimals")) / 24 / (F.col("mid") * F.col("mid"))
    whole = F.count("decimals") == F.count(F.lit(1))
    g = legs.join(decimals, ["a", "b"]).groupBy("cycle").agg(F.when(whole, F.sqrt(F.sum(part)) * BPS).alias("floor"))
    n = bars.groupBy("cycle").agg(F.count(F.lit(1)).alias("__n"))
    return g.join(n, "cycle").select("cycle", "floor", ratio(F.col("floor"), F.sqrt("__n")).alias("floor_of_mean"))


def price_decimals(quotes: DataFrame, most: int = 8) -> DataFrame:
    """a, b, decimals, mid of each pair: the least number of decimals that gives every bid and ask (null over most), and the median mid."""
    need = F.lit(None).cast("int")
    for d in range(most, -1, -1):
        need = F.when((F.round("bid", d) == F.col("bid")) & (F.round("ask", d) == F.col("ask")), d).otherwise(need)
    g = quotes.groupBy("a", "b").agg(F.max(need).alias("d"), F.count_if(need.isNull()).alias("over"), F.percentile((F.col("bid") + F.col("ask")) / 2, 0.5).alias("mid"))
    return g.select("a", "b", F.when(F.col("over") == 0, F.col("d")).alias("decimals"), "mid")


def parkinson(high_low_bps):
    """R6 of R2."""
    return high_low_bps * high_low_bps / (4 * math.log(2))


def leg_ranges(quotes: DataFrame) -> DataFrame:
    """quotes (ts, a, b, bid, ask, hi, lo) with R2..R6, in bps (R6 in bps squared): of high and low, high and bid, ask and low, the mid price to the one before (R2 where there is none), Parkinson's."""
    mid = (F.col("bid") + F.col("ask")) / 2
    before = F.lag(mid).over(Window.partitionBy("a", "b").orderBy("ts"))
    r2 = F.log(F.col("hi") / F.col("lo")) * BPS
    out = quotes.withColumns({"R2": r2, "R3": F.abs(F.log(F.col("hi") / F.col("bid"))) * BPS, "R4": F.abs(F.log(F.col("ask") / F.col("lo"))) * BPS, "R5": F.coalesce(F.abs(F.log(mid / before)) * BPS, r2)})
    return out.withColumn("R6", parkinson(F.col("R2")))
