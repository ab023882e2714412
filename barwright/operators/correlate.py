"""Correlation, portfolios, ranks, deciles, regressions and other statistics of series, by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import ratio
from .graph import components


def pearson(x: str, y: str) -> Column:
    """Aggregate: correlation from centred moments; null where a variance is 0."""
    return ratio(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def matrix(series: DataFrame, key: str, ts: str, value: str, constant: float | None = 0.0) -> DataFrame:
    """a, b, n, corr of all pairs a <= b of series on the stamps that both have; of a constant series it is constant (the diagonal is 1)."""
    left = series.select(ts, F.col(key).alias("a"), F.col(value).alias("x")).where("x IS NOT NULL")
    right = left.select(ts, F.col("a").alias("b"), F.col("x").alias("y"))
    g = left.join(right, ts).where("a <= b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), pearson("x", "y").alias("corr"))
    return g.withColumn("corr", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce("corr", F.lit(constant))))


def extremes(corr: DataFrame) -> DataFrame:
    """kind (max, min), a, b, corr over pairs a < b; of ties the first pair."""
    p = corr.where("a < b")
    hi = p.agg(F.min_by(F.struct("a", "b", "corr"), F.struct(-F.col("corr"), "a", "b")).alias("r")).select(F.lit("max").alias("kind"), "r.*")
    lo = p.agg(F.min_by(F.struct("a", "b", "corr"), F.struct(F.col("corr"), "a", "b")).alias("r")).select(F.lit("min").alias("kind"), "r.*")
    return hi.unionByName(lo)


def portfolio(series: DataFrame, key: str, ts: str, value: str, n: int, weights: dict[str, float] | None = None, per_year: int = 252) -> DataFrame:
    """One row: periods, mean, vol (sample, annual), sharpe, diversification (weighted mean vol over the portfolio's), on stamps with all n series."""
    if weights and abs(sum(weights.values()) - 1) > 1e-6:
        raise ValueError("weights must sum to 1")
    w = F.lit(1.0 / n) if not weights else F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]), F.col(key)), F.lit(0.0))
    s = series.where(F.col(value).isNotNull()).withColumn("w", w).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(ts))).where(F.col("__n") == n)
    year = F.sqrt(F.lit(float(per_year)))
    p = s.groupBy(ts).agg(F.sum(F.col("w") * F.col(value)).alias("r")).agg(F.count(F.lit(1)).alias("periods"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"))
    own = s.groupBy(key).agg(F.stddev_samp(value).alias("v"), F.max("w").alias("w")).agg(F.sum(F.col("v") * F.col("w")).alias("own"))
    return p.crossJoin(own).select("periods", "mean", (F.col("sd") * year).alias("vol"), (ratio("mean", "sd") * year).alias("sharpe"), ratio("own", "sd").alias("diversification"))


def lagged(series: DataFrame, key: str, ts: str, value: str, a: str, b: str, lags: Sequence[int] = (-2, -1, 0, 1, 2), step: str = "1 HOUR") -> DataFrame:
    """lag, n, corr of a at t with b at t + lag steps; null for a constant side."""
    x = series.where((F.col(key) == a) & F.col(value).isNotNull()).select(F.col(ts).alias("t"), F.col(value).alias("x"))
    y = series.where((F.col(key) == b) & F.col(value).isNotNull()).select(F.col(ts).alias("u"), F.col(value).alias("y"))
    shifted = x.select("x", "t", F.explode(F.array(*map(F.lit, lags))).alias("lag")).withColumn("u", F.col("t") + F.expr(f"INTERVAL {step}") * F.col("lag"))
    return shifted.join(y, "u").groupBy("lag").agg(F.count(F.lit(1)).alias("n"), pearson("x", "y").alias("corr"))


def mean_ranks(rows: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Ranks from 1; ties share their mean rank."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return rows.withColumn(out, F.rank().over(Window.partitionBy(*by).orderBy(value)) + (n - 1) / 2.0)


def spearman(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    r = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = mean_ranks(mean_ranks(r, by, x, "__x"), by, y, "__y")
    return r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pearson("__x", "__y").alias("rho"))


def deciles(rows: DataFrame, by: Sequence[str], value: str, order: Sequence[str], out: str = "decile") -> DataFrame:
    """0..9 by place in the order of value, then order: floor((10 * place - 1) / n), which isn't what ntile gives."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(value, *order))
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return rows.withColumn(out, F.floor((10 * place - 1) / n).cast("int"))


def winsorised_mean(rows: DataFrame, by: Sequence[str], value: str, share: float = 0.01) -> DataFrame:
    """by, n, mean of the values cut at the percentiles share and 1 - share."""
    cut = rows.groupBy(*by).agg(F.percentile(value, F.array(F.lit(share), F.lit(1 - share))).alias("__c"))
    c = F.least(F.greatest(F.col(value), F.col("__c")[0]), F.col("__c")[1])
    return rows.join(cut, list(by)).groupBy(*by).agg(F.count(value).alias("n"), F.avg(c).alias("mean"))


def regression(rows: DataFrame, by: Sequence[str], y: str, x: str) -> DataFrame:
    """by, n, slope, intercept, r of y on x; null where x is constant."""
    return rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), pearson(x, y).alias("r"))


def mad_sigma(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, n, sigma = 1.4826 times the median distance from the median."""
    med = rows.groupBy(*by).agg(F.percentile(value, 0.5).alias("__m"))
    return rows.join(med, list(by)).groupBy(*by).agg(F.count(value).alias("n"), (1.4826 * F.percentile(F.abs(F.col(value) - F.col("__m")), 0.5)).alias("sigma"))


def tail_stats(rows: DataFrame, by: Sequence[str], value: str, least: int = 30) -> DataFrame:
    """by, n, sigma, p99 of |value|, ratio of both, excess kurtosis, for groups of least rows or more."""
    g = rows.groupBy(*by).agg(F.percentile(F.abs(value), 0.99).alias("p99"), F.kurtosis(value).alias("kurtosis"))
    return mad_sigma(rows, by, value).where(F.col("n") >= least).join(g, list(by)).select(*by, "n", "sigma", "p99", ratio("p99", "sigma").alias("ratio"), "kurtosis")


def hour_stats(rows: DataFrame, value: str, least: int = 10) -> DataFrame:
    """hour, n, mean, se, median, p90 and peak: whether the hour's median is the greatest of those with least rows."""
    g = rows.where(F.col(value).isNotNull()).groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(F.lit(1)))).alias("se"), F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.9).alias("p90"))
    top = g.where(F.col("n") >= least).agg(F.min_by("hour", F.struct(-F.col("median"), F.col("hour"))).alias("__h"))
    return g.crossJoin(F.broadcast(top)).select("hour", "n", "mean", "se", "median", "p90", F.coalesce(F.col("hour") == F.col("__h"), F.lit(False)).alias("peak"))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Limits of Wilson's interval of a share; null for n = 0."""
    n = F.when(n > 0, n)
    p, z2 = k / n, z * z
    mid, half = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return (mid - half) / (1 + z2 / n), (mid + half) / (1 + z2 / n)


def log_bins(value: Column, bins: int = 200, low: float = -3.0, high: float = 3.0) -> Column:
    """Bin of |value| on a log scale from 10^low to 10^high, the ends clamped; 0 goes to the first."""
    at = F.floor((F.log10(F.abs(value)) - low) * bins / (high - low))
    return F.coalesce(F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)), F.lit(0)).cast("int")


def clusters(corr: DataFrame, threshold: float = 0.5) -> DataFrame:
    """node, component: single linkage of series whose |corr| reaches the threshold."""
    nodes = corr.where("a = b").select(F.col("a").alias("node"))
    return components(nodes, corr.where((F.col("a") < F.col("b")) & (F.abs("corr") >= threshold)).select("a", "b"))


def cluster_votes(votes: DataFrame, clustering: DataFrame) -> DataFrame:
    """component, stance (mean by weight), weight (mean), members, from votes (node, stance, weight)."""
    return votes.join(clustering, "node").groupBy("component").agg(ratio(F.sum(F.col("stance") * F.col("weight")), F.sum("weight")).alias("stance"), F.avg("weight").alias("weight"), F.count(F.lit(1)).alias("members"))


def pairwise_discount(weights: DataFrame, corr: DataFrame) -> DataFrame:
    """node, weight, discounted: weight times 1 - the greatest |corr| with a node of more weight (ties: of an earlier name)."""
    both = corr.where("a < b").select(F.col("a").alias("node"), F.col("b").alias("other"), "corr")
    both = both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"), "corr"))
    own, other = weights.select("node", "weight"), weights.select(F.col("node").alias("other"), F.col("weight").alias("w2"))
    above = both.join(own, "node").join(other, "other").where("w2 > weight OR w2 = weight AND other < node").groupBy("node").agg(F.max(F.abs("corr")).alias("m"))
    return own.join(above, "node", "left").select("node", "weight", (F.col("weight") * (1 - F.coalesce("m", F.lit(0.0)))).alias("discounted"))
