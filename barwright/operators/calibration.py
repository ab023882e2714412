"""All that the detectors see of a bar in one row, and how often they would fire on grids of their parameters.

A bar's legs meet in windows by ts and one aggregate, so that the three detectors and all points of their grids share one
exchange. Grids are counted in one aggregate over the bars, with a count for each point, and never multiply the bars.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import let, median_of
from .detectors import OTHERS_RANGE_BPS, arm_scale
from .runlevel import same_hour_median

#: Scales of detector B and the grids of thresholds, stale volumes and thin shares.
B_KINDS = ("mean_spread", "arm_spread", "hour_median")
A_GRID = (3.0, 5.0, 7.5, 10.0, 15.0, 20.0)
B_GRID = (0.5, 0.75, 1.0, 1.5, 2.0, 3.0)
STALE_GRID = (1.0, 2.0, 5.0)
THIN_GRID = (0.02, 0.05, 0.10)


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def bar_statistics(legs: DataFrame, anchors: tuple[str, str], stale: Sequence[float] = STALE_GRID, thin: Sequence[float] = THIN_GRID, others: float = OTHERS_RANGE_BPS, width: int = 60, least: int = 10) -> DataFrame:
    """ts, max_abs, mean_spread, dispersion, b_mean_spread, b_arm_spread, b_hour_median, c of legs (ts, a, b, s, loo, volume, range_bps, typical).

    b_*: the greatest |loo| over each scale of detector B, null where the scale isn't known (b_hour_median: without enough
    history of mean spreads at the hour; with no positive scale). c: for each stale volume and thin share (stale, share, by_volume, by_zero, thin): a leg has
    no more volume; has no range while the others' median range is others bps or more; is neither and under that share of
    its typical volume. Nulls raise no flag. Repeated legs count as legs of their own; no legs give no rows.
    """
    w = Window.partitionBy("ts")
    x = arm_scale(legs, anchors).withColumnRenamed("scale", "__arm_scale")
    x = x.withColumn("__legs", F.collect_list(F.struct("a", "b", "range_bps")).over(w))
    of_others = F.sort_array(F.transform(F.filter("__legs", lambda y: ((y["a"] != F.col("a")) | (y["b"] != F.col("b"))) & y["range_bps"].isNotNull()), lambda y: y["range_bps"]))
    x = x.withColumn("__zero", _no((F.col("range_bps") == 0) & (F.coalesce(let(of_others, median_of), F.lit(0.0)) >= others))).drop("__legs")
    size, few = F.abs("loo"), lambda v: _no(F.col("volume") <= v)
    short = lambda v, f: ~few(v) & ~F.col("__zero") & _no((F.col("typical") > 0) & (F.col("volume") < f * F.col("typical")))
    over = lambda scale: F.max(F.when(scale > 0, size / scale))
    sums = [F.max(few(v)).alias(f"__v{i}") for i, v in enumerate(stale)] + [F.max(short(v, f)).alias(f"__t{i}_{j}") for i, v in enumerate(stale) for j, f in enumerate(thin)]
    g = x.groupBy("ts").agg(
        F.max(size).alias("max_abs"), F.avg("s").alias("mean_spread"), F.try_divide(F.max("s"), F.min("s")).alias("dispersion"),
        over(F.col("__arm_scale")).alias("b_arm_spread"), F.max("__zero").alias("__zero"), *sums,
    )
    g = same_hour_median(g, [], "mean_spread", width, least, "__med")
    by = lambda scale: F.when(F.col(scale) > 0, F.col("max_abs") / F.col(scale))
    point = lambda i, v, j, f: F.struct(F.lit(float(v)).alias("stale"), F.lit(float(f)).alias("share"), F.col(f"__v{i}").alias("by_volume"), F.col("__zero").alias("by_zero"), F.col(f"__t{i}_{j}").alias("thin"))
    c = F.array(*[point(i, v, j, f) for i, v in enumerate(stale) for j, f in enumerate(thin)])
    return g.select("ts", "max_abs", "mean_spread", "dispersion", by("mean_spread").alias("b_mean_spread"), "b_arm_spread", by("__med").alias("b_hour_median"), c.alias("c"))


def flag_grids(stats: DataFrame, a: Sequence[float] = A_GRID, b: Sequence[float] = B_GRID, stale: Sequence[float] = STALE_GRID, thin: Sequence[float] = THIN_GRID) -> DataFrame:
    """detector, kind, threshold, share, defined, flagged, by_volume, by_zero, thin of bar_statistics: bars strictly over each threshold of A and of each scale of B, and bars that each point of C's grid flags, by what.

    stale and thin are the grid that the statistics were made with. defined: bars with a value. Without bars all counts are 0.
    """
    n = F.count(F.lit(1))
    none = F.lit(None).cast("long")

    def entry(detector: str, kind: str, threshold: float, share, defined: Column, flagged: Column, parts: Sequence[Column] = (none, none, none)) -> Column:
        named = [F.lit(detector).alias("detector"), F.lit(kind).alias("kind"), F.lit(float(threshold)).alias("threshold"), F.lit(share).cast("double").alias("share"), defined.alias("defined"), flagged.alias("flagged")]
        return F.struct(*named, *[p.alias(c) for p, c in zip(parts, ("by_volume", "by_zero", "thin"))])

    points = [entry("A", "loo", t, None, n, F.count_if(F.col("max_abs") > t)) for t in a]
    points += [entry("B", k, t, None, F.count(f"b_{k}"), F.count_if(F.col(f"b_{k}") > t)) for k in B_KINDS for t in b]
    for i, (v, f) in enumerate((v, f) for v in stale for f in thin):
        e = F.get("c", F.lit(i))
        parts = [F.count_if(e[p]) for p in ("by_volume", "by_zero", "thin")]
        points.append(entry("C", "grid", v, f, n, F.count_if(e["by_volume"] | e["by_zero"] | e["thin"]), parts))
    return stats.agg(F.array(*points).alias("p")).select(F.explode("p").alias("p")).select("p.*")
