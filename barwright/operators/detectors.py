"""Fault detectors of a bar's pairs: A by the size of leave-one-out residuals, B by their ratio to spreads, C by stale or thin legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import median_of
from .runlevel import same_hour_median
from .strengths import pair_groups

A_BPS, B_RATIO = 10.0, 1.0
STALE_VOLUME, OTHERS_RANGE_BPS, THIN_SHARE = 2.0, 2.0, 0.05


def _worst(obs: DataFrame, scale: Column, threshold: float) -> DataFrame:
    """ts, flag, worst, pair: the greatest |loo| / scale, of ties the first pair; no pair if all are 0."""
    ratio = F.abs("loo") / scale
    best = F.max_by(F.struct(ratio.alias("r"), F.concat_ws("-", "a", "b").alias("pair")), F.struct(ratio, F.col("__o"))).alias("best")
    w = Window.partitionBy("ts").orderBy(F.desc("a"), F.desc("b"))
    g = obs.withColumn("__o", F.row_number().over(w)).groupBy("ts").agg(best)
    r = F.coalesce(F.col("best.r"), F.lit(0.0))
    return g.select("ts", (r > threshold).alias("flag"), r.alias("worst"), F.when(r > 0, F.col("best.pair")).alias("pair"))


def detector_a(obs: DataFrame, threshold: float = A_BPS) -> DataFrame:
    """obs: ts, a, b, loo. Flags a bar with |loo| over the threshold."""
    return _worst(obs, F.lit(1.0), threshold)


def arm_scale(obs: DataFrame, anchors: tuple[str, str]) -> DataFrame:
    """obs with scale: hub spread plus the pair's arm; for the hub plus the median arm; three times the mean spread for other pairs."""
    w = Window.partitionBy("ts")
    g = obs.withColumn("grp", pair_groups(obs, anchors))
    hub = F.coalesce(F.max(F.when(F.col("grp") == "hub", F.col("s"))).over(w), F.lit(0.0))
    arm = F.when(F.col("grp").startswith("arm:"), F.sum("s").over(Window.partitionBy("ts", "grp")))
    g = g.withColumns({"__hub": hub, "__arm": arm, "__mean": F.avg("s").over(w)})
    each = F.when(F.row_number().over(Window.partitionBy("ts", "grp").orderBy("a", "b")) == 1, F.col("__arm"))
    g = g.withColumn("__each", each).withColumn("__typical", F.coalesce(F.percentile("__each", 0.5).over(w), 2 * F.col("__mean")))
    scale = F.when(F.col("__arm").isNotNull(), F.col("__hub") + F.col("__arm")).when(F.col("grp") == "hub", F.col("__hub") + F.col("__typical")).otherwise(3 * F.col("__mean"))
    return g.withColumn("scale", scale).drop("__hub", "__arm", "__mean", "__each", "__typical", "grp")


def mean_spread_history(obs: DataFrame, width: int = 60, least: int = 10) -> DataFrame:
    """ts, mean_spread, hour_median: the bars' mean spreads and the median of earlier ones at the same hour."""
    m = obs.groupBy("ts").agg(F.avg("s").alias("mean_spread"))
    return same_hour_median(m, [], "mean_spread", width, least)


def detector_b(obs: DataFrame, kind: str, anchors: tuple[str, str] | None = None, threshold: float = B_RATIO, least: int = 10) -> DataFrame:
    """kind: mean_spread, arm_spread or hour_median (flag null without enough history)."""
    if kind == "mean_spread":
        return _worst(obs.withColumn("scale", F.avg("s").over(Window.partitionBy("ts"))), F.col("scale"), threshold)
    if kind == "arm_spread":
        return _worst(arm_scale(obs, anchors), F.col("scale"), threshold)
    h = mean_spread_history(obs, least=least)
    out = _worst(obs.join(h.select("ts", F.col("hour_median").alias("scale")).where("scale IS NOT NULL"), "ts"), F.col("scale"), threshold)
    return h.select("ts").join(out, "ts", "left")


def detector_c(legs: DataFrame, stale: float = STALE_VOLUME, thin: float = THIN_SHARE, others: float = OTHERS_RANGE_BPS) -> DataFrame:
    """legs: ts, name, volume, range_bps, typical. ts, flag, stale and thin (sorted names).

    Stale: volume at most 2, or no range while the median range of the other legs is 2 bps or more; thin: under 5 % of the
    typical volume.
    """
    w = Window.partitionBy("ts")
    ranges = F.collect_list(F.struct("name", "range_bps")).over(w)
    rest = F.array_sort(F.transform(F.filter(ranges, lambda x: (x["name"] != F.col("name")) & x["range_bps"].isNotNull()), lambda x: x["range_bps"]))
    x = legs.withColumn("__rest", rest)
    med = F.coalesce(median_of(F.col("__rest")), F.lit(0.0))
    frozen = F.coalesce(F.col("volume") <= stale, F.lit(False)) | F.coalesce((F.col("range_bps") == 0) & (med >= others), F.lit(False))
    few = ~frozen & F.coalesce((F.col("typical") > 0) & (F.col("volume") < thin * F.col("typical")), F.lit(False))
    x = x.withColumns({"__stale": frozen, "__thin": few})
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(F.col(c), F.col("name")))), ",")
    return x.groupBy("ts").agg(F.max(F.col("__stale") | F.col("__thin")).alias("flag"), names("__stale").alias("stale"), names("__thin").alias("thin"))


def overlap(flags: DataFrame, names: list[str]) -> DataFrame:
    """first, second, both, only_first: counts of bars, for every ordered pair of flag columns."""
    counts = flags.agg(*[F.count_if(F.col(x) & F.col(y)).alias(f"{x}|{y}") for x in names for y in names], *[F.count_if(F.col(x) & ~F.coalesce(F.col(y), F.lit(False))).alias(f"{x}-{y}") for x in names for y in names])
    rows = F.array(*[F.struct(F.lit(x).alias("first"), F.lit(y).alias("second"), F.col(f"`{x}|{y}`").alias("both"), F.col(f"`{x}-{y}`").alias("only_first")) for x in names for y in names if x != y])
    return counts.select(F.explode(rows).alias("r")).select("r.*")
