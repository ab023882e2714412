"""Experiments on series: masks and populations, scales of a deviation, random blocks, injected faults, synthetic worlds.

Draws are hashes (resample.draw), so that an experiment is a join of a design table with the data and repeats itself anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import median_of
from .indicators import along, in_order
from .resample import draw
from .runlevel import rolling_mad, same_hour_median, statistic, time_runs

#: Context buckets by bars into a stretch; floors of the scaled MAD; quantiles of a ladder.
BUCKET_EDGES = (6, 12, 24, 48)
RZ_FLOORS = (0.1, 0.25, 0.5, 1.0)
QUANTILES = (5, 25, 50, 75, 95)
SHAPES = ("flat", "ramp", "decay", "pulse", "expdecay")


def shape(name: str, k: Column, n: int | Column, magnitude: float | None = None, steps: int | None = None, plateau: float | None = None) -> Column:
    """Unit shape of a fault at bar k of n. step_plateau: steps bars at 1, then plateau / magnitude, 1 at most."""
    if name == "step_plateau":
        return F.when(k < steps, 1.0).otherwise(min(plateau / magnitude, 1.0))
    return {
        "flat": F.lit(1.0), "ramp": (k + 1.0) / n, "decay": (n - k) / (F.lit(1.0) * n), "pulse": F.sin(math.pi * (k + 0.5) / n), "expdecay": F.exp(-3.0 * k / n),
    }[name]


def context_bucket(pos: Column) -> Column:
    """0..4: how many of the edges the place in the stretch has reached."""
    out = F.lit(0)
    for e in BUCKET_EDGES:
        out = out + (pos >= e).cast("int")
    return out


def mask_intervals(bars: DataFrame, a_flag: str, b_flag: str, least_run: int) -> DataFrame:
    """source, start, end, bars: each bar with flag A, and runs (gaps of 3 hours at most) of least_run or more bars with flag B."""
    runs = time_runs(bars.where(F.col(b_flag)), []).where(F.col("bars") >= least_run).select(F.lit("B_run").alias("source"), "start", "end", "bars")
    single = bars.where(F.col(a_flag)).select(F.lit("A_flag").alias("source"), F.col("ts").alias("start"), F.col("ts").alias("end"), F.lit(1).cast("long").alias("bars"))
    return runs.unionByName(single)


def masked_hours(intervals: DataFrame, pad: int) -> DataFrame:
    """Every hour within pad hours of an interval, once: an equi-join then masks the bars, not a range join."""
    hour = F.expr("INTERVAL 1 HOUR")
    return intervals.select(F.explode(F.sequence(F.col("start") - hour * pad, F.col("end") + hour * pad, hour)).alias("ts")).distinct()


def populations(rows: DataFrame, hours: DataFrame) -> DataFrame:
    """rows with population: all (every row) and ref (rows that aren't masked)."""
    ref = rows.join(hours, "ts", "left_anti").withColumn("population", F.lit("ref"))
    return rows.withColumn("population", F.lit("all")).unionByName(ref)


def spaced(rows: DataFrame, by: Sequence[str], hours: float) -> DataFrame:
    """Rows kept one after another where the last kept one is hours or more before: sequential, so along each series."""

    def run(s):
        t = s["ts"].to_numpy("datetime64[s]").astype("int64")
        keep, last = np.zeros(len(t)), None
        for i, x in enumerate(t):
            if last is None or x - last >= hours * 3600:
                keep[i], last = 1.0, x
        return {"__keep": keep}

    return along(rows, by, ["__keep"], run).where("__keep = 1").drop("__keep")


def scales(rows: DataFrame, by: Sequence[str], spread: str = "spread", deviation: str = "dev") -> DataFrame:
    """rows with scale_path (own spread), scale_roll (median of 24, 12 at least), scale_hour (same hour), scale_rz_<floor> (1.4826 MAD of 120, 30 at least)."""
    out = statistic(rows.withColumn("scale_path", F.col(spread)), by, spread, "median", 24, "half", out="scale_roll")
    out = same_hour_median(out, by, spread, out="scale_hour")
    out = rolling_mad(out, by, deviation, 120, 30, "__mad")
    return out.withColumns({f"scale_rz_{f:g}": F.greatest(1.4826 * F.col("__mad"), F.when(F.col("__mad").isNotNull(), F.lit(f))) for f in RZ_FLOORS}).drop("__mad")


def ladder(scaled: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """by, scale, quantiles of each scale: what one unit of it is worth."""
    q = [F.percentile(n, F.array(*[F.lit(x / 100) for x in QUANTILES])).alias(n) for n in names]
    g = scaled.groupBy(*by).agg(*q)
    return g.unpivot(list(by), list(names), "scale", "quantiles")


def draw_blocks(segments: DataFrame, by: Sequence[str], length: int, blocks: int, seed: int = 5) -> DataFrame:
    """by, block, segment, first (place of the block's first bar): uniform over all places where a block of that length fits. segments: by, segment, n."""
    w = Window.partitionBy(*by).orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    s = segments.where(F.col("n") >= length).withColumn("__v", (F.col("n") - length + 1).cast("long")).withColumn("__to", F.sum("__v").over(w))
    total = s.groupBy(*by).agg(F.max("__to").alias("__all"))
    d = total.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    d = d.withColumn("__u", F.pmod(draw(seed, F.lit(length), F.col("block")), F.col("__all"))).select(*by, "block", "__u")
    j = d.join(s.select(*by, "segment", "__v", "__to"), list(by)).where((F.col("__u") < F.col("__to")) & (F.col("__u") >= F.col("__to") - F.col("__v")))
    return j.select(*by, "block", "segment", (F.col("__u") - (F.col("__to") - F.col("__v"))).alias("first"))


def block_runs(rows: DataFrame, blocks: DataFrame, by: Sequence[str], flagged: str, starts: str, length: int) -> DataFrame:
    """by, block, runs: run starts inside each block; a run that is under way when its first flag in the block comes counts one more. rows: by, segment, pos."""
    inside = blocks.select(*by, "block", "segment", F.explode(F.sequence(F.col("first"), F.col("first") + length - 1)).alias("pos"))
    j = inside.join(rows.select(*by, "segment", F.col("pos").cast("long").alias("pos"), flagged, starts), [*by, "segment", "pos"])
    g = j.groupBy(*by, "block").agg(F.count_if(starts).alias("s"), F.min_by(F.when(F.col(flagged), F.col(starts)), F.when(F.col(flagged), F.col("pos"))).alias("f"))
    return g.select(*by, "block", (F.col("s") + F.coalesce((~F.col("f")).cast("long"), F.lit(0))).alias("runs"))


def inject(paths: DataFrame, starts: DataFrame, cells: Sequence[tuple[str, int, float, str, int]], width: int, threshold: float, tail: int = 12) -> DataFrame:
    """Detection of faults added to one path: cell, path, sign, magnitude, shape, duration, trials, detected, latency, cover, tail.

    paths: stretch, pos, path, estimate, scale; starts: start_id, stretch, pos. cells: (path, sign, magnitude, shape, bars). A
    trial has the bars from width - 1 before its start to tail after its end, in one stretch. The statistic is the trailing
    median, of width bars, of the path's deviation from the median of all paths; it flags at |statistic| / scale >= threshold.
    """
    spark = paths.sparkSession
    design = spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "cell int, x string, sign int, magnitude double, shape string, duration int")
    each = F.col("k").cast("double")
    unit = F.lit(0.0)
    for name in SHAPES:
        for n in sorted({c[4] for c in cells if c[3] == name}):
            unit = F.when((F.col("shape") == name) & (F.col("duration") == n), shape(name, each, n)).otherwise(unit)
    t = starts.crossJoin(F.broadcast(design)).withColumn("k", F.explode(F.sequence(F.lit(-(width - 1)), F.col("duration") + tail - 1)))
    t = t.withColumn("at", (F.col("pos") + F.col("k")).cast("long")).drop("pos")
    t = t.withColumn("add", F.when((F.col("k") >= 0) & (F.col("k") < F.col("duration")), F.col("sign") * F.col("magnitude") * unit).otherwise(0.0))
    bar = paths.groupBy("stretch", F.col("pos").cast("long").alias("at")).agg(F.collect_list(F.struct("path", "estimate", "scale")).alias("p"))
    t = t.join(bar, ["stretch", "at"])
    shifted = F.transform("p", lambda q: q["estimate"] + F.when(q["path"] == F.col("x"), F.col("add")).otherwise(0.0))
    own = F.get(F.filter("p", lambda q: q["path"] == F.col("x")), F.lit(0))  # null where the bar lacks the path
    t = t.withColumns({"dev": own["estimate"] + F.col("add") - median_of(F.array_sort(shifted)), "scale": own["scale"]})
    key = ["cell", "start_id"]
    t = statistic(t.withColumn("ts", F.col("k")), key, "dev", "median", width, "full")
    flag = F.coalesce(F.abs("median") / F.when(F.col("scale") > 0, F.col("scale")) >= threshold, F.lit(False))
    during = (F.col("k") >= 0) & (F.col("k") < F.col("duration"))
    g = t.withColumn("flag", flag).groupBy(*key).agg(F.min(F.when(F.col("flag") & during, F.col("k"))).alias("first"), F.count_if(F.col("flag") & during).alias("cover"), F.count_if(F.col("flag") & (F.col("k") >= F.col("duration"))).alias("tail"))
    g = g.groupBy("cell").agg(F.count(F.lit(1)).alias("trials"), F.count("first").alias("detected"), F.avg("first").alias("latency"), F.avg("cover").alias("cover"), F.avg("tail").alias("tail"))
    return design.withColumnRenamed("x", "path").join(g, "cell")


def normal(seed: int, *parts: Column) -> Column:
    """A standard normal draw (Box-Muller) that follows from the seed and the parts."""
    u = lambda s: (draw(seed, F.lit(s), *parts) + 0.5) / float(1 << 48)
    return F.sqrt(-2 * F.log(u("r"))) * F.cos(2 * math.pi * u("a"))


def worlds(spark, trials: int, nodes: Sequence[str], seed: int = 3, strength_bps: float = 50.0, noise_bps: float = 1.0, spread_bps: float = 4.0, fault_bps: Sequence[float] = (0.0, 5.0, 20.0, 60.0)) -> DataFrame:
    """Synthetic bars: trial, fault (bps), ts, a, b, y, s, hit (whether the pair has the fault). Pairs are differences of node strengths plus noise."""
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate((a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :])], "pair int, a string, b string")
    faults = spark.createDataFrame([(float(f),) for f in fault_bps], "fault double")
    t = spark.range(trials).select(F.col("id").alias("trial")).crossJoin(F.broadcast(faults)).crossJoin(F.broadcast(pairs))
    n = len(nodes) * (len(nodes) - 1) // 2
    hit = (F.pmod(draw(seed, F.lit("leg"), F.col("trial")), F.lit(n)) == F.col("pair")) & (F.col("fault") > 0)
    c = lambda x: strength_bps * normal(seed, F.lit("c"), F.col("trial"), F.col(x))
    y = c("a") - c("b") + noise_bps * normal(seed, F.lit("e"), F.col("trial"), F.col("pair")) + F.when(hit, F.col("fault")).otherwise(0.0)
    stamp = F.timestamp_seconds(F.col("trial") * 100 + F.dense_rank().over(Window.partitionBy("trial").orderBy("fault"))).cast("timestamp_ntz")
    return t.select("trial", "fault", stamp.alias("ts"), "a", "b", y.alias("y"), F.lit(spread_bps).alias("s"), hit.alias("hit"))


def anchoring(hours: DataFrame, least: int = 10, multiple: float = 2.0) -> DataFrame:
    """One row: which clock the hourly peak follows. hours: cell (daylight-saving), hour, n, mean, se.

    The winter's and the summer's peak hours are looked up in the weeks when London has winter and New York summer time;
    the means there must differ by multiple of their joint standard error.
    """
    peak = lambda c, n: hours.where((F.col("cell") == c) & (F.col("n") >= least)).agg(F.min_by("hour", F.struct(-F.col("mean"), F.col("hour"))).alias(n))
    both = peak("both_winter", "winter_peak").crossJoin(peak("both_summer", "summer_peak"))
    mixed = hours.where((F.col("cell") == "uk_winter_us_summer") & (F.col("n") >= 2))
    at = lambda p: mixed.select(F.col("hour").alias(f"{p}_hour"), F.col("mean").alias(f"{p}_mean"), F.coalesce("se", F.lit(0.0)).alias(f"{p}_se"))
    j = both.join(at("uk"), F.col("winter_peak") == F.col("uk_hour"), "left").join(at("us"), F.col("summer_peak") == F.col("us_hour"), "left")
    diff, se = F.col("us_mean") - F.col("uk_mean"), F.sqrt(F.col("us_se") * F.col("us_se") + F.col("uk_se") * F.col("uk_se"))
    verdict = F.when(F.col("winter_peak").isNull() | F.col("summer_peak").isNull(), "no eligible hour").when(F.col("winter_peak") == F.col("summer_peak"), "no shift").when(diff.isNull(), "too few bars")
    verdict = verdict.when((se > 0) & (diff > multiple * se), "US").when((se > 0) & (-diff > multiple * se), "UK").otherwise("indeterminate")
    return j.select("winter_peak", "summer_peak", diff.alias("difference"), se.alias("joint_se"), verdict.alias("verdict"))


def decimals(values: DataFrame, by: Sequence[str], value: str, most: int = 8) -> DataFrame:
    """by, decimals: the least number of decimals that gives every value; null if it is over most."""
    need = F.lit(None).cast("int")
    for d in range(most, -1, -1):
        need = F.when(F.round(F.col(value), d) == F.col(value), d).otherwise(need)
    g = values.where(F.col(value).isNotNull()).groupBy(*by).agg(F.max(need).alias("decimals"), F.count_if(need.isNull()).alias("__over"))
    return g.select(*by, F.when(F.col("__over") == 0, F.col("decimals")).alias("decimals"))
