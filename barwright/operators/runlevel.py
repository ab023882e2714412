"""Run-level statistics: stretches of bars without a gap, robust statistics of trailing windows, latches, run counts, CUSUM.

All are window functions over a series or a stretch of it; only EWMA, a true recurrence, runs along each stretch in pandas.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import hodges_lehmann, huber_location, median_of, sorted_window, trimmed_mean
from .indicators import along, in_order


def with_stretch(rows: DataFrame, by: Sequence[str], step: str = "1 HOUR", carry: int = 0, out: str = "stretch") -> DataFrame:
    """Numbers the stretches of each series: a new one begins where more than carry bars of the step are missing."""
    w = in_order(by)
    far = F.col("ts") > F.lag("ts").over(w) + F.expr(f"INTERVAL {step}") * (carry + 1)
    return rows.withColumn(out, F.sum(F.coalesce(far, F.lit(True)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def stretch_geometry(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """pos and left: the bar's place in its stretch, from 0, and the bars after it there."""
    key = [*by, "stretch"]
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    return rows.withColumn("pos", F.row_number().over(in_order(key)) - 1).withColumn("left", (n - 1 - F.col("pos")).cast("int"))


def fill_gaps(rows: DataFrame, by: Sequence[str], carry: int, seconds: int = 3600) -> DataFrame:
    """Rows of nulls for the missing bars inside stretches of gaps up to carry bars (the carry policy); real says which rows were there."""
    w = in_order(by)
    there = rows.withColumn("real", F.lit(True))
    after = F.lead("ts").over(w)
    miss = (F.unix_seconds(after.cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))) / seconds - 1
    holes = rows.select(*by, "ts", miss.cast("int").alias("__n")).where(f"__n BETWEEN 1 AND {carry}")
    holes = holes.select(*by, F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__k"), F.col("ts").alias("__t"))
    holes = holes.select(*by, (F.col("__t") + F.make_dt_interval(secs=(F.col("__k") * seconds).cast("decimal(18,6)"))).alias("ts"), F.lit(False).alias("real"))
    return there.unionByName(holes, allowMissingColumns=True)


def bounds(width: int, centred: bool = False) -> tuple[int, int]:
    """(rows before, rows after) of a window; a centred window of even width has one row more."""
    return (-(width // 2), width // 2) if centred else (-(width - 1), 0)


def least_count(nominal: int, fill: str) -> int:
    return {"full": nominal, "half": -(-nominal // 2), "third": -(-nominal // 3), "min3": min(3, nominal)}[fill]


STATS = ("median", "mean", "trim20", "hl", "huber", "sign")


def statistic(rows: DataFrame, by: Sequence[str], value: str, stat: str, width: int, fill: str = "full", centred: bool = False, out: str | None = None) -> DataFrame:
    """A statistic of the valid values in a window; null with fewer of them than fill asks for, and where the bar's own value is missing."""
    w = in_order(by).rowsBetween(*bounds(width, centred))
    low, high = bounds(width, centred)
    enough = (F.count(value).over(w) >= least_count(high - low + 1, fill)) & F.col(value).isNotNull()
    out = out or stat
    if stat == "mean":
        return rows.withColumn(out, F.when(enough, F.avg(value).over(w)))
    if stat == "sign":
        return rows.withColumn(out, F.when(enough, F.avg(F.signum(value)).over(w)))
    kinds = {"median": median_of, "trim20": trimmed_mean, "hl": hodges_lehmann, "huber": huber_location}
    held = rows.withColumn("__v", F.when(enough, sorted_window(value, w)))
    return held.withColumn(out, F.when(F.col("__v").isNotNull(), kinds[stat](F.col("__v")))).drop("__v")


def rolling_mad(rows: DataFrame, by: Sequence[str], value: str, width: int, least: int, out: str = "mad") -> DataFrame:
    """Median absolute deviation (not scaled) of a trailing window."""
    w = in_order(by).rowsBetween(-(width - 1), 0)
    held = rows.withColumn("__v", sorted_window(value, w)).withColumn("__m", median_of(F.col("__v")))
    mad = median_of(F.array_sort(F.transform("__v", lambda x: F.abs(x - F.col("__m")))))
    return held.withColumn(out, F.when(F.size("__v") >= least, mad)).drop("__v", "__m")


def same_hour_median(rows: DataFrame, by: Sequence[str], value: str, width: int = 60, least: int = 10, out: str = "hour_median") -> DataFrame:
    """Median of the last width values at the same hour, this bar's not among them; null with fewer than least."""
    w = Window.partitionBy(*by, F.hour("ts")).orderBy("ts").rowsBetween(-width, -1)
    return rows.withColumn(out, F.when(F.count(value).over(w) >= least, F.percentile(value, 0.5).over(w)))


def ewma(rows: DataFrame, by: Sequence[str], value: str, half_life: float, least: int = 3, out: str = "ewma") -> DataFrame:
    """Exponentially weighted mean that starts anew after a missing value; null for its first values."""
    a = 1 - 0.5 ** (1 / half_life)

    def run(s):
        x = s[value].to_numpy(float)
        got, mean, n = np.full(len(x), np.nan), 0.0, 0
        for i, v in enumerate(x):
            if np.isnan(v):
                n = 0
                continue
            mean = v if n == 0 else a * v + (1 - a) * mean
            n += 1
            if n >= least:
                got[i] = mean
        return {out: got}

    return along(rows, by, [out], run)


def cusum(rows: DataFrame, by: Sequence[str], value: str, k: float, out: str = "cusum") -> DataFrame:
    """Two-sided CUSUM max(0, S + x - k), from 0 after each missing value; the greater side, ties to the positive one, signed.

    A sum C less its least value so far (0 included) is the same as the recursion, so windows do it.
    """
    w = in_order(by)
    rows = rows.withColumn("__run", F.sum(F.col(value).isNull().cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    v = in_order([*by, "__run"]).rowsBetween(Window.unboundedPreceding, 0)
    sums = {"__p": F.sum(F.col(value) - k).over(v), "__n": F.sum(-F.col(value) - k).over(v)}
    rows = rows.withColumns(sums)
    side = lambda c: F.col(c) - F.least(F.lit(0.0), F.min(c).over(v))
    rows = rows.withColumns({"__sp": side("__p"), "__sn": side("__n")})
    both = F.when(F.col("__sp") >= F.col("__sn"), F.col("__sp")).otherwise(-F.col("__sn"))
    return rows.withColumn(out, F.when(F.col(value).isNotNull(), both)).drop("__run", "__p", "__n", "__sp", "__sn")


def flag(stat: Column, scale: Column, threshold: float) -> Column:
    """|stat| / scale >= threshold; a missing or unscaled value isn't flagged."""
    return F.coalesce(F.when(scale > 0, F.abs(stat) / scale >= threshold), F.lit(False))


def latch(rows: DataFrame, by: Sequence[str], enter: Column, stay: Column, out: str = "latched") -> DataFrame:
    """True from a row with enter (and stay) for as long as stay holds."""
    w = in_order(by)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"__e": F.coalesce(enter & stay, F.lit(False)), "__s": F.coalesce(stay, F.lit(False))})
    rows = rows.withColumn("__c", F.sum((~F.col("__s")).cast("long")).over(run))
    met = F.max(F.col("__e")).over(in_order([*by, "__c"]).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(out, F.col("__s") & met).drop("__e", "__s", "__c")


def run_starts(rows: DataFrame, by: Sequence[str], flagged: str, gap: int, out: str = "starts") -> DataFrame:
    """Whether a flagged bar has no flag in the gap bars before it."""
    before = F.max(F.col(flagged).cast("int")).over(in_order(by).rowsBetween(-gap, -1))
    return rows.withColumn(out, F.col(flagged) & (F.coalesce(before, F.lit(0)) == 0))


def run_counts(rows: DataFrame, by: Sequence[str], flagged: str, gaps: Sequence[int]) -> DataFrame:
    """(by, gap, flagged, runs) for each of several gaps, in one pass over the rows."""
    for g in gaps:
        rows = run_starts(rows, by, flagged, g, f"__g{g}")
    g = rows.groupBy(*by).agg(F.count_if(flagged).alias("flagged"), *[F.count_if(f"__g{g}").alias(f"__g{g}") for g in gaps])
    return g.select(*by, "flagged", F.explode(F.array(*[F.struct(F.lit(x).alias("gap"), F.col(f"__g{x}").alias("runs")) for x in gaps])).alias("r")).select(*by, "r.gap", "flagged", "r.runs")


def time_runs(rows: DataFrame, by: Sequence[str], within: str = "3 HOURS") -> DataFrame:
    """Runs of stamps no further than within from the one before: start, end, bars."""
    w = in_order(by)
    new = F.coalesce(F.col("ts") > F.lag("ts").over(w) + F.expr(f"INTERVAL {within}"), F.lit(True))
    out = rows.withColumn("__r", F.sum(new.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy(*by, "__r").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("bars")).drop("__r")


def quiet_ends(rows: DataFrame, by: Sequence[str], value: str, threshold: float, n: int) -> DataFrame:
    """The first bar of each series that begins n bars in a row with |value| under the threshold; null if there is none."""
    w = in_order(by).rowsBetween(0, n - 1)
    quiet = F.coalesce(F.abs(value) < threshold, F.lit(False)).cast("int")
    ok = (F.sum(quiet).over(w) == n) & (F.count(F.lit(1)).over(w) == n)
    return rows.withColumn("__q", ok).groupBy(*by).agg(F.min(F.when(F.col("__q"), F.col("ts"))).alias("quiet_from"))


def gated_estimate(estimate: Column, gate: Column) -> Column:
    return F.when(gate & estimate.isNotNull(), estimate).otherwise(0.0)


def spec_grid(spark, stats: Sequence[str] = STATS, widths: Sequence[int] = (6, 12, 24), fills: Sequence[str] = ("full", "half"), centred: Sequence[bool] = (False, True)) -> DataFrame:
    """The table of statistic specifications, with their names."""
    rows = [(f"{s}|W{w}|{f}|{'centred' if c else 'trailing'}", s, w, f, c) for s in stats for w in widths for f in fills for c in centred]
    return spark.createDataFrame(rows, "sid string, stat string, width int, fill string, centred boolean")
