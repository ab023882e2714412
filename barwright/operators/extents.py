"""Extents of runs by several rules, windows around runs, and what flags do inside them.

A run's neighbourhood is at most some hundred hours, so each run becomes the hours it may reach, once for all rules; these meet
the series by equality of the hour, and the searches in either direction are windows and aggregates over them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Levels that a run returns to, bars in a row that must be under it, shares of a run's peak and their bars, bars searched after and before a start, tolerance of a named run's median.
LEVELS = (1.0, 1.5, 2.0)
BLOCKS = (1, 3, 6)
SHARES, SHARE_BLOCK = (0.5, 0.25), 3
LOOK, BACK = 96, 48
MEDIAN_TOLERANCE = 0.15

HOUR = "INTERVAL 1 HOUR"


def hours(n: int | Column) -> Column:
    return F.expr(HOUR) * n


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def extents(series: DataFrame, runs: DataFrame, by: Sequence[str], value: str = "dev", levels: Sequence[float] = LEVELS, blocks: Sequence[int] = BLOCKS, shares: Sequence[float] = SHARES, share_block: int = SHARE_BLOCK, user: DataFrame | None = None) -> DataFrame:
    """by, run, rule, start, end, censored: where each run (by, run, start, end) lies by each rule, on the series (by, ts, value).

    detector: as given. rtz_x<level>_n<n>: from the first hour of the unbroken stretch with |value| >= level that leads to
    the start, BACK hours at most, to the hour before n hours in a row with |value| < level. peak_f<share>_n<n>: from the
    start to the hour before n hours in a row under the share of the largest |value| inside the run. user: the extent in
    user (by, run, start, end), the given one where it has none. A missing hour is neither under a level nor over it. A
    search that finds no end within LOOK hours is censored there; an end is never before the start. A run without any
    value has no peak: its end stays and is censored.
    """
    key = [*by, "run"]
    rules = [(f"rtz_x{x:g}_n{n}", x, None, n) for x in levels for n in blocks] + [(f"peak_f{f:g}_n{share_block}", None, f, share_block) for f in shares]
    longest = max([*blocks, share_block])
    reach = F.sequence(F.col("start") - hours(BACK), F.greatest(F.col("end"), F.col("start") + hours(LOOK - 2 + longest)), F.expr(HOUR))
    near = runs.select(*key, "start", "end", F.explode(reach).alias("ts")).join(series.select(*by, "ts", F.abs(_finite(F.col(value))).alias("__v")), [*by, "ts"], "left")
    inside = (F.col("ts") >= F.col("start")) & (F.col("ts") <= F.col("end"))
    near = near.withColumn("__peak", F.max(F.when(inside, F.col("__v"))).over(Window.partitionBy(*key)))
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(x).cast("double").alias("level"), F.lit(f).cast("double").alias("share"), F.lit(n).alias("n")) for r, x, f, n in rules]))
    near = near.withColumn("__r", rule).select(*key, "start", "end", "ts", "__v", "__peak", "__r.*")
    near = near.withColumn("__limit", F.coalesce("level", F.col("share") * F.col("__peak")))
    quiet = F.coalesce(F.col("__v") < F.col("__limit"), F.lit(False)).cast("int")
    ahead = Window.partitionBy(*key, "rule").orderBy("ts")
    block = F.lit(False)
    for n in sorted({r[3] for r in rules}):
        block = F.when(F.col("n") == n, F.sum(quiet).over(ahead.rowsBetween(0, n - 1)) == n).otherwise(block)
    near = near.withColumns({"__block": block, "__k": F.timestamp_diff("HOUR", F.col("start"), F.col("ts"))})
    low = (F.col("ts") < F.col("start")) & ~F.coalesce(F.col("__v") >= F.col("__limit"), F.lit(False))
    found = near.groupBy(*key, "start", "end", "rule").agg(
        F.min(F.when(F.col("__block") & F.col("__k").between(1, LOOK - 1), F.col("ts"))).alias("__quiet"),
        F.max(F.when(low & F.col("level").isNotNull(), F.col("ts"))).alias("__low"),
        F.first("level").alias("level"), F.first("__peak").alias("__peak"),
    )
    flat = F.col("level").isNull() & ~F.coalesce(F.col("__peak") > 0, F.lit(False))
    begin = F.when(F.col("level").isNotNull(), F.coalesce(F.col("__low") + hours(1), F.col("start") - hours(BACK))).otherwise(F.col("start"))
    stop = F.when(flat, F.col("end")).otherwise(F.greatest(F.coalesce(F.col("__quiet") - hours(1), F.col("start") + hours(LOOK - 1)), F.col("start")))
    out = found.select(*key, "rule", begin.alias("start"), stop.alias("end"), (flat | F.col("__quiet").isNull()).alias("censored"))
    given = lambda df, name: df.select(*key, F.lit(name).alias("rule"), "start", "end", F.lit(False).alias("censored"))
    out = out.unionByName(given(runs, "detector"))
    if user is not None:
        own = user.select(*key, F.col("start").alias("__s"), F.col("end").alias("__e"))
        out = out.unionByName(given(runs.join(own, key, "left").select(*key, F.coalesce("__s", "start").alias("start"), F.coalesce("__e", "end").alias("end")), "user"))
    return out


def around(spans: DataFrame, rows: DataFrame, by: Sequence[str], hours_: int = BACK) -> DataFrame:
    """The rows (by, ts) inside each span (start, end and more), before it and after it (hours_ hours at most), with part: run, pre or post."""
    reach = F.sequence(F.col("start") - hours(hours_), F.col("end") + hours(hours_), F.expr(HOUR))
    part = F.when(F.col("ts") < F.col("start"), "pre").when(F.col("ts") > F.col("end"), "post").otherwise("run")
    return spans.withColumn("ts", F.explode(reach)).join(rows, [*by, "ts"]).withColumn("part", part)


def flags_in(spans: DataFrame, flags: DataFrame, by: Sequence[str], key: Sequence[str], flag: str = "flag") -> DataFrame:
    """key, valid, flagged, latency, before, after for each span (key, start, end): its rows, those flagged, hours from its start to the first of them (-1: none), and flagged rows up to BACK hours before and after.

    A span without rows has zeros throughout.
    """
    on = F.col(flag)
    inside = F.col("part") == "run"
    first = F.min(F.when(inside & on, F.timestamp_diff("HOUR", F.col("start"), F.col("ts"))))
    got = around(spans.select(*key, "start", "end"), flags.select(*by, "ts", flag), by).groupBy(*key).agg(
        F.count_if(inside).alias("valid"), F.count_if(inside & on).alias("flagged"), F.coalesce(first, F.lit(-1)).alias("latency"),
        F.count_if((F.col("part") == "pre") & on).alias("before"), F.count_if((F.col("part") == "post") & on).alias("after"),
    )
    zero = lambda c: F.when(F.coalesce("valid", F.lit(0)) > 0, F.col(c)).otherwise(0).cast("long").alias(c)
    return spans.select(*key).join(got, list(key), "left").select(*key, *[zero(c) for c in ("valid", "flagged", "latency", "before", "after")])


def check_named(series: DataFrame, runs: DataFrame, by: Sequence[str], value: str = "dev", masked: str = "masked") -> DataFrame:
    """by, run, n, n_masked, median, ok of named runs (by, run, start, end, expected): ok if the median inside is within MEDIAN_TOLERANCE of expected, null without rows."""
    key = [*by, "run"]
    got = around(runs, series.select(*by, "ts", value, masked), by, 0).groupBy(*key, "expected").agg(F.count(F.lit(1)).alias("n"), F.count_if(masked).alias("n_masked"), F.percentile(value, 0.5).alias("median"))
    out = runs.select(*key, "expected").join(got.drop("expected"), key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(*key, zero("n"), zero("n_masked"), "median", (F.abs(F.col("median") - F.col("expected")) <= MEDIAN_TOLERANCE).alias("ok"))
