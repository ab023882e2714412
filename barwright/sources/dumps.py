"""Dumps of bars as JSON lines: written with rounded numbers, read back with what experiments derive from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import mean_of
from ..functions.timepolicy import dst_cell, hour_classes
from ..operators.indicators import in_order
from ..operators.runlevel import same_hour_median

#: The classes of an hour in order of precedence.
CLASSES = ("rollover_ny", "adjacent_ny", "flat")
STAMP = "yyyy-MM-dd'T'HH:mm:ss"


def write_bars(bars: DataFrame, path: str, digits: int = 4) -> None:
    """bars (keys, ts, masked, spread, z: arrays by leg) as JSON lines under path, which must not exist; array values to digits places."""
    fine = lambda c: F.transform(c, lambda x: F.round(x, digits))
    keys = [c for c in bars.columns if c not in ("ts", "masked", "spread", "z")]
    out = bars.select(*keys, F.date_format("ts", STAMP).alias("t"), "masked", fine("spread").alias("spread"), fine("z").alias("z"))
    out.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def primary_class(ts: Column) -> Column:
    """The first of CLASSES that the hour is in; else other."""
    found = F.filter(F.array(*map(F.lit, CLASSES)), lambda c: F.array_contains(hour_classes(ts), c))
    return F.coalesce(F.get(found, F.lit(0)), F.lit("other"))


def read_bars(spark: SparkSession, path: str, keys: Sequence[str], hat: Sequence[float]) -> DataFrame:
    """keys (texts), ts, masked, spread, z, ms, med, cell, cls, res, stretch, clean_stretch of a dump.

    ms: the mean spread; med: the median of earlier ones at the same hour; res: residuals z * spread * sqrt(1 - hat), 0 where
    z is null; stretch: runs of bars an hour apart, from 0; clean_stretch: runs of unmasked bars, null where masked. Windows
    are by keys. Lines that can't be read fail the query; an empty folder gives no rows.
    """
    schema = ", ".join(f"`{k}` string" for k in keys) + (", " if keys else "") + "t string, masked boolean, spread array<double>, z array<double>"
    raw = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    x = raw.select(*keys, F.to_timestamp_ntz("t", F.lit(STAMP)).alias("ts"), "masked", "spread", "z").withColumn("ms", mean_of(F.col("spread")))
    leverage = F.array(*[F.lit(float(h)) for h in hat])
    res = F.transform(F.arrays_zip("spread", "z", leverage.alias("h")), lambda e: F.coalesce(e["z"] * e["spread"] * F.sqrt(1 - e["h"]), F.lit(0.0)))
    x = same_hour_median(x, keys, "ms", out="med").withColumns({"cell": dst_cell(F.col("ts")), "cls": primary_class(F.col("ts")), "res": res})
    w = in_order(keys)
    near = F.coalesce(F.col("ts") == F.lag("ts").over(w) + F.expr("INTERVAL 1 HOUR"), F.lit(False))
    clean = ~F.col("masked")
    x = x.withColumns({"__new": ~near, "__fresh": clean & ~(near & F.coalesce(F.lag(clean).over(w), F.lit(False)))})
    upto = w.rowsBetween(-(2**63), 0)
    count = lambda c: F.sum(F.col(c).cast("long")).over(upto) - 1
    return x.withColumns({"stretch": count("__new"), "clean_stretch": F.when(clean, count("__fresh"))}).drop("__new", "__fresh")


def by_stamp(records: DataFrame, stamp: str, scheme: str) -> DataFrame:
    """stamp and records: a map from scheme to the record (a struct of the other columns); of records of one stamp and scheme the one of greatest text stays."""
    rest = [c for c in records.columns if c not in (stamp, scheme)]
    one = records.groupBy(stamp, scheme).agg(F.max_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias("__r"))
    return one.groupBy(stamp).agg(F.map_from_entries(F.collect_list(F.struct(scheme, "__r"))).alias("records"))
