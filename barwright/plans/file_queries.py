"""Queries of files that are written from the tables and read back: dumps of bars, headerless files in order of precedence."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import checkpoints
from ..sources import candles, dumps
from ..sources.views import BARS, SIDES, bars
from .candle_queries import rounds

QUERIES: dict = {}
ORACLES: dict = {}
_HAT = (0.1, 0.2, 0.3, 0.4)


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def folder(spark: SparkSession, name: str) -> str:
    """A new name in the folder that driver and executors share."""
    checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


_S = [f"round((ask_{s} - bid_{s}) / mid * 10000, 4)" for s in SIDES]
_DUMP = f"""{BARS}, d0 AS (SELECT instrument, ts, (ask_close - bid_close) / mid * 10000 > 190 AS masked, [{", ".join(_S)}] AS spread,
  [{", ".join("NULL" if s == "low" else f"round(((ask_{s} - bid_{s}) / mid * 10000 - 100) / volume, 4)" for s in SIDES)}] AS z FROM bars),
 d1 AS (SELECT *, list_avg(spread) AS ms, coalesce(ts - lag(ts) OVER w = INTERVAL 1 HOUR, false) AS near, coalesce(NOT lag(masked) OVER w, false) AS was FROM d0 WINDOW w AS (PARTITION BY instrument ORDER BY ts)),
 d2 AS (SELECT *, sum((NOT near)::INT) OVER w - 1 AS stretch, CASE WHEN NOT masked THEN sum((NOT masked AND NOT (near AND was))::INT) OVER w - 1 END AS clean_stretch, hour(ts) AS h,
  (hour(ts) - CASE WHEN date_diff('hour', ts, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') = -4 THEN 21 ELSE 22 END + 24) % 24 AS o FROM d1 WINDOW w AS (PARTITION BY instrument ORDER BY ts ROWS UNBOUNDED PRECEDING))"""


@query(f"""WITH {_DUMP} SELECT instrument, ts, masked, round(ms, 6) AS ms, round(CASE WHEN count(ms) OVER w >= 10 THEN quantile_cont(ms, 0.5) OVER w END + 1e-9, 6) AS med, stretch::BIGINT AS stretch, clean_stretch::BIGINT AS clean_stretch,
 CASE WHEN o = 0 THEN 'rollover_ny' WHEN o IN (1, 23) THEN 'adjacent_ny' WHEN h BETWEEN 8 AND 15 THEN 'flat' ELSE 'other' END AS cls,
 {", ".join(f"round(coalesce(z[{i}] * spread[{i}] * sqrt(1 - {h}::DOUBLE), 0), 6) + 0.0 AS res_{s}" for i, (s, h) in enumerate(zip(SIDES, _HAT), 1))}
 FROM d2 WINDOW w AS (PARTITION BY instrument, h ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""")
def bar_dump(spark: SparkSession, sf: str) -> DataFrame:
    """Bars written as JSON lines and read back with means, medians by hour, classes, residuals and stretches."""
    spread = lambda s: (F.col(f"ask_{s}") - F.col(f"bid_{s}")) / F.col("mid") * 1e4
    z = [F.lit(None).cast("double") if s == "low" else (spread(s) - 100) / F.col("volume") for s in SIDES]
    path = folder(spark, "dump")
    dumps.write_bars(bars(spark, sf).select("instrument", "ts", (spread("close") > 190).alias("masked"), F.array(*map(spread, SIDES)).alias("spread"), F.array(*z).alias("z")), path)
    d = dumps.read_bars(spark, path, ["instrument"], _HAT)
    res = [(F.round(F.get("res", F.lit(i)), 6) + 0.0).alias(f"res_{s}") for i, s in enumerate(SIDES)]
    d = d.withColumn("med", F.col("med") + 1e-9)  # medians of dumped numbers end in a 5 at the seventh digit
    return rounds(d.select("instrument", "ts", "masked", "ms", "med", "stretch", "clean_stretch", "cls", *res), [])


@query(f"""WITH {BARS}, f AS (SELECT instrument, ts, mid, volume, CASE WHEN hour(ts) % 3 = 0 THEN 1.02 WHEN hour(ts) % 2 = 0 THEN 1.01 ELSE 1 END AS k FROM bars)
 SELECT instrument, ts, round(mid * k, 6) AS bid_close, round(mid * k, 6) AS ask_close, volume FROM f""")
def headerless_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of all, of even and of every third hour in a historical and two quarters' folders, broken lines among them; later folders win."""
    path, b = folder(spark, "files"), bars(spark, sf)
    price = lambda k: [(F.col("mid") * k).cast("string")] * 4
    line = lambda k: F.concat_ws(",", F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), *price(k), F.col("volume").cast("string"), F.lit("1"))
    hour = F.hour("ts")
    for name, k, some in (("24Q2", 1.02, hour % 3 == 0), ("historical", 1.0, F.lit(True)), ("23Q4", 1.01, hour % 2 == 0)):
        lines = b.where(some).select("instrument", line(k).alias("value"))
        broken = b.select("instrument").distinct().select("instrument", F.lit("not,a,candle").alias("value"))
        lines.unionByName(broken).write.partitionBy("instrument").text(f"{path}/{name}")
    names = [r[0] for r in b.select("instrument").distinct().collect()]  # names of series: some tens
    found = candles.source_folders(["24Q2", "other", "historical", "23Q4"])
    series = [candles.merge_sources([candles.read_trades_csv(spark, f"{path}/{f}/instrument={n}", n) for f in found]) for n in sorted(names)]
    out = series[0]
    for s in series[1:]:
        out = out.unionByName(s)
    return rounds(out.select("instrument", "ts", "bid_close", "ask_close", "volume"), [])
