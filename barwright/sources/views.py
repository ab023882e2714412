"""Views of the driver's tables in the roles that the engine's operators expect, each with its SQL twin.

bars: candles by instrument and hour, with gaps; quotes: bid and ask of pairs of regions by month, for the market graph;
trades: closed trades by group; equity: a daily equity curve by group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SIDES = ("open", "high", "low", "close")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ntz(c):
    return c.cast("timestamp_ntz")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instrument, ts, bid_* and ask_* (open, high, low, close), volume, mid."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value", "props")
    key = F.struct("ts", "event_id")
    g = e.groupBy(F.col("event_type").alias("instrument"), ntz(F.date_trunc("hour", "ts")).alias("hour")).agg(
        F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"), F.max_by("props", key).alias("props"),
    )
    half = (1 + F.regexp_extract("props", "([0-9]+)", 1).cast("int")) * F.lit(1e-4)
    g = g.select("instrument", F.col("hour").alias("ts"), *[(F.col(s) * (1 - half)).alias(f"bid_{s}") for s in SIDES], *[(F.col(s) * (1 + half)).alias(f"ask_{s}") for s in SIDES], "volume")
    return g.withColumn("mid", (F.col("bid_close") + F.col("ask_close")) / 2)


BARS = """bars0 AS (SELECT event_type AS instrument, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS o, max(value) AS h, min(value) AS l,
  arg_max(value, (ts, event_id)) AS c, count(*)::DOUBLE AS volume, (1 + regexp_extract(arg_max(props, (ts, event_id)), '([0-9]+)', 1)::INT) * 0.0001::DOUBLE AS half FROM events GROUP BY ALL),
bars1 AS (SELECT instrument, ts, o * (1 - half) AS bid_open, h * (1 - half) AS bid_high, l * (1 - half) AS bid_low, c * (1 - half) AS bid_close,
  o * (1 + half) AS ask_open, h * (1 + half) AS ask_high, l * (1 + half) AS ask_low, c * (1 + half) AS ask_close, volume FROM bars0),
bars AS (SELECT *, (bid_close + ask_close) / 2 AS mid FROM bars1)"""


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts (month), a, b (regions, a < b), bid, ask, volume (lines), hi, lo (of the unit price)."""
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    c = t("customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("ra"))
    s = t("supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("rb"))
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderdate").join(c, F.col("o_custkey") == F.col("c_custkey"))
    x = t("lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    x = x.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).where("ra <> rb")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    g = x.groupBy(ntz(F.date_trunc("month", "o_orderdate")).alias("ts"), F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(
        F.avg(unit).alias("u"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("x"), F.count(F.lit(1)).cast("double").alias("volume"), F.max(unit).alias("hi"), F.min(unit).alias("lo")
    )
    return g.select("ts", "a", "b", (F.col("u") * (1 - F.col("d"))).alias("bid"), (F.col("u") * (1 + F.col("x"))).alias("ask"), "volume", "hi", "lo")


QUOTES = """quotes0 AS (SELECT date_trunc('month', o_orderdate) AS ts, least(rc.r_name, rs.r_name) AS a, greatest(rc.r_name, rs.r_name) AS b,
  avg(l_extendedprice / l_quantity) AS u, avg(l_discount) AS d, avg(l_tax) AS x, count(*)::DOUBLE AS volume, max(l_extendedprice / l_quantity) AS hi, min(l_extendedprice / l_quantity) AS lo
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation nc ON c_nationkey = nc.n_nationkey JOIN nation ns ON s_nationkey = ns.n_nationkey JOIN region rc ON nc.n_regionkey = rc.r_regionkey JOIN region rs ON ns.n_regionkey = rs.r_regionkey
  WHERE rc.r_name <> rs.r_name GROUP BY ALL),
quotes AS (SELECT ts, a, b, u * (1 - d) AS bid, u * (1 + x) AS ask, volume, hi, lo FROM quotes0)"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades of lines: grp, seq keys, entry_ts, exit_ts, pnl (after commission), commission."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    x = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return x.select(
        F.col("l_returnflag").alias("grp"), F.least("o_orderdate", "l_shipdate").alias("entry_ts"), F.greatest("o_orderdate", "l_shipdate").alias("exit_ts"),
        (F.col("l_extendedprice") * (F.col("l_tax") - F.col("l_discount"))).alias("pnl"), (F.col("l_extendedprice") * 0.001).alias("commission"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


TRADES = """trades AS (SELECT l_returnflag AS grp, least(o_orderdate, l_shipdate) AS entry_ts, greatest(o_orderdate, l_shipdate) AS exit_ts,
  l_extendedprice * (l_tax - l_discount) AS pnl, l_extendedprice * 0.001::DOUBLE AS commission, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
#: Order in which the trades of a group closed; these keys are unique.
CLOSING = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def equity(spark: SparkSession, sf_dir: str, start: float = 1e6) -> DataFrame:
    """grp, ts (ship date), equity: start plus the running sum of the daily pnl."""
    daily = trades(spark, sf_dir).groupBy("grp", F.col("l_shipdate").alias("ts")).agg(F.sum("pnl").alias("pnl"))
    w = Window.partitionBy("grp").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("grp", "ts", (F.lit(start) + F.sum("pnl").over(w)).alias("equity"))


EQUITY = (
    TRADES
    + """, daily AS (SELECT grp, l_shipdate AS ts, sum(pnl) AS pnl FROM trades GROUP BY ALL),
equity AS (SELECT grp, ts, 1e6::DOUBLE + sum(pnl) OVER (PARTITION BY grp ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM daily)"""
)
