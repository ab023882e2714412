"""Queries of small functions over the driver's tables: strict scans, ISO texts, calendar periods, quarters, medians by hour and path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timepolicy
from ..operators import graph, runlevel, strengths
from ..sources import candles
from ..sources.views import BARS, QUOTES, bars, ntz, quotes, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(f"WITH {BARS} SELECT instrument, epoch(ts)::BIGINT AS epoch, round(bid_close, 6) AS bid_close, round(ask_close, 6) AS ask_close FROM bars")
def close_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Closing prices by epoch second, from a scan that refuses bad rows and reads no other column."""
    s = candles.strict(bars(spark, sf))
    return s.select("instrument", F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch"), F.round("bid_close", 6).alias("bid_close"), F.round("ask_close", 6).alias("ask_close"))


@query("""WITH t AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS s, CASE event_id % 4 WHEN 0 THEN '.123456789Z' WHEN 1 THEN '+02:00' WHEN 2 THEN '.5Z' ELSE '' END AS o, ts FROM events)
 SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(date_trunc('second', ts)) + 123456 WHEN 1 THEN epoch_us(date_trunc('second', ts)) - 7200000000 WHEN 2 THEN epoch_us(date_trunc('second', ts)) + 500000 END AS micros FROM t""")
def iso_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Stamps written with nine digits, an offset, one digit and no offset at all, read back."""
    k = F.col("event_id") % 4
    end = F.when(k == 0, ".123456789Z").when(k == 1, "+02:00").when(k == 2, ".5Z").otherwise("")
    text = F.concat(F.date_format(ntz(F.col("ts")), "yyyy-MM-dd'T'HH:mm:ss"), end)
    return table(spark, sf, "events").select("event_id", F.unix_micros(timepolicy.parse_iso(text)).alias("micros"))


@query("""WITH c AS (SELECT o_orderpriority AS instrument, min(o_orderdate)::TIMESTAMP AS low, max(o_orderdate)::TIMESTAMP AS high FROM orders GROUP BY 1), y AS (SELECT *, unnest(range(year(low), year(high) + 1)) AS y FROM c)
 SELECT instrument, y::VARCHAR AS period, greatest(make_timestamp(y, 1, 1, 0, 0, 0), low) AS start, least(make_timestamp(y + 1, 1, 1, 0, 0, 0) - INTERVAL 1 SECOND, high) AS "end" FROM y""")
def calendar_periods(spark: SparkSession, sf: str) -> DataFrame:
    """The calendar years of each series' coverage, the first and last one as far as it goes."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("instrument"), ntz(F.col("o_orderdate")).alias("ts"))
    return timepolicy.year_periods(o, ["instrument"])


@query("""WITH q AS (SELECT DISTINCT year(o_orderdate) AS y, quarter(o_orderdate) AS q FROM orders) SELECT right(y::VARCHAR, 2) || 'Q' || q AS label, make_timestamp(y + q // 4, q % 4 * 3 + 1, 1, 0, 0, 0) - INTERVAL 1 SECOND AS "end" FROM q""")
def quarters(spark: SparkSession, sf: str) -> DataFrame:
    """The quarters that orders fall in, by label and last second."""
    ts = ntz(F.col("o_orderdate"))
    return table(spark, sf, "orders").select(timepolicy.quarter_label(ts).alias("label"), timepolicy.quarter_last(ts).alias("end")).distinct()


@query(f"""WITH {QUOTES}, o AS (SELECT ts, a, b, ln(ask / bid) * 10000 AS s FROM quotes WHERE bid > 0 AND bid < ask), d AS (SELECT ts, a AS p, b AS q, s FROM o UNION ALL SELECT ts, b, a, s FROM o),
 pa AS (SELECT ts, 'hub' AS path, s AS spread FROM d WHERE p = 'AFRICA' AND q = 'AMERICA' UNION ALL SELECT x.ts, 'arm:' || x.q, x.s + y.s FROM d x JOIN d y ON x.ts = y.ts AND x.q = y.p AND x.p = 'AFRICA' AND y.q = 'AMERICA' WHERE x.q <> 'AMERICA' AND y.p <> 'AFRICA'),
 l AS (SELECT ts, path, list(spread) OVER (PARTITION BY path, hour(ts) ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS l FROM pa)
 SELECT ts, path, round(CASE WHEN len(l) >= 10 THEN list_aggregate(l, 'quantile_cont', 0.5) END, 5) AS hour_median FROM l""")
def path_hour_medians(spark: SparkSession, sf: str) -> DataFrame:
    """The median of each path's last sixty spreads at the same hour."""
    p = strengths.paths(graph.observations(quotes(spark, sf)), ("AFRICA", "AMERICA"))
    return runlevel.same_hour_median(p, ["path"], "spread").select("ts", "path", F.round("hour_median", 5).alias("hour_median"))
