"""Candle tables: scans, last-write-wins upserts, coverage, files in order of precedence, manifests."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Files of trades without a header: unix seconds, prices, volume, number of trades.
CSV_SCHEMA = "unix_ts long, open double, high double, low double, close double, volume double, trades long"
PRICES = [f"{side}_{p}" for side in ("bid", "ask") for p in ("open", "high", "low", "close")]


def between(ts: Column, start=None, end=None) -> Column:
    """Both bounds inclusive; a missing one is open."""
    out = F.lit(True)
    if start is not None:
        out = out & (ts >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out & (ts <= F.lit(end).cast("timestamp_ntz"))
    return out


def scan(candles: DataFrame, instruments: str | Sequence[str], start=None, end=None) -> DataFrame:
    """The candles of one or more series; partition pruning and pushed filters do the work."""
    names = [instruments] if isinstance(instruments, str) else list(instruments)
    return candles.where(F.col("instrument").isin(names) & between(F.col("ts"), start, end))


def scan_all(candles: DataFrame, instruments: Sequence[str], start=None, end=None) -> DataFrame:
    """As scan, with a row of nulls for every instrument that has no candle."""
    wanted = candles.sparkSession.createDataFrame([(x,) for x in instruments], "instrument string")
    return F.broadcast(wanted).join(scan(candles, instruments, start, end), "instrument", "left")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("instrument", "ts"), seq: str = "seq") -> DataFrame:
    """old with new's rows in the place of those with the same keys; of new rows with the same keys the one of the greatest seq wins.

    Rows of old carry no seq. The winner is an aggregate by key, so that a map side combine comes before the shuffle.
    """
    values = [c for c in old.columns if c not in keys]
    both = old.withColumn("__n", F.lit(None).cast("long")).unionByName(new.select(*old.columns, F.col(seq).cast("long").alias("__n")))
    best = F.max(F.struct("__n", *values)).alias("best")
    return both.groupBy(*keys).agg(best).select(*keys, *[F.col(f"best.{v}").alias(v) for v in values]).select(*old.columns)


def write_upserted(old_path: str, new: DataFrame, out_path: str, keys: Sequence[str] = ("instrument", "ts")) -> None:
    """An upsert of files: the merged table goes to a new folder, by instrument; a reader switches once it is complete."""
    spark = new.sparkSession
    upsert(spark.read.parquet(old_path), new, keys).repartition("instrument").sortWithinPartitions(*keys).write.partitionBy("instrument").parquet(out_path)


def coverage(candles: DataFrame, by: Sequence[str] = ("instrument",)) -> DataFrame:
    return candles.groupBy(*by).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


def strict(candles: DataFrame) -> DataFrame:
    """instrument, ts, bid_close, ask_close; the query fails on a row without a stamp or with bid > ask."""
    bad = F.col("ts").isNull() | (F.col("bid_close") > F.col("ask_close"))
    return candles.select("instrument", F.when(bad, F.raise_error(F.lit("bad candle"))).otherwise(F.col("ts")).alias("ts"), "bid_close", "ask_close")


def read_trades_csv(spark: SparkSession, paths: str | Sequence[str], instrument: str, start=None, end=None) -> DataFrame:
    """Headerless files as candles with bid = ask = price; lines that don't parse are skipped."""
    raw = spark.read.schema(CSV_SCHEMA).option("mode", "DROPMALFORMED").csv(paths).where("unix_ts IS NOT NULL")
    ts = F.timestamp_seconds("unix_ts").cast("timestamp_ntz")
    out = raw.select(F.lit(instrument).alias("instrument"), ts.alias("ts"), *[F.col(p.split("_")[1]).alias(p) for p in PRICES], "volume")
    return out.where(between(F.col("ts"), start, end))


def source_folders(names: Sequence[str]) -> list[str]:
    """'historical' first, then the folders named like 24Q3 in order of time."""
    quarters = sorted((x for x in names if re.fullmatch(r"[0-9]{2}Q[1-4]", x)), key=lambda x: (int(x[:2]), int(x[3])))
    return [x for x in names if x == "historical"] + quarters


def window_end(names: Sequence[str]) -> tuple[int, int] | None:
    """(year, quarter) of the last quarter folder."""
    found = [x for x in source_folders(names) if x != "historical"]
    return (2000 + int(found[-1][:2]), int(found[-1][3])) if found else None


def merge_sources(parts: Sequence[DataFrame], keys: Sequence[str] = ("instrument", "ts")) -> DataFrame:
    """Candles of several sources, a later source's in the place of an earlier one's."""
    tagged = [p.withColumn("seq", F.lit(i)) for i, p in enumerate(parts)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    return upsert(parts[0].limit(0), both, keys)


def format_check(candles: DataFrame, by: Sequence[str] = ("instrument",)) -> DataFrame:
    """Counts of rows that break a rule, by series: all conditions in one pass."""
    c = F.col
    high = lambda s: c(f"{s}_high") < F.greatest(c(f"{s}_open"), c(f"{s}_close"), c(f"{s}_low"))
    low = lambda s: c(f"{s}_low") > F.least(c(f"{s}_open"), c(f"{s}_close"), c(f"{s}_high"))
    return candles.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c("bid_close") > c("ask_close")).alias("crossed"), F.count_if(high("bid") | high("ask")).alias("bad_high"), F.count_if(low("bid") | low("ask")).alias("bad_low"),
        F.count_if(F.least(*[c(p) for p in PRICES]) <= 0).alias("not_positive"), F.count_if(c("volume").isNull()).alias("no_volume"), F.count_if((F.minute("ts") != 0) | (F.second("ts") != 0)).alias("off_hour"),
        F.countDistinct(F.length(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))).alias("stamp_lengths"),
    )


def manifest(candles: DataFrame, by: Sequence[str] = ("instrument",)) -> DataFrame:
    """rows, first, last and a digest of each series that depends on the order of its rows in time (rows of one stamp: of their text).

    The digest is a hash tree: the rows of a day, in order, are hashed to one digest, the days of a month to one, the months
    to the series', so that no task gathers more than a day's rows, 31 days or a series' months.
    """
    row = F.concat_ws("|", *by, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), *[F.format_string("%.6f", F.col(p)) for p in ("bid_close", "ask_close")], F.format_string("%.0f", F.col("volume")))
    hashed = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n").cast("binary"), 256)
    part = lambda name: F.concat_ws("|", F.col(name), "digest")
    days = candles.groupBy(*by, F.date_format("ts", "yyyy-MM").alias("month"), F.date_format("ts", "dd").alias("day"))
    days = days.agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), hashed(row).alias("digest"))
    up = lambda df, key, name: df.groupBy(*key).agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), hashed(part(name)).alias("digest"))
    return up(up(days, [*by, "month"], "day"), by, "month")


def manifest_diff(expected: DataFrame, actual: DataFrame, key: str = "instrument") -> DataFrame:
    """Series of either manifest that aren't the same in both: MISSING, EXTRA, ROWS, RANGE or DIGEST, the first that holds."""
    e = expected.select(key, *[F.col(c).alias(f"e_{c}") for c in ("n", "first_ts", "last_ts", "digest")])
    a = actual.select(key, *[F.col(c).alias(f"a_{c}") for c in ("n", "first_ts", "last_ts", "digest")])
    kind = (
        F.when(F.col("a_n").isNull(), "MISSING").when(F.col("e_n").isNull(), "EXTRA").when(F.col("e_n") != F.col("a_n"), "ROWS")
        .when((F.col("e_first_ts") != F.col("a_first_ts")) | (F.col("e_last_ts") != F.col("a_last_ts")), "RANGE").when(F.col("e_digest") != F.col("a_digest"), "DIGEST")
    )
    return e.join(a, key, "full_outer").select(key, kind.alias("kind"), F.col("e_n").alias("expected_n"), F.col("a_n").alias("actual_n")).where("kind IS NOT NULL")


def best_quotes(quotes: DataFrame, by: Sequence[str], buy: bool = True) -> DataFrame:
    """The venue with the least ask (buy) or the greatest bid of each instrument; of ties the venue of least venue_order. Venues without a quote are skipped."""
    price = F.col("ask") if buy else -F.col("bid")
    best = F.min_by(F.struct("venue", "bid", "ask"), F.struct(price, F.col("venue_order")))
    return quotes.where(price.isNotNull()).groupBy(*by).agg(best.alias("q")).select(*by, "q.*")


def latest_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
