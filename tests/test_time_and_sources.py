import datetime as dt

import pytest
from pyspark.sql import functions as F

from barwright.functions import timepolicy as tp
from barwright.sources import candles
from barwright.sources.paged import PagedCandles

D = dt.datetime


def one(spark, c, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols) if all(not isinstance(v, D) for v in cols.values()) else ", ".join(f"{k} timestamp_ntz" for k in cols)).select(c).first()[0]


def test_stamps(spark):
    ok = "2024-03-01T05:06:07.000000000Z"
    assert one(spark, tp.parse_stored(F.col("t")), t=ok) == int(D(2024, 3, 1, 5, 6, 7, tzinfo=dt.timezone.utc).timestamp())
    assert one(spark, tp.parse_stored(F.col("t")), t="2024-03-01T05:06:07Z") is None
    assert one(spark, tp.stored(F.col("t")), t=D(2024, 3, 1, 5, 6, 7, 999)) == ok
    assert one(spark, tp.parse_iso(F.col("t")), t="2024-03-01T05:06:07") is None
    assert one(spark, tp.normal_bound(F.col("t")), t="2024-03-01T07:06:07.1234567+02:00") == ok
    assert one(spark, tp.normal_bound(F.col("t")), t=ok) == ok


@pytest.mark.parametrize("t, cell", [(D(2024, 1, 10), "both_winter"), (D(2024, 3, 20), "uk_winter_us_summer"), (D(2024, 7, 1), "both_summer"), (D(2024, 10, 30), "uk_winter_us_summer")])
def test_dst(spark, t, cell):
    assert one(spark, tp.dst_cell(F.col("t")), t=t) == cell


def test_weekend(spark):
    winter = dict(a=D(2024, 1, 12, 21), b=D(2024, 1, 14, 22))
    assert one(spark, tp.weekend_gap(F.col("a"), F.col("b")), **winter)
    assert one(spark, tp.weekend_gap(F.col("a"), F.col("b")), a=D(2024, 7, 12, 20), b=D(2024, 7, 14, 21))
    assert not one(spark, tp.weekend_gap(F.col("a"), F.col("b")), a=D(2024, 7, 12, 21), b=D(2024, 7, 14, 22))


def test_periods():
    assert tp.add_months(D(2024, 1, 31), 1) == D(2024, 2, 29) and tp.add_months(D(2023, 11, 30), 3) == D(2024, 2, 29) and tp.add_months(D(2024, 11, 5), 1) == D(2024, 12, 5)
    years = tp.calendar_years(D(2022, 5, 1), D(2024, 2, 1))
    assert [x[0] for x in years] == ["2022", "2023", "2024"] and years[0][2] == D(2022, 12, 31, 23, 59, 59) and years[2][2] == D(2024, 2, 1)
    chunks = tp.month_chunks(D(2024, 1, 1), D(2024, 8, 10), 3)
    assert [(a, b) for _, a, b in chunks] == [(D(2024, 1, 1), D(2024, 3, 31, 23, 59, 59)), (D(2024, 4, 1), D(2024, 6, 30, 23, 59, 59)), (D(2024, 7, 1), D(2024, 8, 10))]
    cut = tp.month_chunks(D(2024, 1, 1), D(2024, 12, 31), 6, (D(2024, 5, 1), D(2024, 5, 31)))
    assert all(b < D(2024, 5, 1) or a > D(2024, 5, 31) for _, a, b in cut)
    assert tp.quarter_end(2024, 4) == D(2024, 12, 31, 23, 59, 59) and tp.quarter_end(2024, 1) == D(2024, 3, 31, 23, 59, 59)


def test_csv_and_precedence(spark, tmp_path):
    for name, price in (("a", 1.0), ("b", 2.0)):
        (tmp_path / f"{name}.csv").write_text(f"1704067200,{price},{price},{price},{price},0.5,3\nbroken line\n{1704070800 + (name == 'b') * 3600},{price},{price},{price},{price},1.5,3\n")
    parts = [candles.read_trades_csv(spark, str(tmp_path / f"{n}.csv"), "X") for n in "ab"]
    got = [(r.ts.hour, r.bid_close, r.ask_close, r.volume) for r in candles.merge_sources(parts).orderBy("ts").collect()]
    assert got == [(0, 2.0, 2.0, 0.5), (1, 1.0, 1.0, 1.5), (2, 2.0, 2.0, 1.5)]
    assert candles.source_folders(["24Q1", "x", "23Q4", "historical", "24Q3"]) == ["historical", "23Q4", "24Q1", "24Q3"]
    assert candles.window_end(["24Q1", "23Q4"]) == (2024, 1) and candles.window_end(["x"]) is None


def test_upsert_files_and_strict(spark, tmp_path):
    schema = "instrument string, ts timestamp_ntz, bid_close double, ask_close double"
    old = spark.createDataFrame([("a", D(2024, 1, 1), 1.0, 1.1), ("a", D(2024, 1, 1, 1), 1.0, 1.1)], schema)
    old.write.parquet(str(tmp_path / "old"))
    new = spark.createDataFrame([("a", D(2024, 1, 1), 2.0, 2.1, 1), ("a", D(2024, 1, 1), 3.0, 3.1, 2), ("b", D(2024, 1, 1), 4.0, 4.1, 1)], schema + ", seq int")
    candles.write_upserted(str(tmp_path / "old"), new, str(tmp_path / "new"))
    got = spark.read.parquet(str(tmp_path / "new"))
    assert sorted((r.instrument, r.ts.hour, r.bid_close) for r in got.collect()) == [("a", 0, 3.0), ("a", 1, 1.0), ("b", 0, 4.0)]
    assert candles.strict(got).count() == 3
    with pytest.raises(Exception, match="bad candle"):
        candles.strict(spark.createDataFrame([("a", D(2024, 1, 1), 2.0, 1.0)], schema)).collect()


def pages(instrument, since, limit):
    """Bars of 1 s from 0 to 9 s; the last is not complete."""
    rows = [[t, 1.0, 2.0, 0.5, None if t == 9000 else 1.5, 3.0] for t in range(0, 10_000, 1000) if t >= since]
    return rows[:limit]


def test_paged_source(spark):
    spark.dataSource.register(PagedCandles)
    df = spark.read.format("paged_candles").options(fetch="tests.test_time_and_sources:pages", instruments="A,B", start="1500", end="60000", limit="3").load()
    got = sorted((r.instrument, r.epoch_ms) for r in df.collect())
    assert got == [(x, t) for x in "AB" for t in range(2000, 9000, 1000)]
