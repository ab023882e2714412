"""Dumps of bars read back against plain Python; records by stamp; files in order of precedence."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from barwright.sources import candles, dumps

SCHEMA = "k string, ts timestamp_ntz, masked boolean, spread array<double>, z array<double>"
T0 = dt.datetime(2024, 1, 8, 18)


def test_round_trip(spark, tmp_path):
    """Hours 0-4, a gap, hours 7-9; masked at 2 and 8; nulls in z; a series of one bar."""
    hours = [0, 1, 2, 3, 4, 7, 8, 9]
    rows = [("a", T0 + dt.timedelta(hours=h), h in (2, 8), [1.0 + h, 2.00006], [None, 0.5]) for h in hours] + [("b", T0, False, [4.0, 6.0], [1.0, -1.0])]
    dumps.write_bars(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path / "d"))
    got = {(r["k"], r["ts"]): r for r in dumps.read_bars(spark, str(tmp_path / "d"), ["k"], (0.19, 0.36)).collect()}
    assert len(got) == len(rows)
    stretch, clean = [0, 0, 0, 0, 0, 1, 1, 1], [0, 0, None, 1, 1, 2, None, 3]
    for h, s, c in zip(hours, stretch, clean):
        r = got["a", T0 + dt.timedelta(hours=h)]
        assert (r["stretch"], r["clean_stretch"], r["masked"]) == (s, c, h in (2, 8))
        assert r["spread"] == [1.0 + h, 2.0001] and r["res"][0] == 0.0 and math.isclose(r["res"][1], 0.5 * 2.0001 * 0.8)
        assert math.isclose(r["ms"], (1.0 + h + 2.0001) / 2) and r["med"] is None
    # January: New York's 17:00 is 22 UTC; bars begin at 18 UTC
    assert [got["a", T0 + dt.timedelta(hours=h)]["cls"] for h in (0, 3, 4)] == ["other", "adjacent_ny", "rollover_ny"]
    b = got["b", T0]
    assert (b["stretch"], b["clean_stretch"]) == (0, 0) and [round(x, 9) for x in b["res"]] == [3.6, -4.8]
    with pytest.raises(Exception):
        dumps.write_bars(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "d"))


def test_median_of_earlier_days(spark, tmp_path):
    rows = [("a", T0 + dt.timedelta(days=d), False, [float(d)], [0.0]) for d in range(14)]
    dumps.write_bars(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "d"))
    got = {r["ts"]: r["med"] for r in dumps.read_bars(spark, str(tmp_path / "d"), ["k"], (0.5,)).collect()}
    assert [got[T0 + dt.timedelta(days=d)] for d in (9, 10, 13)] == [None, 4.5, 6.0]


def test_no_bars(spark, tmp_path):
    dumps.write_bars(spark.createDataFrame([], SCHEMA), str(tmp_path / "d"))
    assert dumps.read_bars(spark, str(tmp_path / "d"), ["k"], (0.5,)).count() == 0


def test_records_by_stamp(spark):
    df = spark.createDataFrame([("t1", "eq", 1.0), ("t1", "inv", 2.0), ("t2", "eq", 3.0), ("t2", "eq", 4.0)], "t string, scheme string, x double")
    got = {r["t"]: {k: v["x"] for k, v in r["records"].items()} for r in dumps.by_stamp(df, "t", "scheme").collect()}
    assert got == {"t1": {"eq": 1.0, "inv": 2.0}, "t2": {"eq": 4.0}}


def test_later_files_win_and_broken_lines_go(spark, tmp_path):
    for name, text in (("historical", "3600,1,1,1,1,5,1\n7200,2,2,2,2,5,1\nx,y\n"), ("24Q1", "7200,3,3,3,3,6,1\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "p.csv").write_text(text)
    parts = [candles.read_trades_csv(spark, str(tmp_path / f), "p") for f in candles.source_folders(["24Q1", "historical", "notes"])]
    got = candles.merge_sources(parts).select(F.unix_seconds(F.col("ts").cast("timestamp")), "bid_close", "ask_close", "volume").collect()
    assert sorted(map(tuple, got)) == [(3600, 1.0, 1.0, 5.0), (7200, 3.0, 3.0, 6.0)]
    assert candles.window_end(["historical", "23Q4", "24Q1"]) == (2024, 1)
