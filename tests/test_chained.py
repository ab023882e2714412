"""Smoothers chained over segments against the same over whole series; bootstraps beyond their broadcast."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from barwright.operators import chained, indicators, resample

SCHEMA = "k string, ts timestamp_ntz, mid double, note string"


def series(key, n, seed, hole=None):
    rng, t0 = np.random.default_rng(seed), dt.datetime(2024, 1, 1)
    x = 100 + np.cumsum(rng.normal(0, 1, n))
    return [(key, t0 + dt.timedelta(hours=i), None if i == hole else float(x[i]), None if i % 3 else "a") for i in range(n)]


def equal(got, expected, columns):
    a, b = ({(r["k"], r["ts"]): r for r in df.collect()} for df in (got, expected))
    assert a.keys() == b.keys() and got.columns == expected.columns
    for key, r in a.items():
        for c in columns:
            x, y = r[c], b[key][c]
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-9), (key, c, x, y)
        assert r["note"] == b[key]["note"]


def test_chained_equals_whole(spark):
    """Series of many segments, of fewer values than the seed, of a null key, with a missing value, and constant ones; segments of five rows are shorter than any seed."""
    rows = series("a", 230, 1) + series("b", 8, 2) + series(None, 90, 3) + series("c", 100, 4, hole=60) + [("d", t, 5.0, n) for _, t, _, n in series("d", 60, 5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for seg in (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 18_000), chained.weeks("ts")):
        equal(chained.ema(df, 10, ["k"], seg), indicators.ema(df, 10, ["k"]), ["ema"])
        equal(chained.rsi(df, 14, ["k"], seg), indicators.rsi(df, 14, ["k"]), ["rsi"])
        equal(chained.macd(df, ["k"], seg), indicators.macd(df, ["k"]), ["macd", "macd_signal", "macd_hist"])


def test_chained_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chained.ema(df, 3, ["k"], chained.quarters("ts")).collect() == []


def test_bootstrap_by_shuffle_is_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(g, i, float(i * i - 4)) for g in "gh" for i in range(12)], "grp string, k0 int, pnl double")
    draw = lambda: [sorted(map(tuple, f(df, ["grp"], ["k0"], 30).select("grp", "iter", "k", "ix", "pnl").collect())) for f in (resample.resample, resample.shuffle)]
    here = draw()
    assert all(len(x) == 2 * 12 * 30 for x in here)
    monkeypatch.setattr(resample, "BROADCAST_ROWS", 0)
    assert draw() == here
