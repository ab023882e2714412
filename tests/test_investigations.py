"""Investigations of residuals on small frames: sign choices by counting them out, floors by formula, thin columns and nulls."""

import datetime as dt
import itertools
import math

from pyspark.sql import functions as F

from barwright.operators import investigate as inv

T0 = dt.datetime(2024, 1, 1)


def test_sign_combinations_are_counts_of_choices(spark):
    means = {"x": [1.0, -2.0, 0.0], "y": [3.0, 4.0], "z": [-1.0, 5.0, 6.0, -7.0]}
    d = spark.createDataFrame([(c, i, m) for c, ms in means.items() for i, m in enumerate(ms)], "cycle string, leg int, mean double")
    choices = list(itertools.product(*means.values()))
    same = sum(len({m > 0 for m in c}) == 1 for c in choices)
    assert tuple(inv.sign_combinations(d).first()) == (3, len(choices), same)


def test_designations_turn_intervals(spark):
    b = spark.createDataFrame([("c", 2.0, 1.0, 4.0, False, 1.5, -1.0, 3.0, True)], "cycle string, mean double, mean_low double, mean_high double, mean_has_zero boolean, median double, median_low double, median_high double, median_has_zero boolean")
    legs = spark.createDataFrame([("c", 0, 1), ("c", 1, -1)], "cycle string, leg int, d int")
    got = {r.leg: (r.mean, r.mean_low, r.mean_high, r.median_low, r.median_high) for r in inv.designations(b, legs).collect()}
    assert got == {0: (-2.0, -4.0, -1.0, -3.0, 1.0), 1: (2.0, 1.0, 4.0, -1.0, 3.0)}


def test_floor_and_decimals(spark):
    q = spark.createDataFrame([("a", "b", 1.25, 1.5), ("a", "b", 1.5, 1.75), ("b", "c", 100.123, 100.2), ("a", "c", math.pi, 3.2)], "a string, b string, bid double, ask double")
    d = {(r.a, r.b): (r.decimals, r.mid) for r in inv.price_decimals(q).collect()}
    assert d["a", "b"] == (2, 1.5) and d["b", "c"][0] == 3 and d["a", "c"][0] is None
    legs = spark.createDataFrame([("k", "a", "b"), ("k", "b", "c"), ("n", "a", "b"), ("n", "a", "c")], "cycle string, a string, b string")
    bars = spark.createDataFrame([("k",)] * 4 + [("n",)], "cycle string")
    got = {r.cycle: (r.floor, r.floor_of_mean) for r in inv.rounding_floor(inv.price_decimals(q), legs, bars).collect()}
    want = 1e4 * math.sqrt(1e-4 / 24 / 1.5**2 + 1e-6 / 24 / 100.1615**2)
    assert got["n"] == (None, None) and math.isclose(got["k"][0], want, rel_tol=1e-9) and math.isclose(got["k"][1], want / 2, rel_tol=1e-9)


def test_thin_columns(spark):
    rows = [("c", T0 + dt.timedelta(hours=i), float(i), float(i) if i % 5 else None, float(i * i), float(i) if i < 4 else None, None) for i in range(30)]
    f = spark.createDataFrame(rows, "cycle string, ts timestamp_ntz, size double, ratio double, rising double, few double, none double")
    got = {r["column"]: r for r in inv.thin_bars(f, columns=["rising", "few", "none"]).collect()}
    assert set(got) == {"rising", "few"}
    assert got["rising"].n == 30 and math.isclose(got["rising"].rho_size, 1.0) and math.isclose(got["rising"].rho_ratio, 1.0) and len(got["rising"].p99s) == 10
    assert (got["few"].n, got["few"].rho_size, got["few"].p99s) == (4, None, None)


def test_intervals_hold_the_mean_of_one_day(spark):
    rows = [("c", T0 + dt.timedelta(hours=i), 2.0, 4.0, "clean") for i in range(24)] + [("d", T0 + dt.timedelta(days=i), float(i), 1.0, "suspect") for i in range(40)]
    f = spark.createDataFrame(rows, "cycle string, ts timestamp_ntz, resid double, spread double, tier string")
    got = {r.cycle: r for r in inv.bias(f, iterations=100).collect()}
    assert (got["c"].mean_low, got["c"].mean_high, got["c"].median_low, got["c"].mean_has_zero, got["c"].n_days, got["c"].slope) == (2.0, 2.0, 2.0, False, 1, None)
    assert got["d"].mean_low < 19.5 < got["d"].mean_high and got["d"].mean_rated is None and got["d"].n_days == 40
    assert inv.bias(f.where(F.lit(False)), iterations=10).count() == 0
