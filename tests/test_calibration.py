"""Statistics of a bar and detectors' grids against plain Python."""

import datetime as dt
import statistics

import numpy as np

from barwright.operators import calibration

SCHEMA = "ts timestamp_ntz, a string, b string, s double, loo double, volume double, range_bps double, typical double"
ANCHORS = ("X", "Y")
PAIRS = [("X", "Y"), ("X", "P"), ("Y", "P"), ("X", "Q"), ("Y", "Q"), ("P", "Q")]


def legs(bars, seed=5):
    rng, rows = np.random.default_rng(seed), []
    for i in range(bars):
        for a, b in PAIRS:
            volume = None if rng.random() < 0.1 else float(rng.integers(0, 12))
            span = None if rng.random() < 0.1 else float(rng.choice([0.0, 1.0, 4.0, 9.0]))
            typical = None if rng.random() < 0.1 else float(rng.integers(0, 150))
            rows.append((dt.datetime(2024, 1, 1) + dt.timedelta(days=i), a, b, float(rng.uniform(0.5, 4)), None if rng.random() < 0.1 else float(rng.normal(0, 6)), volume, span, typical))
    return rows


def brute(rows):
    bars, out, history = {}, {}, []
    for r in rows:
        bars.setdefault(r[0], []).append(r)
    for ts, leg in sorted(bars.items()):
        s = {(r[1], r[2]): r[3] for r in leg}
        mean = statistics.fmean(s.values())
        arms = {n: s["X", n] + s["Y", n] for n in "PQ"}
        scale = {p: s["X", "Y"] + statistics.median(arms.values()) if p == ("X", "Y") else 3 * mean if p == ("P", "Q") else s["X", "Y"] + arms[p[1]] for p in s}
        worst = max((abs(r[4]) for r in leg if r[4] is not None), default=None)
        arm = max((abs(r[4]) / scale[r[1], r[2]] for r in leg if r[4] is not None), default=None)
        typical = statistics.median(history[-60:]) if len(history) >= 10 else None
        history.append(mean)
        grid = {}
        zero = [r[6] == 0 and statistics.median([x[6] for x in leg if x is not r and x[6] is not None] or [0.0]) >= 2 for r in leg]
        for v in calibration.STALE_GRID:
            for f in calibration.THIN_GRID:
                few = [r[5] is not None and r[5] <= v for r in leg]
                thin = [not x and not z and r[5] is not None and bool(r[7]) and r[5] < f * r[7] for r, x, z in zip(leg, few, zero)]
                grid[v, f] = (any(few), any(zero), any(thin))
        out[ts] = (worst, mean, max(s.values()) / min(s.values()), worst / mean, arm, None if typical is None else worst / typical, grid)
    return out


def test_statistics_and_grids(spark):
    rows = legs(40)
    stats = calibration.bar_statistics(spark.createDataFrame(rows, SCHEMA).repartition(5), ANCHORS)
    expected, got = brute(rows), {r["ts"]: r for r in stats.collect()}
    assert got.keys() == expected.keys()
    names = ("max_abs", "mean_spread", "dispersion", "b_mean_spread", "b_arm_spread", "b_hour_median")
    for ts, r in got.items():
        for name, x in zip(names, expected[ts]):
            assert (r[name] is None) == (x is None) and (x is None or abs(r[name] - x) < 1e-9), (ts, name)
        assert {(c["stale"], c["share"]): (c["by_volume"], c["by_zero"], c["thin"]) for c in r["c"]} == expected[ts][6]
    grid = {(g["kind"], g["threshold"], g["share"]): g for g in calibration.flag_grids(stats).collect()}
    assert len(grid) == 6 + 18 + 9
    for t in calibration.A_GRID:
        assert grid["loo", t, None]["flagged"] == sum(e[0] > t for e in expected.values())
    for t in calibration.B_GRID:
        for k, i in (("mean_spread", 3), ("arm_spread", 4), ("hour_median", 5)):
            v = [e[i] for e in expected.values() if e[i] is not None]
            assert (grid[k, t, None]["defined"], grid[k, t, None]["flagged"]) == (len(v), sum(x > t for x in v))
    for key in expected[rows[0][0]][6]:
        parts = [e[6][key] for e in expected.values()]
        g = grid["grid", *key]
        assert (g["flagged"], g["by_volume"], g["by_zero"], g["thin"]) == (sum(map(any, parts)), *(sum(p[i] for p in parts) for i in range(3)))
        assert 0 < g["by_zero"] < 40


def test_no_bars(spark):
    stats = calibration.bar_statistics(spark.createDataFrame([], SCHEMA), ANCHORS)
    assert stats.count() == 0
    assert {r["flagged"] for r in calibration.flag_grids(stats).collect()} == {0}
