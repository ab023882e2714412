"""Run extents and the statistics lattice against plain Python; the manifest on long series; clustered intervals."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.operators import extents, lattice, resample, runlevel
from barwright.sources import candles

T0 = dt.datetime(2024, 1, 1)
H = dt.timedelta(hours=1)


def at(h):
    return T0 + h * H


def brute_extents(values, runs):
    """values: hour -> value; runs: name -> (start, end) in hours. As the rules read, hour by hour."""
    absd = {h: abs(v) for h, v in values.items() if v is not None}
    out = {}

    def quiet_end(s, limit, n):
        for k in range(1, extents.LOOK):
            if all(absd.get(s + k + j, math.inf) < limit for j in range(n)):
                return s + k - 1, False
        return s + extents.LOOK - 1, True

    for name, (s, e) in runs.items():
        out[name, "detector"] = (s, e, False)
        for x in extents.LEVELS:
            for n in extents.BLOCKS:
                first = s
                while s - first < extents.BACK and absd.get(first - 1, -1) >= x:
                    first -= 1
                end, censored = quiet_end(s, x, n)
                out[name, f"rtz_x{x:g}_n{n}"] = (first, max(end, s), censored)
        peak = max((absd[h] for h in range(s, e + 1) if h in absd), default=0)
        for f in extents.SHARES:
            end, censored = quiet_end(s, f * peak, extents.SHARE_BLOCK) if peak > 0 else (e, True)
            out[name, f"peak_f{f:g}_n{extents.SHARE_BLOCK}"] = (s, max(end, s), censored)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_extents(spark, seed):
    rng = np.random.default_rng(seed)
    values = {h: float(v) for h, v in enumerate(rng.normal(0, 1.2, 400).round(2)) if rng.random() > 0.1}
    values |= {h: 3.0 for h in range(100, 260)}  # never quiet, and longer than one may look back
    values[50] = None
    runs = {"a": (20, 24), "b": (60, 61), "c": (200, 205), "d": (390, 395), "gone": (900, 905), "long": (10, 300)}
    s = spark.createDataFrame([("x", at(h), v) for h, v in values.items()], "i string, ts timestamp_ntz, dev double")
    r = spark.createDataFrame([("x", n, at(a), at(b)) for n, (a, b) in runs.items()], "i string, run string, start timestamp_ntz, end timestamp_ntz")
    got = {(x["run"], x["rule"]): (int((x["start"] - T0) / H), int((x["end"] - T0) / H), x["censored"]) for x in extents.extents(s, r, ["i"]).collect()}
    assert got == brute_extents(values, runs)
    assert extents.extents(s, r.limit(0), ["i"]).count() == 0


def test_flags_in_and_named(spark):
    f = spark.createDataFrame([("x", at(h), h in (5, 12, 70), float(h), h == 12) for h in range(80) if h != 11], "i string, ts timestamp_ntz, flag boolean, dev double, masked boolean")
    spans = spark.createDataFrame([("x", "r", at(10), at(14), 12.6), ("x", "none", at(500), at(501), 1.0)], "i string, run string, start timestamp_ntz, end timestamp_ntz, expected double")
    got = {r["run"]: tuple(r)[2:] for r in extents.flags_in(spans, f, ["i"], ["i", "run"]).collect()}
    assert got == {"r": (4, 1, 2, 1, 0), "none": (0, 0, 0, 0, 0)}
    named = {r["run"]: (r["n"], r["n_masked"], r["median"], r["ok"]) for r in extents.check_named(f, spans, ["i"]).collect()}
    assert named == {"r": (4, 1, 12.5, True), "none": (0, 0, None, None)}


def test_policies(spark):
    assert [lattice.parse_policy(p) for p in ("mask_reset", "all_chron", "mask_carry12", "all_carry0", "mask_barindex")] == [("ref", 0), ("all", 0), ("ref", 12), ("all", 0), ("ref", None)]
    for bad in ("mask", "all_carry", "chron", "mask_reset2", "carry3"):
        with pytest.raises(ValueError, match="policy"):
            lattice.parse_policy(bad)
    rows = spark.createDataFrame([("x", at(h), float(h), h == 4) for h in (0, 1, 4, 5, 9)], "i string, ts timestamp_ntz, raw double, masked boolean")
    got = {}
    for r in lattice.under_policies(rows, ["i"], ["all_chron", "mask_reset", "all_carry2", "mask_barindex"]).collect():
        got.setdefault(r["policy"], []).append((int((r["ts"] - T0) / H), r["stretch"], r["raw"], r["real"]))
    assert sorted(got["all_chron"]) == [(0, 1, 0.0, True), (1, 1, 1.0, True), (4, 2, 4.0, True), (5, 2, 5.0, True), (9, 3, 9.0, True)]
    assert sorted(got["mask_reset"]) == [(0, 1, 0.0, True), (1, 1, 1.0, True), (5, 2, 5.0, True), (9, 3, 9.0, True)]
    assert sorted(got["all_carry2"], key=lambda x: x[0]) == [(0, 1, 0.0, True), (1, 1, 1.0, True), (2, 1, None, False), (3, 1, None, False), (4, 1, 4.0, True), (5, 1, 5.0, True), (9, 2, 9.0, True)]
    assert {x[1] for x in got["mask_barindex"]} == {1} and len(got["mask_barindex"]) == 4


def test_specs_and_profiles():
    of = lattice.specs()
    assert len(of) == len({s.sid for s in of}) == 2 * 5 * 5 * 2 * 4 + 2 * 5 + 6
    assert "median|W12|full|trailing|raw" in lattice.profile("CORRECT", of) and len(lattice.profile("CORRECT", of)) == 6
    assert {s.split("|")[0] for s in lattice.profile("ALERT", of)} == {"median", "hl", "huber", "ewma", "cusum"}
    with pytest.raises(ValueError, match="profile"):
        lattice.profile("NONE", of)


def test_lattice_equals_single_statistics(spark):
    rng = np.random.default_rng(4)
    rows = [("x", 1, at(h), float(rng.normal()) if rng.random() > 0.1 else None) for h in range(120)]
    d = spark.createDataFrame(rows, "i string, stretch int, ts timestamp_ntz, raw double").withColumn("norm", F.col("raw") * 2)
    of = [s for s in lattice.specs(("half", "min3"), (6, 12), signs=True) if s.inp != "norm"]
    by = ["i", "stretch"]
    got = {}
    for r in lattice.series(d, by, of).collect():
        got.setdefault(r["spec"], {})[r["ts"]] = r["value"]
    assert set(got) == {s.sid for s in of}
    for s in of:
        if s.stat == "ewma":
            one = runlevel.ewma(d, by, "raw", s.param, out="v")
        elif s.stat == "cusum":
            one = runlevel.cusum(d, by, "raw", s.param, out="v")
        else:
            one = runlevel.statistic(d, by, "raw", "sign" if s.stat == "signpers" else s.stat, int(s.param), s.fill, s.caus == "centred", out="v")
        for r in one.select("ts", "v").collect():
            a, b = got[s.sid][r["ts"]], r["v"]
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)), (s.sid, r["ts"], a, b)


def test_lattice_is_one_scan_and_one_exchange(spark, tmp_path):
    spark.createDataFrame([("x", at(h), float(h), False) for h in range(30)], "i string, ts timestamp_ntz, raw double, masked boolean").write.parquet(str(tmp_path / "bars"))
    d = spark.read.parquet(str(tmp_path / "bars")).withColumn("norm", F.col("raw") / 2)
    p = lattice.under_policies(d, ["i"], ["all_chron", "all_carry2"])
    x = lattice.series(p, ["policy", "i", "stretch"], lattice.specs(("full",), (3, 6), states=False))
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") <= 1
    lattice.dump(x, str(tmp_path / "series"))
    back = spark.read.parquet(str(tmp_path / "series")).where("policy = 'all_chron' AND spec = 'median|W3|full|trailing|raw'")
    assert back.count() == 30 and back.agg(F.sum("value")).first()[0] == sum(range(1, 29))


def test_flag_counts(spark):
    values = [0.1, 0.5, -0.6, 1.0, -3.0, None, 9.0]
    d = spark.createDataFrame([("s", v, 2.0) for v in values] + [("s", 5.0, 0.0)], "spec string, value double, scale double")
    scales = {"abs": (lattice.ratio(F.col("value"), None), (0.5, 1.0, 10.0)), "path": (lattice.ratio(F.col("value"), F.col("scale")), (0.3, 4.5))}
    got = {(r["scale"], r["threshold"]): r["flagged"] for r in lattice.flag_counts(d, ["spec"], scales).collect()}
    assert got == {("abs", 0.5): 6, ("abs", 1.0): 4, ("abs", 10.0): 0, ("path", 0.3): 4, ("path", 4.5): 1}


def test_manifest_of_long_series_and_swapped_rows(spark):
    d = spark.range(200_000).select(F.lit("x").alias("instrument"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"), (F.col("id") % 97).cast("double").alias("bid_close"), F.lit(1.0).alias("ask_close"), F.lit(2.0).alias("volume"))
    a = candles.manifest(d).first()
    assert (a["n"], a["first_ts"], len(a["digest"])) == (200_000, T0, 64)
    assert candles.manifest(d.repartition(7, "bid_close")).first()["digest"] == a["digest"]
    swapped = d.withColumn("bid_close", F.when(F.minute("ts") == 1, F.lit(2.0) + F.col("bid_close") - 2.0).otherwise(F.col("bid_close")))
    assert candles.manifest(swapped).first()["digest"] == a["digest"]  # nothing has changed yet
    two = [at(1000 / 60), at(1001 / 60)]
    at_row = lambda i: F.col("ts") == F.lit(two[i]).cast("timestamp_ntz")
    v = d.where(at_row(0) | at_row(1)).orderBy("ts").collect()
    swapped = d.withColumn("bid_close", F.when(at_row(0), v[1]["bid_close"]).when(at_row(1), v[0]["bid_close"]).otherwise(F.col("bid_close")))
    assert v[0]["bid_close"] != v[1]["bid_close"] and candles.manifest(swapped).first()["digest"] != a["digest"]


def test_clustered_intervals(spark):
    trials = spark.createDataFrame([("d", "c", k, 1 if k % 2 else None) for k in range(6) for _ in range(k + 1)] + [("d", "never", k, None) for k in range(6)], "design string, cell string, cluster int, first int")
    got = {r["cell"]: r for r in resample.clustered_intervals(trials, ["design"], ["cell"], "cluster", "first", 300).collect()}
    assert math.isclose(got["c"]["rate"], 12 / 21) and got["c"]["rate_low"] < 12 / 21 < got["c"]["rate_high"] and got["c"]["latency"] == got["c"]["latency_low"] == 1.0
    assert (got["never"]["rate"], got["never"]["rate_high"], got["never"]["latency"], got["never"]["latency_low"]) == (0.0, 0.0, None, None)
