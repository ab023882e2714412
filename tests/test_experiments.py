import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from barwright.operators import experiments as ex
from barwright.operators import orchestrate, validate
from barwright.sources import runs

T0 = dt.datetime(2024, 1, 1)


def unit(name, k, n):
    return {"flat": 1.0, "ramp": (k + 1) / n, "decay": (n - k) / n, "pulse": math.sin(math.pi * (k + 0.5) / n), "expdecay": math.exp(-3 * k / n)}[name]


def test_shapes(spark):
    df = spark.range(6).select(F.col("id").cast("double").alias("k"))
    for name in ex.SHAPES:
        got = [r[0] for r in df.select(ex.shape(name, F.col("k"), 6)).collect()]
        assert got == pytest.approx([unit(name, k, 6) for k in range(6)])
    assert [r[0] for r in df.select(ex.shape("step_plateau", F.col("k"), 6, 10.0, 2, 4.0)).collect()] == [1.0, 1.0] + [0.4] * 4


def test_injection_against_loops(spark):
    r = random.Random(1)
    est = {(t, p): r.gauss(0, 3) for t in range(60) for p in "abcd"}
    paths = spark.createDataFrame([(0, t, p, v, 2.0) for (t, p), v in est.items()], "stretch long, pos int, path string, estimate double, scale double")
    starts = spark.createDataFrame([(i, 0, i) for i in (10, 20, 33)], "start_id int, stretch long, pos int")
    cells = [("a", 1, 6.0, "ramp", 5), ("c", -1, 9.0, "flat", 3)]
    got = {x.cell: x for x in ex.inject(paths, starts, cells, 4, 1.5, 4).collect()}
    for c, (x, sign, mag, name, n) in enumerate(cells):
        firsts, cover, tail = [], [], []
        for s in (10, 20, 33):
            dev = []
            for k in range(-3, n + 4):
                v = {p: est[s + k, p] for p in "abcd"}
                v[x] += sign * mag * unit(name, k, n) if 0 <= k < n else 0
                dev.append(v[x] - statistics.median(v.values()))
            flags = [abs(statistics.median(dev[i - 3 : i + 1])) / 2.0 >= 1.5 for i in range(3, len(dev))]
            firsts += [next(i for i in range(n) if flags[i])] if any(flags[:n]) else []
            cover.append(sum(flags[:n]))
            tail.append(sum(flags[n:]))
        assert (got[c].trials, got[c].detected) == (3, len(firsts))
        assert got[c].latency == (pytest.approx(statistics.mean(firsts)) if firsts else None)
        assert (got[c].cover, got[c].tail) == (pytest.approx(statistics.mean(cover)), pytest.approx(statistics.mean(tail)))


def test_blocks_fit_and_cover(spark):
    seg = spark.createDataFrame([("x", 0, 2), ("x", 1, 5), ("x", 2, 9)], "k string, segment long, n long")
    got = ex.draw_blocks(seg, ["k"], 4, 400).toPandas()
    assert len(got) == 400 and set(zip(got.segment, got["first"])) == {(1, i) for i in range(2)} | {(2, i) for i in range(6)}
    rows = spark.createDataFrame([("x", 2, i, i in (1, 2, 6), i in (1, 6)) for i in range(9)], "k string, segment long, pos int, flag boolean, starts boolean")
    one = spark.createDataFrame([("x", 0, 2, 2), ("x", 1, 2, 3), ("x", 2, 2, 0)], "k string, block int, segment long, first long")
    assert {r.block: r.runs for r in ex.block_runs(rows, one, ["k"], "flag", "starts", 5).collect()} == {0: 2, 1: 1, 2: 1}


def test_normal_draws(spark):
    x = spark.range(4000).select(ex.normal(9, F.col("id")).alias("x")).toPandas().x
    assert abs(x.mean()) < 0.06 and abs(x.std() - 1) < 0.05 and abs((x.abs() > 1.96).mean() - 0.05) < 0.015


def test_anchoring(spark):
    rows = [("both_winter", h, 50, 9.0 if h == 22 else 1.0, 0.1) for h in range(24)] + [("both_summer", h, 50, 9.0 if h == 21 else 1.0, 0.1) for h in range(24)]
    mixed = lambda peak: [("uk_winter_us_summer", h, 20, 9.0 if h == peak else 1.0, 0.2) for h in range(24)]
    schema = "cell string, hour int, n long, mean double, se double"
    for more, want in ((mixed(21), "US"), (mixed(22), "UK"), (mixed(3), "indeterminate"), ([], "too few bars")):
        assert ex.anchoring(spark.createDataFrame(rows + more, schema)).first().verdict == want
    assert ex.anchoring(spark.createDataFrame(rows[:24], schema)).first().verdict == "no eligible hour"


def test_hierarchy_finds_a_wave(spark):
    """A slow wave without costs is a series that the crossover can live on."""
    rows = [("x", T0 + dt.timedelta(hours=i), 100 + 10 * math.sin(i / 12)) for i in range(1500)]
    b = spark.createDataFrame([(k, t, v, v, v) for k, t, v in rows], "instrument string, ts timestamp_ntz, mid double, bid_close double, ask_close double")
    sma = lambda x, key: validate.sma_grid(x, key, (3, 5), (8, 12))
    got = {r.param_id: r.tier for r in orchestrate.tiers(b, ["instrument"], sma, validate.grid(spark, fast=(3, 5), slow=(8, 12)), ["fast", "slow"], 400, 200, iterations=50).collect()}
    assert set(got) == {0, 1, 2, 3} and max(got.values()) == 4
    rows = [("a", 9.0, 2.0, 4), ("a", 30.0, 5.0, 3), ("b", 8.0, None, 1), ("b", 50.0, None, 0), ("c", 4.0, -3.0, 3), ("d", -1.0, None, 0), ("e", 7.0, None, 3)]
    w = {r.i: (r.grid_size, r.tier1, r.tier3, r.tier4, r.tier, r.base, r.weight) for r in orchestrate.weigh(spark.createDataFrame(rows, "i string, return_pct double, low double, tier int"), ["i"]).collect()}
    assert w["a"] == (2, 2, 2, 1, 4, 5.0, 5.0)  # the best bound of a finalist, though another one passed the last gate
    assert w["b"] == (2, 1, 0, 0, 1, 8.0, 2.0) and w["c"] == (1, 1, 1, 0, 3, -3.0, 0.0)
    assert w["d"] == (1, 0, 0, 0, 0, None, 0.0) and w["e"] == (1, 1, 1, 0, 3, None, 0.0)


def test_runs_table(spark, tmp_path):
    t = spark.createDataFrame([(1, "LONG", 10.0, T0, 1.0, T0 + dt.timedelta(hours=2), 2.0, 0.1, 9.9, "signal")], "trade_no long, side string, units double, entry_ts timestamp_ntz, entry_price double, exit_ts timestamp_ntz, exit_price double, commission double, pnl double, reason_close string")
    a = runs.record_run(str(tmp_path), t, "sma", {"fast": 5}, "x", "tier4", {"score": 1.0}, T0)
    b = runs.record_run(str(tmp_path), t, "rsi", {}, "x", "tier4", created_at=T0 + dt.timedelta(days=1))
    assert [r.run_id for r in runs.list_runs(spark, str(tmp_path), instrument="x").collect()] == [b, a]
    assert [r.params for r in runs.list_runs(spark, str(tmp_path), strategy="sma").collect()] == ['{"fast": 5}']
    assert runs.trades_of(spark, str(tmp_path), a).count() == 1
    fills = spark.read.parquet(f"{tmp_path}/fills").groupBy("run_id").agg(F.sum("units").alias("n")).collect()
    assert {r.n for r in fills} == {0.0}


def test_fault_starts_are_every_place_with_bars_enough(spark):
    from barwright.plans.experiment_queries import fault_starts

    bars = spark.createDataFrame([(s, i, x) for s, n in ((0, 100), (1, 16), (2, 17)) for i in range(n) for x in "ab"], "stretch long, pos int, path string")
    got = sorted((r.stretch, r.pos) for r in fault_starts(bars, 5, 12).collect())
    assert got == [(0, i) for i in range(5, 89)] + [(2, 5)]


def test_replay_and_sweep(spark):
    """A wave that the crossover lives on passes; a flat series has too few trades; a falling strategy fails by its return."""
    from barwright.operators import signals

    rows = [("wave", T0 + dt.timedelta(hours=i), 100 + 10 * math.sin(i / 8)) for i in range(1500)] + [("flat", T0 + dt.timedelta(hours=i), 100.0) for i in range(300)]
    b = spark.createDataFrame([(k, t, v, v, v) for k, t, v in rows], "instrument string, ts timestamp_ntz, mid double, bid_close double, ask_close double")
    s = signals.sma_cross(b, 3, 8, ["instrument"]).select("instrument", "ts", "bid_close", "ask_close", "signal").withColumn("candidate", F.lit("with"))
    against = s.withColumn("candidate", F.lit("against")).withColumn("signal", F.when(F.col("signal") == "BUY", "SELL").when(F.col("signal") == "SELL", "BUY"))
    got = {(r.instrument, r.candidate): (r.verdict, r.reason) for r in orchestrate.replay(s.unionByName(against), ["instrument", "candidate"], iterations=100).collect()}
    assert got == {("wave", "with"): ("PASS", ""), ("wave", "against"): ("FAIL", "return"), ("flat", "with"): ("FAIL", "trades"), ("flat", "against"): ("FAIL", "trades")}
    sma = (lambda x, key: validate.sma_grid(x, key, (3,), (8, 12)), validate.grid(spark, fast=(3,), slow=(8, 12)), ["fast", "slow"])
    bands = (lambda x, key: validate.strategy_grid(x, key, signals.bollinger_reversal, n=(10,), width=(1.0, 2.0)), validate.grid(spark, n=(10,), width=(1.0, 2.0)), ["n", "width"])
    w = {r.strategy: r for r in orchestrate.sweep(b.where("instrument = 'wave'"), ["instrument"], {"sma": sma, "bollinger": bands}, 400, 200, iterations=30, notional=5_000.0).collect()}
    assert set(w) == {"sma", "bollinger"} and w["sma"].grid_size == w["bollinger"].grid_size == 2
    assert w["sma"].tier == 4 and w["sma"].weight == w["sma"].base > 0 and all(r.weight == max(r.base or 0, 0) * orchestrate.TIER_MULTIPLIER[r.tier] for r in w.values())


def test_units_by_notional(spark):
    from barwright.operators import backtest, signals

    rows = [(k, T0 + dt.timedelta(hours=i), p * (10 + math.sin(i / 3))) for k, p in (("cheap", 1.0), ("dear", 100.0)) for i in range(200)]
    b = spark.createDataFrame([(k, t, v, v, v) for k, t, v in rows], "instrument string, ts timestamp_ntz, mid double, bid_close double, ask_close double")
    s = signals.sma_cross(b, 3, 8, ["instrument"]).join(backtest.sized(b, ["instrument"], 2_000.0), "instrument")
    t = {(r.instrument, r.trade_no): (r.units, r.pnl) for r in backtest.trades(s, ["instrument"], units="units").collect()}
    assert {round(u, 9) for (k, _), (u, _) in t.items() if k == "cheap"} == {200.0} and {round(u, 9) for (k, _), (u, _) in t.items() if k == "dear"} == {2.0}
    assert all(math.isclose(p, t["dear", n][1], rel_tol=1e-9) for (k, n), (_, p) in t.items() if k == "cheap")
    e = backtest.equity_curve(s, ["instrument"], units="units").groupBy("instrument").agg(F.max_by("equity", "ts").alias("e")).collect()
    assert math.isclose(e[0].e, e[1].e, rel_tol=1e-12)


def test_month_windows(spark):
    """Windows before and after a training span against a loop; a begin on the 31st stays cut once it was cut."""
    from barwright.functions.timepolicy import add_months

    spans = {"a": (dt.datetime(2020, 1, 31, 5), dt.datetime(2023, 3, 3)), "late": (dt.datetime(2022, 8, 1), dt.datetime(2022, 9, 15)), "inside": (dt.datetime(2021, 7, 2), dt.datetime(2021, 9, 1)), "pre": (dt.datetime(2021, 1, 1), dt.datetime(2021, 6, 20))}
    b = spark.createDataFrame([(k, t) for k, v in spans.items() for t in v], "instrument string, ts timestamp_ntz")
    first, last = dt.datetime(2021, 7, 1), dt.datetime(2021, 12, 31, 23, 59, 59)
    second, want = dt.timedelta(seconds=1), []
    for k, (low, high) in spans.items():
        sides = [("pre_", low, min(first, high))] * (low < first) + [("post_", max(last + second, low), high)] * (high > last + second)
        for name, a, e in sides:
            n = 0
            while a < e:
                after = add_months(a, 4)
                stop = min(after - second, e)
                want += [(k, f"{name}{n}", a, stop)] * ((stop - a).days >= 30)
                a, n = after, n + 1
    w = orchestrate.month_windows(b, ["instrument"], 4, (first, last))
    assert sorted(map(tuple, w.collect())) == sorted(want)
    got = orchestrate.in_windows(b, w, ["instrument"]).groupBy("instrument").count().collect()
    assert {r["instrument"]: r["count"] for r in got} == {"a": 2, "late": 2, "pre": 2}
