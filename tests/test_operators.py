"""Operators against independent sequential or numpy forms on small made-up inputs."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.operators import audit, backtest, correlate, graph, indicators, market, metrics, resample, runlevel, strengths, validate

T0 = dt.datetime(2024, 1, 1)


def hour(i):
    return T0 + dt.timedelta(hours=i)


def series(spark, values, name="value", key="a"):
    return spark.createDataFrame([(key, hour(i), v) for i, v in enumerate(values)], f"instrument string, ts timestamp_ntz, {name} double")


def random_signals(seed, n=400):
    r = random.Random(seed)
    rows, mid = [], 100.0
    for i in range(n):
        mid *= math.exp(r.gauss(0, 0.01))
        rows.append((hour(i), mid * 0.999, mid * 1.001, r.choice([None] * 6 + ["BUY", "SELL", "CLOSE"])))
    return rows


def fold(rows, c, units, start):
    """One bar after another: closed trades, equity at each bar."""
    slip = lambda p: c.slippage_pips * c.pip_size + p * c.slippage_pct
    fee = lambda p: c.commission_flat + c.commission_per_unit * units + c.commission_pct * p * units
    side, entry, since, balance, trades, curve = 0, 0.0, None, start, [], []
    out = lambda bid, ask: bid - slip(bid) if side > 0 else ask + slip(ask)
    for ts, bid, ask, signal in rows:
        want = {"BUY": 1, "SELL": -1, "CLOSE": 0, None: side}[signal]
        if want != side:
            if side:
                p = out(bid, ask)
                pnl = (p - entry) * side * units - fee(entry) - fee(p)
                balance += pnl
                trades.append((since, ts, round(pnl, 6)))
            side = want
            if side:
                entry, since = (ask + slip(ask), ts) if side > 0 else (bid - slip(bid), ts)
        p = out(bid, ask) if side else 0.0
        curve.append(round(balance + ((p - entry) * side * units - fee(entry) - fee(p) if side else 0.0), 6))
    if side:
        p = out(*rows[-1][1:3])
        trades.append((since, rows[-1][0], round((p - entry) * side * units - fee(entry) - fee(p), 6)))
    return trades, curve


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_backtest_equals_a_fold(spark, seed):
    rows = random_signals(seed)
    c = backtest.Costs(commission_flat=0.5, commission_per_unit=0.001, slippage_pips=2, commission_pct=0.0003, slippage_pct=0.0002)
    df = spark.createDataFrame([("a", *x) for x in rows], "instrument string, ts timestamp_ntz, bid_close double, ask_close double, signal string")
    want, curve = fold(rows, c, 50.0, 1000.0)
    got = backtest.trades(df, ["instrument"], c, 50.0).orderBy("entry_ts").collect()
    assert [(t.entry_ts, t.exit_ts, round(t.pnl, 6)) for t in got] == want
    assert got[-1].reason_close == "end of backtest" or rows[-1][3] == "CLOSE" or got[-1].reason_close == "signal"
    eq = backtest.equity_curve(df, ["instrument"], c, 50.0, 1000.0).orderBy("ts").collect()
    assert [round(x.equity, 6) for x in eq] == pytest.approx(curve, abs=1e-5)


def test_no_signals_no_trades(spark):
    df = spark.createDataFrame([("a", hour(i), 1.0, 1.1, None) for i in range(3)], "instrument string, ts timestamp_ntz, bid_close double, ask_close double, signal string")
    assert backtest.trades(df, ["instrument"]).count() == 0
    assert {x.equity for x in backtest.equity_curve(df, ["instrument"]).collect()} == {10_000.0}
    assert backtest.trades(df.limit(0), ["instrument"]).count() == 0


def test_fills(spark):
    fills = [(10.0, 100.0, 1.0), (10.0, 110.0, 1.0), (-5.0, 120.0, 0.5), (-15.0, 90.0, 1.0)]
    df = spark.createDataFrame([(fills,)], "f array<struct<units: double, price: double, commission: double>>")
    r = df.select(backtest.replay_fills(F.col("f"), F.lit(1)).alias("r"), backtest.realized_pnl(F.col("f"), F.lit(1)).alias("p")).first()
    assert (r.r.avg_entry, r.r.net_units, r.r.gross, r.r.commission) == (105.0, 0.0, 75.0 - 225.0, 3.5) and r.p == -153.5


def test_lot_rounds_half_to_even(spark):
    c = backtest.Costs(min_order_size=5.0, lot_step=10.0)
    df = spark.createDataFrame([(x,) for x in (4.0, -4.9, 5.0, 15.0, 25.0, -25.0, 26.0)], "u double")
    assert [r[0] for r in df.select(c.lot(F.col("u"))).collect()] == [0.0, 0.0, 0.0, 20.0, 20.0, -20.0, 30.0]


def test_metrics_by_hand(spark):
    pnls = [10.0, -5.0, 0.0, 20.0, -1.0, -2.0, 7.0]
    df = spark.createDataFrame([("g", i, hour(i), hour(i + 2), p, 1.0) for i, p in enumerate(pnls)], "grp string, k int, entry_ts timestamp_ntz, exit_ts timestamp_ntz, pnl double, commission double")
    m = metrics.trade_metrics(df, ["grp"], 100.0).first()
    assert (m.total_trades, m.total_return_pct, m.avg_hours, m.profit_factor) == (7, pytest.approx(29.0), 2.0, pytest.approx(37 / 8))
    assert m.win_rate_pct == pytest.approx(300 / 7) and m.avg_loss == pytest.approx(-2.0) and m.var_95 == pytest.approx(-np.percentile(pnls, 5))
    s = metrics.streaks(df, ["grp"], ["k"]).first()
    assert (s.max_wins, s.max_losses) == (1, 2)


def test_drawdown_durations(spark):
    curve = series(spark, [100.0, 90.0, 95.0, 101.0, 100.0, 102.0, 50.0, 60.0, 70.0], "equity")
    d = metrics.drawdown_durations(curve, ["instrument"]).first()
    assert (d.max_duration, d.avg_duration, d.still_under) == (3, 2.0, True)
    flat = metrics.drawdown_durations(series(spark, [1.0, 1.0], "equity"), ["instrument"]).first()
    assert (flat.max_duration, flat.avg_duration, flat.still_under) == (0, 0.0, False)
    m = metrics.curve_metrics(series(spark, [5.0, 5.0, 5.0], "equity"), ["instrument"]).first()
    assert m.sharpe_ratio is None and m.omega_ratio is None and m.calmar_ratio is None and m.max_drawdown_pct == 0


def test_smoothers_by_hand():
    x = np.array([1.0, 2.0, 3.0, 4.0, 3.0])
    assert indicators.smooth(x, 3).tolist()[2:] == [2.0, 3.0, 3.0] and np.isnan(indicators.smooth(x, 3)[:2]).all()
    assert np.isnan(indicators.smooth(x, 9)).all() and len(indicators.rsi_of(x[:1], 14)) == 1
    assert indicators.rsi_of(np.arange(20.0), 5)[5:].tolist() == [100.0] * 15
    line, sig = indicators.macd_of(np.arange(60.0) ** 1.1, 3, 6, 4)
    assert np.isnan(line[:5]).all() and not np.isnan(line[5:]).any() and np.isnan(sig[:8]).all() and not np.isnan(sig[8:]).any()
    assert len(indicators.macd_of(x, 12, 26, 9)[1]) == 5


def test_run_level_against_loops(spark):
    r = random.Random(7)
    x = [None if r.random() < 0.15 else round(r.gauss(0, 5), 3) for _ in range(200)]
    df = series(spark, x)
    got = runlevel.cusum(df, ["instrument"], "value", 1.5).orderBy("ts").collect()
    sp = sn = 0.0
    for row, v in zip(got, x):
        sp, sn = (0.0, 0.0) if v is None else (max(0, sp + v - 1.5), max(0, sn - v - 1.5))
        assert row.cusum == (None if v is None else pytest.approx(sp if sp >= sn else -sn, abs=1e-9))
    flags = df.withColumn("flag", F.coalesce(F.abs("value") >= 6, F.lit(False)))
    got = runlevel.latch(flags, ["instrument"], F.col("flag"), F.coalesce(F.abs("value") >= 2, F.lit(False))).orderBy("ts").collect()
    on = False
    for row, v in zip(got, x):
        on = v is not None and abs(v) >= 2 and (on or abs(v) >= 6)
        assert row.latched == on
    f = [v is not None and abs(v) >= 6 for v in x]
    runs = {q.gap: q.runs for q in runlevel.run_counts(flags, ["instrument"], "flag", (1, 3, 6)).collect()}
    assert runs == {g: sum(f[i] and not any(f[max(0, i - g) : i]) for i in range(200)) for g in (1, 3, 6)}
    got = runlevel.ewma(df, ["instrument"], "value", 4.0).orderBy("ts").collect()
    a, s, n = 1 - 0.5**0.25, 0.0, 0
    for row, v in zip(got, x):
        s, n = (0.0, 0) if v is None else (v if n == 0 else a * v + (1 - a) * s, n + 1)
        assert row.ewma == (pytest.approx(s) if n >= 3 else None)


@pytest.mark.parametrize("stat", runlevel.STATS)
def test_window_statistics_against_lists(spark, stat):
    r = random.Random(stat)
    x = [None if r.random() < 0.2 else round(r.gauss(0, 5), 2) for _ in range(80)]
    med = lambda v: float(np.median(v))

    def huber(v):
        mu, s = med(v), 1.4826 * med(np.abs(np.array(v) - med(v)))
        for _ in range(20 if s > 0 else 0):
            mu += s * np.clip((np.array(v) - mu) / s, -1.345, 1.345).mean()
        return mu

    of = {
        "median": med, "mean": np.mean, "trim20": lambda v: np.mean(sorted(v)[len(v) // 5 : len(v) - len(v) // 5]), "sign": lambda v: np.sign(v).mean(),
        "hl": lambda v: med([(v[i] + v[j]) / 2 for i in range(len(v)) for j in range(i, len(v))]), "huber": huber,
    }[stat]
    for centred in (False, True):
        got = runlevel.statistic(series(spark, x), ["instrument"], "value", stat, 6, "half", centred).orderBy("ts").collect()
        back, ahead = (3, 3) if centred else (5, 0)
        for i, row in enumerate(got):
            v = [y for y in x[max(0, i - back) : i + ahead + 1] if y is not None]
            want = None if x[i] is None or len(v) < (4 if centred else 3) else pytest.approx(of(v), abs=1e-9)
            assert row[stat] == want, (stat, centred, i)


def quotes(spark, seed=1, bars=6, drop=0.2, nodes="ABCDE"):
    r = random.Random(seed)
    rows = []
    for t in range(bars):
        c = {n: r.gauss(0, 0.05) for n in nodes}
        for a, b in itertools.combinations(nodes, 2):
            if r.random() >= drop or (a, b) == ("A", "B"):
                mid, half = math.exp(c[a] - c[b] + r.gauss(0, 0.001)), r.uniform(0.0001, 0.001)
                rows.append((hour(t), a, b, mid * (1 - half), mid * (1 + half)))
    return rows, spark.createDataFrame(rows, "ts timestamp_ntz, a string, b string, bid double, ask double")


@pytest.mark.parametrize("scheme", strengths.SCHEMES)
def test_leave_one_out_equals_refits(spark, scheme):
    rows, df = quotes(spark)
    got = strengths.fit(df, scheme).where("kind = 'pair'").collect()
    assert len(got) >= 20
    for t in sorted({x[0] for x in rows}):
        obs = [(a, b, math.log((p + q) / 2) * 1e4, math.log(q / p) * 1e4) for ts, a, b, p, q in rows if ts == t]
        names = sorted({x for o in obs for x in o[:2]})
        d = np.array([[(n == o[0]) - (n == o[1]) for n in names] for o in obs], float)
        y, w = np.array([o[2] for o in obs]), strengths.weights(scheme, np.array([o[3] for o in obs]))
        for i, o in enumerate(obs):
            keep = np.arange(len(obs)) != i
            row = next((g for g in got if (g.ts, g.a, g.b) == (t, *o[:2])), None)
            if row is None or row.loo is None:
                continue
            root = np.sqrt(w[keep])[:, None]
            c = np.linalg.lstsq(root * d[keep], root[:, 0] * y[keep], rcond=None)[0]
            assert row.loo == pytest.approx(y[i] - d[i] @ c, abs=1e-5)


def test_constant_map_equals_solver(spark):
    _, df = quotes(spark, 3, drop=0.0)
    o = strengths.full_bars(df, 10)
    fast = {(x.ts, x.a, x.b): (x.resid, x.loo) for x in strengths.complete_residuals(o, 5).collect()}
    slow = {(x.ts, x.a, x.b): (x.value, x.loo) for x in strengths.fit(df).where("kind = 'pair'").collect()}
    assert fast.keys() == slow.keys() and all(fast[k] == pytest.approx(slow[k], abs=1e-6) for k in fast)
    m = strengths.residual_map(list("ABCDE"))
    y = {(x.ts, x.a, x.b): x.y for x in o.collect()}
    for (ts, a, b), (resid, _) in fast.items():
        assert sum(k * y[ts, p, q] for x1, x2, p, q, k in m if (x1, x2) == (a, b)) == pytest.approx(resid, abs=1e-6)


def _faulty(spark, seed=4):
    """A bar whose pair of the narrowest spread is off by a percent, and that pair."""
    rows, _ = quotes(spark, seed, bars=1, drop=0.0)
    i = min(range(len(rows)), key=lambda j: rows[j][4] / rows[j][3])
    rows[i] = (*rows[i][:3], rows[i][3] * 1.01, rows[i][4] * 1.01)
    return spark.createDataFrame(rows, "ts timestamp_ntz, a string, b string, bid double, ask double"), rows[i][1:3]


@pytest.mark.parametrize("scale", ["spread", "mad"])
def test_huber_bounds_a_fault(spark, scale):
    """The fault stays with its pair, and at every node the bounded residuals balance."""
    df, pair = _faulty(spark)
    spread = {(r.a, r.b): math.log(r.ask / r.bid) * 1e4 for r in df.collect()}
    for k in (1.0, 1.345, 2.0, 3.0):
        h = strengths.huber(df, k, scale=scale).where("kind = 'pair'").orderBy(F.desc(F.abs("value"))).collect()
        assert (h[0].a, h[0].b) == pair and h[0].psi == min(x.psi for x in h) and all(x.converged for x in h)
        if scale == "spread" or k < 2:  # the MAD is one scale for ten pairs, which the fault's own residuals widen
            assert h[0].psi < (0.2 if scale == "spread" else 0.7)
        net = {}
        for x in h:
            if scale == "spread":  # psi times the residual is the residual within k sigma
                bound = k * strengths.NOISE_RATIO * spread[x.a, x.b]
                assert x.psi * x.value == pytest.approx(max(-bound, min(bound, x.value)), abs=1e-4)
            net[x.a], net[x.b] = net.get(x.a, 0) + x.psi * x.value, net.get(x.b, 0) - x.psi * x.value
        assert all(abs(v) < 1e-3 for v in net.values())
    plain = strengths.huber(df, math.inf, scale=scale).where("kind = 'pair'").collect()
    assert {x.psi for x in plain} == {1.0} and {x.iterations for x in plain} == {0}


def test_service_tiers():
    n = {t: sum(v == t for v in validate.METRIC_TIER.values()) for t in validate.TIERS}
    assert n == {"BRONZE": 8, "SILVER": 13, "GOLD": 13} and sum(n.values()) == 34
    assert validate.METRIC_TIER["profit_factor"] == "BRONZE" and validate.METRIC_TIER["payoff_ratio"] == "SILVER" and validate.METRIC_TIER["kelly_fraction"] == "GOLD"


def test_cycles_of_k5(spark):
    e = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(itertools.combinations("ABCDE", 2))], "edge int, a string, b string")
    n = {r.n: r["count"] for r in graph.simple_cycles(e, 5).groupBy("n").count().collect()}
    assert n == {3: 10, 4: 15, 5: 12}
    two = spark.createDataFrame([(0, "A", "B"), (1, "A", "B"), (2, "A", "A")], "edge int, a string, b string")
    assert graph.simple_cycles(two, 3, least=2).count() == 1


def test_negative_cycles_have_gains(spark):
    rows, _ = quotes(spark, 5, bars=3, drop=0.0)
    rows[4] = (*rows[4][:3], rows[4][3] * 1.05, rows[4][4] * 1.05)
    df = spark.createDataFrame(rows, "ts timestamp_ntz, a string, b string, bid double, ask double")
    found = graph.negative_cycles(df).collect()
    legs = graph.triangle_legs(graph.triangles(df))
    gains = graph.cycle_numbers(df, legs).where("greatest(gain_fwd, gain_rev) > 0")
    assert {x.ts for x in found} >= {x.ts for x in gains.collect()} and all(x.gain_bps > 0 for x in found) and found


def test_components_and_clusters(spark):
    c = spark.createDataFrame([(a, b, 1.0 if a == b else v) for a, b, v in [("a", "a", 1), ("b", "b", 1), ("c", "c", 1), ("d", "d", 1), ("a", "b", -0.7), ("b", "c", 0.5), ("a", "d", 0.4), ("c", "d", 0.1)]], "a string, b string, corr double")
    got = {r.node: r.component for r in correlate.clusters(c).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d"}
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)], "a int, b int")
    assert {r.component for r in graph.components(spark.range(31).select(F.col("id").cast("int").alias("node")), chain).collect()} == {0}
    votes = spark.createDataFrame([("a", 1.0, 3.0), ("b", -1.0, 1.0), ("d", 1.0, 2.0)], "node string, stance double, weight double")
    v = {r.component: (r.stance, r.weight, r.members) for r in correlate.cluster_votes(votes, correlate.clusters(c)).collect()}
    assert v == {"a": (0.5, 2.0, 2), "d": (1.0, 2.0, 1)}


def test_grid_plateau_and_gates(spark):
    g = validate.grid(spark, fast=[1, 2, 3], slow=[10, 20, 30])
    assert [(r.param_id, r.fast, r.slow) for r in g.orderBy("param_id").collect()] == [(i * 3 + j, f, s) for i, f in enumerate((1, 2, 3)) for j, s in enumerate((10, 20, 30))]
    s = g.withColumn("score", F.when(F.col("param_id") == 4, 10.0).when(F.col("param_id") == 0, F.lit(None)).otherwise(1.0)).withColumn("k", F.lit("x"))
    gap = {r.param_id: (r.gap, r.neighbours) for r in validate.neighbour_gap(s, ["k"], ["fast", "slow"]).collect()}
    assert gap[4] == (9.0, 4) and gap[8] == (0.0, 2) and gap[0] == (None, 2) and gap[1] == (1.0 - 5.5, 2)
    assert 4 not in {r.param_id for r in validate.plateau(validate.neighbour_gap(s, ["k"], ["fast", "slow"]), ["k"]).collect()}
    assert [r.param_id for r in validate.best(s, ["k"], 2).orderBy("rank").collect()] == [4, 1]
    assert {r.value: (r.mean_score, r.points) for r in validate.marginal(s, ["k"], "fast").collect()} == {1: (1.0, 2), 2: (4.0, 3), 3: (1.0, 3)}
    rows = [(25, 1.0, None, 5.0), (19, 1.0, 2.0, 5.0), (25, 1.0, 1.0, 5.0), (25, 1.0, 2.0, 20.0), (25, 0.0, 2.0, 5.0)]
    df = spark.createDataFrame(rows, "total_trades int, total_return_pct double, profit_factor double, max_drawdown_pct double")
    assert [r.passed for r in validate.gates(df).collect()] == [True, False, False, False, False]


def test_resampling(spark):
    df = spark.createDataFrame([("g", i, float(i - 4)) for i in range(10)], "grp string, k0 int, pnl double")
    s = resample.resample(df, ["grp"], ["k0"], 300)
    assert s.count() == 3000
    means = s.groupBy("iter").agg(F.avg("pnl").alias("m")).toPandas()["m"]
    assert abs(means.mean() - 0.5) < 0.15 and abs(means.std() - np.std(np.arange(10)) / math.sqrt(10)) < 0.15
    m = resample.sampled_metrics(resample.shuffle(df, ["grp"], ["k0"], 20), ["grp"], 100.0).toPandas()
    assert m.total_return_pct.max() - m.total_return_pct.min() < 1e-9 and m.max_drawdown_pct.nunique() > 3
    assert resample.per_key(df, ["grp"], ["k0"], 3).count() == 3
    t = spark.createDataFrame([("g", float(i)) for i in range(100)], "grp string, v double")
    assert tuple(resample.truncated_interval(t, ["grp"], "v").first())[1:] == (4.0, 94.0)


def brute_tracked(trades, start):
    """The tracked metrics of trades (pnl, commission, hours) in order, in plain Python."""
    pnl = [t[0] for t in trades]
    n, wins, losses = len(pnl), [x for x in pnl if x > 0], [x for x in pnl if x <= 0]
    e = [start]
    for x in pnl:
        e.append(e[-1] + x)
    dd, peak, runs, run = [], e[0], [], 0
    for x in e:
        peak = max(peak, x)
        dd.append((peak - x) / peak * 100 if peak > 0 else 0.0)
        if dd[-1] > 0:
            run += 1
        elif run:
            runs.append(run)
            run = 0
    runs += [run] if run else []

    def pct(q):
        s = sorted(pnl)
        k = q * (n - 1)
        lo = int(k)
        return s[lo] + (s[min(lo + 1, n - 1)] - s[lo]) * (k - lo)

    def longest(win):
        best = now = 0
        for x in pnl:
            now = now + 1 if (x > 0) == win else 0
            best = max(best, now)
        return best

    aw, al = sum(wins) / len(wins) if wins else 0.0, sum(losses) / len(losses) if losses else 0.0
    wr, mean = len(wins) / n, sum(pnl) / n
    sd = math.sqrt(sum((x - mean) ** 2 for x in pnl) / n)
    payoff = aw / abs(al) if al else None
    ret = sum(pnl) / start * 100
    p5 = pct(0.05)
    tail = [x for x in pnl if x <= p5]
    gross = sum(pnl) + sum(t[1] for t in trades)
    expectancy = wr * aw + (1 - wr) * al
    return {
        "total_return_pct": ret, "max_drawdown_pct": max(dd), "win_rate_pct": wr * 100, "profit_factor": sum(wins) / abs(sum(losses)) if sum(losses) else None, "ending_balance": e[-1],
        "trade_expectancy": expectancy, "trade_expectancy_pct": expectancy / start * 100, "payoff_ratio": payoff, "recovery_factor": ret / max(dd) if max(dd) else None, "ulcer_index": math.sqrt(sum(x * x for x in dd) / len(dd)),
        "max_drawdown_duration": max(runs, default=0), "avg_drawdown_duration": sum(runs) / len(runs) if runs else 0.0, "var_95": max(-p5, 0.0), "cvar_95": max(-sum(tail) / len(tail), 0.0),
        "tail_ratio": abs(pct(0.95)) / abs(p5) if p5 else None, "skewness": sum((x - mean) ** 3 for x in pnl) / n / sd**3 if n >= 3 and sd else None, "kurtosis": sum((x - mean) ** 4 for x in pnl) / n / sd**4 - 3 if n >= 3 and sd else None,
        "kelly_fraction": wr - (1 - wr) / payoff if payoff else None, "cost_drag_pct": sum(t[1] for t in trades) / abs(gross) * 100 if gross else None, "avg_trade_duration_hours": sum(t[2] for t in trades) / n,
        "max_consecutive_wins": longest(True), "max_consecutive_losses": longest(False),
    }


def test_bootstrap_of_all_tracked_metrics(spark):
    r = random.Random(8)
    rows = [("g", i, round(r.gauss(3, 40), 2), 0.5, T0, T0 + dt.timedelta(hours=r.randint(1, 9))) for i in range(25)] + [("one", 0, 1.0, 0.5, T0, T0)]
    df = spark.createDataFrame(rows, "grp string, k0 int, pnl double, commission double, entry_ts timestamp_ntz, exit_ts timestamp_ntz")
    drawn = resample.resample(df.where("grp = 'g'"), ["grp"], ["k0"], 6)
    got = {x["iter"]: x.asDict() for x in resample.tracked_metrics(drawn, ["grp"], 1000.0).collect()}
    by = {}
    for x in drawn.orderBy("iter", "k").collect():
        by.setdefault(x["iter"], []).append((x.pnl, x.commission, (x.exit_ts - x.entry_ts).seconds / 3600))
    assert len(got) == 6 and len(resample.TRACKED) == 22
    for it, t in by.items():
        want = brute_tracked(t, 1000.0)
        assert want.keys() == set(resample.TRACKED)
        for name, v in want.items():
            assert got[it][name] == (None if v is None else pytest.approx(v, rel=1e-9, abs=1e-9)), name
    b = {x.metric: x for x in resample.bootstrap(df, ["grp"], ["k0"], iterations=40, start=1000.0).collect()}
    assert len(b) == 22 and {x.grp for x in b.values()} == {"g"}
    own = brute_tracked([(x[2], x[3], (x[5] - x[4]).seconds / 3600) for x in rows[:25]], 1000.0)
    assert b["total_return_pct"].observed == pytest.approx(own["total_return_pct"]) and 0 <= b["total_return_pct"].rank <= 100
    s = {x.metric: x for x in resample.bootstrap(df, ["grp"], ["k0"], "shuffle", 40, start=1000.0).collect()}
    assert s["total_return_pct"].high - s["total_return_pct"].low < 1e-9 and s["max_drawdown_pct"].sd > 0 and s["ending_balance"].sd < 1e-9
    for bad in (dict(iterations=50_001), dict(method="other")):
        with pytest.raises(ValueError):
            resample.bootstrap(df, ["grp"], ["k0"], **bad)


def test_grid_of_any_strategy(spark):
    from barwright.operators import signals

    rows = [("x", T0 + dt.timedelta(hours=i), 100 + 10 * math.sin(i / 5)) for i in range(300)]
    b = spark.createDataFrame([(k, t, v, v, v) for k, t, v in rows], "instrument string, ts timestamp_ntz, mid double, bid_close double, ask_close double")
    any_ = validate.strategy_grid(b, ["instrument"], signals.sma_cross, fast=(3, 5, 9), slow=(8, 12))
    one = validate.sma_grid(b, ["instrument"], (3, 5, 9), (8, 12))
    rows_of = lambda d: sorted((r.param_id, r.ts, r.signal) for r in d.where("signal is not null").select("param_id", "ts", "signal").collect())
    assert rows_of(any_) == rows_of(one)
    params = validate.grid(spark, fast=(3, 5, 9), slow=(8, 12))
    scored = {r.param_id: (r.score, r.trades) for r in validate.sensitivity(any_, params, ["instrument"]).collect()}
    assert set(scored) == set(range(6)) and scored[4] == (None, None)
    sharpe = validate.sensitivity(any_, params, ["instrument"], metric=F.col("sharpe_ratio"))
    assert {r.param_id for r in sharpe.where("score is null").collect()} == {4} and sharpe.where("param_id = 0").first().trades == scored[0][1]
    of = lambda x, key: validate.strategy_grid(x, key, signals.sma_cross, fast=(3, 5, 9), slow=(8, 12))
    a = validate.walk_forward(b, ["instrument"], of, params, 100, 50).orderBy("window").collect()
    assert [r.window for r in a] == [0, 1, 2, 3] and all(r.fast < r.slow for r in a)
    c = validate.walk_forward(b, ["instrument"], of, params, 100, 50, metric=-F.col("max_drawdown_pct")).collect()
    assert len(c) == 4 and all(r.score <= 0 for r in c)
    with pytest.raises(ValueError):
        validate.strategy_grid(b, ["instrument"], signals.sma_cross, fast=(9,), slow=(8,))


def test_report_comparer(spark):
    g = [("a", 1.0, None), ("b_count", 10.0, None), ("c", 2.0, None), ("d", None, "x"), ("e", None, "y"), ("f", 1.0, None), ("h", 3.0, None)]
    f = [("a", 1.0, None), ("b_count", 12.0, None), ("c", 2.0001, None), ("d", None, "x"), ("e", None, "z"), ("g", 1.0, None), ("h", 3.1, None)]
    schema = "path string, number double, text string"
    got = {r.path: r.kind for r in audit.compare_reports(spark.createDataFrame(g, schema), spark.createDataFrame(f, schema)).collect()}
    assert got == {"b_count": "FLIP", "c": "FLIP", "e": "FAIL", "f": "FAIL", "g": "FAIL", "h": "FAIL"}


def test_run_log(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"record_type": "start", "run_id": "r", "seq": 0, "ts": "2024-01-01T00:00:00"}\n{"record_type": "item", "run_id": "r", "seq": 1, "seconds": 2.0}\n{"record_type": "item", "run_id": "r", "seq": 1, "seconds": 2.0}\n{"record_type": "end", "run_id": "r", "seq": 2, "status": "ok", "ts": "2024-01-01T01:00:00"}\n{"record_type": "start", "run_id": "q", "seq": 0}\n{"record_ty')
    log = audit.read_log(spark, str(p)).cache()
    assert log.where("_corrupt IS NOT NULL").count() == 1
    m = {r.run_id: (r.status, r["items"], r.total_s) for r in audit.merge_log(log).collect()}
    assert m == {"r": ("ok", 1, 2.0), "q": ("unfinished", 0, None)}
    assert audit.unseen(log.where("run_id IS NOT NULL"), log.where("seq = 0")).count() == 3


def test_cycle_basis(spark):
    """E - N + C closed walks that are independent: each has an edge of its own. Two components, parallel edges, a loop, a lone node."""
    pairs = [*itertools.combinations("ABCDE", 2), ("A", "B"), ("A", "A"), *itertools.pairwise("PQRSTUVWP"), ("P", "T")]
    e = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "edge int, a string, b string")
    nodes = spark.createDataFrame([(c,) for c in "ABCDEPQRSTUVWZ"], "node string")
    basis = graph.cycle_basis(nodes, e).collect()
    assert len(basis) == (len(pairs) - 1) - 14 + 3 and {r.root for r in basis} == {"A", "P"}
    own = [r.edge for r in basis]
    for r in basis:
        walk = [pairs[x.edge] if x.d > 0 else pairs[x.edge][::-1] for x in r.legs]
        assert all(p[1] == q[0] for p, q in zip(walk, walk[1:] + walk[:1])) and len({x.edge for x in r.legs}) == len(r.legs)
        assert sum(x.edge in own for x in r.legs) == 1  # its own; all others are of the forest
    depth = {r.node: (r.root, r.depth, len(r.way)) for r in graph.forest(nodes, e).collect()}
    assert depth["S"] == ("P", 2, 2) and depth["Z"] == ("Z", 0, 0) and len(depth) == 14  # S by way of T, which the chord joins with P


def test_canonical_walks(spark):
    names = ["GBP_USD", "EUR_USD", "EUR_GBP", "LTC/USDT", "LTC/GBP", "BTC/USDT", "BTC/EUR", "LTC/BTC", "bad", "x_y_z"]
    inst = spark.createDataFrame([(n,) for n in names], "instrument string")
    venues = spark.createDataFrame([("USDT", "one"), ("GBP", "two")], "quote string, venue string")
    edges = market.topology(inst, venues, spark.createDataFrame([("USDT", "USD"), ("USDC", "USD")], "proxy string, usd string"))
    got = {r.instrument: (r.kind, r.base, r.quote, r.venue, r.venue_b) for r in edges.collect()}
    assert len(got) == 9 and got["USDT~USD"] == ("BASIS", "USDT", "USD", "one", "fx") and got["LTC/GBP"][3] == "two" and got["BTC/EUR"][3] == "other" and got["GBP_USD"][3:] == ("fx", None)
    cycles = graph.simple_cycles(edges.select("edge", F.col("base").alias("a"), F.col("quote").alias("b")), 5)
    w = market.canonical_walks(cycles, edges).collect()
    by = lambda c: {r.label for r in w if r["class"] == c and (r.path is not None or c not in ("basis", "triangle"))}
    assert by("triangle") == {"+EUR_GBP +GBP_USD -EUR_USD"}
    assert by("basis") == {"LTC via USDT/GBP: -LTC/USDT +LTC/GBP +GBP_USD", "BTC via USDT/EUR: -BTC/USDT +BTC/EUR +EUR_USD"}
    other = [r for r in w if r["class"] == "basis" and r.path is None]
    assert other and all(r.label.startswith("basis: ") and "~" not in r.label and r.key.startswith("~ ") for r in other)
    assert any("LTC/BTC" in x for x in by("crypto_only")) and not by("fx_other")


def test_method_grid_agrees_with_single_fits(spark):
    rows, _ = quotes(spark, 6, bars=7, drop=0.15)
    rows[3] = (*rows[3][:3], rows[3][3] * 1.01, rows[3][4] * 1.01)
    df = spark.createDataFrame(rows, "ts timestamp_ntz, a string, b string, bid double, ask double")
    grid = strengths.method_grid(df)
    got = {(r.ts, r.method): (r.strengths, r.iterations, r.converged) for r in grid.collect()}
    assert len({m for _, m in got}) == 27 == len(strengths.method_names()) and grid._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    for name, scheme, k, scale in [m for m in strengths.method_names() if m[2] in (math.inf, 1.345)]:
        one = {}
        for r in strengths.huber(df, k, scheme, scale).where("kind = 'node'").collect():
            one.setdefault(r.ts, {})[r.a] = (r.value, r.iterations, r.converged)
        assert {t for t, m in got if m == name} == set(one)
        for t, nodes in one.items():
            c, its, done = got[t, name]
            assert all(math.isclose(c[x], v[0], rel_tol=1e-7, abs_tol=1e-7) and (its, done) == v[1:] for x, v in nodes.items()), (name, t)


def test_corrected_equals_a_full_refit(spark):
    rows, _ = quotes(spark, 6, bars=5, drop=0.2)
    df = spark.createDataFrame(rows, "ts timestamp_ntz, a string, b string, bid double, ask double")
    first = df.join(df.agg(F.min("ts").alias("ts")), "ts")
    fix = first.orderBy("a", "b").limit(2).select("ts", "a", "b", F.lit(25.0).alias("estimate")).unionByName(first.limit(1).select("ts", F.lit("no").alias("a"), F.lit("pair").alias("b"), F.lit(9.0).alias("estimate")))
    keys = [(r.ts, r.a, r.b) for r in fix.collect()]
    moved = spark.createDataFrame([(t, a, b, bid * math.exp(-25e-4), ask * math.exp(-25e-4)) if (t, a, b) in keys else (t, a, b, bid, ask) for t, a, b, bid, ask in rows], df.schema)
    for scheme in strengths.SCHEMES:
        want = {(r.ts, r.a): r.value for r in strengths.fit(moved, scheme).where("kind = 'node'").collect()}
        plain = {(r.ts, r.a): r.value for r in strengths.fit(df, scheme).where("kind = 'node'").collect()}
        got = {(r.ts, r.node): (r.c, r.c_corrected) for r in strengths.corrected(df, fix, scheme).collect()}
        assert set(got) == set(want) and any(abs(want[k] - plain[k]) > 1 for k in want)
        assert all(math.isclose(a, plain[k], abs_tol=1e-9) and math.isclose(b, want[k], abs_tol=1e-9) for k, (a, b) in got.items())
