"""Queries of correlation, validation, resampling, reports and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import rounded as r
from ..operators import audit, backtest, correlate, indicators, metrics, resample, signals, validate
from ..sources import candles
from ..sources.views import BARS, CLOSING, TRADES, bars, trades
from .candle_queries import _RN, COSTS, _smooth_sql, rounds, trades_sql

QUERIES: dict = {}
ORACLES: dict = {}
BY = ["instrument"]
FAST, SLOW = (3, 5, 8), (10, 20, 30)


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_RET = f"{BARS}, rt AS (SELECT instrument, ts, CASE WHEN lag(ts) OVER w = ts - INTERVAL 1 HOUR THEN ln(mid / lag(mid) OVER w) * 10000 END AS ret FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY ts)), ret AS (SELECT * FROM rt WHERE ret IS NOT NULL)"
_CORR = f"{_RET}, cm AS (SELECT x.instrument AS a, y.instrument AS b, count(*) AS n, CASE WHEN x.instrument = y.instrument THEN 1.0 ELSE coalesce(covar_pop(x.ret, y.ret) / nullif(sqrt(var_pop(x.ret) * var_pop(y.ret)), 0), 0) END AS corr FROM ret x JOIN ret y ON x.ts = y.ts AND x.instrument <= y.instrument GROUP BY 1, 2)"


def _ret(spark: SparkSession, sf: str) -> DataFrame:
    return indicators.hourly_log_return(bars(spark, sf), BY).select("instrument", "ts", "ret").where("ret IS NOT NULL")


def _corr(spark: SparkSession, sf: str) -> DataFrame:
    return correlate.matrix(_ret(spark, sf), "instrument", "ts", "ret")


@query(f"WITH {_CORR} SELECT a, b, n, round(corr, 6) AS corr FROM cm")
def correlation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(_corr(spark, sf), [])


@query(f"WITH {_CORR} (SELECT 'max' AS kind, a, b, round(corr, 6) AS corr FROM cm WHERE a < b ORDER BY cm.corr DESC, a, b LIMIT 1) UNION ALL (SELECT 'min', a, b, round(corr, 6) FROM cm WHERE a < b ORDER BY cm.corr, a, b LIMIT 1)")
def extreme_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(correlate.extremes(_corr(spark, sf)), [])


@query(f"""WITH {_RET}, f AS (SELECT * FROM ret WHERE ts IN (SELECT ts FROM ret GROUP BY 1 HAVING count(*) = 5)), p AS (SELECT ts, sum(ret) / 5 AS r FROM f GROUP BY 1), o AS (SELECT sum(v) / 5 AS own FROM (SELECT stddev_samp(ret) AS v FROM f GROUP BY instrument))
 SELECT count(*) AS periods, round(avg(r), 6) AS mean, round(stddev_samp(r) * sqrt(8760), 4) AS vol, round(avg(r) / stddev_samp(r) * sqrt(8760), 6) AS sharpe, round(any_value(own) / stddev_samp(r), 6) AS diversification FROM p, o""")
def portfolio_metrics(spark: SparkSession, sf: str) -> DataFrame:
    p = correlate.portfolio(_ret(spark, sf), "instrument", "ts", "ret", 5, per_year=8760)
    return p.select("periods", r("mean").alias("mean"), r("vol", 4).alias("vol"), r("sharpe").alias("sharpe"), r("diversification").alias("diversification"))


@query(f"""WITH {_RET}, l(lag) AS (VALUES (-2), (-1), (0), (1), (2)) SELECT lag, count(*) AS n, round(covar_pop(x.ret, y.ret) / sqrt(var_pop(x.ret) * var_pop(y.ret)), 6) AS corr
 FROM ret x, l, ret y WHERE x.instrument = 'click' AND y.instrument = 'view' AND y.ts = x.ts + lag * INTERVAL 1 HOUR GROUP BY 1""")
def lag_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(correlate.lagged(_ret(spark, sf), "instrument", "ts", "ret", "click", "view"), [])


@query(f"""WITH {_RET}, j AS (SELECT x.ret AS y, a.ret - b.ret AS x FROM ret x JOIN ret a ON a.ts = x.ts AND a.instrument = 'view' JOIN ret b ON b.ts = x.ts AND b.instrument = 'error' WHERE x.instrument = 'click')
 SELECT count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)), 6) AS r FROM j""")
def basis_loading(spark: SparkSession, sf: str) -> DataFrame:
    """Slope of one series on the difference of two others, on the hours that all three have."""
    s = _ret(spark, sf)
    one = lambda k, c: s.where(F.col("instrument") == k).select("ts", F.col("ret").alias(c))
    j = one("click", "y").join(one("view", "p"), "ts").join(one("error", "q"), "ts").withColumn("x", F.col("p") - F.col("q"))
    g = correlate.regression(j, [], "y", "x")
    return g.select("n", r("slope").alias("slope"), r("intercept", 4).alias("intercept"), r("r").alias("r"))


@query(f"""WITH {BARS}, v AS (SELECT instrument, ts, volume AS x, (ask_close - bid_close) / mid AS y FROM bars), k AS (SELECT instrument, rank() OVER (PARTITION BY instrument ORDER BY x) + (count(*) OVER (PARTITION BY instrument, x) - 1) / 2.0::DOUBLE AS rx,
 rank() OVER (PARTITION BY instrument ORDER BY y) + (count(*) OVER (PARTITION BY instrument, y) - 1) / 2.0::DOUBLE AS ry FROM v) SELECT instrument, count(*) AS n, round(covar_pop(rx, ry) / nullif(sqrt(var_pop(rx) * var_pop(ry)), 0), 6) AS rho FROM k GROUP BY 1""")
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    v = bars(spark, sf).select("instrument", F.col("volume").alias("x"), ((F.col("ask_close") - F.col("bid_close")) / F.col("mid")).alias("y"))
    return rounds(correlate.spearman(v, BY, "x", "y"), [])


@query(f"""WITH {_RET}, d AS (SELECT instrument, abs(ret) AS v, floor((10 * row_number() OVER (PARTITION BY instrument ORDER BY abs(ret), ts) - 1) / count(*) OVER (PARTITION BY instrument))::INT AS decile FROM ret)
 SELECT instrument, decile, count(*) AS n, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.99), 6) AS p99 FROM d GROUP BY ALL""")
def decile_table(spark: SparkSession, sf: str) -> DataFrame:
    d = correlate.deciles(_ret(spark, sf).withColumn("v", F.abs("ret")), BY, "v", ["ts"])
    return rounds(d.groupBy("instrument", "decile").agg(F.count(F.lit(1)).alias("n"), F.percentile("v", 0.5).alias("p50"), F.percentile("v", 0.99).alias("p99")), [])


@query(f"WITH {_RET}, c AS (SELECT instrument, quantile_cont(ret, 0.01) AS lo, quantile_cont(ret, 0.99) AS hi FROM ret GROUP BY 1) SELECT instrument, count(*) AS n, round(avg(least(greatest(ret, lo), hi)), 6) AS mean FROM ret JOIN c USING (instrument) GROUP BY 1")
def winsorised_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(correlate.winsorised_mean(_ret(spark, sf), BY, "ret"), [])


@query(f"WITH {BARS} SELECT instrument, count(*) AS n, round(regr_slope(mid, volume), 6) AS slope, round(regr_intercept(mid, volume), 6) AS intercept, round(covar_pop(volume, mid) / nullif(sqrt(var_pop(volume) * var_pop(mid)), 0), 6) AS r FROM bars GROUP BY 1")
def regression(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(correlate.regression(bars(spark, sf), BY, "mid", "volume"), [])


@query(f"""WITH {_RET}, g AS (SELECT hour(ts)::INT AS hour, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) / sqrt(count(*)) AS se, quantile_cont(ret, 0.5) AS median, quantile_cont(ret, 0.9) AS p90 FROM ret GROUP BY 1)
 SELECT hour, n, round(mean, 6) AS mean, round(se, 6) AS se, round(median, 6) AS median, round(p90, 6) AS p90, coalesce(hour = (SELECT hour FROM g WHERE n >= 10 ORDER BY g.median DESC, hour LIMIT 1), false) AS peak FROM g""")
def hour_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(correlate.hour_stats(_ret(spark, sf), "ret"), [])


@query(f"""WITH {BARS}, z AS (SELECT *, date_diff('hour', ts, ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London') = 1 AS uk, date_diff('hour', ts, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') = -4 AS us FROM (SELECT instrument, ts + INTERVAL (m) MONTH AS ts, mid FROM bars, (VALUES (0), (2), (6)) v(m)))
 SELECT CASE WHEN uk AND us THEN 'both_summer' WHEN us THEN 'uk_winter_us_summer' WHEN uk THEN 'uk_summer_us_winter' ELSE 'both_winter' END AS cell, count(*) AS n, round(quantile_cont(mid, 0.5), 6) AS median FROM z GROUP BY 1""")
def hour_dst_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Bars, also moved on by 2 and 6 months, by daylight-saving cell."""
    from ..functions.timepolicy import dst_cell

    b = bars(spark, sf).withColumn("m", F.explode(F.array(F.lit(0), F.lit(2), F.lit(6)))).withColumn("ts", F.col("ts") + F.make_ym_interval(F.lit(0), F.col("m")))
    return rounds(b.groupBy(dst_cell(F.col("ts")).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.percentile("mid", 0.5).alias("median")), [])


@query(f"""WITH {_RET}, m AS (SELECT instrument, quantile_cont(ret, 0.5) AS m, quantile_cont(abs(ret), 0.99) AS p99, kurtosis_pop(ret) AS k FROM ret GROUP BY 1), s AS (SELECT instrument, count(*) AS n, 1.4826 * quantile_cont(abs(ret - m), 0.5) AS sigma FROM ret JOIN m USING (instrument) GROUP BY 1)
 SELECT instrument, n, round(sigma, 6) AS sigma, round(p99, 6) AS p99, round(p99 / sigma, 6) AS ratio, round(k, 6) AS kurtosis FROM s JOIN m USING (instrument) WHERE n >= 30""")
def tail_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(correlate.tail_stats(_ret(spark, sf), BY, "ret"), [])


@query(f"WITH {_RET} SELECT instrument, least(greatest(floor((log10(nullif(abs(ret), 0)) + 3) * 200 / 6), 0), 199)::INT AS bin, count(*) AS n FROM ret WHERE ret <> 0 GROUP BY ALL")
def log_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return _ret(spark, sf).where("ret <> 0").groupBy("instrument", correlate.log_bins(F.col("ret")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_RET}, k AS (SELECT instrument, count(*) AS n, count(*) FILTER (ret > 0) AS k FROM ret GROUP BY 1), p AS (SELECT *, k / n AS p, 1.959963984540054::DOUBLE AS z FROM k)
 SELECT instrument, n, k, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n))) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n))) / (1 + z * z / n), 6) AS high FROM p""")
def wilson_interval(spark: SparkSession, sf: str) -> DataFrame:
    g = _ret(spark, sf).groupBy("instrument").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ret") > 0).alias("k"))
    low, high = correlate.wilson(F.col("k"), F.col("n"))
    return g.select("instrument", "n", "k", r(low).alias("low"), r(high).alias("high"))


@query(f"""WITH RECURSIVE {_CORR}, e AS (SELECT a, b FROM cm WHERE a < b AND abs(corr) >= 0.02 UNION SELECT b, a FROM cm WHERE a < b AND abs(corr) >= 0.02), n AS (SELECT DISTINCT a AS node FROM cm WHERE a = b),
 reach AS (SELECT node, node AS other FROM n UNION SELECT reach.node, e.b FROM reach JOIN e ON reach.other = e.a) SELECT node, min(other) AS component FROM reach GROUP BY 1""")
def series_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return correlate.clusters(_corr(spark, sf), 0.02)


@query(f"""WITH {_CORR}, w AS (SELECT instrument AS node, count(*)::DOUBLE AS weight FROM bars GROUP BY 1), b AS (SELECT a AS node, b AS other, corr FROM cm WHERE a < b UNION ALL SELECT b, a, corr FROM cm WHERE a < b),
 m AS (SELECT b.node, max(abs(corr)) AS m FROM b JOIN w x ON x.node = b.node JOIN w y ON y.node = b.other WHERE y.weight > x.weight OR y.weight = x.weight AND b.other < b.node GROUP BY 1)
 SELECT node, weight, round(weight * (1 - coalesce(m, 0)), 6) AS discounted FROM w LEFT JOIN m USING (node)""")
def pairwise_discount(spark: SparkSession, sf: str) -> DataFrame:
    w = bars(spark, sf).groupBy(F.col("instrument").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return rounds(correlate.pairwise_discount(w, _corr(spark, sf)), [])


_GRID = f"""{BARS}, prm AS (SELECT (i * {len(SLOW)} + j)::BIGINT AS param_id, {list(FAST)}[i + 1] AS fast, i AS fast_ix, {list(SLOW)}[j + 1] AS slow, j AS slow_ix FROM range({len(FAST)}) f(i), range({len(SLOW)}) s(j)),
 nb AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts) AS rn FROM bars),
 mn AS (SELECT instrument, ts, bid_close, ask_close, rn, {', '.join(f'avg(mid) OVER (PARTITION BY instrument ORDER BY ts ROWS {p - 1} PRECEDING) AS m{p}' for p in sorted({*FAST, *SLOW}))} FROM nb),
 ab AS (SELECT instrument, param_id, ts, bid_close, ask_close, CASE WHEN rn >= slow THEN (CASE fast {' '.join(f'WHEN {p} THEN m{p}' for p in FAST)} END) > (CASE slow {' '.join(f'WHEN {p} THEN m{p}' for p in SLOW)} END) END AS above FROM mn, prm WHERE fast < slow),
 sig AS (SELECT *, CASE WHEN above AND NOT lag(above) OVER w THEN 'BUY' WHEN NOT above AND lag(above) OVER w THEN 'SELL' END AS signal FROM ab WINDOW w AS (PARTITION BY instrument, param_id ORDER BY ts)),
 {trades_sql('instrument, param_id')}, sc AS (SELECT instrument, param_id, count(*) AS trades, sum(pnl) / 100 AS score FROM tr GROUP BY ALL),
 sens AS (SELECT i.instrument, prm.*, CASE WHEN fast < slow THEN coalesce(trades, 0) END AS trades, CASE WHEN fast < slow THEN coalesce(score, 0) END AS score FROM (SELECT DISTINCT instrument FROM bars) i CROSS JOIN prm LEFT JOIN sc ON sc.instrument = i.instrument AND sc.param_id = prm.param_id),
 gap AS (SELECT a.instrument, a.param_id, avg(b.score) AS near, count(b.score) AS k FROM sens a JOIN sens b ON a.instrument = b.instrument AND abs(a.fast_ix - b.fast_ix) + abs(a.slow_ix - b.slow_ix) = 1 AND b.score IS NOT NULL GROUP BY ALL)"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    params = validate.grid(spark, fast=FAST, slow=SLOW)
    return validate.sensitivity(validate.sma_grid(bars(spark, sf), BY, FAST, SLOW), params, BY, COSTS)


def _sma(b: DataFrame, key: list[str]) -> DataFrame:
    return validate.sma_grid(b, key, FAST, SLOW)


@query(f"WITH {_GRID} SELECT instrument, param_id, fast, slow, trades, round(score, 4) AS score FROM sens")
def grid_sensitivity_sma(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(_scored(spark, sf).select("instrument", "param_id", "fast", "slow", "trades", "score"), [], 4)


@query(f"WITH {_GRID} SELECT instrument, param_id, k AS neighbours, round(score - near, 4) AS gap FROM sens LEFT JOIN gap USING (instrument, param_id)")
def neighbor_gap(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(validate.neighbour_gap(_scored(spark, sf), BY, ["fast", "slow"]).select("instrument", "param_id", "neighbours", "gap"), [], 4)


@query(f"WITH {_GRID}, p AS (SELECT *, score - near AS g, stddev_pop(score) OVER (PARTITION BY instrument) AS sd, count(score) OVER (PARTITION BY instrument) AS n FROM sens LEFT JOIN gap USING (instrument, param_id)) SELECT instrument, param_id, round(g, 4) AS gap, round(sd, 4) AS sd FROM p WHERE n >= 2 AND g <= sd")
def plateau(spark: SparkSession, sf: str) -> DataFrame:
    p = validate.plateau(validate.neighbour_gap(_scored(spark, sf), BY, ["fast", "slow"]), BY)
    return rounds(p.select("instrument", "param_id", "gap", "sd"), [], 4)


@query(f"WITH {_GRID} SELECT instrument, fast AS value, round(avg(score), 4) AS mean_score, count(score) AS points FROM sens GROUP BY ALL")
def marginal_effect(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(validate.marginal(_scored(spark, sf), BY, "fast"), [], 4)


@query(f"WITH {_GRID} SELECT instrument, slow, {', '.join(f'round(max(CASE WHEN fast = {f} THEN score END), 4) AS fast_{f}' for f in FAST)} FROM sens GROUP BY ALL")
def heatmap_pivot(spark: SparkSession, sf: str) -> DataFrame:
    h = validate.heatmap(_scored(spark, sf), BY, "fast", "slow", FAST)
    return rounds(h.withColumnsRenamed({str(f): f"fast_{f}" for f in FAST}), [], 4)


@query(f"WITH {_GRID}, k AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY score DESC, param_id)::INT AS rank FROM sens WHERE score IS NOT NULL) SELECT instrument, param_id, rank, round(score, 4) AS score FROM k WHERE rank <= 3")
def best_points(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(validate.best(_scored(spark, sf), BY, 3).select("instrument", "param_id", "rank", "score"), [], 4)


_LENGTHS, _WIDTHS = (10, 20), (1.0, 1.5, 2.0)
_BANDS = f"""{BARS}, prm AS (SELECT (i * {len(_WIDTHS)} + j)::BIGINT AS param_id, {list(_LENGTHS)}[i + 1] AS n, {list(_WIDTHS)}[j + 1]::DOUBLE AS width FROM range({len(_LENGTHS)}) f(i), range({len(_WIDTHS)}) s(j)),
 mn AS (SELECT instrument, ts, bid_close, ask_close, mid, row_number() OVER (PARTITION BY instrument ORDER BY ts) AS rn, {', '.join(f'avg(mid) OVER (PARTITION BY instrument ORDER BY ts ROWS {p - 1} PRECEDING) AS m{p}, stddev_pop(mid) OVER (PARTITION BY instrument ORDER BY ts ROWS {p - 1} PRECEDING) AS s{p}' for p in _LENGTHS)} FROM bars),
 bd AS (SELECT instrument, param_id, ts, bid_close, ask_close, mid, width, CASE WHEN rn >= n THEN CASE n {' '.join(f'WHEN {p} THEN m{p}' for p in _LENGTHS)} END END AS m, CASE n {' '.join(f'WHEN {p} THEN s{p}' for p in _LENGTHS)} END AS sd FROM mn, prm),
 zn AS (SELECT *, CASE WHEN m IS NOT NULL THEN CASE WHEN mid < m - width * sd THEN 'below' WHEN mid > m + width * sd THEN 'above' ELSE 'inside' END END AS zone FROM bd),
 sig AS (SELECT *, CASE WHEN lag(zone) OVER w = 'below' AND zone <> 'below' THEN 'BUY' WHEN lag(zone) OVER w = 'above' AND zone <> 'above' THEN 'SELL' END AS signal FROM zn WINDOW w AS (PARTITION BY instrument, param_id ORDER BY ts)),
 {trades_sql('instrument, param_id')}, sc AS (SELECT instrument, param_id, count(*) AS trades, sum(pnl) / 100 AS score FROM tr GROUP BY ALL)"""


@query(f"WITH {_BANDS} SELECT i.instrument, prm.param_id, n, width, coalesce(trades, 0) AS trades, round(coalesce(score, 0), 4) AS score FROM (SELECT DISTINCT instrument FROM bars) i CROSS JOIN prm LEFT JOIN sc ON sc.instrument = i.instrument AND sc.param_id = prm.param_id")
def grid_sensitivity_bollinger(spark: SparkSession, sf: str) -> DataFrame:
    """A grid of a strategy given as a function: every combination of its parameters."""
    s = validate.strategy_grid(bars(spark, sf), BY, signals.bollinger_reversal, n=_LENGTHS, width=_WIDTHS)
    out = validate.sensitivity(s, validate.grid(spark, n=_LENGTHS, width=_WIDTHS), BY, COSTS)
    return rounds(out.select("instrument", "param_id", "n", "width", "trades", "score"), ["width"], 4)


def _rsi_of(n: int) -> str:
    return f"""{_smooth_sql(f'u{n}', 'ups', n, f'(1.0::DOUBLE / {n})')}, {_smooth_sql(f'd{n}', 'downs', n, f'(1.0::DOUBLE / {n})')},
 r{n} AS (SELECT instrument, rn + 1 AS rn, CASE WHEN d.s = 0 THEN 100 ELSE 100 - 100 / (1 + u.s / d.s) END AS rsi FROM u{n} u JOIN d{n} d USING (instrument, rn))"""


_RSI_N, _RSI_LOW = (7, 14), (40.0, 45.0)
_RSI_GRID = f"""{BARS}, {_RN}, chg AS (SELECT instrument, rn - 1 AS rn, mid - lag(mid) OVER (PARTITION BY instrument ORDER BY rn) AS d FROM num), ups AS (SELECT instrument, rn, greatest(d, 0) AS x FROM chg WHERE rn > 0), downs AS (SELECT instrument, rn, greatest(-d, 0) AS x FROM chg WHERE rn > 0),
 {', '.join(map(_rsi_of, _RSI_N))}, prm AS (SELECT (i * {len(_RSI_LOW)} + j)::BIGINT AS param_id, {list(_RSI_N)}[i + 1] AS n, {list(_RSI_LOW)}[j + 1]::DOUBLE AS low FROM range({len(_RSI_N)}) f(i), range({len(_RSI_LOW)}) s(j)),
 rsis AS ({' UNION ALL '.join(f'SELECT b.instrument, b.ts, bid_close, ask_close, {n} AS n, rsi FROM bars b JOIN num USING (instrument, ts) LEFT JOIN r{n} USING (instrument, rn)' for n in _RSI_N)}),
 sig AS (SELECT instrument, param_id, ts, bid_close, ask_close, CASE WHEN lag(rsi) OVER w <= low AND rsi > low THEN 'BUY' WHEN lag(rsi) OVER w >= 70 AND rsi < 70 THEN 'SELL' END AS signal FROM rsis JOIN prm USING (n) WINDOW w AS (PARTITION BY instrument, param_id ORDER BY ts)),
 {trades_sql('instrument, param_id')}, sc AS (SELECT instrument, param_id, count(*) AS trades, sum(pnl) / 100 AS score FROM tr GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_RSI_GRID} SELECT i.instrument, prm.param_id, n, low, coalesce(trades, 0) AS trades, round(coalesce(score, 0), 4) AS score FROM (SELECT DISTINCT instrument FROM bars) i CROSS JOIN prm LEFT JOIN sc ON sc.instrument = i.instrument AND sc.param_id = prm.param_id")
def grid_sensitivity_rsi(spark: SparkSession, sf: str) -> DataFrame:
    s = validate.strategy_grid(bars(spark, sf), BY, signals.rsi_reversal, n=_RSI_N, low=_RSI_LOW)
    out = validate.sensitivity(s, validate.grid(spark, n=_RSI_N, low=_RSI_LOW), BY, COSTS)
    return rounds(out.select("instrument", "param_id", "n", "low", "trades", "score"), ["low"], 4)


_WF_IN, _WF_OUT = 60, 30


@query(f"""WITH {BARS}, ib AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY instrument) AS n FROM bars),
 wb AS (SELECT ib.*, k AS win, i - k * {_WF_OUT} >= {_WF_IN} AS oos FROM ib JOIN range(1000000) r(k) ON i >= k * {_WF_OUT} AND i < k * {_WF_OUT} + {_WF_IN + _WF_OUT} AND k * {_WF_OUT} + {_WF_IN + _WF_OUT} <= n),
 prm AS (SELECT (i * {len(SLOW)} + j)::BIGINT AS param_id, {list(FAST)}[i + 1] AS fast, {list(SLOW)}[j + 1] AS slow FROM range({len(FAST)}) f(i), range({len(SLOW)}) s(j)),
 mn AS (SELECT *, row_number() OVER (PARTITION BY instrument, win ORDER BY ts) AS rn, {', '.join(f'avg(mid) OVER (PARTITION BY instrument, win ORDER BY ts ROWS {p - 1} PRECEDING) AS m{p}' for p in sorted({*FAST, *SLOW}))} FROM wb),
 ab AS (SELECT instrument, win, param_id, fast, slow, ts, oos, bid_close, ask_close, CASE WHEN rn >= slow THEN (CASE fast {' '.join(f'WHEN {p} THEN m{p}' for p in FAST)} END) > (CASE slow {' '.join(f'WHEN {p} THEN m{p}' for p in SLOW)} END) END AS above FROM mn, prm WHERE fast < slow),
 sig AS (SELECT *, CASE WHEN above AND NOT lag(above) OVER w THEN 'BUY' WHEN NOT above AND lag(above) OVER w THEN 'SELL' END AS signal FROM ab WINDOW w AS (PARTITION BY instrument, win, param_id ORDER BY ts)),
 {trades_sql('instrument, win, param_id')}, bg AS (SELECT instrument, win, min(ts) AS b FROM wb WHERE oos GROUP BY ALL),
 isc AS (SELECT instrument, win, param_id, (arg_max(equity, ts) / 10000 - 1) * 100 AS score FROM eq JOIN bg USING (instrument, win) WHERE ts < b GROUP BY ALL),
 pick AS (SELECT *, row_number() OVER (PARTITION BY instrument, win ORDER BY round(score, 9) DESC, param_id) AS rk FROM isc),
 oo AS (SELECT instrument, win, param_id, sum(pnl) / 100 AS o FROM tr JOIN bg USING (instrument, win) WHERE exit_ts >= b GROUP BY ALL),
 f AS (SELECT p.instrument, p.win, p.param_id, fast, slow, score, coalesce(o, 0) AS o FROM pick p JOIN prm USING (param_id) LEFT JOIN oo ON oo.instrument = p.instrument AND oo.win = p.win AND oo.param_id = p.param_id WHERE rk = 1)
 SELECT instrument, win AS "window", param_id, fast, slow, round(score, 4) AS score, round(o, 4) AS oos_return_pct, round(10000 * exp(sum(ln(greatest(1 + o / 100, 1e-12))) OVER (PARTITION BY instrument ORDER BY win)), 2) AS balance FROM f""")
def walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    w = validate.walk_forward(bars(spark, sf), BY, _sma, validate.grid(spark, fast=FAST, slow=SLOW), _WF_IN, _WF_OUT, costs=COSTS)
    return rounds(w.withColumn("balance", r("balance", 2)), [], 4)


@query(f"""WITH {BARS}, ib AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY instrument) AS n FROM bars),
 wb AS (SELECT ib.*, k AS win, i - k * {_WF_OUT} >= {_WF_IN} AS oos FROM ib JOIN range(1000000) r(k) ON i >= k * {_WF_OUT} AND i < k * {_WF_OUT} + {_WF_IN + _WF_OUT} AND k * {_WF_OUT} + {_WF_IN + _WF_OUT} <= ib.n),
 prm AS (SELECT j::BIGINT AS param_id, 10 AS n, {list(_WIDTHS)}[j + 1]::DOUBLE AS width FROM range({len(_WIDTHS)}) s(j)),
 mn AS (SELECT instrument, win, ts, oos, bid_close, ask_close, mid, row_number() OVER w AS rn, avg(mid) OVER (w ROWS 9 PRECEDING) AS m, stddev_pop(mid) OVER (w ROWS 9 PRECEDING) AS sd FROM wb WINDOW w AS (PARTITION BY instrument, win ORDER BY ts)),
 zn AS (SELECT *, CASE WHEN rn >= 10 THEN CASE WHEN mid < m - width * sd THEN 'below' WHEN mid > m + width * sd THEN 'above' ELSE 'inside' END END AS zone FROM mn, prm),
 sig AS (SELECT *, CASE WHEN lag(zone) OVER w = 'below' AND zone <> 'below' THEN 'BUY' WHEN lag(zone) OVER w = 'above' AND zone <> 'above' THEN 'SELL' END AS signal FROM zn WINDOW w AS (PARTITION BY instrument, win, param_id ORDER BY ts)),
 {trades_sql('instrument, win, param_id')}, bg AS (SELECT instrument, win, min(ts) AS b FROM wb WHERE oos GROUP BY ALL),
 isc AS (SELECT instrument, win, param_id, (arg_max(equity, ts) / 10000 - 1) * 100 AS score FROM eq JOIN bg USING (instrument, win) WHERE ts < b GROUP BY ALL),
 pick AS (SELECT *, row_number() OVER (PARTITION BY instrument, win ORDER BY round(score, 9) DESC, param_id) AS rk FROM isc),
 oo AS (SELECT instrument, win, param_id, sum(pnl) / 100 AS o FROM tr JOIN bg USING (instrument, win) WHERE exit_ts >= b GROUP BY ALL),
 f AS (SELECT p.instrument, p.win, p.param_id, n, width, score, coalesce(o, 0) AS o FROM pick p JOIN prm USING (param_id) LEFT JOIN oo ON oo.instrument = p.instrument AND oo.win = p.win AND oo.param_id = p.param_id WHERE rk = 1)
 SELECT instrument, win AS "window", param_id, n, width, round(score, 4) AS score, round(o, 4) AS oos_return_pct, round(10000 * exp(sum(ln(greatest(1 + o / 100, 1e-12))) OVER (PARTITION BY instrument ORDER BY win)), 2) AS balance FROM f""")
def walk_forward_bollinger(spark: SparkSession, sf: str) -> DataFrame:
    def of(b: DataFrame, key: list[str]) -> DataFrame:
        return validate.strategy_grid(b, key, signals.bollinger_reversal, n=(10,), width=_WIDTHS)

    w = validate.walk_forward(bars(spark, sf), BY, of, validate.grid(spark, n=(10,), width=_WIDTHS), _WF_IN, _WF_OUT, costs=COSTS)
    return rounds(w.withColumn("balance", r("balance", 2)), ["width"], 4)


#: Samples of bootstrap_ci, the operators' default; orders of shuffle_drawdown and samples of bootstrap_metrics are fewer.
_SAMPLES, _SHUFFLES = 5_000, 200
_DAILY = f"{TRADES}, dt AS (SELECT grp, l_shipdate AS ts, sum(pnl) / 1000 AS pnl FROM trades GROUP BY ALL)"
_DRAW = "('0x' || substr(md5({}), 1, 12))::BIGINT"
_BOOT = f"""{_DAILY}, ix AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts) - 1 AS ix, count(*) OVER (PARTITION BY grp) AS n FROM dt), g AS (SELECT grp, max(n) AS n FROM ix GROUP BY 1),
 d AS (SELECT grp, iter, k, {_DRAW.format("concat_ws('|', '42', iter::VARCHAR, k::VARCHAR)")} % n AS ix FROM (SELECT grp, iter, n, unnest(range(n)) AS k FROM g, range({_SAMPLES}) i(iter))),
 bm AS (SELECT d.grp, iter, sum(pnl) / 100 AS total_return_pct FROM d JOIN ix ON ix.grp = d.grp AND ix.ix = d.ix GROUP BY ALL)"""


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return trades(spark, sf).groupBy("grp", F.col("l_shipdate").alias("ts")).agg((F.sum("pnl") / 1000).alias("pnl"))


@query(f"""WITH {_BOOT} SELECT grp, round(quantile_cont(total_return_pct, 0.05), 4) AS low, round(quantile_cont(total_return_pct, 0.95), 4) AS high, round(quantile_cont(total_return_pct, 0.5), 4) AS median, round(avg(total_return_pct), 4) AS mean,
 round(stddev_pop(total_return_pct), 4) AS sd, round(count(*) FILTER (total_return_pct < 0) * 100.0::DOUBLE / count(*), 4) AS below_zero FROM bm GROUP BY 1""")
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Returns of samples of as many daily results as there are."""
    s = resample.resample(_daily(spark, sf), ["grp"], ["ts"], _SAMPLES)
    return rounds(resample.summary(resample.returns(s, ["grp"]), ["grp"], "total_return_pct"), [], 4)


@query(f"""WITH {_DAILY}, ix AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts) - 1 AS ix FROM dt), sh AS (SELECT grp, iter, pnl, row_number() OVER (PARTITION BY grp, iter ORDER BY {_DRAW.format("concat_ws('|', '42', iter::VARCHAR, ix::VARCHAR)")}, ix) AS k FROM ix, range({_SHUFFLES}) i(iter)),
 cv AS (SELECT *, 1e6 + sum(pnl) OVER (PARTITION BY grp, iter ORDER BY k ROWS UNBOUNDED PRECEDING) AS e FROM sh), pk AS (SELECT *, greatest(1e6, max(e) OVER (PARTITION BY grp, iter ORDER BY k ROWS UNBOUNDED PRECEDING)) AS p FROM cv)
 SELECT grp, iter::INT AS iter, round(sum(pnl) / 1e6 * 100, 6) AS total_return_pct, round(max((p - e) / p * 100), 6) AS max_drawdown_pct FROM pk GROUP BY ALL""")
def shuffle_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    s = resample.shuffle(_daily(spark, sf), ["grp"], ["ts"], _SHUFFLES)
    return rounds(resample.sampled_metrics(s, ["grp"], 1e6).select("grp", "iter", "total_return_pct", "max_drawdown_pct"), [])


@query()
def bootstrap_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """All tracked metrics of daily results by group: observed, their rank among samples, and the interval."""
    t = trades(spark, sf).groupBy("grp", F.col("l_shipdate").alias("ts")).agg((F.sum("pnl") / 1000).alias("pnl"), (F.sum("commission") / 1000).alias("commission"), F.min("entry_ts").alias("entry_ts"), F.max("exit_ts").alias("exit_ts"))
    return rounds(resample.bootstrap(t, ["grp"], ["ts"], iterations=_SHUFFLES), [], 4)


@query(f"""WITH {_RET}, b AS (SELECT instrument, ts::DATE AS day, sum(ret) AS s, count(ret) AS c FROM ret GROUP BY ALL), ix AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY day) - 1 AS ix, count(*) OVER (PARTITION BY instrument) AS n FROM b),
 g AS (SELECT instrument, max(n) AS n FROM ix GROUP BY 1), d AS (SELECT instrument, iter, {_DRAW.format("concat_ws('|', '7', iter::VARCHAR, k::VARCHAR)")} % n AS ix FROM g, range(1000) i(iter), range(10000) r(k) WHERE k < n),
 m AS (SELECT instrument, iter, sum(s) / sum(c) AS mean FROM d JOIN ix USING (instrument, ix) GROUP BY ALL), l AS (SELECT instrument, list_sort(list(mean)) AS v FROM m GROUP BY 1)
 SELECT instrument, round(v[floor((1 - 0.9::DOUBLE) / 2 * (len(v) - 1))::INT + 1], 6) AS low, round(v[floor((1 - (1 - 0.9::DOUBLE) / 2) * (len(v) - 1))::INT + 1], 6) AS high FROM l""")
def day_block_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    s = _ret(spark, sf).withColumn("day", F.col("ts").cast("date"))
    return rounds(resample.truncated_interval(resample.block_bootstrap(s, BY, "day", "ret", 1_000), BY, "mean"), [])


@query(f"""WITH {BARS}, k AS (SELECT instrument, ts, volume, row_number() OVER (PARTITION BY instrument ORDER BY {_DRAW.format("concat_ws('|', '11', strftime(ts, '%Y-%m-%d %H:%M:%S'))")}, ts) AS rk FROM bars) SELECT instrument, ts, volume FROM k WHERE rk <= 20""")
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty bars of each series."""
    b = bars(spark, sf).withColumn("stamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return resample.per_key(b, BY, ["stamp"], 20).select("instrument", "ts", "volume")


@query(f"""WITH {BARS}, v AS (SELECT instrument, ts, 'v' || k AS venue, k AS venue_order, bid_close * (1 - k * 0.0001::DOUBLE) AS bid, CASE WHEN k <> 2 OR volume > 3 THEN ask_close * (1 + (volume % 3 - 1) * k * 0.0001::DOUBLE) END AS ask FROM bars, range(3) r(k)),
 w AS (SELECT *, row_number() OVER (PARTITION BY instrument, ts ORDER BY ask, venue_order) AS rk FROM v WHERE ask IS NOT NULL) SELECT instrument, ts, venue, round(bid, 10) AS bid, round(ask, 10) AS ask FROM w WHERE rk = 1""")
def best_quote_route(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).withColumn("venue_order", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    k, half = F.col("venue_order"), F.lit(0.0001)
    ask = F.when((k != 2) | (F.col("volume") > 3), F.col("ask_close") * (1 + (F.col("volume") % 3 - 1) * k * half))
    v = b.select("instrument", "ts", F.concat(F.lit("v"), k).alias("venue"), "venue_order", (F.col("bid_close") * (1 - k * half)).alias("bid"), ask.alias("ask"))
    return rounds(candles.best_quotes(v, ["instrument", "ts"]), [], 10)


#: Service tiers (0 to 2) of the metrics that the query shows.
_VISIBLE = "('total_return_pct', 0), ('total_trades', 0), ('win_rate_pct', 0), ('profit_factor', 0), ('avg_win', 0), ('avg_loss', 0), ('total_commission_paid', 0), ('trade_expectancy', 1), ('payoff_ratio', 1), ('kelly_fraction', 2), ('tail_ratio', 2)"


@query(f"""WITH {TRADES}, m0 AS (SELECT grp, count(*)::DOUBLE AS total_trades, sum(pnl) / 100 AS total_return_pct, count(*) FILTER (pnl > 0)::DOUBLE / count(*) AS wr, sum(pnl) FILTER (pnl > 0) / abs(sum(pnl) FILTER (pnl <= 0)) AS profit_factor, avg(pnl) FILTER (pnl > 0) AS avg_win, avg(pnl) FILTER (pnl <= 0) AS avg_loss,
 sum(commission) AS total_commission_paid, avg(pnl) AS trade_expectancy, avg(pnl) / stddev_samp(pnl) * sqrt(count(*)) AS t_stat, abs(quantile_cont(pnl, 0.95)) / abs(quantile_cont(pnl, 0.05)) AS tail_ratio FROM trades GROUP BY 1),
 m AS (SELECT grp, total_trades, total_return_pct, wr * 100 AS win_rate_pct, profit_factor, avg_win, avg_loss, total_commission_paid, trade_expectancy, avg_win / abs(avg_loss) AS payoff_ratio, wr - (1 - wr) / (avg_win / abs(avg_loss)) AS kelly_fraction, tail_ratio, t_stat FROM m0),
 l AS (UNPIVOT m ON COLUMNS(* EXCLUDE grp) INTO NAME metric VALUE value), t(metric, need) AS (VALUES {_VISIBLE}), s(tier, have) AS (VALUES ('BRONZE', 0), ('SILVER', 1), ('GOLD', 2))
 SELECT tier, grp, metric, round(value, 4) AS value FROM l LEFT JOIN t USING (metric) JOIN s ON coalesce(need, 2) <= have""")
def tier_visibility(spark: SparkSession, sf: str) -> DataFrame:
    """What each tier shows; t_stat has no tier of its own, and so shows from GOLD on."""
    m = metrics.trade_metrics(trades(spark, sf), ["grp"])
    m = m.select("grp", "total_trades", "total_return_pct", "win_rate_pct", "profit_factor", "avg_win", "avg_loss", F.col("total_commission").alias("total_commission_paid"), F.col("expectancy").alias("trade_expectancy"), "payoff_ratio", "kelly_fraction", "tail_ratio", "t_stat")
    return rounds(validate.visible_by_tier(m, ["grp"]), [], 4)


#: Two strategies as two values of a key beside the instrument.
_TWO = f"""{BARS}, mn AS (SELECT instrument, ts, bid_close, ask_close, mid, row_number() OVER w AS rn, avg(mid) OVER (w ROWS 2 PRECEDING) AS f, avg(mid) OVER (w ROWS 9 PRECEDING) AS s, stddev_pop(mid) OVER (w ROWS 9 PRECEDING) AS sd FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY ts)),
 st AS (SELECT *, CASE WHEN rn >= 10 THEN f > s END AS above, CASE WHEN rn >= 10 THEN CASE WHEN mid < s - sd THEN 'below' WHEN mid > s + sd THEN 'above' ELSE 'inside' END END AS zone FROM mn),
 sig AS (SELECT instrument, 'sma' AS strategy, ts, bid_close, ask_close, CASE WHEN above AND NOT lag(above) OVER w THEN 'BUY' WHEN NOT above AND lag(above) OVER w THEN 'SELL' END AS signal FROM st WINDOW w AS (PARTITION BY instrument ORDER BY ts)
  UNION ALL SELECT instrument, 'bollinger', ts, bid_close, ask_close, CASE WHEN lag(zone) OVER w = 'below' AND zone <> 'below' THEN 'BUY' WHEN lag(zone) OVER w = 'above' AND zone <> 'above' THEN 'SELL' END FROM st WINDOW w AS (PARTITION BY instrument ORDER BY ts)),
 {trades_sql('instrument, strategy')}"""


def _two(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf)
    keep = [*BY, "strategy", "ts", "bid_close", "ask_close", "signal"]
    one = signals.sma_cross(b, 3, 10, BY).withColumn("strategy", F.lit("sma")).select(keep)
    return one.unionByName(signals.bollinger_reversal(b, BY, 10, 1.0).withColumn("strategy", F.lit("bollinger")).select(keep))


@query(f"""WITH {_TWO}, rt AS (SELECT instrument, strategy, ts, equity / nullif(lag(equity) OVER (PARTITION BY instrument, strategy ORDER BY ts), 0) - 1 AS ret FROM eq)
 SELECT x.instrument, count(*) AS n, round(coalesce(covar_pop(x.ret, y.ret) / nullif(sqrt(var_pop(x.ret) * var_pop(y.ret)), 0), 0), 6) AS corr FROM rt x JOIN rt y ON x.instrument = y.instrument AND x.ts = y.ts AND x.strategy = 'bollinger' AND y.strategy = 'sma' WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1""")
def strategy_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """How the returns of two strategies on the same bars go together."""
    key = [*BY, "strategy"]
    e = indicators.simple_return(backtest.equity_curve(_two(spark, sf), key, COSTS), key, "equity").where("ret IS NOT NULL").select(*key, "ts", "ret")
    x = e.where("strategy = 'bollinger'").select(*BY, "ts", F.col("ret").alias("x")).join(e.where("strategy = 'sma'").select(*BY, "ts", F.col("ret").alias("y")), [*BY, "ts"])
    return rounds(x.groupBy(*BY).agg(F.count(F.lit(1)).alias("n"), correlate.pearson("x", "y").alias("corr")), [])


_LOG = """lg AS (SELECT CASE WHEN event_id % 97 = 0 THEN 'end' WHEN event_type = 'signup' THEN 'start' ELSE 'item' END AS record_type, user_id::VARCHAR AS run_id, event_id // 2 AS seq, ts, value AS seconds, event_type AS status, event_id FROM events),
 lo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, seq ORDER BY event_id) AS k FROM lg) WHERE k = 1)"""


@query(f"""WITH {_LOG} SELECT run_id, min(ts) FILTER (record_type = 'start') AS started, max(ts) FILTER (record_type = 'end') AS ended, coalesce(max(status) FILTER (record_type = 'end'), 'unfinished') AS status, count(*) FILTER (record_type = 'item') AS items,
 round(sum(seconds) FILTER (record_type = 'item'), 4) AS total_s, min(seconds) FILTER (record_type = 'item') AS least_s, max(seconds) FILTER (record_type = 'item') AS most_s FROM lo GROUP BY 1""")
def runlog_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Events as records of runs; of a repeated (run_id, seq) the first counts."""
    from ..sources.views import table

    e = table(spark, sf, "events")
    kind = F.when(F.col("event_id") % 97 == 0, "end").when(F.col("event_type") == "signup", "start").otherwise("item")
    log = e.select(kind.alias("record_type"), F.col("user_id").cast("string").alias("run_id"), F.expr("event_id div 2").alias("seq"), "ts", F.col("value").alias("seconds"), F.col("event_type").alias("status"), "event_id")
    first = log.groupBy("run_id", "seq").agg(F.min_by(F.struct("record_type", "ts", "seconds", "status"), "event_id").alias("x")).select("run_id", "seq", "x.*")
    m = audit.merge_log(first)
    return m.withColumn("total_s", r("total_s", 4))


@query("""WITH g AS (SELECT o_orderpriority || '/' || o_orderstatus AS k, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1), f AS (SELECT o_orderpriority || '/' || o_orderstatus AS k, count(*) AS n, avg(o_totalprice) AS m FROM orders WHERE o_orderkey % 501 <> 7 AND NOT (o_orderpriority LIKE '5%' AND o_orderstatus = 'P') GROUP BY 1),
 j AS (SELECT k || '_count' AS path, g.n::DOUBLE AS a, f.n::DOUBLE AS b, 2.0 AS slack FROM g LEFT JOIN f USING (k) UNION ALL SELECT k || '_mean', round(g.m, 4), round(f.m, 4), 0.0001 FROM g LEFT JOIN f USING (k))
 SELECT path, CASE WHEN b IS NULL THEN 'FAIL' WHEN abs(a - b) <= slack + 1e-9 THEN 'FLIP' ELSE 'FAIL' END AS kind FROM j WHERE b IS NULL OR abs(a - b) > 1e-9 * greatest(1, abs(a))""")
def report_compare(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.views import table

    def report(o: DataFrame) -> DataFrame:
        g = o.groupBy(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("_count"), r(F.avg("o_totalprice"), 4).alias("_mean"))
        return g.unpivot(["k"], ["_count", "_mean"], "what", "number").select(F.concat("k", "what").alias("path"), "number", F.lit(None).cast("string").alias("text"))

    o = table(spark, sf, "orders")
    fewer = o.where("o_orderkey % 501 <> 7 AND NOT (o_orderpriority LIKE '5%' AND o_orderstatus = 'P')")
    return audit.compare_reports(report(o), report(fewer)).select("path", "kind")


@query(f"""WITH {BARS}, hrs AS (SELECT DISTINCT ts FROM bars), ins AS (SELECT DISTINCT instrument FROM bars), miss AS (SELECT instrument, ts FROM (SELECT * FROM ins CROSS JOIN hrs) ANTI JOIN bars USING (instrument, ts)), h AS (SELECT ts, count(*) AS instruments FROM miss GROUP BY 1) SELECT instruments, count(*) AS hours FROM h GROUP BY 1""")
def venue_gaps(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).select("instrument", "ts")
    miss = b.select("ts").distinct().crossJoin(F.broadcast(b.select("instrument").distinct())).join(b, ["instrument", "ts"], "left_anti")
    return audit.venue_gaps(miss)


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN -l_quantity / 2 ELSE l_quantity END AS units, l_extendedprice / l_quantity AS price, l_extendedprice * 0.001::DOUBLE AS fee FROM lineitem),
 o AS (SELECT l_orderkey, count(*) AS fills, sum(abs(units)) AS turnover, sum(fee) AS commission FROM f GROUP BY 1) SELECT l_orderkey, fills, round(turnover, 4) AS turnover, round(commission, 8) AS commission FROM o""")
def fills_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Fills of an order, folded in their order; units and commission of each."""
    from ..sources.views import table

    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_linenumber") % 2 == 0, -F.col("l_quantity") / 2).otherwise(F.col("l_quantity")).alias("units"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.col("l_extendedprice") * 0.001).alias("commission"))
    g = x.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "units", "price", "commission"))).alias("f"))
    turnover = F.aggregate("f", F.lit(0.0), lambda a, f: a + F.abs(f["units"]))
    paid = backtest.replay_fills(F.col("f"), F.lit(1))["commission"]
    return g.select("l_orderkey", F.size("f").cast("long").alias("fills"), r(turnover, 4).alias("turnover"), r(paid, 8).alias("commission"))
