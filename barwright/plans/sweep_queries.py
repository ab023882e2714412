"""Queries of the validation hierarchy, the full sweep and the replay of frozen candidates out of their time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest, orchestrate, signals, validate
from ..sources.views import BARS, bars, ntz, table
from .candle_queries import trades_sql

QUERIES: dict = {}
ORACLES: dict = {}
BY = ["instrument"]
COSTS = backtest.Costs(commission_flat=0.1, slippage_pips=0.5, commission_pct=0.00001, slippage_pct=0.000005)
NOTIONAL, IN, OUT, DRAWS = 400.0, 60, 30, 300
FAST, SLOW, LENGTH, WIDTHS = (3, 5), (8, 12, 20), 10, (0.5, 1.0, 1.5, 2.0)
_DRAW = "('0x' || substr(md5({}), 1, 12))::BIGINT"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def plain(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c, kind in df.dtypes if kind == "double"})


def _sma_sql(by: str, source: str) -> str:
    """CTEs prm and sig (by, param_id, ts, bid_close, ask_close, units, signal) of the crossover on a source with mid."""
    w = f"PARTITION BY {by} ORDER BY ts"
    pick = lambda axis, values: f"CASE {axis} {' '.join(f'WHEN {p} THEN m{p}' for p in values)} END"
    return f"""prm AS (SELECT (i * {len(SLOW)} + j)::BIGINT AS param_id, {list(FAST)}[i + 1] AS fast, i AS x, {list(SLOW)}[j + 1] AS slow, j AS y FROM range({len(FAST)}) f(i), range({len(SLOW)}) s(j)),
 mn AS (SELECT *, row_number() OVER ({w}) AS rn, {', '.join(f'avg(mid) OVER ({w} ROWS {p - 1} PRECEDING) AS m{p}' for p in sorted({*FAST, *SLOW}))} FROM {source}),
 ab AS (SELECT {by}, param_id, ts, bid_close, ask_close, units, CASE WHEN rn >= slow THEN ({pick('fast', FAST)}) > ({pick('slow', SLOW)}) END AS above FROM mn, prm WHERE fast < slow),
 sig AS (SELECT *, CASE WHEN above AND NOT lag(above) OVER w THEN 'BUY' WHEN NOT above AND lag(above) OVER w THEN 'SELL' END AS signal FROM ab WINDOW w AS (PARTITION BY {by}, param_id ORDER BY ts))"""


def _bands_sql(by: str, source: str) -> str:
    w = f"PARTITION BY {by} ORDER BY ts"
    return f"""prm AS (SELECT j::BIGINT AS param_id, 0 AS x, {list(WIDTHS)}[j + 1]::DOUBLE AS width, j AS y FROM range({len(WIDTHS)}) s(j)),
 mn AS (SELECT *, row_number() OVER ({w}) AS rn, avg(mid) OVER ({w} ROWS {LENGTH - 1} PRECEDING) AS m, stddev_pop(mid) OVER ({w} ROWS {LENGTH - 1} PRECEDING) AS sd FROM {source}),
 zn AS (SELECT {by}, param_id, ts, bid_close, ask_close, units, CASE WHEN rn >= {LENGTH} THEN CASE WHEN mid < m - width * sd THEN 'below' WHEN mid > m + width * sd THEN 'above' ELSE 'inside' END END AS zone FROM mn, prm),
 sig AS (SELECT *, CASE WHEN lag(zone) OVER w = 'below' AND zone <> 'below' THEN 'BUY' WHEN lag(zone) OVER w = 'above' AND zone <> 'above' THEN 'SELL' END AS signal FROM zn WINDOW w AS (PARTITION BY {by}, param_id ORDER BY ts))"""


_SIGNALS = {"sma": _sma_sql, "bands": _bands_sql}
_SIZED = f"""{BARS}, wv AS (SELECT instrument, ts, 100 + 10 * sin(epoch(ts) / 3600 / (4 + length(instrument))) + 0.01 * mid AS mid FROM bars), sz AS (SELECT instrument, {NOTIONAL}::DOUBLE / arg_min(mid, ts) AS units FROM wv GROUP BY 1),
 ub AS (SELECT wv.*, mid * 0.9999::DOUBLE AS bid_close, mid * 1.0001::DOUBLE AS ask_close, units, row_number() OVER (PARTITION BY instrument ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY instrument) AS k FROM wv JOIN sz USING (instrument)),
 wb AS (SELECT ub.*, r.w AS win, i - r.w * {OUT} >= {IN} AS oos FROM ub JOIN range(1000000) r(w) ON i >= r.w * {OUT} AND i < r.w * {OUT} + {IN + OUT} AND r.w * {OUT} + {IN + OUT} <= k), bg AS (SELECT instrument, win, min(ts) AS b FROM wb WHERE oos GROUP BY ALL)"""


def _boot_sql(name: str, trades: str, key: str, iterations: int) -> str:
    """CTE name: key, low, prob_loss by resampling the trades of each key with two or more."""
    return f"""{name} AS (WITH ix AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY entry_ts) - 1 AS ix, count(*) OVER (PARTITION BY {key}) AS n FROM {trades}), g AS (SELECT DISTINCT {key}, n FROM ix WHERE n >= 2),
 d AS (SELECT {key}, iter, {_DRAW.format("concat_ws('|', '42', iter::VARCHAR, j::VARCHAR)")} % n AS ix FROM (SELECT *, unnest(range(n)) AS j FROM g, range({iterations}) r(iter))),
 s AS (SELECT {key}, iter, sum(pnl) / 100 AS r FROM d JOIN ix USING ({key}, ix) GROUP BY ALL) SELECT {key}, quantile_cont(r, 0.05) AS low, count(*) FILTER (r < 0) * 100.0::DOUBLE / count(*) AS prob_loss FROM s GROUP BY ALL)"""


def _tiers_sql(name: str) -> str:
    """CTE name: instrument, param_id, score, return_pct, low, prob_loss, tier of a strategy's grid."""
    sig, key = _SIGNALS[name], "instrument, param_id"
    return f"""{name}_t AS (WITH {sig('instrument', 'ub')}, {trades_sql(key, COSTS, 'units')} SELECT * FROM tr), {name}_e AS (WITH {sig('instrument', 'ub')}, {trades_sql(key, COSTS, 'units')} SELECT * FROM eq),
 {name}_s AS (WITH {sig('instrument', 'ub')}, k AS (SELECT DISTINCT instrument, param_id, x, y FROM sig JOIN prm USING (param_id)), m AS (SELECT {key}, sum(pnl) / 100 AS r FROM {name}_t GROUP BY ALL) SELECT k.*, coalesce(r, 0) AS score FROM k LEFT JOIN m USING ({key})),
 {name}_g AS (SELECT a.instrument, a.param_id, a.score - avg(b.score) AS gap FROM {name}_s a JOIN {name}_s b ON a.instrument = b.instrument AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY a.instrument, a.param_id, a.score),
 {name}_1 AS (WITH m AS (SELECT {key}, count(*) AS n, sum(pnl) / 100 AS r, sum(pnl) FILTER (pnl > 0) / nullif(abs(sum(pnl) FILTER (pnl <= 0)), 0) AS pf FROM {name}_t GROUP BY ALL), p AS (SELECT *, max(equity) OVER (PARTITION BY {key} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS top FROM {name}_e),
  d AS (SELECT {key}, max(CASE WHEN top > 0 THEN (top - equity) / top * 100 ELSE 0 END) AS dd FROM p GROUP BY ALL) SELECT {key}, n >= 20 AND r > 0 AND coalesce(pf > 1, true) AND dd < 20 AS passed, r FROM m JOIN d USING ({key})),
 {name}_2 AS (SELECT {key} FROM (SELECT *, stddev_pop(score) OVER (PARTITION BY instrument) AS sd, count(score) OVER (PARTITION BY instrument) AS c FROM {name}_s LEFT JOIN {name}_g USING ({key})) JOIN {name}_1 USING ({key}) WHERE passed AND c >= 2 AND gap <= sd),
 {name}_3 AS (WITH {sig('instrument, win', 'wb')}, {trades_sql('instrument, win, param_id', COSTS, 'units')}, isc AS (SELECT instrument, win, param_id, (arg_max(equity, ts) / 10000 - 1) * 100 AS score FROM eq JOIN bg USING (instrument, win) SEMI JOIN {name}_2 USING ({key}) WHERE ts < b GROUP BY ALL),
  pick AS (SELECT *, row_number() OVER (PARTITION BY instrument, win ORDER BY round(score, 9) DESC, param_id) AS rk FROM isc), oo AS (SELECT instrument, win, param_id, sum(pnl) / 100 AS o FROM tr JOIN bg USING (instrument, win) WHERE exit_ts >= b GROUP BY ALL),
  f AS (SELECT instrument, win, param_id, coalesce(o, 0) AS o FROM pick LEFT JOIN oo USING (instrument, win, param_id) WHERE rk = 1), ok AS (SELECT instrument FROM f GROUP BY 1 HAVING sum(ln(greatest(1 + o / 100, 1e-12))) > 0) SELECT DISTINCT {key} FROM f SEMI JOIN ok USING (instrument)),
 {name}_f AS (SELECT * FROM {name}_t SEMI JOIN {name}_3 USING ({key})), {_boot_sql(f'{name}_b', f'{name}_f', key, DRAWS)},
 {name} AS (SELECT {key}, score, coalesce(r, 0) AS return_pct, low, prob_loss, (coalesce(passed, false)::INT + (t2.y IS NOT NULL)::INT + (t3.z IS NOT NULL)::INT + (t3.z IS NOT NULL AND coalesce(low > 0 AND prob_loss < 40, false))::INT)::INT AS tier
  FROM {name}_s LEFT JOIN {name}_1 USING ({key}) LEFT JOIN (SELECT *, 1 AS y FROM {name}_2) t2 USING ({key}) LEFT JOIN (SELECT *, 1 AS z FROM {name}_3) t3 USING ({key}) LEFT JOIN {name}_b USING ({key}))"""


def _strategies(spark: SparkSession) -> dict[str, tuple]:
    sma = lambda b, key: validate.sma_grid(b, key, FAST, SLOW)
    bands = lambda b, key: validate.strategy_grid(b, key, signals.bollinger_reversal, n=(LENGTH,), width=WIDTHS)
    return {"sma": (sma, validate.grid(spark, fast=FAST, slow=SLOW), ["fast", "slow"]), "bands": (bands, validate.grid(spark, n=(LENGTH,), width=WIDTHS), ["n", "width"])}


def waves(spark: SparkSession, sf: str) -> DataFrame:
    """The bars with a slow wave in place of most of the price, another one for each series: something a crossover can live on."""
    b = bars(spark, sf).withColumn("m", 100 + 10 * F.sin(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600 / (4 + F.length("instrument"))) + 0.01 * F.col("mid"))
    return b.select("instrument", "ts", F.col("m").alias("mid"), (F.col("m") * 0.9999).alias("bid_close"), (F.col("m") * 1.0001).alias("ask_close"))


@query(f"WITH {_SIZED}, {_tiers_sql('sma')} SELECT instrument, param_id, round(score, 4) AS score, round(return_pct, 4) AS return_pct, round(low, 4) AS low, round(prob_loss, 4) AS prob_loss, tier FROM sma")
def validation_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """The tier of every candidate of a grid, with the bounds of its bootstrap, sized by notional."""
    of, params, axes = _strategies(spark)["sma"]
    return plain(orchestrate.tiers(waves(spark, sf), BY, of, params, axes, IN, OUT, COSTS, iterations=DRAWS, notional=NOTIONAL))


@query(f"""WITH {_SIZED}, {_tiers_sql('sma')}, {_tiers_sql('bands')}, u AS (SELECT 'sma' AS strategy, * FROM sma UNION ALL SELECT 'bands', * FROM bands),
 g AS (SELECT strategy, instrument, count(*) AS grid_size, count(*) FILTER (tier >= 1) AS tier1, count(*) FILTER (tier >= 2) AS tier2, count(*) FILTER (tier >= 3) AS tier3, count(*) FILTER (tier >= 4) AS tier4, max(tier) AS tier, max(low) FILTER (tier >= 3) AS l, max(return_pct) FILTER (tier >= 1) AS r FROM u GROUP BY ALL)
 SELECT strategy, instrument, grid_size, tier1, tier2, tier3, tier4, tier, round(CASE WHEN tier >= 3 THEN l ELSE r END, 4) AS base, round(greatest(coalesce(CASE WHEN tier >= 3 THEN l ELSE r END, 0), 0) * [0.0, 0.25, 0.5, 0.75, 1.0][tier + 1]::DOUBLE, 4) AS weight FROM g""")
def full_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Two strategies on every series: candidates by tier and the weight that the best of them gives."""
    return plain(orchestrate.sweep(waves(spark, sf), BY, _strategies(spark), IN, OUT, COSTS, iterations=DRAWS, notional=NOTIONAL))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Days of orders as bars of their priorities: instrument, ts, mid (mean price in thousands), bid_close, ask_close."""
    g = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("instrument"), ntz(F.date_trunc("day", "o_orderdate")).alias("ts")).agg((F.avg("o_totalprice") / 1000).alias("mid"))
    return g.select("instrument", "ts", "mid", (F.col("mid") * 0.9995).alias("bid_close"), (F.col("mid") * 1.0005).alias("ask_close"))


_DAILY = """dy AS (SELECT o_orderpriority AS instrument, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, avg(o_totalprice) / 1000 AS mid FROM orders GROUP BY ALL), daily AS (SELECT *, mid * 0.9995::DOUBLE AS bid_close, mid * 1.0005::DOUBLE AS ask_close FROM dy)"""
_TRAINING, _MONTHS = (datetime(1994, 1, 1), datetime(1994, 12, 31, 23, 59, 59)), 18
_FIRST, _LAST = (f"TIMESTAMP '{t}'" for t in _TRAINING)
#: Eighteen months from a cursor, step by step; a day that was cut stays cut.
_WINDOWS = f"""cv AS (SELECT instrument, min(ts) AS low, max(ts) AS high FROM daily GROUP BY 1), sd AS (SELECT instrument, 'pre_' AS side, low AS a, least({_FIRST}, high) AS b FROM cv WHERE low < {_FIRST} UNION ALL SELECT instrument, 'post_', greatest({_LAST} + INTERVAL 1 SECOND, low), high FROM cv WHERE high > {_LAST} + INTERVAL 1 SECOND),
 cu AS (SELECT instrument, side, b, 0 AS k, a AS c FROM sd WHERE a < b UNION ALL SELECT instrument, side, b, k + 1, c + INTERVAL {_MONTHS} MONTH FROM cu WHERE c + INTERVAL {_MONTHS} MONTH < b),
 wn AS (SELECT instrument, side || k AS "window", c AS start, least(c + INTERVAL {_MONTHS} MONTH - INTERVAL 1 SECOND, b) AS "end" FROM cu WHERE epoch(least(c + INTERVAL {_MONTHS} MONTH - INTERVAL 1 SECOND, b)) - epoch(c) >= 30 * 86400)"""


@query(f'WITH RECURSIVE {_DAILY}, {_WINDOWS} SELECT instrument, "window", start, "end" FROM wn')
def training_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of eighteen months before and after a training year, from each series' own coverage."""
    return orchestrate.month_windows(daily(spark, sf), BY, _MONTHS, _TRAINING)


_FROZEN = (1.0, 0.2)


def _frozen_sql() -> str:
    w = 'PARTITION BY instrument, "window" ORDER BY ts'
    return f"""ib AS (SELECT d.*, wn."window" FROM daily d JOIN wn ON d.instrument = wn.instrument AND d.ts BETWEEN wn.start AND wn."end"), sz AS (SELECT instrument, "window", {NOTIONAL}::DOUBLE / arg_min(mid, ts) AS units FROM ib GROUP BY ALL),
 mn AS (SELECT ib.*, units, row_number() OVER ({w}) AS rn, avg(mid) OVER ({w} ROWS {LENGTH - 1} PRECEDING) AS m, stddev_pop(mid) OVER ({w} ROWS {LENGTH - 1} PRECEDING) AS sd FROM ib JOIN sz USING (instrument, "window")),
 zn AS (SELECT candidate, instrument, "window", ts, bid_close, ask_close, units, CASE WHEN rn >= {LENGTH} THEN CASE WHEN mid < m - width * sd THEN 'below' WHEN mid > m + width * sd THEN 'above' ELSE 'inside' END END AS zone FROM mn, (VALUES {', '.join(f"('bands {x:g}', {x}::DOUBLE)" for x in _FROZEN)}) c(candidate, width)
  UNION ALL SELECT 'crossover', instrument, "window", ts, bid_close, ask_close, units, CASE WHEN rn >= {LENGTH} THEN CASE WHEN f > m THEN 'up' ELSE 'down' END END FROM (SELECT *, avg(mid) OVER ({w} ROWS 2 PRECEDING) AS f FROM mn)),
 sig AS (SELECT *, CASE WHEN candidate = 'crossover' THEN CASE WHEN lag(zone) OVER w = 'down' AND zone = 'up' THEN 'BUY' WHEN lag(zone) OVER w = 'up' AND zone = 'down' THEN 'SELL' END WHEN lag(zone) OVER w = 'below' AND zone <> 'below' THEN 'BUY' WHEN lag(zone) OVER w = 'above' AND zone <> 'above' THEN 'SELL' END AS signal FROM zn WINDOW w AS (PARTITION BY candidate, instrument, "window" ORDER BY ts)),
 {trades_sql('candidate, instrument, "window"', COSTS, 'units')}"""


_KEY = 'candidate, instrument, "window"'
_REPLAY = f"""m AS (SELECT {_KEY}, count(*) AS trades, sum(pnl) / 100 AS return_pct FROM tr GROUP BY ALL), pk AS (SELECT *, max(equity) OVER (PARTITION BY {_KEY} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS p FROM eq), dd AS (SELECT {_KEY}, max(CASE WHEN p > 0 THEN (p - equity) / p * 100 ELSE 0 END) AS drawdown_pct FROM pk GROUP BY ALL),
 x AS (SELECT {_KEY}, coalesce(trades, 0) AS trades, coalesce(return_pct, 0) AS return_pct, drawdown_pct, CASE WHEN coalesce(trades, 0) < 20 THEN 'trades' WHEN coalesce(return_pct, 0) <= 0 THEN 'return' WHEN drawdown_pct >= 20 THEN 'drawdown' END AS gate FROM dd LEFT JOIN m USING ({_KEY})),
 op AS (SELECT * FROM tr SEMI JOIN (SELECT {_KEY} FROM x WHERE gate IS NULL) USING ({_KEY})), {_boot_sql('bt', 'op', _KEY, DRAWS)},
 jd AS (SELECT x.*, low, prob_loss, gate IS NULL AND coalesce(low > 0 AND prob_loss < 40, false) AS ok FROM x LEFT JOIN bt USING ({_KEY}))
 SELECT {_KEY}, trades, round(return_pct, 4) AS return_pct, round(drawdown_pct, 4) AS drawdown_pct, round(low, 4) AS low, round(prob_loss, 4) AS prob_loss, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS verdict, CASE WHEN ok THEN '' ELSE coalesce(gate, 'bootstrap') END AS reason FROM jd"""


def _candidates() -> dict:
    bands = lambda x: lambda b, key: signals.bollinger_reversal(b, key, LENGTH, x)
    return {**{f"bands {x:g}": bands(x) for x in _FROZEN}, "crossover": lambda b, key: signals.sma_cross(b, 3, LENGTH, key)}


@query(f"WITH RECURSIVE {_DAILY}, {_WINDOWS}, {_frozen_sql()}, {_REPLAY}")
def out_of_time(spark: SparkSession, sf: str) -> DataFrame:
    """Frozen candidates run afresh on every window that they weren't chosen on, with verdict, reason and bootstrap bounds."""
    d = daily(spark, sf)
    windows = orchestrate.month_windows(d, BY, _MONTHS, _TRAINING)
    return plain(orchestrate.out_of_time(d, BY, _candidates(), windows, NOTIONAL, COSTS, iterations=DRAWS))


@query(f"""WITH {_DAILY}, wn AS (SELECT instrument, 'whole' AS "window", min(ts) AS start, max(ts) AS "end" FROM daily GROUP BY 1), {_frozen_sql()}, {_REPLAY}""")
def replay_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Frozen candidates on whole series: verdict and the first gate that fails, the bootstrap's among them."""
    d = daily(spark, sf)
    windows = d.groupBy("instrument").agg(F.lit("whole").alias("window"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    return plain(orchestrate.out_of_time(d, BY, _candidates(), windows, NOTIONAL, COSTS, iterations=DRAWS))
