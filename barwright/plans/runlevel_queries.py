"""Queries of run extents, the lattice of statistics, and intervals clustered by stretches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extents, lattice, resample, runlevel
from ..sources.views import BARS, bars
from .candle_queries import rounds

QUERIES: dict = {}
ORACLES: dict = {}
_DRAW = "('0x' || substr(md5({}), 1, 12))::BIGINT"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def plain(df: DataFrame) -> DataFrame:
    """Doubles to 6 digits, without -0.0."""
    return df.withColumns({c: F.round(c, 6) + 0.0 for c, kind in df.dtypes if kind == "double"})


def deviations(spark: SparkSession, sf: str) -> DataFrame:
    """instrument, ts, dev (spread in bps less 100), raw (the same), norm (by volume), scale (volume), masked (spread over 190)."""
    s = (F.col("ask_close") - F.col("bid_close")) / F.col("mid") * 1e4
    b = bars(spark, sf).select("instrument", "ts", (s - 100).alias("dev"), "volume")
    return b.select("instrument", "ts", "dev", F.col("dev").alias("raw"), (F.col("dev") / F.col("volume")).alias("norm"), F.col("volume").alias("scale"), (F.col("dev") > 90).alias("masked"))


_DEV = f"""{BARS}, dv AS (SELECT instrument, ts, (ask_close - bid_close) / mid * 10000 - 100 AS dev, volume AS scale FROM bars)"""
_RUNS = f"""{_DEV}, r0 AS (SELECT instrument, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY instrument ORDER BY ts) <= INTERVAL 3 HOUR THEN 0 ELSE 1 END AS f FROM dv WHERE abs(dev) >= 60),
 r1 AS (SELECT *, sum(f) OVER (PARTITION BY instrument ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM r0), runs AS (SELECT instrument, strftime(min(ts), '%Y-%m-%d %H') AS run, min(ts) AS start, max(ts) AS "end" FROM r1 GROUP BY instrument, g HAVING count(*) >= 2)"""


def runs(d: DataFrame) -> DataFrame:
    r = runlevel.time_runs(d.where(F.abs("dev") >= 60), ["instrument"]).where("bars >= 2")
    return r.select("instrument", F.date_format("start", "yyyy-MM-dd HH").alias("run"), "start", "end")


_LEVELS, _BLOCKS = (30.0, 50.0), (1, 3)
_USER = """us AS (SELECT instrument, run, start - INTERVAL 1 HOUR AS s, "end" + INTERVAL 2 HOUR AS e FROM runs WHERE instrument = 'click')"""
_EXTENTS = f"""{_RUNS}, {_USER}, h AS (SELECT instrument, run, start, "end", unnest(generate_series(start - INTERVAL 48 HOUR, greatest("end", start + INTERVAL 97 HOUR), INTERVAL 1 HOUR)) AS ts FROM runs),
 x AS (SELECT h.*, abs(dev) AS v FROM h LEFT JOIN dv USING (instrument, ts)), pk AS (SELECT instrument, run, max(v) FILTER (ts BETWEEN start AND "end") AS peak FROM x GROUP BY ALL),
 rules(rule, level, share, n) AS (VALUES {", ".join([f"('rtz_x{x:g}_n{n}', {x}::DOUBLE, NULL, {n})" for x in _LEVELS for n in _BLOCKS] + [f"('peak_f{f:g}_n3', NULL, {f}::DOUBLE, 3)" for f in extents.SHARES])}),
 y AS (SELECT x.*, peak, rule, level, n, coalesce(level, share * peak) AS lim FROM x JOIN pk USING (instrument, run), rules),
 q AS (SELECT *, date_diff('hour', start, ts) AS k, sum(coalesce(v < lim, false)::INT) OVER w1 AS c1, sum(coalesce(v < lim, false)::INT) OVER w3 AS c3 FROM y
   WINDOW w1 AS (PARTITION BY instrument, run, rule ORDER BY ts ROWS BETWEEN CURRENT ROW AND CURRENT ROW), w3 AS (PARTITION BY instrument, run, rule ORDER BY ts ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
 f AS (SELECT instrument, run, start, "end", rule, any_value(level) AS level, any_value(peak) AS peak, min(k) FILTER (k BETWEEN 1 AND 95 AND CASE n WHEN 1 THEN c1 = 1 ELSE c3 = 3 END) AS kq, max(ts) FILTER (ts < start AND NOT coalesce(v >= lim, false)) AS low FROM q GROUP BY instrument, run, start, "end", rule),
 ex AS (SELECT instrument, run, rule, CASE WHEN level IS NULL THEN start ELSE coalesce(low + INTERVAL 1 HOUR, start - INTERVAL 48 HOUR) END AS start,
   CASE WHEN level IS NULL AND NOT coalesce(peak > 0, false) THEN "end" ELSE greatest(start + INTERVAL 1 HOUR * (coalesce(kq - 1, 95)), start) END AS "end", kq IS NULL OR (level IS NULL AND NOT coalesce(peak > 0, false)) AS censored FROM f
   UNION ALL SELECT instrument, run, 'detector', start, "end", false FROM runs UNION ALL SELECT instrument, run, 'user', coalesce(s, start), coalesce(e, "end"), false FROM runs LEFT JOIN us USING (instrument, run))"""


def _extents(d: DataFrame) -> DataFrame:
    r = runs(d)
    user = r.where("instrument = 'click'").select("instrument", "run", (F.col("start") - extents.hours(1)).alias("start"), (F.col("end") + extents.hours(2)).alias("end"))
    return extents.extents(d, r, ["instrument"], levels=_LEVELS, blocks=_BLOCKS, user=user)


@query(f"WITH {_EXTENTS} SELECT * FROM ex")
def run_extents(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of deviations by every rule: as detected, back to a level, down to a share of the peak, as the user says."""
    return _extents(deviations(spark, sf))


@query(f"""WITH {_EXTENTS}, fl AS (SELECT instrument, ts, abs(dev) >= 80 AS flag FROM dv), w AS (SELECT instrument, run, rule, start, "end", unnest(generate_series(start - INTERVAL 48 HOUR, "end" + INTERVAL 48 HOUR, INTERVAL 1 HOUR)) AS ts FROM ex),
 g AS (SELECT instrument, run, rule, count(*) FILTER (ts BETWEEN start AND "end") AS valid, count(*) FILTER (flag AND ts BETWEEN start AND "end") AS flagged, coalesce(min(date_diff('hour', start, ts)) FILTER (flag AND ts BETWEEN start AND "end"), -1) AS latency,
  count(*) FILTER (flag AND ts < start) AS before, count(*) FILTER (flag AND ts > "end") AS after FROM w JOIN fl USING (instrument, ts) GROUP BY ALL)
 SELECT instrument, run, rule, coalesce(valid, 0) AS valid, CASE WHEN valid > 0 THEN flagged ELSE 0 END AS flagged, CASE WHEN valid > 0 THEN latency ELSE 0 END AS latency, CASE WHEN valid > 0 THEN before ELSE 0 END AS before, CASE WHEN valid > 0 THEN after ELSE 0 END AS after FROM ex LEFT JOIN g USING (instrument, run, rule)""")
def run_flags(spark: SparkSession, sf: str) -> DataFrame:
    """What a flag says inside each extent of each run, 48 hours before it and after it."""
    d = deviations(spark, sf)
    return extents.flags_in(_extents(d), d.select("instrument", "ts", (F.abs("dev") >= 80).alias("flag")), ["instrument"], ["instrument", "run", "rule"])


@query(f"""WITH {_RUNS}, e AS (SELECT r.*, d.dev + 0.1 AS expected FROM runs r JOIN dv d ON d.instrument = r.instrument AND d.ts = r.start), j AS (SELECT e.instrument, run, expected, dev FROM e JOIN dv d ON d.instrument = e.instrument AND d.ts BETWEEN e.start AND e."end")
 SELECT instrument, run, count(*) AS n, count(*) FILTER (dev > 90) AS n_masked, round(quantile_cont(dev, 0.5), 6) + 0.0 AS median, abs(quantile_cont(dev, 0.5) - expected) <= 0.15 AS ok FROM j GROUP BY instrument, run, expected""")
def named_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Named runs against an expected median: here that of a run's first hour, and 0.1 more."""
    d = deviations(spark, sf)
    first = d.select("instrument", F.col("ts").alias("start"), (F.col("dev") + 0.1).alias("expected"))
    return plain(extents.check_named(d, runs(d).join(first, ["instrument", "start"]), ["instrument"]))


_POLICIES = ("all_chron", "mask_reset", "mask_carry2", "all_barindex")
_POLICY = f"""{_DEV}, pol(policy, ref, carry) AS (VALUES {", ".join(f"('{p}', {str(a == 'ref').lower()}, {1000000 if c is None else c})" for p in _POLICIES for a, c in [lattice.parse_policy(p)])}),
 pb AS (SELECT policy, carry, instrument, ts, dev AS raw, dev / scale AS norm, scale FROM dv, pol WHERE NOT (ref AND dev > 90)),
 pg AS (SELECT *, lag(ts) OVER w AS pv, lead(ts) OVER w AS nx FROM pb WINDOW w AS (PARTITION BY policy, instrument ORDER BY ts)),
 ps AS (SELECT *, sum(CASE WHEN pv IS NULL OR date_diff('hour', pv, ts) - 1 > carry THEN 1 ELSE 0 END) OVER (PARTITION BY policy, instrument ORDER BY ts ROWS UNBOUNDED PRECEDING) AS stretch FROM pg),
 pf AS (SELECT policy, instrument, stretch, ts, raw, norm, scale, true AS real FROM ps UNION ALL SELECT policy, instrument, stretch, unnest(generate_series(ts + INTERVAL 1 HOUR, nx - INTERVAL 1 HOUR, INTERVAL 1 HOUR)), NULL, NULL, NULL, false FROM ps WHERE carry < 1000000 AND date_diff('hour', ts, nx) - 1 BETWEEN 1 AND carry)"""
_MED, _MAD = "list_aggregate(l, 'quantile_cont', 0.5)", "(1.4826 * list_aggregate(list_transform(l, lambda x: abs(x - list_aggregate(l, 'quantile_cont', 0.5))), 'quantile_cont', 0.5))"
_STATS = {
    "median": _MED, "mean": "list_avg(l)", "trim20": "list_avg(list_sort(l)[len(l) // 5 + 1:len(l) - len(l) // 5])",
    "hl": "list_aggregate(flatten(list_transform(list_sort(l), lambda x, i: list_transform(list_sort(l)[i:], lambda y: (x + y) / 2))), 'quantile_cont', 0.5)",
    "huber": f"CASE WHEN {_MAD} > 0 THEN list_reduce(list_prepend({_MED}, list_transform(range(20), lambda z: 0.0::DOUBLE)), lambda mu, z: mu + {_MAD} * list_avg(list_transform(l, lambda x: greatest(-1.345, least(1.345, (x - mu) / {_MAD}))))) ELSE {_MED} END",
}


def _lattice_sql(width: int, fills: tuple[str, ...]) -> str:
    """The long table lt (policy, instrument, ts, scale, spec, value) of all statistics of one width, signs too."""
    frames = {c: runlevel.bounds(width, c == "centred") for c in lattice.CAUSALITY}
    lists = ", ".join(f"list({i}) FILTER ({i} IS NOT NULL) OVER (PARTITION BY policy, instrument, stretch ORDER BY ts ROWS BETWEEN {-lo} PRECEDING AND {hi} FOLLOWING) AS l_{i}_{c}" for i in ("raw", "norm") for c, (lo, hi) in frames.items())
    parts, rows = [], []
    for c, (lo, hi) in frames.items():
        for i in ("raw", "norm"):
            parts.append(f"SELECT policy, instrument, ts, scale, '{i}' AS inp, '{c}' AS caus, l_{i}_{c} AS l FROM lw WHERE real AND {i} IS NOT NULL")
    one = f"lu AS ({' UNION ALL '.join(parts)}), ls AS (SELECT *, len(l) AS k, {', '.join(f'{s} AS {n}' for n, s in _STATS.items())}, list_avg(list_transform(l, lambda x: sign(x))) AS signpers FROM lu)"
    for c, (lo, hi) in frames.items():
        for f in fills:
            least = runlevel.least_count(hi - lo + 1, f)
            for i in ("raw", "norm"):
                for s in (*_STATS, *["signpers"] * (i == "raw")):
                    rows.append(f"SELECT policy, instrument, ts, scale, '{lattice.spec(s, width, f, c, 'none' if s == 'signpers' else i).sid}' AS spec, CASE WHEN k >= {least} THEN {s} END AS value FROM ls WHERE inp = '{i}' AND caus = '{c}'")
    return f"{_POLICY}, lw AS (SELECT policy, instrument, ts, scale, real, raw, norm, {lists} FROM pf), {one}, lt AS ({' UNION ALL '.join(rows)})"


_LATTICE = _lattice_sql(6, ("full", "half"))


def _lattice(spark: SparkSession, sf: str, names: list[str] | None = None) -> DataFrame:
    of = lattice.specs(("full", "half"), (6,), signs=True, states=False)
    p = lattice.under_policies(deviations(spark, sf).drop("dev"), ["instrument"], _POLICIES)
    return lattice.series(p, ["policy", "instrument", "stretch"], [s for s in of if names is None or s.sid in names]).where("real")


@query(f"WITH {_LATTICE} SELECT policy, instrument, spec, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, round(min(value), 6) + 0.0 AS low, round(max(value), 6) + 0.0 AS high FROM lt GROUP BY ALL")
def lattice_series(spark: SparkSession, sf: str) -> DataFrame:
    """Every statistic of six bars under four gap policies, by both causalities, two fills and two inputs, summed up."""
    v = F.col("value")
    return plain(_lattice(spark, sf).groupBy("policy", "instrument", "spec").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high")))


@query(f"""WITH {_LATTICE}, s(scale, threshold) AS (SELECT 'abs', unnest({list(10 * t for t in lattice.LADDERS['abs'])})::DOUBLE UNION ALL SELECT 'path', unnest({list(4 * t for t in lattice.LADDERS['ratio'])})::DOUBLE),
 g AS (SELECT DISTINCT policy, spec FROM lt) SELECT g.policy, g.spec, s.scale, s.threshold, count(*) FILTER (round(CASE s.scale WHEN 'abs' THEN abs(value) ELSE abs(value) / lt.scale END, 6) >= s.threshold) AS flagged FROM g JOIN lt USING (policy, spec), s GROUP BY ALL""")
def lattice_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Flagged bars of every statistic at every threshold of two scales, each value compared with its ladder once."""
    exact = lambda c: F.round(c, 6)  # noqa: E731  thresholds are round numbers that sums may miss by a last bit
    scales = {"abs": (exact(lattice.ratio(F.col("value"), None)), [10 * t for t in lattice.LADDERS["abs"]]), "path": (exact(lattice.ratio(F.col("value"), F.col("scale"))), [4 * t for t in lattice.LADDERS["ratio"]])}
    return lattice.flag_counts(_lattice(spark, sf), ["policy", "spec"], scales)


@query(f"WITH {_lattice_sql(12, ('full',))} SELECT policy, instrument, ts, spec, round(value, 6) + 0.0 AS value FROM lt WHERE spec IN {tuple(lattice.profile('CORRECT', lattice.specs(('full',), (12,), states=False)))} AND policy = 'mask_reset'")
def lattice_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics that serve a correction, chosen by profile, bar by bar."""
    of = lattice.specs(("full",), (12,), states=False)
    names = set(lattice.profile("CORRECT", of))
    p = lattice.under_policies(deviations(spark, sf).drop("dev"), ["instrument"], ["mask_reset"])
    x = lattice.series(p, ["policy", "instrument", "stretch"], [s for s in of if s.sid in names]).where("real")
    return x.select("policy", "instrument", "ts", "spec", (F.round("value", 6) + 0.0).alias("value"))


_TRIALS = f"""{_DEV}, st AS (SELECT *, sum(CASE WHEN pv IS NULL OR ts - pv > INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY instrument ORDER BY ts ROWS UNBOUNDED PRECEDING) AS stretch FROM (SELECT *, lag(ts) OVER (PARTITION BY instrument ORDER BY ts) AS pv FROM dv)),
 tl AS (SELECT instrument, stretch, list(abs(dev)) OVER (PARTITION BY instrument, stretch ORDER BY ts ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS l FROM st), tr AS (SELECT instrument, stretch, threshold, list_position(list_transform(l, lambda x: x >= threshold), true) - 1 AS first FROM tl, (VALUES (60), (90)) v(threshold) WHERE len(l) = 4)"""


def _trials(spark: SparkSession, sf: str) -> DataFrame:
    """instrument, threshold, stretch, first: the first of four bars whose deviation reaches the threshold (null: none), for each bar with three more in its stretch."""
    from pyspark.sql.window import Window

    s = runlevel.with_stretch(deviations(spark, sf), ["instrument"])
    w = Window.partitionBy("instrument", "stretch").orderBy("ts").rowsBetween(0, 3)
    s = s.select("instrument", "stretch", F.collect_list(F.abs("dev")).over(w).alias("l")).where("size(l) = 4").withColumn("threshold", F.explode(F.array(F.lit(60), F.lit(90))))
    at = F.array_position(F.transform("l", lambda x: x >= F.col("threshold")), F.lit(True))
    return s.select("instrument", "threshold", "stretch", F.when(at > 0, at - 1).alias("first"))


_N = 200


@query(f"""WITH {_TRIALS}, c AS (SELECT instrument, threshold, stretch, count(*) AS n, count(first) AS d, coalesce(sum(first), 0) AS l FROM tr GROUP BY ALL),
 u AS (SELECT instrument, stretch, row_number() OVER (PARTITION BY instrument ORDER BY stretch) - 1 AS ix, count(*) OVER (PARTITION BY instrument) AS m FROM (SELECT DISTINCT instrument, stretch FROM c)), g AS (SELECT DISTINCT instrument, m FROM u),
 dr AS (SELECT instrument, iter, {_DRAW.format("concat_ws('|', '31337', iter::VARCHAR, k::VARCHAR)")} % m AS ix FROM (SELECT instrument, iter, m, unnest(range(m)) AS k FROM g, range({_N}) r(iter))),
 s AS (SELECT c.instrument, threshold, iter, sum(n) AS n, sum(d) AS d, sum(l) AS l FROM dr JOIN u USING (instrument, ix) JOIN c USING (instrument, stretch) GROUP BY ALL),
 o AS (SELECT instrument, threshold, sum(d) / sum(n) AS rate, sum(l) / nullif(sum(d), 0) AS latency FROM c GROUP BY ALL)
 SELECT instrument, threshold::INT AS threshold, round(any_value(rate), 6) AS rate, round(quantile_cont(d / s.n, 0.025), 6) AS rate_low, round(quantile_cont(d / s.n, 0.975), 6) AS rate_high,
 round(any_value(latency), 6) AS latency, round(quantile_cont(l / nullif(d, 0), 0.025), 6) AS latency_low, round(quantile_cont(l / nullif(d, 0), 0.975), 6) AS latency_high FROM s JOIN o USING (instrument, threshold) GROUP BY ALL""")
def detection_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """How often four bars reach a threshold and how soon, with intervals from stretches drawn with replacement."""
    return rounds(resample.clustered_intervals(_trials(spark, sf), ["instrument"], ["threshold"], "stretch", "first", _N), [])
