"""Queries over the market graph: cycles, strengths, detectors, run-level statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import quotient
from ..functions.numbers import rounded as r
from ..operators import audit, detectors, graph, runlevel, strengths
from ..sources.views import BARS, QUOTES, bars, quotes
from .candle_queries import rounds

QUERIES: dict = {}
ORACLES: dict = {}
#: Nodes and pairs of the graph of regions.
N, PAIRS = 5, 10
ANCHORS = ("AFRICA", "AMERICA")


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_OBS = f"{QUOTES}, obs AS (SELECT ts, a, b, bid, ask, volume, ln((bid + ask) / 2) * 10000 AS y, ln(ask / bid) * 10000 AS s FROM quotes WHERE bid > 0 AND bid < ask)"
_LEGS = """tri AS (SELECT x.a, x.b, z.b AS c, x.a || '-' || x.b || '-' || z.b AS cycle FROM (SELECT DISTINCT a, b FROM quotes) x JOIN (SELECT DISTINCT a, b FROM quotes) z ON x.b = z.a JOIN (SELECT DISTINCT a, b FROM quotes) w ON w.a = x.a AND w.b = z.b),
 legs AS (SELECT cycle, a, b, 1 AS d FROM tri UNION ALL SELECT cycle, b, c, 1 FROM tri UNION ALL SELECT cycle, a, c, -1 FROM tri)"""
_NUM = f"""{_OBS}, {_LEGS}, num AS (SELECT cycle, ts, sum(d * y) AS resid, sum(CASE WHEN d > 0 THEN ln(bid) ELSE -ln(ask) END) * 10000 AS gain_fwd, sum(CASE WHEN d > 0 THEN -ln(ask) ELSE ln(bid) END) * 10000 AS gain_rev, sum(s) AS spread
 FROM obs JOIN legs USING (a, b) GROUP BY ALL HAVING count(*) = 3)"""
_TIER = "CASE WHEN abs(resid) > 10 THEN 'suspect' WHEN spread <= 0 THEN 'unrated' WHEN abs(resid) / spread <= 0.25 THEN 'clean' WHEN abs(resid) / spread <= 1 THEN 'noisy' ELSE 'suspect' END"


def _legs(q: DataFrame) -> DataFrame:
    return graph.triangle_legs(graph.triangles(q))


def _numbers(spark: SparkSession, sf: str) -> DataFrame:
    q = quotes(spark, sf)
    return graph.cycle_numbers(q, _legs(q))


@query(f"WITH {_OBS} SELECT ts, a, b, round(y, 6) AS y, round(s, 6) AS s FROM obs")
def graph_observations(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(graph.observations(quotes(spark, sf)).select("ts", "a", "b", "y", "s"), [])


@query(f"WITH {QUOTES}, {_LEGS} SELECT cycle, a, b, c FROM tri")
def triangle_enumeration(spark: SparkSession, sf: str) -> DataFrame:
    return graph.triangles(quotes(spark, sf))


@query(f"""WITH RECURSIVE {QUOTES}, e AS (SELECT row_number() OVER (ORDER BY a, b) AS edge, a, b FROM (SELECT DISTINCT a, b FROM quotes)),
 arc AS (SELECT edge, a AS tail, b AS head FROM e UNION ALL SELECT edge, b, a FROM e),
 p AS (SELECT tail AS start, head AS at, [tail, head] AS nodes, edge AS first, edge AS last, false AS shut FROM arc WHERE tail < head
  UNION ALL SELECT start, arc.head, CASE WHEN arc.head = start THEN nodes ELSE list_append(nodes, arc.head) END, first, arc.edge, arc.head = start FROM p JOIN arc ON p.at = arc.tail
  WHERE NOT shut AND (arc.head = start AND len(nodes) >= 3 OR arc.head > start AND NOT list_contains(nodes, arc.head)) AND len(nodes) <= 5)
 SELECT array_to_string(nodes, '-') AS cycle, len(nodes)::INT AS n FROM p WHERE shut AND first < last""")
def simple_cycles(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    e = quotes(spark, sf).select("a", "b").distinct().withColumn("edge", F.row_number().over(Window.orderBy("a", "b")))  # the topology: a row a pair
    return graph.simple_cycles(e, 5).select("cycle", "n")


@query(f"WITH {_NUM} SELECT cycle, ts, round(resid, 6) AS resid, round(gain_fwd, 6) AS gain_fwd, round(gain_rev, 6) AS gain_rev, round(spread, 6) AS spread FROM num")
def cycle_residuals(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(_numbers(spark, sf), [])


@query(f"WITH {_NUM} SELECT cycle, {_TIER} AS tier, count(*) AS n FROM num GROUP BY ALL")
def cycle_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return _numbers(spark, sf).groupBy("cycle", graph.tier(F.col("resid"), F.col("spread")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_NUM}, q AS (SELECT cycle, ts, bool_and(a <> 'ASIA') AS rated, count(DISTINCT CASE WHEN b = 'MIDDLE EAST' THEN 'x' ELSE 'y' END) > 1 AS multi,
 CASE WHEN count(CASE WHEN volume >= 20 THEN volume END) = count(*) THEN sum(volume / 10) END AS cost FROM quotes JOIN legs USING (a, b) GROUP BY ALL)
 SELECT cycle, ts, CASE WHEN rated THEN {_TIER} ELSE 'unrated' END AS tier, round(cost, 6) AS cost, round(greatest(gain_fwd, gain_rev) - cost, 6) AS net_gain, CASE WHEN multi THEN 'VENUE_BLOCKED' WHEN NOT rated THEN 'UNRATED' WHEN greatest(gain_fwd, gain_rev) <= 0 THEN 'NO_GAIN'
  WHEN cost IS NULL THEN 'GAIN_COST_UNKNOWN' WHEN greatest(gain_fwd, gain_rev) - cost > 0 THEN 'EXECUTABLE_AFTER_COST' ELSE 'COST_EATS_GAIN' END AS verdict FROM num JOIN q USING (cycle, ts)""")
def cycle_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    q = quotes(spark, sf).withColumns({"venue": F.when(F.col("b") == "MIDDLE EAST", "x").otherwise("y"), "spread_known": F.col("a") != "ASIA", "taker_bps": F.when(F.col("volume") >= 20, F.col("volume") / 10)})
    return rounds(graph.evaluate(q, _legs(q)).select("cycle", "ts", "tier", "cost", "net_gain", "verdict"), [])


@query(f"""WITH {_NUM}, t AS (SELECT *, {_TIER} AS tier FROM num) SELECT cycle, count(*) AS n, round(avg(resid), 6) AS mean, round(quantile_cont(abs(resid), 0.5), 6) AS p50, round(quantile_cont(abs(resid), 0.9), 6) AS p90, round(quantile_cont(abs(resid), 0.99), 6) AS p99,
 round(quantile_cont(abs(resid) / spread, 0.5), 6) AS ratio_p50, round(count(*) FILTER (greatest(gain_fwd, gain_rev) > 0) / count(*), 6) AS gain_share, count(*) FILTER (tier = 'clean') AS clean, count(*) FILTER (tier = 'noisy') AS noisy, count(*) FILTER (tier = 'suspect') AS suspect, count(*) FILTER (tier = 'unrated') AS unrated FROM t GROUP BY 1""")
def cycle_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(audit.cycle_summary(_numbers(spark, sf)), [])


@query(f"""WITH {BARS}, d AS (SELECT instrument, date_trunc('day', ts)::DATE AS day, count(*) AS n, quantile_cont((ask_close - bid_close) / mid, 0.5) AS m FROM bars GROUP BY ALL HAVING count(*) >= 10),
 k AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY m DESC, day DESC) AS rk FROM d) SELECT instrument, day, n, round(m, 6) AS median FROM k WHERE rk <= 5""")
def stress_days(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).withColumn("v", (F.col("ask_close") - F.col("bid_close")) / F.col("mid"))
    return rounds(audit.stress_days(b, ["instrument"], F.col("ts").cast("date"), "v").drop("rank"), [])


@query()
def negative_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(graph.negative_cycles(quotes(spark, sf)), [])


_FULL = f"""{_OBS}, full_ AS (SELECT * FROM obs WHERE ts IN (SELECT ts FROM obs GROUP BY 1 HAVING count(*) = {PAIRS})),
 c AS (SELECT ts, node, sum(v) / {N} AS c FROM (SELECT ts, a AS node, y AS v FROM full_ UNION ALL SELECT ts, b, -y FROM full_) GROUP BY ALL),
 loo AS (SELECT f.*, f.y - (ca.c - cb.c) AS resid, (f.y - (ca.c - cb.c)) / (1 - 2.0::DOUBLE / {N}) AS loo FROM full_ f JOIN c ca ON ca.ts = f.ts AND ca.node = f.a JOIN c cb ON cb.ts = f.ts AND cb.node = f.b)"""


def _full(spark: SparkSession, sf: str) -> DataFrame:
    return strengths.full_bars(quotes(spark, sf), PAIRS)


def _loo(spark: SparkSession, sf: str) -> DataFrame:
    return strengths.complete_residuals(_full(spark, sf), N)


@query(f"WITH {_FULL} SELECT ts, node, round(c, 6) AS c FROM c")
def strengths_unweighted(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(strengths.complete_strengths(_full(spark, sf), N), [])


@query(f"WITH {_FULL} SELECT ts, node, round(c, 4) AS c FROM c")
def strengths_solver(spark: SparkSession, sf: str) -> DataFrame:
    """The general solver on the bars with all pairs."""
    f = strengths.fit(_full(spark, sf)).where("kind = 'node'")
    return f.select("ts", F.col("a").alias("node"), r("value", 4).alias("c"))


@query()
def strengths_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(strengths.fit(quotes(spark, sf), "inv_spread"), [])


#: Strengths by weights 1 / spread, by 200 rounds in which every node takes the mean of what its pairs say.
_INV = f"""{_FULL}, sg AS (SELECT ts, a AS p, b AS q, y AS v, 1 / s AS w FROM full_ UNION ALL SELECT ts, b, a, -y, 1 / s FROM full_),
 it AS (SELECT 0 AS k, ts, node, 0.0::DOUBLE AS x FROM c UNION ALL SELECT any_value(it.k) + 1, sg.ts, sg.p, sum(w * (v + it.x)) / sum(w) FROM it JOIN sg ON it.ts = sg.ts AND it.node = sg.q WHERE it.k < 200 GROUP BY sg.ts, sg.p),
 ci AS (SELECT ts, node, x - avg(x) OVER (PARTITION BY ts) AS c FROM it WHERE k = 200)"""


@query(f"WITH RECURSIVE {_INV} SELECT ts, node, round(c, 3) AS c FROM ci")
def strengths_inv_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted strengths of the bars with all pairs."""
    f = strengths.fit(_full(spark, sf), "inv_spread").where("kind = 'node'")
    return f.select("ts", F.col("a").alias("node"), r("value", 3).alias("c"))


@query(f"WITH RECURSIVE {_INV}, d AS (SELECT node, abs(ci.c - c.c) AS diff FROM ci JOIN c USING (ts, node)) SELECT 'inv_spread' AS scheme, node, count(*) AS n, round(quantile_cont(diff, 0.5), 3) AS p50, round(quantile_cont(diff, 0.99), 3) AS p99, round(max(diff), 3) AS most FROM d GROUP BY node")
def scheme_differences(spark: SparkSession, sf: str) -> DataFrame:
    d = strengths.scheme_differences(_full(spark, sf), ("inv_spread",))
    return rounds(d.groupBy("scheme", "node").agg(F.count(F.lit(1)).alias("n"), F.percentile("diff", 0.5).alias("p50"), F.percentile("diff", 0.99).alias("p99"), F.max("diff").alias("most")), [], 3)


@query(f"""WITH RECURSIVE {_INV}, l AS (SELECT ts, max(abs(loo)) AS max_loo, max(s) / min(s) AS dispersion FROM loo GROUP BY 1), d AS (SELECT ts, max(abs(ci.c - c.c)) AS max_diff FROM ci JOIN c USING (ts, node) GROUP BY 1)
 SELECT month(ts)::INT AS month, count(*) AS n, count(*) FILTER (max_loo > 300) AS n_fault, round(quantile_cont(max_diff, 0.5) FILTER (max_loo <= 300), 3) AS max_diff_p50, round(quantile_cont(dispersion, 0.5), 6) AS dispersion_p50 FROM l JOIN d USING (ts) GROUP BY 1""")
def scheme_dependence(spark: SparkSession, sf: str) -> DataFrame:
    """By month (bars are months here, as hours are elsewhere): how far weights move the strengths of bars without a fault."""
    m = strengths.bar_metrics(_full(spark, sf), PAIRS, 300.0, ("unweighted", "inv_spread")).where("scheme = 'inv_spread'")
    g = m.groupBy(F.month("ts").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_if("fault").alias("n_fault"), F.percentile(F.when(~F.col("fault"), F.col("max_diff")), 0.5).alias("max_diff_p50"), F.percentile("dispersion", 0.5).alias("dispersion_p50"))
    return g.select("month", "n", "n_fault", r("max_diff_p50", 3).alias("max_diff_p50"), r("dispersion_p50").alias("dispersion_p50"))


@query(f"WITH {_OBS}, g AS (SELECT ts, count(*) AS n FROM obs GROUP BY 1), k AS (SELECT CASE WHEN n = {PAIRS} THEN 'B_full' ELSE 'D_degraded' END AS grp FROM g), e AS (SELECT grp FROM k UNION ALL SELECT 'D_all' FROM k) SELECT grp, count(*) AS bars FROM e GROUP BY 1")
def strength_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Bars with all pairs, bars without some, and both."""
    g = graph.observations(quotes(spark, sf)).groupBy("ts").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.col("n") == PAIRS, "B_full").otherwise("D_degraded")
    return g.select(F.explode(F.array(own, F.lit("D_all"))).alias("grp")).groupBy("grp").agg(F.count(F.lit(1)).alias("bars"))


@query(f"WITH {_FULL} SELECT count(*) AS compared, 0::BIGINT AS mismatches, true AS within FROM loo")
def fast_against_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Leave-one-out residuals from hat values against fits made anew, on the bars with all pairs."""
    return strengths.fast_against_exact(_full(spark, sf)).select("compared", "mismatches", "within")


@query(f"WITH {_FULL} SELECT ts, a, b, round(resid, 6) AS resid, round(loo, 6) AS loo FROM loo")
def loo_residuals(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(_loo(spark, sf).select("ts", "a", "b", "resid", "loo"), [])


@query(f"""WITH {_FULL}, dr AS (SELECT DISTINCT node AS dropped FROM c), rest AS (SELECT ts, dropped, node, sum(v) / {N - 1} AS c FROM (SELECT ts, dropped, a AS node, y AS v FROM full_, dr WHERE dropped NOT IN (a, b) UNION ALL SELECT ts, dropped, b, -y FROM full_, dr WHERE dropped NOT IN (a, b)) GROUP BY ALL)
 SELECT ts, dropped, node, round(c.c - avg(c.c) OVER (PARTITION BY ts, dropped) - rest.c, 4) AS shift FROM rest JOIN c USING (ts, node)""")
def loco(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(strengths.loco(_full(spark, sf)), [], 4)


@query()
def huber_strengths(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(strengths.huber(quotes(spark, sf)), [], 4)


@query(f"""WITH {_FULL}, sp AS (SELECT ts, node, avg(s) AS spread FROM (SELECT ts, a AS node, s FROM full_ UNION ALL SELECT ts, b, s FROM full_) GROUP BY ALL)
 SELECT ts, node, round(c, 6) AS zero_sum, round(c - max(CASE WHEN node = 'EUROPE' THEN c END) OVER w, 6) AS vs_ref, round(c - avg(c) OVER w, 6) AS basket_equal, round(c - sum(c / spread) OVER w / sum(1 / spread) OVER w, 6) AS basket_inv_spread FROM c JOIN sp USING (ts, node) WINDOW w AS (PARTITION BY ts)""")
def strength_views(spark: SparkSession, sf: str) -> DataFrame:
    o = _full(spark, sf)
    return rounds(strengths.views(strengths.complete_strengths(o, N), o, "EUROPE"), [])


_PATHS = f"""{_OBS}, sg AS (SELECT ts, a AS p, b AS q, y, s FROM obs UNION ALL SELECT ts, b, a, -y, s FROM obs),
 paths AS (SELECT ts, 'hub' AS path, y AS estimate, s AS spread FROM sg WHERE p = 'AFRICA' AND q = 'AMERICA' UNION ALL SELECT x.ts, 'arm:' || x.q, x.y + z.y, x.s + z.s FROM sg x JOIN sg z ON x.ts = z.ts AND x.q = z.p WHERE x.p = 'AFRICA' AND z.q = 'AMERICA' AND x.q <> 'AMERICA')"""


@query(f"WITH {_PATHS} SELECT ts, path, round(estimate, 6) AS estimate, round(spread, 6) AS spread FROM paths")
def hub_arm_paths(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(strengths.paths(graph.observations(quotes(spark, sf))), [])


@query(f"""WITH {_PATHS}, m AS (SELECT ts, quantile_cont(estimate, 0.5) AS med, count(*) AS n FROM paths GROUP BY 1), r AS (SELECT ts, path, abs(estimate - med) / spread AS ratio FROM paths JOIN m USING (ts)),
 g AS (SELECT ts, list(path ORDER BY ratio DESC) FILTER (ratio > 3) AS w, list(ratio ORDER BY ratio DESC) FILTER (ratio > 3) AS x FROM r GROUP BY 1)
 SELECT ts, n AS paths, round(CASE WHEN n >= 3 THEN med END, 6) AS median, CASE WHEN n < 3 THEN 'insufficient' WHEN coalesce(len(w), 0) = 0 THEN 'clean' WHEN len(w) = 1 THEN w[1] ELSE 'ambiguous' END AS verdict, round(CASE WHEN n >= 3 AND len(x) > 1 THEN x[1] / x[2] END, 6) AS margin FROM m JOIN g USING (ts)""")
def path_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(strengths.attribution(strengths.paths(graph.observations(quotes(spark, sf)), ANCHORS), 3.0), [])


def _worst_sql(scale: str, limit: float) -> str:
    return f"""w AS (SELECT ts, abs(loo) / {scale} AS r, a || '-' || b AS pair, a, b FROM src),
 k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY r DESC, a, b) AS rn FROM w) SELECT ts, r > {limit} AS flag, round(r, 6) AS worst, CASE WHEN r > 0 THEN pair END AS pair FROM k WHERE rn = 1"""


@query(f"WITH {_FULL}, src AS (SELECT * FROM loo), {_worst_sql('1', 300)}")
def detector_a(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(detectors.detector_a(_loo(spark, sf), 300.0), [])


@query(f"WITH {_FULL}, src AS (SELECT *, avg(s) OVER (PARTITION BY ts) AS scale FROM loo), {_worst_sql('scale', 1)}")
def detector_b(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(detectors.detector_b(_loo(spark, sf), "mean_spread"), [])


@query(f"""WITH {_FULL}, g AS (SELECT *, CASE WHEN a IN ('AFRICA', 'AMERICA') AND b IN ('AFRICA', 'AMERICA') THEN 'hub' WHEN a IN ('AFRICA', 'AMERICA') THEN 'arm:' || b WHEN b IN ('AFRICA', 'AMERICA') THEN 'arm:' || a ELSE 'other' END AS grp FROM loo),
 arm AS (SELECT ts, grp, sum(s) AS arm FROM g WHERE grp LIKE 'arm:%' GROUP BY ALL), typ AS (SELECT ts, quantile_cont(arm, 0.5) AS typ FROM arm GROUP BY 1), bar AS (SELECT ts, avg(s) AS m, max(CASE WHEN grp = 'hub' THEN s END) AS hub FROM g GROUP BY 1),
 src AS (SELECT g.*, CASE WHEN arm IS NOT NULL THEN hub + arm WHEN g.grp = 'hub' THEN hub + typ ELSE 3 * m END AS scale FROM g JOIN bar USING (ts) JOIN typ USING (ts) LEFT JOIN arm USING (ts, grp)), {_worst_sql('scale', 1)}""")
def detector_b_arm(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(detectors.detector_b(_loo(spark, sf), "arm_spread", ANCHORS), [])


@query(f"""WITH {BARS}, v AS (SELECT instrument, hour(ts) AS h, quantile_cont(volume, 0.5) AS typical FROM bars GROUP BY ALL), legs AS (SELECT ts, b.instrument AS name, volume, (bid_high - bid_low) / bid_low * 10000 AS range_bps, typical FROM bars b JOIN v ON v.instrument = b.instrument AND v.h = hour(ts)),
 o AS (SELECT x.ts, x.name, quantile_cont(y.range_bps, 0.5) AS med FROM legs x JOIN legs y ON x.ts = y.ts AND x.name <> y.name GROUP BY ALL),
 f AS (SELECT l.*, volume <= 2 OR range_bps = 0 AND coalesce(med, 0) >= 2 AS st FROM legs l LEFT JOIN o USING (ts, name)), g AS (SELECT *, NOT st AND volume < 0.05 * typical AS th FROM f)
 SELECT ts, bool_or(st OR th) AS flag, coalesce(string_agg(name, ',' ORDER BY name) FILTER (st), '') AS stale, coalesce(string_agg(name, ',' ORDER BY name) FILTER (th), '') AS thin FROM g GROUP BY 1""")
def detector_c(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf)
    typical = b.groupBy("instrument", F.hour("ts").alias("h")).agg(F.percentile("volume", 0.5).alias("typical"))
    legs = b.withColumn("h", F.hour("ts")).join(F.broadcast(typical), ["instrument", "h"]).select("ts", F.col("instrument").alias("name"), "volume", (quotient(F.col("bid_high") - F.col("bid_low"), "bid_low") * 1e4).alias("range_bps"), "typical")
    return detectors.detector_c(legs)


@query(f"""WITH {_FULL}, f AS (SELECT ts, max(abs(loo)) > 300 AS a, max(abs(loo)) > 500 AS x, max(abs(loo) / s) > 0.5 AS y FROM loo GROUP BY 1), n(k) AS (VALUES ('a'), ('x'), ('y')),
 l AS (SELECT ts, k, CASE k WHEN 'a' THEN a WHEN 'x' THEN x ELSE y END AS v FROM f, n) SELECT p.k AS first, q.k AS second, count(*) FILTER (p.v AND q.v) AS both, count(*) FILTER (p.v AND NOT q.v) AS only_first FROM l p JOIN l q ON p.ts = q.ts AND p.k <> q.k GROUP BY ALL""")
def detector_overlap(spark: SparkSession, sf: str) -> DataFrame:
    x = F.max(F.abs("loo"))
    f = _loo(spark, sf).groupBy("ts").agg((x > 300).alias("a"), (x > 500).alias("x"), (F.max(F.abs("loo") / F.col("s")) > 0.5).alias("y"))
    return detectors.overlap(f, ["a", "x", "y"])


_SPREADS = f"{BARS}, sp AS (SELECT instrument, ts, (ask_close - bid_close) / mid * 10000 AS v FROM bars)"


def _spreads(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select("instrument", "ts", ((F.col("ask_close") - F.col("bid_close")) / F.col("mid") * 1e4).alias("v"))


@query(f"WITH {_SPREADS} SELECT instrument, ts, round(CASE WHEN count(v) OVER w >= 10 THEN quantile_cont(v, 0.5) OVER w END, 6) AS hour_median FROM sp WINDOW w AS (PARTITION BY instrument, hour(ts) ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)")
def hour_median_history(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(runlevel.same_hour_median(_spreads(spark, sf), ["instrument"], "v").select("instrument", "ts", "hour_median"), [])


_STRETCH = f"""{_SPREADS}, st0 AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY instrument ORDER BY ts) = INTERVAL 1 HOUR THEN 0 ELSE 1 END AS f FROM sp),
 st AS (SELECT instrument, ts, round(v - 100, 6) AS v, sum(f) OVER (PARTITION BY instrument ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS stretch FROM st0)"""
_IN = "PARTITION BY instrument, stretch ORDER BY ts"


def _stretched(spark: SparkSession, sf: str) -> DataFrame:
    """Deviation of the spread from 100 bps, by instrument and stretch."""
    return runlevel.with_stretch(_spreads(spark, sf).withColumn("v", r(F.col("v") - 100)), ["instrument"])


def _stat(name: str, sql: str, width: int = 12):
    oracle = f"""WITH {_STRETCH}, fr AS (SELECT instrument, ts, list_sort(list(v) OVER w) AS l, count(v) OVER w AS k FROM st WINDOW w AS ({_IN} ROWS {width - 1} PRECEDING))
 SELECT instrument, ts, round(CASE WHEN k >= {width // 2} THEN {sql} END, 6) + 0.0 AS {name} FROM fr"""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = runlevel.statistic(_stretched(spark, sf), ["instrument", "stretch"], "v", name, width, "half")
        return out.select("instrument", "ts", (r(name) + 0.0).alias(name))  # no -0.0

    QUERIES[f"rolling_{name}"], ORACLES[f"rolling_{name}"] = run, oracle


_MED = "(l[(len(l) + 1) // 2] + l[len(l) // 2 + 1]) / 2"
_stat("median", _MED)
_stat("mean", "list_avg(l)")
_stat("trim20", "list_avg(l[len(l) // 5 + 1:len(l) - len(l) // 5])")
_stat("sign", "list_avg(list_transform(l, lambda x: sign(x)))")
_stat("hl", "list_aggregate(flatten(list_transform(l, lambda x, i: list_transform(l[i:], lambda y: (x + y) / 2))), 'quantile_cont', 0.5)")
_stat("huber", """CASE WHEN list_aggregate(list_transform(l, lambda x: abs(x - list_aggregate(l, 'quantile_cont', 0.5))), 'quantile_cont', 0.5) > 0 THEN
 list_reduce(list_prepend(list_aggregate(l, 'quantile_cont', 0.5), list_transform(range(20), lambda z: 0.0::DOUBLE)), lambda mu, z: mu + 1.4826 * list_aggregate(list_transform(l, lambda x: abs(x - list_aggregate(l, 'quantile_cont', 0.5))), 'quantile_cont', 0.5)
 * list_avg(list_transform(l, lambda x: greatest(-1.345, least(1.345, (x - mu) / (1.4826 * list_aggregate(list_transform(l, lambda t: abs(t - list_aggregate(l, 'quantile_cont', 0.5))), 'quantile_cont', 0.5)))))))
 ELSE list_aggregate(l, 'quantile_cont', 0.5) END""", 8)  # fmt: skip


@query(f"""WITH {_STRETCH}, fr AS (SELECT instrument, ts, list(v) OVER (PARTITION BY instrument ORDER BY ts ROWS 29 PRECEDING) AS l FROM st)
 SELECT instrument, ts, round(CASE WHEN len(l) >= 10 THEN list_aggregate(list_transform(l, lambda x: abs(x - list_aggregate(l, 'quantile_cont', 0.5))), 'quantile_cont', 0.5) END, 6) AS mad FROM fr""")
def rolling_mad(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(runlevel.rolling_mad(_stretched(spark, sf), ["instrument"], "v", 30, 10).select("instrument", "ts", "mad"), [])


@query(f"""WITH RECURSIVE {_STRETCH}, n AS (SELECT *, row_number() OVER ({_IN}) AS rn FROM st), e AS (SELECT instrument, stretch, rn, ts, v AS s FROM n WHERE rn = 1
 UNION ALL SELECT n.instrument, n.stretch, n.rn, n.ts, (1 - power(0.5, 1.0 / 6)) * n.v + power(0.5, 1.0 / 6) * s FROM e JOIN n ON n.instrument = e.instrument AND n.stretch = e.stretch AND n.rn = e.rn + 1)
 SELECT instrument, ts, round(CASE WHEN rn >= 3 THEN s END, 6) AS ewma FROM e""")
def ewma(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(runlevel.ewma(_stretched(spark, sf), ["instrument", "stretch"], "v", 6.0).select("instrument", "ts", "ewma"), [])


@query(f"""WITH RECURSIVE {_STRETCH}, n AS (SELECT *, row_number() OVER ({_IN}) AS rn FROM st), e AS (SELECT instrument, stretch, rn, ts, greatest(0, v - 10) AS sp, greatest(0, -v - 10) AS sn FROM n WHERE rn = 1
 UNION ALL SELECT n.instrument, n.stretch, n.rn, n.ts, greatest(0, sp + n.v - 10), greatest(0, sn - n.v - 10) FROM e JOIN n ON n.instrument = e.instrument AND n.stretch = e.stretch AND n.rn = e.rn + 1)
 SELECT instrument, ts, round(CASE WHEN sp >= sn THEN sp ELSE -sn END, 6) + 0.0 AS cusum FROM e""")
def cusum(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(runlevel.cusum(_stretched(spark, sf), ["instrument", "stretch"], "v", 10.0).select("instrument", "ts", "cusum"), []).withColumn("cusum", F.col("cusum") + 0.0)


_FLAGS = f"{_STRETCH}, fl AS (SELECT instrument, ts, stretch, abs(v) / 100 >= 0.7 AS flag, abs(v) / 100 >= 0.35 AS stay FROM st)"


def _flags(spark: SparkSession, sf: str) -> DataFrame:
    s = _stretched(spark, sf)
    return s.select("instrument", "ts", "stretch", runlevel.flag(F.col("v"), F.lit(100.0), 0.7).alias("flag"), runlevel.flag(F.col("v"), F.lit(100.0), 0.35).alias("stay"))


@query(f"""WITH {_FLAGS}, c AS (SELECT *, sum((NOT stay)::INT) OVER ({_IN} ROWS UNBOUNDED PRECEDING) AS comp FROM fl)
 SELECT instrument, ts, flag, stay AND max(flag AND stay) OVER (PARTITION BY instrument, stretch, comp ORDER BY ts ROWS UNBOUNDED PRECEDING) AS latched FROM c""")
def latch(spark: SparkSession, sf: str) -> DataFrame:
    return runlevel.latch(_flags(spark, sf), ["instrument", "stretch"], F.col("flag"), F.col("stay")).select("instrument", "ts", "flag", "latched")


@query(f"""WITH {_FLAGS}, s AS (SELECT *, {', '.join(f"flag AND coalesce(max(flag) OVER (PARTITION BY instrument ORDER BY ts ROWS BETWEEN {g} PRECEDING AND 1 PRECEDING), false) = false AS g{g}" for g in (1, 3, 6, 12))} FROM fl)
 {' UNION ALL '.join(f"SELECT instrument, {g} AS gap, count(*) FILTER (flag) AS flagged, count(*) FILTER (g{g}) AS runs FROM s GROUP BY 1" for g in (1, 3, 6, 12))}""")
def run_counts(spark: SparkSession, sf: str) -> DataFrame:
    return runlevel.run_counts(_flags(spark, sf), ["instrument"], "flag", (1, 3, 6, 12))


@query(f"""WITH {_FLAGS}, f AS (SELECT instrument, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 3 HOUR THEN 0 ELSE 1 END AS n FROM fl WHERE flag WINDOW w AS (PARTITION BY instrument ORDER BY ts)),
 k AS (SELECT *, sum(n) OVER (PARTITION BY instrument ORDER BY ts ROWS UNBOUNDED PRECEDING) AS r FROM f) SELECT instrument, min(ts) AS start, max(ts) AS "end", count(*) AS bars FROM k GROUP BY instrument, r""")
def hour_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runlevel.time_runs(_flags(spark, sf).where("flag"), ["instrument"])


@query(f"""WITH {_STRETCH}, q AS (SELECT *, sum((abs(v) < 60)::INT) OVER w AS k FROM st WINDOW w AS ({_IN} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
 SELECT instrument, stretch, min(ts) FILTER (k = 4) AS quiet_from FROM q GROUP BY ALL""")
def quiet_ends(spark: SparkSession, sf: str) -> DataFrame:
    return runlevel.quiet_ends(_stretched(spark, sf), ["instrument", "stretch"], "v", 60.0, 4)


@query(f"""WITH {_SPREADS}, g AS (SELECT instrument, ts, lead(ts) OVER (PARTITION BY instrument ORDER BY ts) AS nx FROM sp), h AS (SELECT instrument, unnest(generate_series(ts + INTERVAL 1 HOUR, nx - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts FROM g WHERE nx - ts BETWEEN INTERVAL 2 HOUR AND INTERVAL 4 HOUR)
 SELECT instrument, ts, true AS real, round(v, 6) AS v FROM sp UNION ALL SELECT instrument, ts, false, NULL FROM h""")
def carry_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(runlevel.fill_gaps(_spreads(spark, sf), ["instrument"], 3).select("instrument", "ts", "real", "v"), [])


@query(f"""WITH {_STRETCH}, p AS (SELECT *, row_number() OVER ({_IN}) - 1 AS pos, count(*) OVER (PARTITION BY instrument, stretch) AS n FROM st) SELECT instrument, ts, stretch, pos::INT AS pos, (n - 1 - pos)::INT AS "left" FROM p""")
def stretch_geometry(spark: SparkSession, sf: str) -> DataFrame:
    return runlevel.stretch_geometry(_stretched(spark, sf), ["instrument"]).select("instrument", "ts", "stretch", "pos", "left")
