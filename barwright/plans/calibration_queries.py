"""Queries of all statistics of a bar and of the detectors' grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration
from ..sources.views import quotes
from .candle_queries import rounds
from .graph_queries import _FULL, _loo, ANCHORS

QUERIES: dict = {}
ORACLES: dict = {}
#: Volumes of the tables are higher than ticks of an hour: stale volumes and thin shares are too, and residuals are of another size.
_STALE, _THIN, _OTHERS = (3.0, 40.0, 50.0), (0.6, 0.8, 0.95), 2.0
_A, _B = (50.0, 100.0, 200.0, 300.0, 400.0, 600.0), (0.1, 0.2, 0.3, 0.4, 0.5, 1.0)


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _legs(spark: SparkSession, sf: str) -> DataFrame:
    """Legs of full bars with their range and the median volume of the pair in that month of all years."""
    q = quotes(spark, sf).withColumn("m", F.month("ts"))
    typical = q.groupBy("a", "b", "m").agg(F.percentile("volume", 0.5).alias("typical"))
    ranges = q.join(typical, ["a", "b", "m"]).select("ts", "a", "b", "volume", "typical", ((F.col("hi") - F.col("lo")) / (F.col("hi") + F.col("lo")) * 2e4).alias("range_bps"))
    return _loo(spark, sf).select("ts", "a", "b", "s", "loo").join(ranges, ["ts", "a", "b"])


_STATS = f"""{_FULL}, ty AS (SELECT a, b, month(ts) AS m, quantile_cont(volume, 0.5) AS typical FROM quotes GROUP BY ALL),
 lg AS (SELECT l.ts, l.a, l.b, l.s, l.loo, l.volume, typical, (hi - lo) / (hi + lo) * 20000 AS rng, CASE WHEN l.a IN {ANCHORS} AND l.b IN {ANCHORS} THEN 'hub' WHEN l.a IN {ANCHORS} THEN 'arm:' || l.b WHEN l.b IN {ANCHORS} THEN 'arm:' || l.a ELSE 'other' END AS grp
  FROM loo l JOIN quotes q ON q.ts = l.ts AND q.a = l.a AND q.b = l.b JOIN ty ON ty.a = l.a AND ty.b = l.b AND ty.m = month(l.ts)),
 arm AS (SELECT ts, grp, sum(s) AS arm FROM lg WHERE grp LIKE 'arm:%' GROUP BY ALL), mid AS (SELECT ts, quantile_cont(arm, 0.5) AS mid FROM arm GROUP BY 1), br AS (SELECT ts, avg(s) AS m, max(CASE WHEN grp = 'hub' THEN s END) AS hub FROM lg GROUP BY 1),
 md AS (SELECT x.ts, x.a, x.b, quantile_cont(y.rng, 0.5) AS med FROM lg x JOIN lg y ON x.ts = y.ts AND (x.a <> y.a OR x.b <> y.b) GROUP BY ALL),
 sc AS (SELECT lg.*, m, CASE WHEN arm IS NOT NULL THEN hub + arm WHEN lg.grp = 'hub' THEN hub + mid ELSE 3 * m END AS scale, rng = 0 AND coalesce(med, 0) >= {_OTHERS} AS zero FROM lg JOIN br USING (ts) JOIN mid USING (ts) LEFT JOIN arm USING (ts, grp) LEFT JOIN md USING (ts, a, b)),
 one AS (SELECT ts, max(abs(loo)) AS max_abs, any_value(m) AS mean_spread, max(s) / min(s) AS dispersion, max(abs(loo) / scale) AS b_arm_spread FROM sc GROUP BY 1),
 st AS (SELECT *, max_abs / mean_spread AS b_mean_spread, max_abs / CASE WHEN count(*) OVER w >= 10 THEN quantile_cont(mean_spread, 0.5) OVER w END AS b_hour_median FROM one WINDOW w AS (PARTITION BY hour(ts) ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
 gd(stale, share) AS (VALUES {", ".join(f"({v}::DOUBLE, {f}::DOUBLE)" for v in _STALE for f in _THIN)}),
 cg AS (SELECT ts, stale, share, bool_or(volume <= stale) AS by_volume, bool_or(zero) AS by_zero, bool_or(NOT volume <= stale AND NOT zero AND volume < share * typical) AS thin FROM sc, gd GROUP BY ALL)"""


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    return calibration.bar_statistics(_legs(spark, sf), ANCHORS, _STALE, _THIN, _OTHERS)


@query(f"""WITH {_STATS} SELECT st.ts, {", ".join(f"round({c}, 6) AS {c}" for c in ("max_abs", "mean_spread", "dispersion", "b_mean_spread", "b_arm_spread", "b_hour_median"))},
 n AS points FROM st JOIN (SELECT ts, count(*) FILTER (by_volume OR by_zero OR thin)::INT AS n FROM cg GROUP BY 1) USING (ts)""")
def bar_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """What the three detectors see of each bar, and how many points of C's grid flag it."""
    points = F.size(F.filter("c", lambda x: x["by_volume"] | x["by_zero"] | x["thin"]))
    return rounds(_stats(spark, sf).withColumn("points", points).drop("c"), [])


@query(f"""WITH {_STATS}, bk(kind, v) AS (SELECT 'mean_spread', round(b_mean_spread, 6) FROM st UNION ALL SELECT 'arm_spread', round(b_arm_spread, 6) FROM st UNION ALL SELECT 'hour_median', round(b_hour_median, 6) FROM st)
 SELECT 'A' AS detector, 'loo' AS kind, t AS threshold, NULL::DOUBLE AS share, count(*) AS defined, count(*) FILTER (round(max_abs, 6) > t) AS flagged, NULL::BIGINT AS by_volume, NULL::BIGINT AS by_zero, NULL::BIGINT AS thin FROM st, (SELECT unnest({list(_A)})::DOUBLE AS t) GROUP BY t
 UNION ALL SELECT 'B', kind, t, NULL, count(v), count(*) FILTER (v > t), NULL, NULL, NULL FROM bk, (SELECT unnest({list(_B)})::DOUBLE AS t) GROUP BY kind, t
 UNION ALL SELECT 'C', 'grid', stale, share, count(*), count(*) FILTER (by_volume OR by_zero OR thin), count(*) FILTER (by_volume), count(*) FILTER (by_zero), count(*) FILTER (thin) FROM cg GROUP BY stale, share""")
def flag_grids(spark: SparkSession, sf: str) -> DataFrame:
    """Bars that A's six thresholds, B's six by its three scales, and C's three volumes by three shares would flag."""
    s = _stats(spark, sf).withColumns({c: F.round(c, 6) for c in ("max_abs", *[f"b_{k}" for k in calibration.B_KINDS])})
    return calibration.flag_grids(s, _A, _B, _STALE, _THIN)
