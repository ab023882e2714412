"""Queries of the investigations of residuals, over triangles of regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, investigate
from ..sources.views import QUOTES, quotes

QUERIES: dict = {}
ORACLES: dict = {}
_DRAW = "('0x' || substr(md5({}), 1, 12))::BIGINT"
_DRAWS = 300


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def plain(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 5) + 0.0 for c, kind in df.dtypes if kind == "double"})


def _legs(q: DataFrame) -> DataFrame:
    return graph.triangle_legs(graph.triangles(q))


def _frame(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    q = quotes(spark, sf)
    legs = _legs(q)
    return investigate.frame(investigate.leg_ranges(q), legs), legs, q


_SIDES = ", ".join(f"{a}({r}) AS {r}_{a}" for r in investigate.RANGES for a in investigate.PUT_TOGETHER)
_FRAME = f"""{QUOTES}, lr AS (SELECT *, ln(hi / lo) * 10000 AS R2, abs(ln(hi / bid)) * 10000 AS R3, abs(ln(ask / lo)) * 10000 AS R4, coalesce(abs(ln(((bid + ask) / 2) / lag((bid + ask) / 2) OVER (PARTITION BY a, b ORDER BY ts))) * 10000, ln(hi / lo) * 10000) AS R5, power(ln(hi / lo) * 10000, 2) / (4 * ln(2)) AS R6 FROM quotes),
 pr AS (SELECT DISTINCT a, b FROM quotes), tri AS (SELECT x.a || '-' || x.b || '-' || y.b AS cycle, x.a AS p, x.b AS q, y.b AS r FROM pr x JOIN pr y ON x.b = y.a JOIN pr z ON z.a = x.a AND z.b = y.b),
 lg AS (SELECT cycle, 0 AS leg, p AS a, q AS b, 1 AS d FROM tri UNION ALL SELECT cycle, 1, q, r, 1 FROM tri UNION ALL SELECT cycle, 2, p, r, -1 FROM tri),
 fr0 AS (SELECT cycle, ts, sum(d * ln((bid + ask) / 2) * 10000) AS resid, sum(ln(ask / bid) * 10000) AS spread, {_SIDES}, CASE WHEN count(volume) = 3 THEN min(volume) END AS volume_min FROM lr JOIN lg USING (a, b) WHERE bid > 0 AND bid < ask GROUP BY ALL HAVING count(*) = 3),
 fr AS (SELECT *, abs(resid) AS size, CASE WHEN spread > 0 THEN abs(resid) / spread END AS ratio, CASE WHEN abs(resid) > 10 THEN 'suspect' WHEN spread <= 0 THEN 'unrated' WHEN abs(resid) / spread <= 0.25 THEN 'clean' WHEN abs(resid) / spread <= 1 THEN 'noisy' ELSE 'suspect' END AS tier FROM fr0)"""
_RANK = "rank() OVER (PARTITION BY cycle, col ORDER BY {0}) + (count(*) OVER (PARTITION BY cycle, col, {0}) - 1) / 2.0::DOUBLE"


@query(f"""WITH {_FRAME}, lo AS ({' UNION ALL '.join(f"SELECT cycle, ts, size, ratio, '{c}' AS col, {c}::DOUBLE AS x FROM fr WHERE {c} IS NOT NULL" for c in investigate.COLUMNS)}),
 rk AS (SELECT *, {_RANK.format('x')} AS rx, {_RANK.format('size')} AS rs, {_RANK.format('ratio')} AS rr, floor((10 * row_number() OVER (PARTITION BY cycle, col ORDER BY x, ts) - 1) / count(*) OVER (PARTITION BY cycle, col)) AS dec FROM lo),
 t AS (SELECT cycle, col, dec, quantile_cont(size, 0.99) AS p FROM rk GROUP BY ALL), tt AS (SELECT cycle, col, max(p) FILTER (dec = 0) AS p_first, max(p) FILTER (dec = 9) AS p_last FROM t GROUP BY ALL),
 pe AS (SELECT cycle, col, count(*) AS n, coalesce(covar_pop(rx, rs) / nullif(sqrt(var_pop(rx) * var_pop(rs)), 0), 0) AS rho_size, coalesce(covar_pop(rx, rr) / nullif(sqrt(var_pop(rx) * var_pop(rr)), 0), 0) AS rho_ratio FROM rk GROUP BY ALL)
 SELECT cycle, col AS "column", n, CASE WHEN n >= 10 THEN round(rho_size, 5) + 0.0 END AS rho_size, CASE WHEN n >= 10 THEN round(rho_ratio, 5) + 0.0 END AS rho_ratio, CASE WHEN n >= 10 THEN round(p_first, 5) + 0.0 END AS p99_first, CASE WHEN n >= 10 THEN round(p_last, 5) + 0.0 END AS p99_last FROM pe JOIN tt USING (cycle, col)""")
def thin_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Eleven columns of each triangle's bars against its residual: rank correlations, and the residual's tail in the first and last tenth."""
    f, _, _ = _frame(spark, sf)
    t = investigate.thin_bars(f)
    return plain(t.select("cycle", "column", "n", "rho_size", "rho_ratio", F.get("p99s", F.lit(0)).alias("p99_first"), F.get("p99s", F.lit(9)).alias("p99_last")))


_BIAS = f"""{_FRAME}, g AS (SELECT cycle, count(*) AS n, count(DISTINCT ts::DATE) AS n_days, avg(resid) AS mean, quantile_cont(resid, 0.5) AS median, avg(resid) FILTER (tier <> 'suspect') AS mean_rated, quantile_cont(resid, 0.01) AS lo, quantile_cont(resid, 0.99) AS hi,
  regr_slope(resid, spread) AS slope, regr_intercept(resid, spread) AS intercept, coalesce(covar_pop(resid, spread) / nullif(sqrt(var_pop(resid) * var_pop(spread)), 0), 0) AS r FROM fr GROUP BY 1),
 w AS (SELECT cycle, avg(least(greatest(resid, lo), hi)) AS winsorised FROM fr JOIN g USING (cycle) GROUP BY 1), dy AS (SELECT cycle, ts::DATE AS day, resid FROM fr), ix AS (SELECT *, row_number() OVER (PARTITION BY cycle ORDER BY day) - 1 AS ix, count(*) OVER (PARTITION BY cycle) AS m FROM (SELECT DISTINCT cycle, day FROM dy)),
 dr AS (SELECT cycle, iter, {_DRAW.format("concat_ws('|', '7', iter::VARCHAR, k::VARCHAR)")} % m AS ix FROM (SELECT *, unnest(range(m)) AS k FROM (SELECT DISTINCT cycle, m FROM ix), range({_DRAWS}) q(iter))),
 s AS (SELECT cycle, iter, avg(resid) AS mean, quantile_cont(resid, 0.5) AS median FROM dr JOIN ix USING (cycle, ix) JOIN dy USING (cycle, day) GROUP BY ALL),
 iv AS (SELECT cycle, quantile_cont(mean, 0.025) AS mean_low, quantile_cont(mean, 0.975) AS mean_high, quantile_cont(median, 0.025) AS median_low, quantile_cont(median, 0.975) AS median_high FROM s GROUP BY 1),
 bi AS (SELECT g.*, winsorised, mean_low, mean_high, median_low, median_high, mean_low <= 0 AND mean_high >= 0 AS mean_has_zero, median_low <= 0 AND median_high >= 0 AS median_has_zero FROM g JOIN w USING (cycle) JOIN iv USING (cycle))"""
_R = lambda *names: ", ".join(f"round({n}, 5) + 0.0 AS {n}" for n in names)


@query(f"WITH {_BIAS} SELECT cycle, n, n_days, {_R('mean', 'median', 'mean_rated', 'winsorised', 'mean_low', 'mean_high', 'median_low', 'median_high', 'slope', 'intercept', 'r')}, mean_has_zero, median_has_zero FROM bi")
def residual_bias(spark: SparkSession, sf: str) -> DataFrame:
    """Whether triangles' residuals are biased: means, medians and their intervals by days, and the slope on the spread."""
    f, _, _ = _frame(spark, sf)
    return plain(investigate.bias(f, iterations=_DRAWS))


_DESIGNATED = f"""{_BIAS}, de AS (SELECT cycle, leg, d, -d * mean AS mean, least(-d * mean_low, -d * mean_high) AS mean_low, greatest(-d * mean_low, -d * mean_high) AS mean_high, mean_has_zero, -d * median AS median, least(-d * median_low, -d * median_high) AS median_low, greatest(-d * median_low, -d * median_high) AS median_high, median_has_zero FROM bi JOIN lg USING (cycle))"""


@query(f"WITH {_DESIGNATED} SELECT cycle, leg, d, {_R('mean', 'mean_low', 'mean_high', 'median', 'median_low', 'median_high')}, mean_has_zero, median_has_zero FROM de")
def leg_designations(spark: SparkSession, sf: str) -> DataFrame:
    """Each leg of each triangle called the direct one."""
    f, legs, _ = _frame(spark, sf)
    return plain(investigate.designations(investigate.bias(f, iterations=_DRAWS), legs))


@query(f"WITH {_DESIGNATED}, c AS (SELECT cycle, count(*) AS n, count(*) FILTER (mean > 0) AS up FROM de GROUP BY 1) SELECT count(*) AS cycles, product(n)::BIGINT AS combinations, (product(up) + product(n - up))::BIGINT AS all_same_sign FROM c")
def sign_combinations(spark: SparkSession, sf: str) -> DataFrame:
    """How many choices of one leg a triangle have means of one sign."""
    f, legs, _ = _frame(spark, sf)
    return investigate.sign_combinations(investigate.designations(investigate.bias(f, iterations=_DRAWS), legs))


@query(f"""WITH {_FRAME}, rq AS (SELECT a, b, round(bid, (2 + len(b) % 3)::INT) AS bid, round(ask, (2 + len(b) % 3)::INT) AS ask FROM quotes), de AS (SELECT a, b, CASE WHEN bool_and(round(bid, 2) = bid AND round(ask, 2) = ask) THEN 2 WHEN bool_and(round(bid, 3) = bid AND round(ask, 3) = ask) THEN 3 ELSE 4 END AS k, quantile_cont((bid + ask) / 2, 0.5) AS mid FROM rq GROUP BY ALL),
 fl AS (SELECT cycle, sqrt(sum(power(10.0, -2 * k) / 24 / (mid * mid))) * 10000 AS floor FROM lg JOIN de USING (a, b) GROUP BY 1) SELECT cycle, round(floor, 8) AS floor, round(floor / sqrt(n), 8) AS floor_of_mean FROM fl JOIN (SELECT cycle, count(*) AS n FROM fr GROUP BY 1) USING (cycle)""")
def rounding_floor(spark: SparkSession, sf: str) -> DataFrame:
    """What rounding prices to two, three or four decimals, by pair, does to residuals."""
    f, legs, q = _frame(spark, sf)
    places = 2 + F.length("b") % 3
    at = lambda c: F.when(places == 2, F.round(c, 2)).when(places == 3, F.round(c, 3)).otherwise(F.round(c, 4)).alias(c)
    out = investigate.rounding_floor(investigate.price_decimals(q.select("ts", "a", "b", at("bid"), at("ask"))), legs, f)
    return out.select("cycle", F.round("floor", 8).alias("floor"), F.round("floor_of_mean", 8).alias("floor_of_mean"))
