"""Queries of the market model, of names and time rules, of parameter grids of the detectors, and of groups of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import timepolicy
from ..functions.numbers import rounded as r
from ..operators import backtest, correlate, experiments, market, metrics, runlevel, validate
from ..sources.views import BARS, EQUITY, QUOTES, TRADES, bars, equity, quotes, table, trades
from .candle_queries import rounds
from .study_queries import _CORR, _corr

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_NAMES = "names AS (SELECT DISTINCT event_type || (CASE WHEN event_id % 3 = 0 THEN '/' WHEN event_id % 3 = 1 THEN '_' ELSE '' END) || (CASE WHEN event_id % 7 = 0 THEN '' ELSE 'usd' END) || (CASE WHEN event_id % 11 = 0 THEN '_x' ELSE '' END) AS name FROM events)"


@query(f"""WITH {_NAMES}, p AS (SELECT name, contains(name, '/') AS crypto, string_split(name, CASE WHEN contains(name, '/') THEN '/' ELSE '_' END) AS s FROM names)
 SELECT name, crypto, CASE WHEN len(s) = 2 AND s[1] <> '' AND s[2] <> '' THEN s[1] END AS base, CASE WHEN len(s) = 2 AND s[1] <> '' AND s[2] <> '' THEN s[2] END AS quote FROM p""")
def pair_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names made of event types, some of which aren't pairs."""
    i = F.col("event_id")
    name = F.concat("event_type", F.when(i % 3 == 0, "/").when(i % 3 == 1, "_").otherwise(""), F.when(i % 7 == 0, "").otherwise("usd"), F.when(i % 11 == 0, "_x").otherwise(""))
    n = table(spark, sf, "events").select(name.alias("name")).distinct()
    return n.select("name", market.is_crypto(F.col("name")).alias("crypto"), market.split_pair(F.col("name"))["base"].alias("base"), market.split_pair(F.col("name"))["quote"].alias("quote"))


_EDGES = """edges AS (SELECT l_orderkey * 8 + l_linenumber AS edge, CASE l_linenumber % 5 WHEN 0 THEN 'VENUE' WHEN 1 THEN 'BASIS' ELSE 'QUOTED' END AS kind, 'A' || l_suppkey % 5 AS base, 'A' || l_partkey % 5 AS quote, 'v' || l_orderkey % 3 AS venue, CASE WHEN l_linenumber % 2 = 1 THEN 'v' || l_suppkey % 3 END AS venue_b,
 'A' || l_suppkey % 5 || '_' || 'A' || l_partkey % 5 AS instrument, l_extendedprice - CASE WHEN l_quantity > 45 THEN 1e9 ELSE 0 END AS bid, l_extendedprice * (1 + l_tax - CASE WHEN l_discount > 0.09 THEN 0.05 ELSE 0 END) AS ask, l_linenumber % 3 > 0 AS spread_known FROM lineitem)"""
_PROBLEM = """CASE WHEN base = '' OR quote = '' OR venue = '' THEN 'empty name' WHEN NOT (bid > 0 AND bid <= ask) THEN 'prices' WHEN kind = 'VENUE' AND (base <> quote OR coalesce(venue_b, '') = '' OR venue_b = venue) THEN 'venues' WHEN kind <> 'VENUE' AND base = quote THEN 'one asset' END"""


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    base, quote = F.concat(F.lit("A"), F.col("l_suppkey") % 5), F.concat(F.lit("A"), F.col("l_partkey") % 5)
    return x.select(
        (F.col("l_orderkey") * 8 + n).alias("edge"), F.when(n % 5 == 0, "VENUE").when(n % 5 == 1, "BASIS").otherwise("QUOTED").alias("kind"), base.alias("base"), quote.alias("quote"), F.concat(F.lit("v"), F.col("l_orderkey") % 3).alias("venue"),
        F.when(n % 2 == 1, F.concat(F.lit("v"), F.col("l_suppkey") % 3)).alias("venue_b"), F.concat_ws("_", base, quote).alias("instrument"), (F.col("l_extendedprice") - F.when(F.col("l_quantity") > 45, 1e9).otherwise(0.0)).alias("bid"),
        (F.col("l_extendedprice") * (1 + F.col("l_tax") - F.when(F.col("l_discount") > 0.09, 0.05).otherwise(0.0))).alias("ask"), (n % 3 > 0).alias("spread_known"),
    )


@query(f"WITH {_EDGES} SELECT kind, coalesce({_PROBLEM}, 'none') AS problem, count(*) AS n FROM edges GROUP BY ALL")
def edge_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as edges between ten assets at three venues, and what keeps a row from being one."""
    p = market.problem(_edges(spark, sf))
    return p.groupBy("kind", F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


_ORIENTED = f"""{_EDGES}, ok AS (SELECT *, CASE WHEN kind = 'VENUE' THEN coalesce(venue > venue_b, false) ELSE base > quote END AS turn FROM edges WHERE {_PROBLEM} IS NULL),
 ori AS (SELECT edge, kind, CASE WHEN turn THEN quote ELSE base END AS base, CASE WHEN turn THEN base ELSE quote END AS quote, CASE WHEN turn THEN coalesce(venue_b, venue) ELSE venue END AS venue, CASE WHEN turn AND venue_b IS NOT NULL THEN venue ELSE venue_b END AS venue_b,
 instrument, CASE WHEN turn AND kind <> 'VENUE' THEN 1 / ask ELSE bid END AS bid, CASE WHEN turn AND kind <> 'VENUE' THEN 1 / bid ELSE ask END AS ask, spread_known FROM ok)"""


def _oriented(spark: SparkSession, sf: str) -> DataFrame:
    return market.oriented(market.problem(_edges(spark, sf)).where("problem IS NULL").drop("problem"))


@query(f"WITH {_ORIENTED} SELECT kind, base, quote, venue, venue_b, count(*) AS n, round(avg(ln(bid)), 6) AS bid, round(avg(ln(ask)), 6) AS ask FROM ori GROUP BY ALL")
def oriented_edges(spark: SparkSession, sf: str) -> DataFrame:
    o = _oriented(spark, sf)
    return rounds(o.groupBy("kind", "base", "quote", "venue", "venue_b").agg(F.count(F.lit(1)).alias("n"), F.avg(F.log("bid")).alias("bid"), F.avg(F.log("ask")).alias("ask")), [])


@query(f"""WITH {_ORIENTED}, p AS (SELECT 'asset' AS mode, '*' AS graph, base AS a, quote AS b FROM ori WHERE kind <> 'VENUE' UNION ALL SELECT 'asset_venue', '*', base || '@' || venue, quote || '@' || coalesce(venue_b, venue) FROM ori
 UNION ALL SELECT 'per_venue', venue, base, quote FROM ori WHERE kind <> 'VENUE' AND coalesce(venue_b, venue) = venue) SELECT mode, graph, a, b, count(*) AS edges FROM p WHERE a <> b GROUP BY ALL""")
def graph_projections(spark: SparkSession, sf: str) -> DataFrame:
    o, out = _oriented(spark, sf), None
    for mode in market.MODES:
        p = market.project(o, mode).groupBy(F.lit(mode).alias("mode"), "graph", "a", "b").agg(F.count(F.lit(1)).alias("edges"))
        out = p if out is None else out.unionByName(p)
    return out


#: A ring of a square with one diagonal per nation pair of a region: walks whose last leg may lead astray.
_WALKS = """e AS (SELECT n_regionkey AS g, n_name AS x, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INT AS i FROM nation), k AS (SELECT g, max(i) AS n FROM e GROUP BY 1),
 w AS (SELECT e.g, e.i, e.x AS a, f.x AS b FROM e JOIN k USING (g) JOIN e f ON f.g = e.g AND f.i = CASE WHEN e.i = n THEN CASE WHEN e.g % 2 = 0 THEN 1 ELSE 2 END ELSE e.i + 1 END)"""


def _walks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(walks, ends) of the nations of each region in a ring; in odd regions the last leg misses the first nation."""
    own = Window.partitionBy("g")
    e = table(spark, sf, "nation").select(F.col("n_regionkey").alias("g"), F.col("n_name").alias("x"), "n_nationkey")
    e = e.withColumn("i", F.row_number().over(own.orderBy("n_nationkey"))).withColumn("n", F.max("i").over(own))
    to = F.when(F.col("i") < F.col("n"), F.col("i") + 1).when(F.col("g") % 2 == 0, 1).otherwise(2)
    f = e.select(F.col("g").alias("h"), F.col("i").alias("j"), F.col("x").alias("b"))
    w = e.withColumn("to", to).join(f, (F.col("g") == F.col("h")) & (F.col("to") == F.col("j"))).select("g", "i", F.col("x").alias("a"), "b", (F.col("g") * 100 + F.col("i")).alias("edge"))
    return w.select(F.concat(F.lit("ring"), "g").alias("cycle"), F.col("i").alias("leg"), "edge", F.lit(1).alias("d")), w.select("edge", "a", "b")


@query(f"WITH {_WALKS} SELECT 'ring' || g AS cycle, g % 2 = 0 AS closed FROM w GROUP BY g")
def closed_walks(spark: SparkSession, sf: str) -> DataFrame:
    return market.closed(*_walks(spark, sf))


_KINDS = """CASE WHEN i = 2 AND g = 3 THEN 'BASIS' ELSE 'QUOTED' END AS kind, a || CASE WHEN g % 2 = 1 THEN '/' ELSE '_' END || b AS instrument, 'v' || i % 2 AS venue"""


def _leg_edges(ends: DataFrame) -> DataFrame:
    g, i = F.floor(F.col("edge") / 100), F.col("edge") % 100
    return ends.select("edge", F.when((i == 2) & (g == 3), "BASIS").otherwise("QUOTED").alias("kind"), F.concat("a", F.when(g % 2 == 1, "/").otherwise("_"), "b").alias("instrument"), F.concat(F.lit("v"), i % 2).alias("venue"), F.lit(None).cast("string").alias("venue_b"))


@query(f"WITH {_WALKS}, l AS (SELECT g, {_KINDS} FROM w) SELECT 'ring' || g AS cycle, string_agg(DISTINCT instrument || '|' || venue || '|', ',' ORDER BY instrument || '|' || venue || '|') AS signature FROM l GROUP BY g")
def cycle_signatures(spark: SparkSession, sf: str) -> DataFrame:
    w, ends = _walks(spark, sf)
    return market.signatures(w, _leg_edges(ends))


@query(f"""WITH {_WALKS}, l AS (SELECT g, i, {_KINDS} FROM w) SELECT 'ring' || g AS cycle, count(*) AS legs, CASE WHEN bool_or(kind = 'BASIS') THEN 'basis' WHEN count(*) FILTER (contains(instrument, '/')) = 0 AND count(*) = 3 THEN 'triangle' WHEN bool_or(contains(instrument, '/')) THEN 'crypto_only' ELSE 'fx_other' END AS class,
 string_agg('+' || instrument, ' ' ORDER BY i) FILTER (kind = 'QUOTED') AS label FROM l GROUP BY g""")
def cycle_classes(spark: SparkSession, sf: str) -> DataFrame:
    w, ends = _walks(spark, sf)
    return market.classes(w, _leg_edges(ends))


@query(r"""WITH l AS (SELECT 'pre ' || l_returnflag || ': ' || CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END || l_returnflag || CASE WHEN l_linenumber % 3 = 0 THEN ' ' ELSE ' +' END || l_linestatus AS label FROM lineitem GROUP BY 1)
 SELECT label, CASE WHEN regexp_full_match(t[1], '[+-]\S+') AND regexp_full_match(t[2], '[+-]\S+') AND t[1][2:] <> t[2][2:] THEN t[1][2:] || (CASE WHEN t[1][1] = '+' THEN ' 1' ELSE ' -1' END) || ', ' || t[2][2:] || (CASE WHEN t[2][1] = '+' THEN ' 1' ELSE ' -1' END) END AS legs
 FROM (SELECT label, string_split(regexp_replace(label, '^.*?: ', ''), ' ') AS t FROM l)""")
def cycle_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels made of lines' columns, some of which have a leg without a sign or a name twice."""
    n = F.col("l_linenumber")
    label = F.concat(F.lit("pre "), "l_returnflag", F.lit(": "), F.when(n % 2 == 0, "+").otherwise("-"), "l_returnflag", F.when(n % 3 == 0, " ").otherwise(" +"), "l_linestatus")
    l = table(spark, sf, "lineitem").select(label.alias("label")).distinct()
    return l.select("label", F.array_join(F.transform(market.legs_of_label(F.col("label")), lambda x: F.concat_ws(" ", x["instrument"], x["d"].cast("string"))), ", ").alias("legs"))


@query("""SELECT l_linenumber, l_quantity, round(CASE WHEN abs(u) < 5 THEN 0 ELSE sign(u) * round_even(abs(u) / 3, 0) * 3 END, 6) AS lot FROM (SELECT DISTINCT l_linenumber, l_quantity, CASE WHEN l_linenumber % 2 = 0 THEN -l_quantity ELSE l_quantity END / 2 AS u FROM lineitem)""")
def lots(spark: SparkSession, sf: str) -> DataFrame:
    """Signed half quantities by the lot rules: 0 under 5, else the nearest multiple of 3, halves to even."""
    u = F.when(F.col("l_linenumber") % 2 == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity")) / 2
    x = table(spark, sf, "lineitem").select("l_linenumber", "l_quantity").distinct()
    return x.select("l_linenumber", "l_quantity", r(backtest.Costs(min_order_size=5.0, lot_step=3.0).lot(u) + 0.0).alias("lot"))


@query("""SELECT name, n::INT AS n, k::INT AS k, round(CASE name WHEN 'flat' THEN 1 WHEN 'ramp' THEN (k + 1) / n WHEN 'decay' THEN (n - k) / n WHEN 'pulse' THEN sin(pi() * (k + 0.5) / n) WHEN 'expdecay' THEN exp(-3.0 * k / n) ELSE CASE WHEN k < 2 THEN 1 ELSE 0.25 END END, 6) AS unit
 FROM (VALUES ('flat'), ('ramp'), ('decay'), ('pulse'), ('expdecay'), ('step_plateau')) s(name), (SELECT DISTINCT l_linenumber + 2 AS n FROM lineitem), range(12) r(k) WHERE k < n""")
def fault_shapes(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    lengths = table(spark, sf, "lineitem").select((F.col("l_linenumber") + 2).cast("int").alias("n")).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    for name in (*experiments.SHAPES, "step_plateau"):
        part = lengths.select(F.lit(name).alias("name"), "n", "k", r(experiments.shape(name, F.col("k"), F.col("n"), 8.0, 2, 2.0).cast("double")).alias("unit"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {BARS}, s AS (SELECT instrument, ts, (ask_close - bid_close) / mid * 10000 AS v FROM bars) SELECT instrument, count(*) AS n, round(sum(CASE WHEN v > 150 THEN v ELSE 0 END), 4) AS gated, count(*) FILTER (v > 150) AS open FROM s GROUP BY 1""")
def gated_estimates(spark: SparkSession, sf: str) -> DataFrame:
    s = bars(spark, sf).select("instrument", ((F.col("ask_close") - F.col("bid_close")) / F.col("mid") * 1e4).alias("v")).withColumn("g", runlevel.gated_estimate(F.col("v"), F.col("v") > 150))
    return rounds(s.groupBy("instrument").agg(F.count(F.lit(1)).alias("n"), F.sum("g").alias("gated"), F.count_if(F.col("g") > 0).alias("open")), [], 4)


@query(f"""WITH {TRADES}, m AS (SELECT grp, sum(pnl) / 100 AS ret, sum(commission) / abs(sum(pnl) + sum(commission)) * 100 AS drag FROM trades GROUP BY 1) SELECT grp, round(ret, 4) AS total_return_pct, round(drag, 4) AS cost_drag_pct, round(ret * greatest(1 - drag / 100, 0), 4) AS adjusted FROM m""")
def cost_adjusted_returns(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.trade_metrics(trades(spark, sf), ["grp"]).select("grp", "total_return_pct", "cost_drag_pct")
    return rounds(m.withColumn("adjusted", validate.cost_adjusted(F.col("total_return_pct"), F.col("cost_drag_pct"))), [], 4)


_CELL = "CASE WHEN uk AND us THEN 'both_summer' WHEN us THEN 'uk_winter_us_summer' WHEN uk THEN 'uk_summer_us_winter' ELSE 'both_winter' END"
_MOVED = f"""{BARS}, z AS (SELECT *, date_diff('hour', ts, ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London') = 1 AS uk, date_diff('hour', ts, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') = -4 AS us FROM (SELECT instrument, ts + INTERVAL (m) MONTH AS ts, (ask_close - bid_close) / mid * 10000 AS spread FROM bars, (VALUES (0), (2), (6)) v(m))),
 cl AS (SELECT *, {_CELL} AS cell, hour(ts) AS h, (hour(ts) - CASE WHEN us THEN 21 ELSE 22 END + 24) % 24 AS o FROM z),
 gm AS (SELECT instrument, ts, spread, cell, unnest(list_filter(['all', CASE WHEN h BETWEEN 8 AND 15 THEN 'flat' END, CASE WHEN o = 0 THEN 'rollover_ny' END, CASE WHEN o IN (1, 23) THEN 'adjacent_ny' END, CASE WHEN h = 21 THEN 'utc21_legacy' END], lambda x: x IS NOT NULL)) AS class FROM cl)"""


def _moved(spark: SparkSession, sf: str) -> DataFrame:
    """Spreads of bars, also moved on by 2 and 6 months, with their daylight-saving cell and, a row each, hour classes."""
    b = bars(spark, sf).withColumn("m", F.explode(F.array(F.lit(0), F.lit(2), F.lit(6)))).withColumn("ts", F.col("ts") + F.make_ym_interval(F.lit(0), F.col("m")))
    b = b.select("instrument", "ts", ((F.col("ask_close") - F.col("bid_close")) / F.col("mid") * 1e4).alias("spread"))
    return b.withColumn("cell", timepolicy.dst_cell(F.col("ts"))).withColumn("class", F.explode(timepolicy.hour_classes(F.col("ts"))))


@query(f"WITH {_MOVED} SELECT cell, class, count(*) AS n FROM gm GROUP BY ALL")
def hour_classes(spark: SparkSession, sf: str) -> DataFrame:
    return _moved(spark, sf).groupBy("cell", "class").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_MOVED}, gr AS (SELECT class AS grp, spread FROM gm UNION ALL SELECT 'h' || lpad(hour(ts)::VARCHAR, 2, '0'), spread FROM gm WHERE class = 'all' UNION ALL SELECT cell || '|' || class, spread FROM gm WHERE class IN ('rollover_ny', 'adjacent_ny', 'flat'))
 SELECT grp, count(*) AS n, CASE WHEN count(*) >= 30 THEN round(quantile_cont(spread, 0.5), 6) END AS p50, CASE WHEN count(*) >= 30 THEN round(quantile_cont(spread, 0.9), 6) END AS p90, CASE WHEN count(*) >= 30 THEN round(quantile_cont(spread, 0.99), 6) END AS p99 FROM gr GROUP BY 1""")
def group_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Spreads by every group that a bar is in: its hour's classes, its hour, classes by daylight-saving cell; under 30 bars only the count."""
    g = _moved(spark, sf)
    own = F.when(F.col("class") == "all", F.date_format("ts", "'h'HH"))
    cell = F.when(F.col("class").isin("rollover_ny", "adjacent_ny", "flat"), F.concat_ws("|", "cell", "class"))
    e = g.select(F.explode(F.array("class", own, cell)).alias("grp"), "spread").where("grp IS NOT NULL")
    p = F.percentile("spread", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    a = e.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), p.alias("p"))
    ok = F.col("n") >= 30
    return rounds(a.select("grp", "n", *[F.when(ok, F.col("p")[i]).alias(c) for i, c in enumerate(("p50", "p90", "p99"))]), [])


_GRID_A, _GRID_V = (50.0, 100.0, 150.0, 170.0, 190.0, 199.0), (1.0, 2.0, 5.0)


@query(f"""WITH {BARS}, m AS (SELECT ts, max((ask_close - bid_close) / mid * 10000) AS widest, min(volume) AS least FROM bars GROUP BY 1)
 SELECT 'A' AS detector, x AS threshold, count(*) FILTER (widest > x) AS flags, count(*) AS bars FROM m, (VALUES {', '.join(f'({x}::DOUBLE)' for x in _GRID_A)}) g(x) GROUP BY ALL
 UNION ALL SELECT 'C', x, count(*) FILTER (least <= x), count(*) FROM m, (VALUES {', '.join(f'({x}::DOUBLE)' for x in _GRID_V)}) g(x) GROUP BY ALL""")
def flag_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Bars flagged at every threshold of a grid: one aggregate with a count each, unpivoted."""
    m = bars(spark, sf).groupBy("ts").agg(F.max((F.col("ask_close") - F.col("bid_close")) / F.col("mid") * 1e4).alias("widest"), F.min("volume").alias("least"))
    counts = [F.struct(F.lit("A").alias("detector"), F.lit(x).alias("threshold"), F.count_if(F.col("widest") > x).alias("flags")) for x in _GRID_A]
    counts += [F.struct(F.lit("C").alias("detector"), F.lit(x).alias("threshold"), F.count_if(F.col("least") <= x).alias("flags")) for x in _GRID_V]
    return m.agg(F.array(*counts).alias("g"), F.count(F.lit(1)).alias("bars")).select(F.explode("g").alias("g"), "bars").select("g.*", "bars")


@query(f"""WITH {BARS}, s AS (SELECT instrument, (ask_close - bid_close) / mid * 10000 AS v, volume, high_ FROM (SELECT *, bid_high - bid_low AS high_ FROM bars)) SELECT instrument, count(*) AS n, {', '.join(f'round(quantile_cont(v, {q}), 6) AS spread_p{int(q * 100)}' for q in (0.1, 0.5, 0.9, 0.99))},
 {', '.join(f'round(quantile_cont(volume, {q}), 6) AS volume_p{int(q * 100)}' for q in (0.01, 0.05, 0.5))}, round(count(*) FILTER (high_ = 0)::DOUBLE / count(*), 6) AS zero_range_share, round(count(*) FILTER (volume <= 2)::DOUBLE / count(*), 6) AS volume_le_2_share FROM s GROUP BY 1""")
def pair_stats(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).select("instrument", ((F.col("ask_close") - F.col("bid_close")) / F.col("mid") * 1e4).alias("v"), "volume", (F.col("bid_high") - F.col("bid_low")).alias("span"))
    s, v = F.percentile("v", F.array(*map(F.lit, (0.1, 0.5, 0.9, 0.99)))), F.percentile("volume", F.array(*map(F.lit, (0.01, 0.05, 0.5))))
    n = F.count(F.lit(1))
    g = b.groupBy("instrument").agg(n.alias("n"), s.alias("s"), v.alias("v"), (F.count_if(F.col("span") == 0) / n).alias("zero_range_share"), (F.count_if(F.col("volume") <= 2) / n).alias("volume_le_2_share"))
    return rounds(g.select("instrument", "n", *[F.col("s")[i].alias(f"spread_p{q}") for i, q in enumerate((10, 50, 90, 99))], *[F.col("v")[i].alias(f"volume_p{q}") for i, q in enumerate((1, 5, 50))], "zero_range_share", "volume_le_2_share"), [])


_SPREADS = f"{BARS}, sp AS (SELECT instrument, ts, ln(greatest((ask_close - bid_close) / mid * 10000, 1e-9)) AS v FROM bars), sc AS (SELECT x.instrument AS a, y.instrument AS b, count(*) AS n, CASE WHEN x.instrument = y.instrument THEN 1.0 ELSE coalesce(covar_pop(x.v, y.v) / nullif(sqrt(var_pop(x.v) * var_pop(y.v)), 0), 0) END AS corr FROM sp x JOIN sp y ON x.ts = y.ts AND x.instrument <= y.instrument GROUP BY 1, 2)"


@query(f"WITH {_SPREADS} SELECT a, b, n, round(corr, 6) AS corr, round(avg(CASE WHEN a < b THEN corr END) OVER (), 6) AS mean_off FROM sc")
def spread_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation of log spreads of all pairs of series, with the mean of those off the diagonal."""
    v = bars(spark, sf).select("instrument", "ts", F.log(F.greatest((F.col("ask_close") - F.col("bid_close")) / F.col("mid") * 1e4, F.lit(1e-9))).alias("v"))
    m = correlate.matrix(v, "instrument", "ts", "v")
    off = m.where("a < b").agg(F.avg("corr").alias("mean_off"))
    return rounds(m.crossJoin(F.broadcast(off)), [])  # off is one row


@query(f"""WITH {BARS}, i AS (SELECT DISTINCT instrument FROM bars), t AS (SELECT DISTINCT ts FROM bars), m AS (SELECT ts, string_agg(instrument, ',' ORDER BY instrument) AS missing FROM (SELECT ts, instrument FROM t, i EXCEPT SELECT ts, instrument FROM bars) GROUP BY 1)
 SELECT missing, count(*) AS bars FROM m GROUP BY 1 ORDER BY bars DESC, missing LIMIT 30""")
def missing_sets(spark: SparkSession, sf: str) -> DataFrame:
    """The 30 most common sets of series that a bar lacks."""
    b = bars(spark, sf).select("instrument", "ts")
    every = b.groupBy().agg(F.array_sort(F.collect_set("instrument")).alias("all"))  # names of series: some tens
    have = b.groupBy("ts").agg(F.collect_set("instrument").alias("have"))
    m = have.crossJoin(F.broadcast(every)).select(F.array_join(F.array_except("all", "have"), ",").alias("missing")).where("missing <> ''")
    return m.groupBy("missing").agg(F.count(F.lit(1)).alias("bars")).orderBy(F.desc("bars"), "missing").limit(30)


@query(f"WITH {TRADES}, g AS (SELECT l_orderkey % 50 AS node, grp, max(pnl) AS score FROM trades GROUP BY ALL) SELECT node, grp, round(score, 4) AS score, rank() OVER (PARTITION BY node ORDER BY score DESC)::INT AS rank FROM g")
def group_ranks(spark: SparkSession, sf: str) -> DataFrame:
    g = trades(spark, sf).groupBy((F.col("l_orderkey") % 50).alias("node"), "grp").agg(F.max("pnl").alias("score"))
    return rounds(g.withColumn("rank", F.rank().over(Window.partitionBy("node").orderBy(F.desc("score")))), [], 4)


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000000000Z' AS stored, epoch(date_trunc('second', ts))::BIGINT AS epoch, strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London', '%Y-%m-%d %H:%M') AS london, strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:%M') AS new_york,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE strftime(ts - CASE WHEN event_id % 5 = 1 THEN INTERVAL 0 HOUR ELSE INTERVAL 2 HOUR END, '%Y-%m-%dT%H:%M:%S') || '.000000000Z' END AS bound FROM events""")
def time_stamps(spark: SparkSession, sf: str) -> DataFrame:
    """Stamps as stored text and back, views in two zones, and bounds read from text with Z, with an offset, or (null) with neither."""
    i = F.col("event_id")
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(i % 5 == 0, "").when(i % 5 == 1, "Z").otherwise(".123456789+02:00"))
    stored = timepolicy.stored(F.col("ts"))
    return e.select("event_id", stored.alias("stored"), timepolicy.parse_stored(stored).alias("epoch"), timepolicy.local_view(F.col("ts"), timepolicy.LONDON).alias("london"), timepolicy.local_view(F.col("ts"), timepolicy.NEW_YORK).alias("new_york"), timepolicy.normal_bound(text).alias("bound"))


_VOTES = f"""{_CORR}, vt AS (SELECT instrument AS node, CASE WHEN avg(ret) > 0 THEN 1.0 ELSE -1.0 END AS stance, count(*)::DOUBLE AS weight FROM ret GROUP BY 1),
 e AS (SELECT a, b FROM cm WHERE a < b AND abs(corr) >= 0.02 UNION SELECT b, a FROM cm WHERE a < b AND abs(corr) >= 0.02), reach AS (SELECT node, node AS other FROM vt UNION SELECT reach.node, e.b FROM reach JOIN e ON reach.other = e.a), cp AS (SELECT node, min(other) AS component FROM reach GROUP BY 1)"""


@query(f"WITH RECURSIVE {_VOTES} SELECT component, round(sum(stance * weight) / sum(weight), 6) AS stance, round(avg(weight), 6) AS weight, count(*) AS members FROM vt JOIN cp USING (node) GROUP BY 1")
def cluster_votes(spark: SparkSession, sf: str) -> DataFrame:
    """The series' stances, one vote for each cluster of correlated ones."""
    from .study_queries import _ret

    v = _ret(spark, sf).groupBy(F.col("instrument").alias("node")).agg(F.when(F.avg("ret") > 0, 1.0).otherwise(-1.0).alias("stance"), F.count(F.lit(1)).cast("double").alias("weight"))
    return rounds(correlate.cluster_votes(v, correlate.clusters(_corr(spark, sf), 0.02)), [])


@query(f"""WITH {EQUITY}, n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM equity) SELECT grp, ts, round(equity, 2) AS equity FROM n WHERE i % greatest(n // 500, 1) = 0 OR i = n - 1""")
def equity_points(spark: SparkSession, sf: str) -> DataFrame:
    """Every k-th point of a curve, for some five hundred points a curve, and its last."""
    return rounds(metrics.downsample(equity(spark, sf), ["grp"], 500), [], 2)


@query(f"""WITH {QUOTES}, o AS (SELECT ts, a, b, ln((bid + ask) / 2) * 10000 AS y FROM quotes WHERE bid > 0 AND bid < ask), c AS (SELECT ts, node, avg(y) AS c FROM (SELECT ts, a AS node, y FROM o UNION ALL SELECT ts, b, -y FROM o) GROUP BY ALL),
 w AS (SELECT ts, sum(c * CASE node WHEN 'ASIA' THEN 0.4 WHEN 'EUROPE' THEN 0.6 ELSE 0 END) / nullif(sum(CASE node WHEN 'ASIA' THEN 0.4 WHEN 'EUROPE' THEN 0.6 ELSE 0 END), 0) AS m FROM c GROUP BY 1) SELECT ts, node, round(c - m, 6) + 0 AS basket_user FROM c JOIN w USING (ts)""")
def user_baskets(spark: SparkSession, sf: str) -> DataFrame:
    """Strengths (here means of a node's pairs) less those of a basket given as text."""
    from ..operators.graph import observations

    o = observations(quotes(spark, sf))
    c = o.select("ts", F.col("a").alias("node"), "y").unionByName(o.select("ts", F.col("b").alias("node"), (-F.col("y")).alias("y"))).groupBy("ts", "node").agg(F.avg("y").alias("c"))
    return market.user_basket(c, market.user_weights(F.lit("ASIA=0.4, EUROPE=0.6"))).withColumn("basket_user", r("basket_user") + 0.0)
