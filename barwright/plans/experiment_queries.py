"""Queries of experiments and of the validation hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timepolicy import dst_cell
from ..operators import experiments, graph, runlevel, strengths
from ..sources.views import BARS, QUOTES, bars, quotes
from .candle_queries import gaps, rounds

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


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).groupBy("ts").agg(F.max((F.col("ask_close") - F.col("bid_close")) / F.col("mid") * 1e4).alias("v"), F.count(F.lit(1)).alias("n"))
    return b.select("ts", "v", (F.col("v") > 199).alias("a"), (F.col("v") > 170).alias("b"))


_FLAGGED = f"{BARS}, fb AS (SELECT ts, max((ask_close - bid_close) / mid * 10000) AS v FROM bars GROUP BY 1), fl AS (SELECT ts, v, v > 199 AS a, v > 170 AS b FROM fb)"
_MASK = f"""{_FLAGGED}, r0 AS (SELECT ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) <= INTERVAL 3 HOUR THEN 0 ELSE 1 END AS n FROM fl WHERE b), r1 AS (SELECT ts, sum(n) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS r FROM r0),
 iv AS (SELECT 'B_run' AS source, min(ts) AS start, max(ts) AS "end", count(*) AS bars FROM r1 GROUP BY r HAVING count(*) >= 3 UNION ALL SELECT 'A_flag', ts, ts, 1 FROM fl WHERE a)"""


@query(f"WITH {_MASK} SELECT * FROM iv")
def mask_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return experiments.mask_intervals(_flagged(spark, sf), "a", "b", 3)


@query(f"""WITH {_MASK}, h AS (SELECT DISTINCT unnest(generate_series(start - INTERVAL 2 HOUR, "end" + INTERVAL 2 HOUR, INTERVAL 1 HOUR)) AS ts FROM iv),
 p AS (SELECT 'all' AS population, v FROM fl UNION ALL SELECT 'ref', v FROM fl ANTI JOIN h USING (ts)) SELECT population, count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.9), 6) AS p90 FROM p GROUP BY 1""")
def population_summary(spark: SparkSession, sf: str) -> DataFrame:
    f = _flagged(spark, sf)
    p = experiments.populations(f, experiments.masked_hours(experiments.mask_intervals(f, "a", "b", 3), 2))
    return rounds(p.groupBy("population").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.percentile("v", 0.9).alias("p90")), [])


@query(f"""WITH {BARS}, g AS (SELECT instrument, ts AS a, lead(ts) OVER (PARTITION BY instrument ORDER BY ts) AS b FROM bars), w AS (SELECT * FROM g WHERE instrument = 'click' AND b > a + INTERVAL 1 HOUR)
 SELECT w.a AS gap_start, w.b AS gap_end, count(o.ts) AS inside FROM w LEFT JOIN bars o ON o.instrument = 'view' AND o.ts > w.a AND o.ts < w.b GROUP BY ALL""")
def bars_inside_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """How many bars of another series lie inside each gap of one: by hours of the gap, so that the join is by equality."""
    b = bars(spark, sf)
    g = gaps(b).where("instrument = 'click'").select("gap_start", "gap_end")
    hour = F.expr("INTERVAL 1 HOUR")
    hours = g.select("gap_start", "gap_end", F.explode(F.sequence(F.col("gap_start") + hour, F.col("gap_end") - hour, hour)).alias("ts"))
    j = hours.join(b.where("instrument = 'view'").select("ts", F.lit(1).alias("one")), "ts", "left")
    return j.groupBy("gap_start", "gap_end").agg(F.count("one").alias("inside"))


@query(f"""WITH {BARS}, b AS (SELECT instrument, ts, CASE WHEN ts - lag(ts) OVER w = INTERVAL 1 HOUR THEN 0 ELSE 1 END AS f FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY ts)), s AS (SELECT *, sum(f) OVER (PARTITION BY instrument ORDER BY ts ROWS UNBOUNDED PRECEDING) AS st FROM b),
 p AS (SELECT instrument, row_number() OVER (PARTITION BY instrument, st ORDER BY ts) - 1 AS pos FROM s) SELECT instrument, ((pos >= 6)::INT + (pos >= 12)::INT + (pos >= 24)::INT + (pos >= 48)::INT)::INT AS bucket, count(*) AS n FROM p GROUP BY ALL""")
def context_buckets(spark: SparkSession, sf: str) -> DataFrame:
    s = runlevel.stretch_geometry(runlevel.with_stretch(bars(spark, sf), ["instrument"]), ["instrument"])
    return s.groupBy("instrument", experiments.context_bucket(F.col("pos")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {BARS}, n AS (SELECT instrument, ts FROM bars), e AS (SELECT instrument, min(ts) AS ts FROM n GROUP BY 1 UNION ALL SELECT e.instrument, (SELECT min(n.ts) FROM n WHERE n.instrument = e.instrument AND n.ts >= e.ts + INTERVAL 30 HOUR) AS ts FROM e WHERE e.ts IS NOT NULL)
 SELECT instrument, ts FROM e WHERE ts IS NOT NULL""")
def spaced_starts(spark: SparkSession, sf: str) -> DataFrame:
    return experiments.spaced(bars(spark, sf).select("instrument", "ts"), ["instrument"], 30)


@query(f"""WITH {BARS}, d AS (SELECT instrument, ts, (ask_close - bid_close) / mid * 10000 AS spread, volume AS dev FROM bars), m AS (SELECT *, list(spread) OVER (PARTITION BY instrument ORDER BY ts ROWS 23 PRECEDING) AS l, list(dev) OVER (PARTITION BY instrument ORDER BY ts ROWS 119 PRECEDING) AS q FROM d),
 r AS (SELECT instrument, ts, CASE WHEN len(l) >= 12 THEN list_aggregate(l, 'quantile_cont', 0.5) END AS roll, CASE WHEN len(q) >= 30 THEN greatest(1.4826 * list_aggregate(list_transform(q, lambda x: abs(x - list_aggregate(q, 'quantile_cont', 0.5))), 'quantile_cont', 0.5), 1.0) END AS rz FROM m)
 SELECT instrument, ts, round(roll, 6) AS scale_roll, round(rz, 6) AS scale_rz_1 FROM r""")
def deviation_scales(spark: SparkSession, sf: str) -> DataFrame:
    d = bars(spark, sf).select("instrument", "ts", ((F.col("ask_close") - F.col("bid_close")) / F.col("mid") * 1e4).alias("spread"), F.col("volume").alias("dev"))
    return rounds(experiments.scales(d, ["instrument"]).select("instrument", "ts", "scale_roll", "scale_rz_1"), [])


@query(f"""WITH {BARS}, b AS (SELECT instrument, ts, CASE WHEN ts - lag(ts) OVER w = INTERVAL 1 HOUR THEN 0 ELSE 1 END AS f FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY ts)), s AS (SELECT *, sum(f) OVER (PARTITION BY instrument ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM b),
 g AS (SELECT instrument, segment, count(*) AS n FROM s GROUP BY ALL), v AS (SELECT *, n - 3 + 1 AS v, sum(n - 3 + 1) OVER (PARTITION BY instrument ORDER BY segment)::BIGINT AS t FROM g WHERE n >= 3), a AS (SELECT instrument, max(t) AS m FROM v GROUP BY 1),
 d AS (SELECT instrument, block, {_DRAW.format("concat_ws('|', '5', '3', block::VARCHAR)")} % m AS u FROM a, range(40) r(block)) SELECT d.instrument, block::INT AS block, segment, u - (t - v) AS first FROM d JOIN v ON d.instrument = v.instrument AND u < t AND u >= t - v""")
def random_blocks(spark: SparkSession, sf: str) -> DataFrame:
    s = runlevel.with_stretch(bars(spark, sf), ["instrument"], out="segment").groupBy("instrument", "segment").agg(F.count(F.lit(1)).alias("n"))
    return experiments.draw_blocks(s, ["instrument"], 3, 40)


@query()
def block_run_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of wide spreads in random blocks of three bars."""
    b = runlevel.with_stretch(bars(spark, sf), ["instrument"], out="segment")
    s = runlevel.run_starts(b.withColumn("flag", (F.col("ask_close") - F.col("bid_close")) / F.col("mid") * 1e4 > 150), ["instrument", "segment"], "flag", 3)
    s = s.withColumn("pos", F.row_number().over(runlevel.in_order(["instrument", "segment"])) - 1)
    blocks = experiments.draw_blocks(b.groupBy("instrument", "segment").agg(F.count(F.lit(1)).alias("n")), ["instrument"], 3, 200)
    r = experiments.block_runs(s, blocks, ["instrument"], "flag", "starts", 3)
    return rounds(r.groupBy("instrument").agg(F.count(F.lit(1)).alias("blocks"), F.avg("runs").alias("rate")), [])


def fault_starts(bars: DataFrame, before: int, after: int) -> DataFrame:
    """start_id, stretch, pos of every bar with so many bars before it and, itself included, so many from it on, in its stretch. bars: stretch, pos."""
    b = bars.select("stretch", "pos").distinct()
    last = b.groupBy("stretch").agg(F.max("pos").alias("last"))
    s = b.join(last, "stretch").where((F.col("pos") >= before) & (F.col("pos") + after - 1 <= F.col("last")))
    return s.select(F.concat_ws("|", "stretch", "pos").alias("start_id"), "stretch", "pos")


@query()
def fault_injection(spark: SparkSession, sf: str) -> DataFrame:
    """Faults added to each path of the region graph at every start that has bars enough, months as bars; a stretch has no month missing."""
    from pyspark.sql.window import Window

    p = strengths.paths(graph.observations(quotes(spark, sf)), ("AFRICA", "AMERICA"))
    ts = p.select("ts").distinct().withColumn("stretch", F.year("ts") * 12 + F.month("ts") - F.row_number().over(Window.orderBy("ts")))
    ts = ts.withColumn("pos", F.row_number().over(Window.partitionBy("stretch").orderBy("ts")) - 1)
    p = p.join(ts.select("ts", F.col("stretch").cast("long").alias("stretch"), "pos"), "ts")
    p = p.select("stretch", "pos", "path", "estimate", F.col("spread").alias("scale"))
    names, out = sorted(r["path"] for r in p.select("path").distinct().collect()), None
    for i, d in enumerate((6, 12)):
        cells = [(x, s, m, k, d) for x in names for s in (1, -1) for m in (200.0, 1000.0, 4000.0) for k in experiments.SHAPES]
        part = experiments.inject(p, fault_starts(p, 5, d + 6), cells, 6, 0.5, 6).withColumn("cell", F.col("cell") + i * len(cells))
        out = part if out is None else out.unionByName(part)
    return rounds(out, [])


@query()
def world_trials(spark: SparkSession, sf: str) -> DataFrame:
    """Detector A on synthetic bars: how often it flags, and whether its pair is the faulty one, by size of the fault."""
    from ..operators.detectors import detector_a

    w = experiments.worlds(spark, 100, list("ABCDE"))
    d = detector_a(strengths.complete_residuals(w, 5))
    hit = w.groupBy("ts", "fault").agg(F.max(F.when(F.col("hit"), F.concat_ws("-", "a", "b"))).alias("true_pair"))
    return hit.join(d, "ts").groupBy("fault").agg(F.count(F.lit(1)).alias("trials"), F.count_if("flag").alias("flagged"), F.count_if(F.col("flag") & (F.col("pair") == F.col("true_pair"))).alias("named"))


@query()
def clock_anchoring(spark: SparkSession, sf: str) -> DataFrame:
    """The peak hour of spreads, with bars also moved on by 2 and 6 months, by daylight-saving cell."""
    b = bars(spark, sf).withColumn("m", F.explode(F.array(F.lit(0), F.lit(2), F.lit(6)))).withColumn("ts", F.col("ts") + F.make_ym_interval(F.lit(0), F.col("m")))
    v = (F.col("ask_close") - F.col("bid_close")) / F.col("mid") * 1e4
    h = b.groupBy(dst_cell(F.col("ts")).alias("cell"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), (F.stddev_samp(v) / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return rounds(experiments.anchoring(h), [])


@query("WITH v AS (SELECT event_type, value AS x FROM events) SELECT event_type, CASE WHEN bool_and(round(x, 0) = x) THEN 0 WHEN bool_and(round(x, 1) = x) THEN 1 WHEN bool_and(round(x, 2) = x) THEN 2 WHEN bool_and(round(x, 3) = x) THEN 3 END AS decimals FROM v GROUP BY 1")
def price_decimals(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.views import table

    return experiments.decimals(table(spark, sf, "events"), ["event_type"], "value")


@query(f"WITH {QUOTES} SELECT ts, a, b, round(abs(ln(bid / ask)) * 10000, 6) AS size FROM quotes ORDER BY abs(ln(bid / ask)) DESC, ts DESC, a, b LIMIT 10")
def top_events(spark: SparkSession, sf: str) -> DataFrame:
    """The ten widest quotes: a sort with a limit keeps ten rows a task."""
    q = quotes(spark, sf).withColumn("size", F.abs(F.log(F.col("bid") / F.col("ask"))) * 1e4)
    return rounds(q.orderBy(F.desc("size"), F.desc("ts"), "a", "b").limit(10).select("ts", "a", "b", "size"), [])
