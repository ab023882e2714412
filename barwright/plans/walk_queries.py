"""Queries of the market graph: cycles in canonical direction, a basis of all cycles, two reports' cycles, fits by many methods, corrected fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import audit, graph, market, strengths
from ..sources.views import QUOTES, quotes, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


#: FX names of pairs of regions, every second one turned; nations are coins, quoted in EUROPE and in a proxy of AMERICA.
_NAMES = f"""{QUOTES}, fx AS (SELECT DISTINCT CASE WHEN (length(a) + length(b)) % 2 = 0 THEN b || '_' || a ELSE a || '_' || b END AS instrument FROM quotes), coin AS (SELECT n_name || '/' || q AS instrument FROM nation, (VALUES ('PROXY', 5), ('EUROPE', 3)) v(q, k) WHERE n_nationkey % k = 0)"""


def _instruments(spark: SparkSession, sf: str) -> DataFrame:
    turned = (F.length("a") + F.length("b")) % 2 == 0
    fx = quotes(spark, sf).select(F.when(turned, F.concat_ws("_", "b", "a")).otherwise(F.concat_ws("_", "a", "b")).alias("instrument")).distinct()
    graph.checkpoints(spark)
    fx = fx.checkpoint()  # pairs of regions, once: every step of the topology would join all lines again
    n = table(spark, sf, "nation")
    in_proxy = n.where("n_nationkey % 5 = 0").select(F.concat("n_name", F.lit("/PROXY")).alias("instrument"))
    return fx.unionByName(in_proxy).unionByName(n.where("n_nationkey % 3 = 0").select(F.concat("n_name", F.lit("/EUROPE")).alias("instrument")))


@query(f"""WITH {_NAMES}, f AS (SELECT instrument, split_part(instrument, '_', 1) AS base, split_part(instrument, '_', 2) AS quote FROM fx), g AS (SELECT least(base, quote) AS x, greatest(base, quote) AS y, instrument, base FROM f),
 tri AS (SELECT 'triangle' AS class, p.x || ' ' || p.y || ' ' || q.y AS key, (CASE WHEN p.base = p.x THEN '+' ELSE '-' END || p.instrument) || ' ' || (CASE WHEN q.base = q.x THEN '+' ELSE '-' END || q.instrument) || ' ' || (CASE WHEN r.base = r.y THEN '+' ELSE '-' END || r.instrument) AS label FROM g p JOIN g q ON p.y = q.x JOIN g r ON r.x = p.x AND r.y = q.y),
 c AS (SELECT instrument, split_part(instrument, '/', 1) AS base, split_part(instrument, '/', 2) AS quote FROM coin),
 bas AS (SELECT 'basis' AS class, m.base || ' PROXY EUROPE' AS key, m.base || ' via PROXY/EUROPE: -' || m.instrument || ' +' || o.instrument || ' ' || CASE WHEN f.base = 'EUROPE' THEN '+' ELSE '-' END || f.instrument AS label FROM c m JOIN c o ON m.base = o.base AND m.quote = 'PROXY' AND o.quote = 'EUROPE' JOIN g ON g.x = 'AMERICA' AND g.y = 'EUROPE' JOIN f ON f.instrument = g.instrument)
 SELECT * FROM tri UNION ALL SELECT * FROM bas""")
def canonical_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Triangles of regions, and basis cycles of nations' coins that go through the proxy, in canonical direction and by name."""
    venues = spark.createDataFrame([("PROXY", "v1"), ("EUROPE", "v2")], "quote string, venue string")
    edges = market.topology(_instruments(spark, sf), venues, spark.createDataFrame([("PROXY", "AMERICA")], "proxy string, usd string"))
    cycles = graph.simple_cycles(edges.select("edge", F.col("base").alias("a"), F.col("quote").alias("b")), 4)
    w = market.canonical_walks(cycles, edges).where("path IS NOT NULL")
    return w.select("class", "key", "label")


@query("""WITH e AS (SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT * FROM (SELECT n_name, lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b FROM nation) WHERE b IS NOT NULL UNION ALL SELECT x.r_name, y.r_name FROM region x JOIN region y ON x.r_regionkey + 2 = y.r_regionkey),
 n AS (SELECT a AS node FROM e UNION SELECT b FROM e), k AS (SELECT r_name AS node, r_regionkey % 2 AS c FROM region UNION ALL SELECT n_name, n_regionkey % 2 FROM nation),
 m AS (SELECT c, min(node) AS root, count(*) AS nodes FROM k GROUP BY 1), j AS (SELECT c, count(*) AS edges FROM e JOIN k ON e.a = k.node GROUP BY 1)
 SELECT root, nodes, edges, edges - nodes + 1 AS cycles, edges - nodes + 1 AS closed FROM m JOIN j USING (c)""")
def cycle_basis(spark: SparkSession, sf: str) -> DataFrame:
    """A basis of the cycles of nations and regions, by component: as many as edges less nodes and one, all of them closed walks."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    home = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("a"), F.col("r_name").alias("b"))
    chain = n.select(F.col("n_name").alias("a"), F.lead("n_name").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("b")).where("b IS NOT NULL")
    far = r.select(F.col("r_name").alias("a"), (F.col("r_regionkey") + 2).alias("k")).join(r.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("b")), "k").select("a", "b")
    e = home.unionByName(chain).unionByName(far).withColumn("edge", F.row_number().over(Window.orderBy("a", "b")))  # the topology
    nodes = e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct()
    basis = graph.cycle_basis(nodes, e)
    walks = basis.select("root", F.col("edge").alias("cycle"), F.posexplode("legs").alias("leg", "x")).select("root", "cycle", "leg", "x.edge", "x.d")
    closed = market.closed(walks.select("cycle", "leg", "edge", "d"), e)
    by = basis.select("root", F.col("edge").alias("cycle")).join(closed, "cycle").groupBy("root").agg(F.count(F.lit(1)).alias("cycles"), F.count_if("closed").alias("closed"))
    comp = graph.components(nodes, e.select("a", "b"))
    size = comp.groupBy(F.col("component").alias("root")).agg(F.count(F.lit(1)).alias("nodes"))
    edges = e.join(comp, F.col("a") == F.col("node")).groupBy(F.col("component").alias("root")).agg(F.count(F.lit(1)).alias("edges"))
    return size.join(edges, "root").join(by, "root").select("root", "nodes", "edges", "cycles", "closed")


#: A month's triangles as a report: labels as quoted, and in the second one turned, doubled, left out, misread or moved ones.
_REPORT = f"""{QUOTES}, pr AS (SELECT DISTINCT a, b FROM quotes), y AS (SELECT ts, a, b, ln((bid + ask) / 2) * 10000 AS y FROM quotes), tri AS (SELECT x.a AS p, x.b AS q, z.b AS r FROM pr x JOIN pr z ON x.b = z.a JOIN pr w ON w.a = x.a AND w.b = z.b),
 nu AS (SELECT p, q, r, count(*) AS n, avg(u.y + v.y - t.y) AS m FROM tri JOIN y u ON u.a = p AND u.b = q JOIN y v ON v.a = q AND v.b = r AND v.ts = u.ts JOIN y t ON t.a = p AND t.b = r AND t.ts = u.ts GROUP BY ALL),
 k AS (SELECT replace(p, ' ', '') AS p, replace(q, ' ', '') AS q, replace(r, ' ', '') AS r, n, m, row_number() OVER (ORDER BY p, q, r) AS pos FROM nu)"""


def _reports(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    q = quotes(spark, sf)
    tri = graph.triangles(q)
    n = graph.cycle_numbers(q, graph.triangle_legs(tri)).groupBy("cycle").agg(F.count(F.lit(1)).alias("n"), (F.avg("resid") / 1000).alias("signed_mean"))
    k = n.join(tri, "cycle").withColumn("pos", F.row_number().over(Window.orderBy("a", "b", "c")))  # ten triangles
    a, b, c = (F.replace(F.col(x), F.lit(" "), F.lit("")) for x in "abc")  # a label's legs are parted by spaces
    label = lambda x, y, z: F.concat(F.lit(x), a, F.lit("_"), b, F.lit(f" {y}"), b, F.lit("_"), c, F.lit(f" {z}"), a, F.lit("_"), c)
    golden = k.select(F.lit("cycles").alias("section"), "pos", label("+", "+", "-").alias("cycle"), "n", "signed_mean")
    turned = F.when(F.col("pos") == 2, label("-", "-", "+")).when(F.col("pos") == 3, label("+", "-", "-")).when(F.col("pos") == 4, label("", "+", "-")).otherwise(label("+", "+", "-"))
    mean = F.when(F.col("pos") == 2, -F.col("signed_mean")).when(F.col("pos") == 5, F.col("signed_mean") + 1).when(F.col("pos") == 6, F.col("signed_mean") + 0.00005).otherwise(F.col("signed_mean"))
    place = F.when(F.col("pos") == 8, 20).otherwise(F.col("pos"))
    fresh = k.where("pos <> 1").select(F.lit("cycles").alias("section"), place.alias("pos"), turned.alias("cycle"), "n", mean.alias("signed_mean"))
    return golden, fresh.unionByName(fresh.where("pos = 7").withColumn("pos", F.lit(30)))


@query(f"""WITH {_REPORT}, l AS (SELECT pos, '+' || p || '_' || q || ' +' || q || '_' || r || ' -' || p || '_' || r AS label, p || '_' || q || ' +' || q || '_' || r || ' -' || p || '_' || r AS odd FROM k), v(pos, kind, why) AS (VALUES (1, 'FAIL', 'missing from fresh'), (2, 'INFO', 'label differs'), (3, 'FAIL', 'shared legs disagree in direction'), (4, 'FAIL', 'missing from fresh'),
 (5, 'FAIL', 'signed_mean differs'), (6, 'FLIP', 'signed_mean differs'), (7, 'FAIL', 'duplicate cycle in fresh'))
 SELECT 'cycles' AS section, label AS cycle, kind, why FROM l JOIN v USING (pos) UNION ALL SELECT 'cycles', odd, 'FAIL', 'unparseable cycle in fresh' FROM l WHERE pos = 4 UNION ALL SELECT 'cycles', NULL, 'INFO', 'order differs' WHERE (SELECT count(*) FROM k) > 8""")
def matched_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Two reports' cycles by the set of their instruments: what is missing, doubled, turned, moved or apart."""
    return audit.match_cycles(*_reports(spark, sf), ["n", "signed_mean"])


@query()
def method_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every bar's strengths by 27 methods, one pass of the quotes."""
    g = strengths.method_grid(quotes(spark, sf))
    return g.select("ts", "method", F.explode("strengths").alias("node", "value"), "converged").withColumn("value", F.round("value", 4) + 0.0)


@query(f"""WITH {QUOTES}, f AS (SELECT *, ln((bid + ask) / 2) * 10000 AS y, count(*) OVER (PARTITION BY ts) AS k FROM quotes WHERE bid > 0 AND bid < ask), g AS (SELECT ts, a, b, y, y - CASE WHEN a = 'AFRICA' AND b = 'ASIA' AND volume % 2 = 0 THEN y / 100 ELSE 0 END AS z FROM f WHERE k = 10),
 e AS (SELECT ts, a AS node, y, z FROM g UNION ALL SELECT ts, b, -y, -z FROM g) SELECT ts, node, round(sum(y) / 5, 6) + 0.0 AS c, round(sum(z) / 5, 6) + 0.0 AS c_corrected FROM e GROUP BY ALL""")
def corrected_strengths(spark: SparkSession, sf: str) -> DataFrame:
    """Strengths of bars with all pairs, after a hundredth is taken off one pair where it is flagged."""
    full = strengths.full_bars(quotes(spark, sf), 10)
    flagged = full.where("a = 'AFRICA' AND b = 'ASIA' AND volume % 2 = 0").select("ts", "a", "b", (F.col("y") / 100).alias("estimate"))
    c = strengths.corrected(full.select("ts", "a", "b", "bid", "ask"), flagged)
    return c.select("ts", "node", *[(F.round(x, 6) + 0.0).alias(x) for x in ("c", "c_corrected")])
