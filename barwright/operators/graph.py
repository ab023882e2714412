"""The market graph: pairs of nodes with quotes, their cycles, gains around them, verdicts, components, negative cycles."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BPS = 1e4
#: Limits of a bar's tier: |residual| in bps, and over the cycle's spread.
ABS_SUSPECT_BPS, RATIO_CLEAN, RATIO_SUSPECT = 10.0, 0.25, 1.0
#: Cycles are looked for up to so many edges.
MAX_LENGTH = 8


def observations(quotes: DataFrame) -> DataFrame:
    """quotes (ts, a, b, bid, ask and more) with y = ln(mid) and s = ln(ask / bid), in bps; rows without 0 < bid < ask go."""
    ok = (F.col("bid") > 0) & (F.col("bid") < F.col("ask"))
    return quotes.where(ok).withColumns({"y": F.log((F.col("bid") + F.col("ask")) / 2) * BPS, "s": F.log(F.col("ask") / F.col("bid")) * BPS})


def canonical(edges: DataFrame) -> DataFrame:
    """Edges (base, quote, bid, ask) turned so that base < quote; a turned edge has the reciprocal prices, swapped."""
    turn = F.col("base") > F.col("quote")
    return edges.withColumns({
        "__b": F.least("base", "quote"), "__q": F.greatest("base", "quote"),
        "__bid": F.when(turn, 1 / F.col("ask")).otherwise(F.col("bid")), "__ask": F.when(turn, 1 / F.col("bid")).otherwise(F.col("ask")),
    }).drop("base", "quote", "bid", "ask").withColumnsRenamed({"__b": "base", "__q": "quote", "__bid": "bid", "__ask": "ask"})


def arcs(edges: DataFrame, *more: str) -> DataFrame:
    """Both directions of edges (edge, a, b): edge, d (1 or -1), tail, head."""
    one = edges.where("a <> b").select("edge", F.lit(1).alias("d"), F.col("a").alias("tail"), F.col("b").alias("head"), *more)
    return one.unionByName(edges.where("a <> b").select("edge", F.lit(-1).alias("d"), F.col("b").alias("tail"), F.col("a").alias("head"), *more))


def triangles(pairs: DataFrame) -> DataFrame:
    """cycle, a, b, c of the triples a < b < c whose three pairs (a, b), canonical, all exist."""
    p = pairs.select("a", "b").distinct()
    ab, bc, ac = p.alias("ab"), p.select(F.col("a").alias("b1"), F.col("b").alias("c")), p.select(F.col("a").alias("a2"), F.col("b").alias("c2"))
    t = ab.join(bc, F.col("b") == F.col("b1")).join(ac, (F.col("a") == F.col("a2")) & (F.col("c") == F.col("c2")))
    return t.select(F.concat_ws("-", "a", "b", "c").alias("cycle"), "a", "b", "c")


def triangle_legs(tri: DataFrame) -> DataFrame:
    """cycle, leg, a, b, d of triangles: + (a, b), + (b, c), - (a, c)."""
    leg = lambda n, x, y, d: F.struct(F.lit(n).alias("leg"), F.col(x).alias("a"), F.col(y).alias("b"), F.lit(d).alias("d"))
    return tri.select("cycle", F.explode(F.array(leg(0, "a", "b", 1), leg(1, "b", "c", 1), leg(2, "a", "c", -1))).alias("l")).select("cycle", "l.*")


def simple_cycles(edges: DataFrame, length: int = 4, least: int = 3) -> DataFrame:
    """Every simple cycle of least..length edges once: cycle (node names from the least node on), n, legs array<struct<edge, d>>.

    Paths start at their least node and grow by a join with the arcs; of the two directions the one whose first edge is
    less than its last is kept. edges (edge, a, b) are the topology, not the bars: a table of a bounded number of rows.
    """
    if not 2 <= length <= MAX_LENGTH:
        raise ValueError(f"length must be 2..{MAX_LENGTH}")
    checkpoints(edges.sparkSession)
    step = arcs(edges).checkpoint()  # once, not for each length
    legs = F.array(F.struct("edge", "d"))
    path = step.where("tail < head").select(F.col("tail").alias("start"), F.col("head").alias("at"), F.array("tail", "head").alias("nodes"), legs.alias("legs"))
    out = None
    for n in range(2, length + 1):
        grown = path.join(step, F.col("at") == F.col("tail"))
        grown = grown.withColumn("legs", F.concat("legs", F.array(F.struct("edge", "d"))))
        first, last = F.element_at("legs", 1)["edge"], F.element_at("legs", -1)["edge"]
        if n >= least:
            shut = grown.where((F.col("head") == F.col("start")) & (first < last)).select(F.concat_ws("-", "nodes").alias("cycle"), F.lit(n).alias("n"), "legs")
            out = shut if out is None else out.unionByName(shut)
        path = grown.where((F.col("head") > F.col("start")) & ~F.array_contains("nodes", F.col("head")))
        path = path.select("start", F.col("head").alias("at"), F.concat("nodes", F.array("head")).alias("nodes"), "legs")
    return out


def cycle_numbers(quotes: DataFrame, legs: DataFrame) -> DataFrame:
    """cycle, ts, resid, gain_fwd, gain_rev, spread (bps) of every bar that has all legs of a cycle. legs: cycle, a, b, d."""
    n = legs.groupBy("cycle").agg(F.count(F.lit(1)).alias("need"))
    q = observations(quotes).join(legs.join(n, "cycle"), ["a", "b"])
    up = F.col("d") > 0
    bid, ask = F.log("bid") * BPS, -F.log("ask") * BPS
    g = q.groupBy("cycle", "ts").agg(
        F.sum(F.col("d") * F.col("y")).alias("resid"), F.sum(F.when(up, bid).otherwise(ask)).alias("gain_fwd"), F.sum(F.when(up, ask).otherwise(bid)).alias("gain_rev"),
        F.sum("s").alias("spread"), F.count(F.lit(1)).alias("k"), F.max("need").alias("need"),
    )
    return g.where("k = need").drop("k", "need")


def tier(resid: Column, spread: Column) -> Column:
    """suspect over 10 bps; unrated without a spread; else by |resid| / spread: clean, noisy, suspect."""
    x = F.abs(resid)
    part = F.when(spread > 0, x / spread)
    return F.when(x > ABS_SUSPECT_BPS, "suspect").when(spread <= 0, "unrated").when(part <= RATIO_CLEAN, "clean").when(part <= RATIO_SUSPECT, "noisy").otherwise("suspect")


def verdict(multi_venue: Column, rated: Column, gain: Column, cost: Column, preposition: bool = False) -> Column:
    """First that holds: VENUE_BLOCKED, UNRATED, NO_GAIN, GAIN_COST_UNKNOWN, EXECUTABLE_AFTER_COST, COST_EATS_GAIN."""
    blocked = multi_venue & F.lit(not preposition)
    return F.when(blocked, "VENUE_BLOCKED").when(~rated, "UNRATED").when(gain <= 0, "NO_GAIN").when(cost.isNull(), "GAIN_COST_UNKNOWN").when(gain - cost > 0, "EXECUTABLE_AFTER_COST").otherwise("COST_EATS_GAIN")


def evaluate(quotes: DataFrame, legs: DataFrame, preposition: bool = False) -> DataFrame:
    """cycle_numbers with tier, rated, multi_venue, cost, net_gain and verdict. quotes also have venue, spread_known and taker_bps (null: unknown)."""
    numbers = cycle_numbers(quotes, legs)
    q = quotes.join(legs, ["a", "b"]).groupBy("cycle", "ts").agg(
        F.bool_and("spread_known").alias("rated"), (F.count_distinct("venue") > 1).alias("multi_venue"), F.when(F.count("taker_bps") == F.count(F.lit(1)), F.sum("taker_bps")).alias("cost")
    )
    out = numbers.join(q, ["cycle", "ts"]).withColumn("gain", F.greatest("gain_fwd", "gain_rev"))
    return out.select(
        "cycle", "ts", "resid", "gain_fwd", "gain_rev", "spread", F.when(F.col("rated"), tier(F.col("resid"), F.col("spread"))).otherwise("unrated").alias("tier"), "rated", "multi_venue", "cost",
        (F.col("gain") - F.col("cost")).alias("net_gain"), verdict(F.col("multi_venue"), F.col("rated"), F.col("gain"), F.col("cost"), preposition).alias("verdict"),
    )


def checkpoints(spark: SparkSession) -> None:
    """See to it that checkpoint() has a folder that all executors share; only a local session gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="barwright-"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (its least node) of nodes (node) and edges (a, b), by least labels that hop along edges and labels."""
    checkpoints(nodes.sparkSession)
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct()
    label = nodes.select("node", F.col("node").alias("component")).checkpoint()
    while True:
        near = both.join(label.select(F.col("node").alias("other"), F.col("component").alias("c")), "other").groupBy("node").agg(F.min("c").alias("c"))
        new = label.join(near, "node", "left").select("node", F.least("component", F.coalesce("c", "component")).alias("new"), "component")
        up = new.select(F.col("node").alias("n2"), F.col("new").alias("hop"))
        new = new.join(up, F.col("new") == F.col("n2")).select("node", F.least("new", "hop").alias("new"), "component").checkpoint()
        moved = not new.where("new <> component").isEmpty()
        label = new.select("node", F.col("new").alias("component"))
        if not moved:
            return label


def hub_and_arms(pairs: DataFrame) -> tuple[str, str]:
    """The anchors: the two nodes of most pairs, ties by name. Two names come to the driver, whatever the table's size."""
    p = pairs.select("a", "b").distinct()
    d = p.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    first, second = d.orderBy(F.desc("n"), "node").limit(2).collect()
    return first["node"], second["node"]


def negative_cycles(quotes: DataFrame, most: int = 10, eps: float = 1e-12, require_rated: bool = True) -> DataFrame:
    """ts, cycle (nodes), gain_bps of cycles with a gain, found one after another by Bellman-Ford on -ln(rate) with the costliest arc of each banned.

    The arcs of one bar, some tens of them, are one group. require_rated: of quotes with the columns kind or spread_known,
    those alone count that are QUOTED and whose spread is known.
    """
    if require_rated:
        if "kind" in quotes.columns:
            quotes = quotes.where("kind = 'QUOTED'")
        if "spread_known" in quotes.columns:
            quotes = quotes.where("spread_known")

    def find(n: int, tail: np.ndarray, head: np.ndarray, cost: np.ndarray) -> list[int] | None:
        dist, by = np.zeros(n), np.full(n, -1)
        last = -1
        for _ in range(n):
            last = -1
            for e in range(len(tail)):
                if dist[tail[e]] + cost[e] < dist[head[e]] - eps:
                    dist[head[e]], by[head[e]], last = dist[tail[e]] + cost[e], e, head[e]
            if last < 0:
                return None
        for _ in range(n):
            last = tail[by[last]]
        out, at = [], last
        while True:
            out.append(int(by[at]))
            at = tail[by[at]]
            if at == last:
                return out[::-1]

    def bar(q: pd.DataFrame) -> pd.DataFrame:
        q = q.sort_values(["a", "b"])
        names = sorted({*q.a, *q.b})
        no = {x: i for i, x in enumerate(names)}
        tail = np.array([*q.a.map(no), *q.b.map(no)])
        head = np.array([*q.b.map(no), *q.a.map(no)])
        cost = np.concatenate([-np.log(q.bid.to_numpy(float)), np.log(q.ask.to_numpy(float))])
        live, rows = np.arange(len(tail)), []
        while len(rows) < most and len(live):
            found = find(len(names), tail[live], head[live], cost[live])
            if found is None:
                break
            arcs_ = live[found]
            nodes = [names[i] for i in tail[arcs_]]
            k = nodes.index(min(nodes))
            rows.append((q.ts.iloc[0], "-".join(nodes[k:] + nodes[:k]), float(-cost[arcs_].sum() * BPS)))
            live = live[live != arcs_[np.argmax(cost[arcs_])]]
        return pd.DataFrame(rows, columns=["ts", "cycle", "gain_bps"])

    return quotes.select("ts", "a", "b", "bid", "ask").groupBy("ts").applyInPandas(bar, "ts timestamp_ntz, cycle string, gain_bps double")


def forest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root, depth, way (array<struct<edge, d, node>> from the root on) of a breadth-first forest: roots are the least nodes of components, and of several arcs to a node the one of the least edge is taken.

    A round a level of depth, each a join of the level's nodes with the arcs; edges (edge, a, b) are a topology.
    """
    checkpoints(nodes.sparkSession)
    step = arcs(edges).checkpoint()
    kind = dict(step.dtypes)["edge"]
    start = components(nodes, edges.select("a", "b")).where("node = component")
    level = start.select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.array().cast(f"array<struct<edge:{kind},d:int,node:string>>").alias("way")).checkpoint()
    seen = level
    while not level.isEmpty():
        new = level.join(step, F.col("node") == F.col("tail")).join(seen.select(F.col("node").alias("known")), F.col("head") == F.col("known"), "left_anti")
        first = new.groupBy("head").agg(F.min(F.struct("edge", "d", "node", "root", "depth", "way")).alias("x"))
        way = F.concat("x.way", F.array(F.struct(F.col("x.edge").alias("edge"), F.col("x.d").alias("d"), F.col("head").alias("node"))))
        level = first.select(F.col("head").alias("node"), "x.root", (F.col("x.depth") + 1).alias("depth"), way.alias("way")).checkpoint()
        seen = seen.unionByName(level).checkpoint()
    return seen


def cycle_basis(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """root, edge, legs (array<struct<edge, d>>): for each edge outside the forest the cycle that it closes with the ways to its ends, E - N + C in all.

    The walk goes along the edge from a to b, up from b to where both ways part, and down to a. Loops are left out;
    parallel edges close cycles of two legs. Nothing is gathered on the driver.
    """
    f = forest(nodes, edges)
    tree = f.where("depth > 0").select(F.element_at("way", -1)["edge"].alias("in_tree"))
    rest = edges.where("a <> b").join(tree, F.col("edge") == F.col("in_tree"), "left_anti")
    end = lambda c: f.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"), F.col("way").alias(f"way_{c}"))
    x = rest.select("edge", "a", "b").join(end("a"), "a").join(end("b"), "b")
    same = F.zip_with("way_a", "way_b", lambda p, q: F.coalesce(p["edge"] == q["edge"], F.lit(False)))
    x = x.withColumn("shared", F.coalesce(F.array_position(same, F.lit(False)).cast("int") - 1, F.lit(0)))
    x = x.withColumn("shared", F.when(F.col("shared") < 0, F.size(same)).otherwise(F.col("shared")))
    own = lambda c: F.slice(f"way_{c}", F.col("shared") + 1, F.size(f"way_{c}"))
    up = F.transform(F.reverse(own("b")), lambda s: F.struct(s["edge"].alias("edge"), (-s["d"]).alias("d")))
    down = F.transform(own("a"), lambda s: F.struct(s["edge"].alias("edge"), s["d"].alias("d")))
    return x.select(F.col("root_a").alias("root"), "edge", F.concat(F.array(F.struct(F.col("edge").alias("edge"), F.lit(1).alias("d"))), up, down).alias("legs"))
