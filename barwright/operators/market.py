"""The market model: edges of three kinds with their checks, projections to graphs, walks, cycle classes and labels, user baskets.

An edge is a row (edge, kind, base, quote, venue, venue_b, instrument, bid, ask, spread_known). QUOTED edges have a market's
prices, BASIS edges stand for an equivalence without a quote, VENUE edges for the same asset on two venues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import BPS

MODES = ("asset", "asset_venue", "per_venue")


def is_crypto(name: Column) -> Column:
    return F.contains(name, F.lit("/"))


def split_pair(name: Column) -> Column:
    """struct(base, quote) of a name split at / if it has one, else at _; null unless that gives two parts that aren't empty."""
    parts = F.when(is_crypto(name), F.split(name, "/")).otherwise(F.split(name, "_"))
    ok = (F.size(parts) == 2) & (F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != "")
    return F.when(ok, F.struct(F.get(parts, F.lit(0)).alias("base"), F.get(parts, F.lit(1)).alias("quote")))


def problem(edges: DataFrame) -> DataFrame:
    """edges with problem: why a row can't be an edge; null if it can."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    prices = ~F.coalesce((F.col("bid") > 0) & (F.col("bid") <= F.col("ask")), F.lit(False))
    venue = (F.col("kind") == "VENUE") & ((F.col("base") != F.col("quote")) | empty("venue_b") | (F.col("venue_b") == F.col("venue")))
    same = (F.col("kind") != "VENUE") & (F.col("base") == F.col("quote"))
    said = F.when(empty("base") | empty("quote") | empty("venue"), "empty name").when(prices, "prices").when(venue, "venues").when(same, "one asset")
    return edges.withColumn("problem", said)


def basis_edges(pairs: DataFrame) -> DataFrame:
    """Edges of pairs (base, quote, venue, venue_b, basis_bps): one base is exp(basis_bps / 1e4) quote; there is no spread to know."""
    rate = F.exp(F.col("basis_bps") / BPS)
    return pairs.select(F.lit("BASIS").alias("kind"), "base", "quote", "venue", "venue_b", F.concat_ws("~", "base", "quote").alias("instrument"), rate.alias("bid"), rate.alias("ask"), F.lit(False).alias("spread_known"))


def inverted(edges: DataFrame, turn: Column) -> DataFrame:
    """edges, those of turn seen from the other side: names and venues swapped, bid 1 / ask, ask 1 / bid (VENUE: venues alone)."""
    venue = F.col("kind") == "VENUE"
    far = F.coalesce("venue_b", "venue")
    new = {
        "base": F.when(turn, F.col("quote")).otherwise(F.col("base")), "quote": F.when(turn, F.col("base")).otherwise(F.col("quote")),
        "bid": F.when(turn & ~venue, 1 / F.col("ask")).otherwise(F.col("bid")), "ask": F.when(turn & ~venue, 1 / F.col("bid")).otherwise(F.col("ask")),
        "venue": F.when(turn, far).otherwise(F.col("venue")), "venue_b": F.when(turn & F.col("venue_b").isNotNull(), F.col("venue")).otherwise(F.col("venue_b")),
    }
    return edges.select(*[new[c].alias(c) if c in new else F.col(c) for c in edges.columns])


def oriented(edges: DataFrame) -> DataFrame:
    """edges with base < quote (VENUE: venue < venue_b)."""
    return inverted(edges, F.when(F.col("kind") == "VENUE", F.col("venue") > F.col("venue_b")).otherwise(F.col("base") > F.col("quote")))


def project(edges: DataFrame, mode: str = "asset") -> DataFrame:
    """graph, edge, a, b of a projection. asset: nodes are assets, VENUE edges go; asset_venue: nodes are asset@venue; per_venue: a graph for each venue, edges between venues go. Loops go."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if mode == "asset_venue":
        a, b = F.concat_ws("@", "base", "venue"), F.concat_ws("@", "quote", F.coalesce("venue_b", "venue"))
        out = edges.select(F.lit("*").alias("graph"), "edge", a.alias("a"), b.alias("b"))
    else:
        kept = edges.where("kind <> 'VENUE'")
        key = F.lit("*") if mode == "asset" else F.when(F.coalesce("venue_b", "venue") == F.col("venue"), F.col("venue"))
        out = kept.select(key.alias("graph"), "edge", F.col("base").alias("a"), F.col("quote").alias("b")).where("graph IS NOT NULL")
    return out.where("a <> b")


def closed(walks: DataFrame, ends: DataFrame) -> DataFrame:
    """cycle, closed: whether the legs (cycle, leg, edge, d) chain from head to tail and come back. ends: edge, a, b of a projection."""
    w = Window.partitionBy("cycle").orderBy("leg")
    x = walks.join(ends.select("edge", "a", "b"), "edge", "left")
    up = F.col("d") > 0
    x = x.withColumns({"tail": F.when(up, F.col("a")).otherwise(F.col("b")), "head": F.when(up, F.col("b")).otherwise(F.col("a"))})
    first = F.first("tail").over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("to", F.coalesce(F.lead("tail").over(w), first))
    return x.groupBy("cycle").agg(F.bool_and(F.coalesce(F.col("head") == F.col("to"), F.lit(False))).alias("closed"))


def signatures(walks: DataFrame, edges: DataFrame) -> DataFrame:
    """cycle, signature: its legs' instruments and venues, sorted, whatever the order and direction of the walk."""
    name = F.concat_ws("|", "instrument", "venue", F.coalesce("venue_b", F.lit("")))
    return walks.join(edges.select("edge", name.alias("name")), "edge").groupBy("cycle").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("signature"))


def classes(walks: DataFrame, edges: DataFrame) -> DataFrame:
    """cycle, legs, class, label: basis (has a BASIS leg), triangle (three legs, none crypto), crypto_only, fx_other; the label has the quoted legs in order."""
    x = walks.join(edges.select("edge", "kind", "instrument"), "edge")
    n, crypto = F.count(F.lit(1)), F.count_if(is_crypto(F.col("instrument")))
    leg = F.concat(F.when(F.col("d") > 0, "+").otherwise("-"), "instrument")
    g = x.groupBy("cycle").agg(n.alias("legs"), F.count_if(F.col("kind") == "BASIS").alias("basis"), crypto.alias("crypto"), F.array_sort(F.collect_list(F.when(F.col("kind") == "QUOTED", F.struct("leg", leg.alias("name"))))).alias("named"))
    kind = F.when(F.col("basis") > 0, "basis").when((F.col("crypto") == 0) & (F.col("legs") == 3), "triangle").when(F.col("crypto") > 0, "crypto_only").otherwise("fx_other")
    return g.select("cycle", "legs", kind.alias("class"), F.array_join(F.transform("named", lambda s: s["name"]), " ").alias("label"))


def topology(instruments: DataFrame, venues: DataFrame, proxies: DataFrame, fx_venue: str = "fx", other_venue: str = "other") -> DataFrame:
    """edge, kind, base, quote, venue, venue_b, instrument of instrument names (instrument): what there is to walk along, without prices.

    Names with / are crypto pairs on the venue of their quote (venues: quote, venue; other_venue without one), others FX pairs
    on fx_venue. proxies (proxy, usd): a BASIS edge for each proxy that a crypto pair is quoted in. Names that don't split
    in two go. Edges are numbered by kind and name; the three tables are lists of names, not bars.
    """
    names = instruments.select("instrument", split_pair(F.col("instrument")).alias("p"), is_crypto(F.col("instrument")).alias("crypto")).where("p IS NOT NULL").distinct()
    names = names.select("instrument", "crypto", "p.base", "p.quote").join(venues.select(F.col("quote").alias("q"), F.col("venue").alias("v")), F.col("quote") == F.col("q"), "left")
    quoted = names.select(F.lit("QUOTED").alias("kind"), "base", "quote", F.when(F.col("crypto"), F.coalesce("v", F.lit(other_venue))).otherwise(fx_venue).alias("venue"), F.lit(None).cast("string").alias("venue_b"), "instrument")
    used = proxies.join(names.where("crypto").select("quote", "v").distinct(), F.col("proxy") == F.col("quote"))
    alias = used.select(F.lit("BASIS").alias("kind"), F.col("proxy").alias("base"), F.col("usd").alias("quote"), F.coalesce("v", F.lit(other_venue)).alias("venue"), F.lit(fx_venue).alias("venue_b"), F.concat_ws("~", "proxy", "usd").alias("instrument"))
    number = F.row_number().over(Window.orderBy("kind", "instrument"))  # a row an instrument
    return quoted.unionByName(alias).withColumn("edge", number)


def canonical_walks(cycles: DataFrame, edges: DataFrame) -> DataFrame:
    """cycle, class, path, label, key of cycles (cycle, legs: array<struct<edge, d>>), turned and begun as their class says.

    Triangles walk their sorted assets; a basis cycle of the shape proxy, X, other, usd, with one alias leg, two crypto legs
    of one base X and one FX leg, walks so, labelled 'X via proxy/other: ...'; other basis cycles keep their direction,
    labelled 'basis: ...', and have no path; so do crypto_only and fx_other ones, plainly labelled. A leg is + where it is
    walked from base to quote; the alias leg isn't named. key sorts the cycles of a class. Legs of a cycle are an array of
    MAX_LENGTH entries at most, so that every step is a function of one row.
    """
    x = cycles.select("cycle", F.posexplode("legs").alias("at", "leg")).select("cycle", "at", "leg.edge", "leg.d").join(edges.select("edge", "kind", "base", "quote", "instrument"), "edge")
    row = F.struct("at", "d", "kind", "base", "quote", "instrument", is_crypto(F.col("instrument")).alias("crypto"))
    x = x.groupBy("cycle").agg(F.array_sort(F.collect_list(row)).alias("legs"))
    of = lambda test: F.filter("legs", test)
    quoted = lambda e: e["kind"] == "QUOTED"
    x = x.withColumns({"alias": of(lambda e: e["kind"] == "BASIS"), "coins": of(lambda e: quoted(e) & e["crypto"]), "fx": of(lambda e: quoted(e) & ~e["crypto"]), "nodes": F.array_sort(F.array_distinct(F.flatten(F.transform("legs", lambda e: F.array(e["base"], e["quote"])))))})
    kind = F.when(F.size("alias") > 0, "basis").when((F.size("coins") == 0) & (F.size("legs") == 3), "triangle").when(F.size("coins") > 0, "crypto_only").otherwise("fx_other")
    one = lambda c, i=0: F.get(c, F.lit(i))
    proxy, usd = one("alias")["base"], one("alias")["quote"]
    other = one(F.filter(F.transform("coins", lambda e: e["quote"]), lambda q: q != proxy))
    both = lambda a, b: F.array_sort(F.array(a, b))
    shape = (F.size("legs") == 4) & (F.size("alias") == 1) & (F.size("coins") == 2) & (F.size("fx") == 1) & (one("coins")["base"] == one("coins", 1)["base"])
    shape = shape & (both(one("coins")["quote"], one("coins", 1)["quote"]) == both(proxy, other)) & (both(one("fx")["base"], one("fx")["quote"]) == both(other, usd))
    x = x.withColumn("class", kind)
    x = x.withColumn("path", F.when(F.col("class") == "triangle", F.col("nodes")).when((F.col("class") == "basis") & F.coalesce(shape, F.lit(False)), F.array(proxy, one("coins")["base"], other, usd)))
    named = lambda e, up: F.concat(F.when(up, "+").otherwise("-"), e["instrument"])

    def step(y: Column, i: Column) -> Column:
        """The leg from the asset before y to y, '' for the alias: of each pair of neighbours on the path there is one."""
        before = F.element_at("path", F.when(i == 0, F.size("path")).otherwise(i))
        hit = one(F.filter("legs", lambda e: both(e["base"], e["quote"]) == both(before, y)))
        return F.when(quoted(hit), named(hit, hit["base"] == before)).otherwise("")

    # the step into the first asset closes the walk, so it comes last
    steps = F.transform("path", step)
    walked = F.filter(F.concat(F.slice(steps, 2, F.size("path")), F.slice(steps, 1, 1)), lambda t: t != "")
    kept = F.transform(of(quoted), lambda e: named(e, e["d"] > 0))
    legs = F.array_join(F.when(F.col("path").isNotNull(), walked).otherwise(kept), " ")
    label = F.when((F.col("class") == "basis") & F.col("path").isNotNull(), F.concat(one("path", 1), F.lit(" via "), one("path"), F.lit("/"), one("path", 2), F.lit(": "), legs)).when(F.col("class") == "basis", F.concat(F.lit("basis: "), legs)).otherwise(legs)
    key = F.when(F.col("class") == "triangle", F.col("nodes")).when((F.col("class") == "basis") & F.col("path").isNotNull(), F.array(one("path", 1), one("path"), one("path", 2))).when(F.col("class") == "basis", F.concat(F.array(F.lit("~")), F.col("nodes"))).otherwise(F.array_sort(F.transform(of(quoted), lambda e: e["instrument"])))
    return x.select("cycle", "class", "path", label.alias("label"), F.array_join(key, " ").alias("key"))


def legs_of_label(label: Column) -> Column:
    """array<struct<instrument, d>> of '+A -B', a prefix up to ': ' left out; null where a leg has no sign or a name comes twice."""
    body = F.regexp_replace(label, r"^.*?: ", "")
    tokens = F.filter(F.split(body, r"\s+"), lambda t: t != "")
    ok = (F.size(tokens) > 0) & F.forall(tokens, lambda t: t.rlike(r"^[+-]\S+$")) & (F.size(F.array_distinct(F.transform(tokens, lambda t: F.substring(t, 2, 1 << 30)))) == F.size(tokens))
    return F.when(ok, F.transform(tokens, lambda t: F.struct(F.substring(t, 2, 1 << 30).alias("instrument"), F.when(F.startswith(t, F.lit("+")), 1).otherwise(-1).alias("d"))))


def user_weights(text: Column) -> Column:
    """map<string, double> of 'USD=0.4,EUR=0.6'; null where a part isn't a name and a number."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    ok = F.forall(parts, lambda p: p.rlike(r"^[^=\s]+\s*=\s*[+-]?[0-9]*\.?[0-9]+([eE][+-]?[0-9]+)?$"))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.split_part(p, F.lit("="), F.lit(1))), F.split_part(p, F.lit("="), F.lit(2)).cast("double")))
    return F.when(ok, F.map_from_entries(pairs))


def user_basket(strengths: DataFrame, weights: Column) -> DataFrame:
    """ts, node, basket_user: strengths (ts, node, c) less their mean by a user's weights; names without a weight count nothing, and a bar without any has null."""
    w = Window.partitionBy("ts")
    own = F.coalesce(F.try_element_at(weights, F.col("node")), F.lit(0.0))
    x = strengths.withColumn("__w", own)
    return x.select("ts", "node", (F.col("c") - F.try_divide(F.sum(F.col("c") * F.col("__w")).over(w), F.sum("__w").over(w))).alias("basket_user"))
