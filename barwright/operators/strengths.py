"""Node strengths by least squares on the pairs of each bar: fits, leave-one-out checks, views, robust fits, path attribution.

A bar's pairs (some tens) are gathered into one row; batches of such rows are solved in numpy. The gauge is zero-sum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import hub_and_arms, observations

SCHEMES = ("unweighted", "inv_spread", "inv_spread2")
#: A pair whose hat value comes within this of 1 is a bridge: without it the graph falls apart.
BRIDGE_TOL = 1e-9
HUBER_ITERATIONS, HUBER_TOL, MAD_FLOOR_BPS, NOISE_RATIO = 200, 1e-7, 0.1, 0.25


def full_bars(quotes: DataFrame, pairs: int) -> DataFrame:
    """Observations of the bars that have so many pairs."""
    o = observations(quotes)
    return o.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("ts"))).where(F.col("__n") == pairs).drop("__n")


def solve(n: int, a: np.ndarray, b: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(strengths, residuals, hat values) of a weighted zero-sum fit, with one step of refinement; LinAlgError if the graph is in parts."""
    d = np.zeros((len(y), n))
    rows = np.arange(len(y))
    d[rows, a], d[rows, b] = 1.0, -1.0
    m = d.T @ (d * w[:, None])
    if np.linalg.matrix_rank(m, tol=1e-9 * max(1.0, np.abs(m).max())) < n - 1:
        raise np.linalg.LinAlgError("graph is not connected")
    inv = np.linalg.inv(m + 1.0 / n)
    c = inv @ (d.T @ (w * y))
    c = c + inv @ (d.T @ (w * (y - d @ c)))
    return c - c.mean(), y - d @ c, w * np.einsum("ij,jk,ik->i", d, inv, d)


def weights(scheme: str, s: np.ndarray) -> np.ndarray:
    """Weights of mean 1."""
    raw = {"unweighted": np.ones_like(s), "inv_spread": 1 / s, "inv_spread2": 1 / s**2}[scheme]
    return raw / raw.mean()


def _bars(quotes: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return observations(quotes).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("a", "b", "y", "s"))).alias("obs"))


def _each(df: pd.DataFrame):
    for row in df.itertuples(index=False):
        obs = row.obs
        a, b = [o["a"] for o in obs], [o["b"] for o in obs]
        names = sorted({*a, *b})
        no = {x: i for i, x in enumerate(names)}
        yield row, names, np.array([no[x] for x in a]), np.array([no[x] for x in b]), np.array([o["y"] for o in obs], float), np.array([o["s"] for o in obs], float)


def _types(quotes: DataFrame, by: tuple[str, ...]) -> str:
    return ", ".join(f"`{c}` {dict(quotes.dtypes)[c]}" for c in by)


def fit(quotes: DataFrame, scheme: str = "unweighted", by: tuple[str, ...] = ("ts",)) -> DataFrame:
    """by, kind (node or pair), a, b (null for nodes), value (strength or residual), hat, loo, weight of every connected bar.

    loo is the residual of a pair under the fit without it, from the hat value; null for a bridge.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for row, names, a, b, y, s in _each(df):
                w = weights(scheme, s)
                try:
                    c, e, h = solve(len(names), a, b, y, w)
                except np.linalg.LinAlgError:
                    continue
                key = tuple(getattr(row, k) for k in by)
                rows += [(*key, "node", names[i], None, float(c[i]), None, None, None) for i in range(len(names))]
                rows += [(*key, "pair", names[a[i]], names[b[i]], float(e[i]), float(h[i]), float(e[i] / (1 - h[i])) if 1 - h[i] >= BRIDGE_TOL else None, float(w[i])) for i in range(len(y))]
            yield pd.DataFrame(rows, columns=[*by, "kind", "a", "b", "value", "hat", "loo", "weight"])

    return _bars(quotes, by).mapInPandas(run, f"{_types(quotes, by)}, kind string, a string, b string, value double, hat double, loo double, weight double")


def loo_exact(quotes: DataFrame, scheme: str = "unweighted") -> DataFrame:
    """ts, a, b, exact: the residual of each pair under a fit of the others, made anew for each; null if they fall apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for row, names, a, b, y, s in _each(df):
                w = weights(scheme, s)
                for i in range(len(y)):
                    keep = np.arange(len(y)) != i
                    try:
                        c, _, _ = solve(len(names), a[keep], b[keep], y[keep], w[keep])
                        rows.append((row.ts, names[a[i]], names[b[i]], float(y[i] - c[a[i]] + c[b[i]])))
                    except np.linalg.LinAlgError:
                        rows.append((row.ts, names[a[i]], names[b[i]], None))
            yield pd.DataFrame(rows, columns=["ts", "a", "b", "exact"])

    return _bars(quotes, ("ts",)).mapInPandas(run, "ts timestamp_ntz, a string, b string, exact double")


def fast_against_exact(quotes: DataFrame, scheme: str = "unweighted", tolerance: float = 1e-9) -> DataFrame:
    """compared, max_diff, mismatches (null in one alone) and whether max_diff, by the size of the residual, is within tolerance."""
    fast = fit(quotes, scheme).where("kind = 'pair'").select("ts", "a", "b", "loo")
    both = fast.join(loo_exact(quotes, scheme), ["ts", "a", "b"])
    off = F.abs(F.col("loo") - F.col("exact")) / F.greatest(F.abs("exact"), F.lit(1.0))
    return both.agg(F.count(off).alias("compared"), F.max(off).alias("max_diff"), F.count_if(F.col("loo").isNull() != F.col("exact").isNull()).alias("mismatches")).withColumn("within", F.col("max_diff") <= tolerance)


def scheme_differences(quotes: DataFrame, schemes: tuple[str, ...] = SCHEMES[1:]) -> DataFrame:
    """ts, scheme, node, diff: how far a weighted strength stands from the unweighted one, in bps."""
    base = fit(quotes).where("kind = 'node'").select("ts", F.col("a").alias("node"), F.col("value").alias("c"))
    out = None
    for s in schemes:
        own = fit(quotes, s).where("kind = 'node'").select("ts", F.col("a").alias("node"), "value")
        d = base.join(own, ["ts", "node"]).select("ts", F.lit(s).alias("scheme"), "node", F.abs(F.col("value") - F.col("c")).alias("diff"))
        out = d if out is None else out.unionByName(d)
    return out


def bar_metrics(quotes: DataFrame, pairs: int, fault: float, schemes: tuple[str, ...] = SCHEMES) -> DataFrame:
    """ts, scheme, max_loo, max_diff (to the unweighted strengths), dispersion (widest spread over the narrowest), mean_spread, full (has so many pairs), fault: max_loo of the unweighted fit over a limit."""
    out = None
    for s in schemes:
        m = fit(quotes, s).where("kind = 'pair'").groupBy("ts").agg(F.max(F.abs("loo")).alias("max_loo")).select("ts", F.lit(s).alias("scheme"), "max_loo")
        out = m if out is None else out.unionByName(m)
    d = scheme_differences(quotes, tuple(s for s in schemes if s != "unweighted")).groupBy("ts", "scheme").agg(F.max("diff").alias("max_diff"))
    o = observations(quotes).groupBy("ts").agg((F.max("s") / F.min("s")).alias("dispersion"), F.avg("s").alias("mean_spread"), (F.count(F.lit(1)) == pairs).alias("full"))
    base = out.where("scheme = 'unweighted'").select("ts", F.coalesce(F.col("max_loo") > fault, F.lit(False)).alias("fault"))
    return out.join(d, ["ts", "scheme"], "left").join(o, "ts").join(base, "ts")


def residual_map(nodes: list[str]) -> list[tuple[str, str, str, str, float]]:
    """(a, b, from a, from b, coefficient): residual and pairs of the complete graph, where the unweighted fit is one constant linear map."""
    pairs = [(x, y) for i, x in enumerate(nodes) for y in nodes[i + 1 :]]
    no = {x: i for i, x in enumerate(nodes)}
    d = np.zeros((len(pairs), len(nodes)))
    for i, (x, y) in enumerate(pairs):
        d[i, no[x]], d[i, no[y]] = 1, -1
    r = np.eye(len(pairs)) - d @ np.linalg.pinv(d)
    return [(*pairs[i], *pairs[j], float(r[i, j])) for i in range(len(pairs)) for j in range(len(pairs)) if abs(r[i, j]) > 1e-15]


def complete_strengths(obs: DataFrame, n: int) -> DataFrame:
    """ts, node, c of bars with all pairs of n nodes: a node's strength is the sum of its signed pairs over n. No solver, no Python."""
    each = obs.select("ts", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("y").alias("v")), F.struct(F.col("b").alias("node"), (-F.col("y")).alias("v")))).alias("x"))
    return each.groupBy("ts", "x.node").agg((F.sum("x.v") / n).alias("c"))


def complete_residuals(obs: DataFrame, n: int) -> DataFrame:
    """obs with resid and loo for bars with all pairs of n nodes (hat value 2 / n for each)."""
    c = complete_strengths(obs, n)
    out = obs.join(c.select("ts", F.col("node").alias("a"), F.col("c").alias("ca")), ["ts", "a"]).join(c.select("ts", F.col("node").alias("b"), F.col("c").alias("cb")), ["ts", "b"])
    out = out.withColumn("resid", F.col("y") - (F.col("ca") - F.col("cb"))).drop("ca", "cb")
    return out.withColumn("loo", F.col("resid") / (1 - 2.0 / n))


def loco(quotes: DataFrame, scheme: str = "unweighted") -> DataFrame:
    """ts, dropped, node, shift: how far each node's strength, centred on the rest, moves when one node and its pairs go; null if the rest falls apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for row, names, a, b, y, s in _each(df):
                w = weights(scheme, s)
                try:
                    full, _, _ = solve(len(names), a, b, y, w)
                except np.linalg.LinAlgError:
                    continue
                for k in range(len(names)):
                    keep, rest = (a != k) & (b != k), [i for i in range(len(names)) if i != k]
                    no = {x: i for i, x in enumerate(rest)}
                    try:
                        c, _, _ = solve(len(rest), np.array([no[i] for i in a[keep]], int), np.array([no[i] for i in b[keep]], int), y[keep], w[keep])
                        shift = full[rest] - full[rest].mean() - c
                    except np.linalg.LinAlgError:
                        shift = [None] * len(rest)
                    rows += [(row.ts, names[k], names[i], None if v is None else float(v)) for i, v in zip(rest, shift)]
            yield pd.DataFrame(rows, columns=["ts", "dropped", "node", "shift"])

    return _bars(quotes, ("ts",)).mapInPandas(run, "ts timestamp_ntz, dropped string, node string, shift double")


def huber(quotes: DataFrame, k: float = 1.345, scheme: str = "unweighted", scale: str = "spread", noise_ratio: float = NOISE_RATIO) -> DataFrame:
    """ts, kind, a, b, value, psi, iterations, converged of a Huber fit by reweighting. scale: noise_ratio times each pair's spread, or the bar's MAD."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for row, names, a, b, y, s in _each(df):
                w = weights(scheme, s)
                try:
                    c, e, h = solve(len(names), a, b, y, w)
                except np.linalg.LinAlgError:
                    continue
                psi, done, it = np.ones(len(y)), math.isinf(k), 0
                while not done and it < HUBER_ITERATIONS:
                    it += 1
                    if scale == "spread":
                        sigma = noise_ratio * s
                    else:
                        pool = np.abs(e[1 - h >= BRIDGE_TOL])
                        sigma = np.full(len(y), max(1.4826 * float(np.median(pool)), MAD_FLOOR_BPS) if len(pool) else MAD_FLOOR_BPS)
                    psi = np.minimum(1.0, k * sigma / np.maximum(np.abs(e), 1e-300))
                    try:
                        new, e, h = solve(len(names), a, b, y, w * psi)
                    except np.linalg.LinAlgError:  # weights too far apart to go on: what there is hasn't converged
                        break
                    done = bool(np.abs(new - c).max() < HUBER_TOL)
                    c = new
                rows += [(row.ts, "node", names[i], None, float(c[i]), None, it, done) for i in range(len(names))]
                rows += [(row.ts, "pair", names[a[i]], names[b[i]], float(e[i]), float(psi[i]), it, done) for i in range(len(y))]
            yield pd.DataFrame(rows, columns=["ts", "kind", "a", "b", "value", "psi", "iterations", "converged"])

    return _bars(quotes, ("ts",)).mapInPandas(run, "ts timestamp_ntz, kind string, a string, b string, value double, psi double, iterations int, converged boolean")


#: Tuning constants and scales of the Huber fits of a method grid.
HUBER_KS, HUBER_SCALES = (1.0, 1.345, 2.0, 3.0), ("spread", "mad")


def method_names(schemes: Sequence[str] = SCHEMES, ks: Sequence[float] = HUBER_KS, scales: Sequence[str] = HUBER_SCALES) -> list[tuple[str, str, float, str]]:
    """(name, scheme, k, scale): least squares once a scheme, and Huber for every k and scale."""
    return [(f"ls|{s}", s, math.inf, "spread") for s in schemes] + [(f"huber{k:g}|{x}|{s}", s, k, x) for s in schemes for k in ks for x in scales]


def solve_stack(d: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """solve for many rows of y and w over one topology d (pairs x nodes): (strengths, residuals, hat values, whether the graph hangs together)."""
    n = d.shape[1]
    m = np.einsum("pi,kp,pj->kij", d, w, d, optimize=True)
    ok = np.linalg.matrix_rank(m, tol=1e-9 * np.maximum(1.0, np.abs(m).max((1, 2)))) >= n - 1
    inv = np.linalg.inv(np.where(ok[:, None, None], m, np.eye(n)) + 1.0 / n)
    c = np.einsum("kij,kj->ki", inv, (w * y) @ d)
    c = c + np.einsum("kij,kj->ki", inv, (w * (y - c @ d.T)) @ d)
    return c - c.mean(1, keepdims=True), y - c @ d.T, w * np.einsum("pi,kij,pj->kp", d, inv, d, optimize=True), ok


def _huber_stack(d: np.ndarray, y: np.ndarray, s: np.ndarray, w: np.ndarray, k: np.ndarray, by_mad: np.ndarray, noise_ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(strengths, iterations, converged, fitted at all) of rows of bars and methods; rows that are done leave the stack."""
    c, e, h, fits = solve_stack(d, y, w)
    done, its, live = np.isinf(k) | ~fits, np.zeros(len(y), int), np.flatnonzero(fits & ~np.isinf(k))
    for _ in range(HUBER_ITERATIONS):
        if not len(live):
            break
        its[live] += 1
        sigma = noise_ratio * s[live]
        if (mad := by_mad[live]).any():
            pool = np.where(1 - h[live[mad]] >= BRIDGE_TOL, np.abs(e[live[mad]]), np.nan)
            none = np.isnan(pool).all(1)
            pool[none] = 0.0
            sigma[mad] = np.maximum(1.4826 * np.nanmedian(pool, axis=1), MAD_FLOOR_BPS)[:, None]
        psi = np.minimum(1.0, k[live, None] * sigma / np.maximum(np.abs(e[live]), 1e-300))
        new, e_new, h_new, ok = solve_stack(d, y[live], w[live] * psi)
        go = live[ok]  # of the others the weights are too far apart: what there is hasn't converged
        done[go] = np.abs(new[ok] - c[go]).max(1) < HUBER_TOL
        c[go], e[go], h[go] = new[ok], e_new[ok], h_new[ok]
        live = go[~done[go]]
    return c, its, done & fits, fits


def method_grid(quotes: DataFrame, methods: Sequence[tuple[str, str, float, str]] | None = None, noise_ratio: float = NOISE_RATIO) -> DataFrame:
    """ts, method, strengths (map of node to strength), iterations, converged: a row for each bar and method whose fit hangs together.

    The bars of an Arrow batch that have the same pairs are one tensor of bars x methods, fitted together in one pass of
    the data; agrees with fit and huber method by method.
    """
    methods = list(methods or method_names())
    names = [m[0] for m in methods]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            groups: dict[tuple, list] = {}
            for row in df.itertuples(index=False):
                groups.setdefault(tuple((o["a"], o["b"]) for o in row.obs), []).append((row.ts, [o["y"] for o in row.obs], [o["s"] for o in row.obs]))
            out = []
            for pairs, bars in groups.items():
                nodes = sorted({x for p in pairs for x in p})
                no = {x: i for i, x in enumerate(nodes)}
                d = np.zeros((len(pairs), len(nodes)))
                for i, (a, b) in enumerate(pairs):
                    d[i, no[a]], d[i, no[b]] = 1.0, -1.0
                y, s = np.array([b[1] for b in bars], float), np.array([b[2] for b in bars], float)
                w = np.stack([np.stack([weights(scheme, x) for x in s]) for _, scheme, _, _ in methods], 1).reshape(-1, len(pairs))
                each = lambda x: np.repeat(x, len(methods), axis=0)
                k, mad = (np.tile(np.array(x), len(bars)) for x in ([m[2] for m in methods], [m[3] == "mad" for m in methods]))
                c, its, done, fits = _huber_stack(d, each(y), each(s), w, k, mad, noise_ratio)
                for i in np.flatnonzero(fits):
                    out.append((bars[i // len(methods)][0], names[i % len(methods)], dict(zip(nodes, c[i].tolist())), int(its[i]), bool(done[i])))
            yield pd.DataFrame(out, columns=["ts", "method", "strengths", "iterations", "converged"])

    return _bars(quotes, ("ts",)).mapInPandas(run, "ts timestamp_ntz, method string, strengths map<string,double>, iterations int, converged boolean")


def corrected(quotes: DataFrame, corrections: DataFrame, scheme: str = "unweighted") -> DataFrame:
    """ts, node, c, c_corrected: strengths as quoted, and after the estimates in corrections (ts, a, b, estimate) are taken off their pairs' ln-mids.

    Only bars with a correction are fitted twice over, and not anew: weights and pairs stay, so the second fit is the kept
    inverse times what changed. Elsewhere c_corrected is c. Corrections of pairs that a bar hasn't got are ignored.
    """
    o = observations(quotes)
    d = corrections.groupBy("ts", "a", "b").agg(F.sum("estimate").alias("d"))
    bars = o.join(d, ["ts", "a", "b"], "left").groupBy("ts").agg(F.array_sort(F.collect_list(F.struct("a", "b", "y", "s", F.coalesce("d", F.lit(0.0)).alias("d")))).alias("obs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for row, names, a, b, y, s in _each(df):
                w = weights(scheme, s)
                try:
                    c, _, _ = solve(len(names), a, b, y, w)
                except np.linalg.LinAlgError:
                    continue
                delta, new = np.array([x["d"] for x in row.obs]), c
                if delta.any():
                    m = np.zeros((len(y), len(names)))
                    m[np.arange(len(y)), a], m[np.arange(len(y)), b] = 1.0, -1.0
                    new = c - np.linalg.inv(m.T @ (m * w[:, None]) + 1.0 / len(names)) @ (m.T @ (w * delta))
                    new = new - new.mean()
                rows += [(row.ts, names[i], float(c[i]), float(new[i])) for i in range(len(names))]
            yield pd.DataFrame(rows, columns=["ts", "node", "c", "c_corrected"])

    return bars.mapInPandas(run, "ts timestamp_ntz, node string, c double, c_corrected double")


def incident_spread(obs: DataFrame) -> DataFrame:
    """ts, node, spread: mean spread of the node's pairs."""
    return obs.select("ts", F.explode(F.array("a", "b")).alias("node"), "s").groupBy("ts", "node").agg(F.avg("s").alias("spread"))


def views(strengths: DataFrame, obs: DataFrame, ref: str) -> DataFrame:
    """ts, node, zero_sum, vs_ref, basket_equal, basket_inv_spread. vs_ref is null in bars without the reference."""
    w = Window.partitionBy("ts")
    out = strengths.join(incident_spread(obs), ["ts", "node"])
    at = F.max(F.when(F.col("node") == ref, F.col("c"))).over(w)
    inv = F.sum(F.col("c") / F.col("spread")).over(w) / F.sum(1 / F.col("spread")).over(w)
    return out.select("ts", "node", F.col("c").alias("zero_sum"), (F.col("c") - at).alias("vs_ref"), (F.col("c") - F.avg("c").over(w)).alias("basket_equal"), (F.col("c") - inv).alias("basket_inv_spread"))


def paths(obs: DataFrame, anchors: tuple[str, str] | None = None) -> DataFrame:
    """ts, path, estimate, spread: ways to measure strength(A) - strength(B) of the anchors: the hub pair, and one arm over each node with a pair to both."""
    first, second = anchors or hub_and_arms(obs)
    both = obs.select("ts", F.col("a").alias("p"), F.col("b").alias("q"), "y", "s").unionByName(obs.select("ts", F.col("b").alias("p"), F.col("a").alias("q"), (-F.col("y")).alias("y"), "s"))
    hub = both.where((F.col("p") == first) & (F.col("q") == second)).select("ts", F.lit("hub").alias("path"), F.col("y").alias("estimate"), F.col("s").alias("spread"))
    to = both.where((F.col("p") == first) & (F.col("q") != second)).select("ts", F.col("q").alias("x"), F.col("y").alias("y1"), F.col("s").alias("s1"))
    fro = both.where((F.col("q") == second) & (F.col("p") != first)).select("ts", F.col("p").alias("x"), F.col("y").alias("y2"), F.col("s").alias("s2"))
    arm = to.join(fro, ["ts", "x"]).select("ts", F.concat(F.lit("arm:"), "x").alias("path"), (F.col("y1") + F.col("y2")).alias("estimate"), (F.col("s1") + F.col("s2")).alias("spread"))
    return hub.unionByName(arm)


def attribution(path_rows: DataFrame, threshold: float = 1.0, least: int = 3) -> DataFrame:
    """ts, paths, median, verdict, margin: the path whose distance from the median is over threshold times its spread.

    clean: none; ambiguous: more than one, with margin the ratio of the two worst; insufficient: fewer than least paths.
    """
    med = path_rows.groupBy("ts").agg(F.percentile("estimate", 0.5).alias("median"), F.count(F.lit(1)).alias("paths"))
    r = path_rows.join(med, "ts").withColumn("ratio", F.abs(F.col("estimate") - F.col("median")) / F.greatest(F.col("spread"), F.lit(1e-12)))
    over = F.when(F.col("ratio") > threshold, F.struct(F.col("ratio"), F.col("path")))
    g = r.groupBy("ts").agg(F.max("paths").alias("paths"), F.max("median").alias("median"), F.sort_array(F.collect_list(over), asc=False).alias("worst"))
    n = F.size("worst")
    enough = F.col("paths") >= least
    name = F.when(~enough, "insufficient").when(n == 0, "clean").when(n == 1, F.get("worst", F.lit(0))["path"]).otherwise("ambiguous")
    margin = F.when(enough & (n > 1), F.get("worst", F.lit(0))["ratio"] / F.get("worst", F.lit(1))["ratio"])
    return g.select("ts", "paths", F.when(enough, F.col("median")).alias("median"), name.alias("verdict"), margin.alias("margin"))


def pair_groups(obs: DataFrame, anchors: tuple[str, str]) -> Column:
    """hub, arm:<node> or other, by a pair's names; every node but the anchors is taken to have a pair to both."""
    first, second = anchors
    hub = F.col("a").isin(first, second) & F.col("b").isin(first, second)
    other = F.when(F.col("a").isin(first, second), F.col("b")).when(F.col("b").isin(first, second), F.col("a"))
    return F.when(hub, "hub").when(other.isNotNull(), F.concat(F.lit("arm:"), other)).otherwise("other")
