"""Quality by hierarchical empirical Bayes: a document's own evidence, and the rate of good documents at its path and host.

A logistic classifier of surface features, fitted on a bounded sample of labelled rows, gives each document a chance p.
Sums of p by host and by path make the posteriors: a path's rate is shrunk toward its host's, a host's toward the whole
corpus's, by as much as the spread between groups (method of moments) calls for; sparse sites stay near the global rate. A
document's odds are its likelihood ratio times the odds of its path, which leave out the document itself.
The table documents has no url: by default its column source stands in for the host, and lang for the path.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, small, store, table

#: Labelled rows that the classifier is fitted on, at most: those of the least hashes of doc_id.
MAX_LABELLED = 20_000
#: Rows of the table of groups that are broadcast; more are joined by shuffle.
MAX_BROADCAST_GROUPS = 200_000
_UPPER = bytes(range(65, 91))
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_PLAIN = b".,;:'\"-?()"
_SYMBOLS = bytes(c for c in range(33, 127) if c not in _LETTERS + _DIGITS + _PLAIN)
FEATURES = 11
#: Texts that a task holds as Python's at once.
CHUNK_ROWS = 500


def features(text: str | None) -> list[float]:
    """Ratios over the whole text; zeros for an empty one."""
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()
    n = len(words)
    if not n:
        return [0.0] * (FEATURES - 1) + [1.0]
    size = len(b)
    without = lambda chars: size - len(b.translate(None, chars))
    letters, counts = without(_LETTERS), Counter(words)
    return [
        without(_UPPER) / max(1, letters), without(_SYMBOLS) / size, min(1.0, b.count(b"!") / n), min(1.0, b.count(b"|") / n), without(_DIGITS) / size, without(_PLAIN) / size,
        len(counts) / n, counts.most_common(1)[0][1] / n, sum(map(eq, words, words[1:])) / n, min(3.0, size / n / 10), 0.0,
    ]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression over standardised features, by Newton steps: (3, FEATURES + 1) mean, scale, weights."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    reg = np.full(z.shape[1], ridge)
    reg[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + reg * len(x) / 100 * w
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(reg * len(x) / 100 + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.vstack([np.append(mean, 0), np.append(scale, 1), w])


def _chance(model: np.ndarray, x: np.ndarray) -> np.ndarray:
    z = np.hstack([np.clip((x - model[0, :-1]) / model[1, :-1], -8, 8), np.ones((len(x), 1))])
    return np.clip(1 / (1 + np.exp(-np.clip(z @ model[2], -30, 30))), 1e-4, 1 - 1e-4)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """(model, share of good rows) from max_labelled labelled rows at most. Without rows of both labels every chance is that share."""
    some = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y")).orderBy(F.xxhash64("__id"), "__y").limit(max_labelled)
    some = store(some, "quality-labels")

    @F.pandas_udf("array<double>")
    def of(text: pd.Series) -> pd.Series:
        return text.map(features)

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(F.broadcast(some), "__id").select(of("__t").alias("x"), "__y").orderBy(F.xxhash64("x"), "__y").limit(max_labelled).toPandas()
    y = rows["__y"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        rate = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        flat = np.vstack([np.zeros(FEATURES + 1), np.ones(FEATURES + 1), np.zeros(FEATURES + 1)])
        flat[2, -1] = np.log(rate / (1 - rate))
        return flat, rate
    return fit(np.array(rows["x"].tolist()), y), float(y.mean())


def chance(model: np.ndarray, text: Column) -> Column:
    """The classifier's chance that the text is good."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:  # texts become Python's some at a time
        rows = [features(t) for at in range(0, len(texts), CHUNK_ROWS) for t in texts.slice(at, CHUNK_ROWS).to_pylist()]
        return pa.array(_chance(model, np.array(rows).reshape(-1, FEATURES)), pa.float64())

    return run(text)


def _spread(groups: DataFrame, mean: Column) -> float:
    """Weight of the prior in documents (kappa of a beta distribution with that mean), from sums n, s, v (of p * (1 - p)) by group."""
    d = groups.select("n", (F.col("s") / F.col("n")).alias("m"), mean.alias("mu"), (F.col("v") / F.col("n")).alias("w")).where("n > 1")
    between, within, var = d.agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mu"), 2)) / F.sum("n"), F.sum(F.col("w")) / F.sum("n"), F.sum(F.col("n") * F.col("mu") * (1 - F.col("mu"))) / F.sum("n")).first()
    if between is None:
        return 1e6
    return float(np.clip((var or 0.25) / max(between - (within or 0.0), 1e-6) - 1, 2.0, 1e6))


def _odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", threshold: float = 0.5) -> DataFrame:
    """docs with __evidence (the classifier's chance), __prior (the rate at its path, without it) and __posterior.

    Null text counts as empty, null hosts and paths as hosts and paths of their own; repeated rows count as rows. An empty
    table gives no rows; without labels of both kinds only the sites speak. Other columns are left as they are.
    """
    model, rate = train(docs, labels, id_col, text_col, label_col)
    scored = docs.withColumn("__evidence", chance(model, F.col(text_col)))
    each = scored.groupBy(F.col(host_col).alias("__h"), F.col(path_col).alias("__p")).agg(F.count(F.lit(1)).alias("n"), F.sum("__evidence").alias("s"), F.sum(F.col("__evidence") * (1 - F.col("__evidence"))).alias("v"))
    paths = store(each, "quality-paths")
    hosts = store(paths.groupBy("__h").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("v").alias("v")), "quality-hosts")
    n, s, n_paths = *hosts.agg(F.sum("n"), F.sum("s")).first(), paths.count()
    mu = s / n if n else rate
    k1 = _spread(hosts, F.lit(mu))
    of_host = hosts.select(F.col("__h").alias("__hh"), F.col("n").alias("__hn"), F.col("s").alias("__hs"))
    both = store(paths.join(small(of_host, hosts.count(), MAX_BROADCAST_GROUPS), F.col("__h").eqNullSafe(F.col("__hh"))).drop("__hh"), "quality-groups")
    k2 = _spread(both, (F.col("__hs") + k1 * mu) / (F.col("__hn") + k1))
    groups = both.select(F.col("__h").alias("__gh"), F.col("__p").alias("__gp"), F.col("n").alias("__n"), F.col("s").alias("__s"), "__hn", "__hs")
    out = join_groups(scored, groups, n_paths, MAX_BROADCAST_GROUPS, [(host_col, "__gh"), (path_col, "__gp")], F.xxhash64(F.col(id_col), F.col(text_col)))
    e = F.col("__evidence")
    host = (F.col("__hs") - e + k1 * mu) / (F.col("__hn") - 1 + k1)
    path = F.least(F.greatest((F.col("__s") - e + k2 * host) / (F.col("__n") - 1 + k2), F.lit(1e-4)), F.lit(1 - 1e-4))
    out = out.withColumn("__prior", path).withColumn("__posterior", 1 / (1 + F.exp(-(_odds(e) - float(np.log(rate / (1 - rate))) + _odds(F.col("__prior"))))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "__evidence", "__prior", "__posterior").withColumn("__kept", F.col("__posterior") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    """The rows of docs that the classifier keeps, with docs' own columns."""
    return judge(docs, labels, **names).where("__kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.col("__evidence").alias("evidence"), F.col("__prior").alias("site_prior"), F.col("__posterior").alias("posterior"), F.col("__kept").alias("kept"))


QUERIES = {"op3_quality": op3_quality}
ORACLES: dict[str, str] = {}
