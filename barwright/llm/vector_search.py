"""Nearest neighbours by randomly rotated one-bit codes: estimates with error bounds choose the vectors that are measured.

A vector is taken as its difference from the nearest of a few centres, turned by a random rotation that all share, and kept
as the signs of its components, one bit each, with two scalars: the difference's length, and the inner product of its
direction with the direction that the signs stand for. Signs and scalars give an unbiased estimate of the inner product with
any query and a bound of the estimate's error, so a lower bound of the distance. A vector is measured on its original
components only if that bound is within the k-th distance known so far; a whole list is left out if by its centre and its
largest length no vector of it can be near enough. Vectors lie with their codes, so that what is chosen is measured in the
task that chose it: no pair leaves a task, k rows a query do. A round holds a bounded number of queries against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import store, table

#: Rows that centres are fitted on and first distances are measured to, at most, and the number of centres. All rows are indexed.
SAMPLE_ROWS, CENTRES, FIT_ROUNDS = 8_192, 64, 10
#: Components of the queries that one round sends to all tasks (32 MB); more queries are searched in more rounds.
MAX_QUERY_VALUES = 4_000_000
#: Standard deviations of an estimate's error that its bound covers.
EPSILON = 3.5
#: Queries estimated and pairs measured at once.
QUERY_BLOCK, PAIR_BLOCK = 512, 65_536

FIELDS = "tag long, vec_id long, embedding array<double>, list int, code binary, length double, agreement double"


@dataclass
class Coder:
    """Centres and rotation: what turns vectors into codes."""

    centres: np.ndarray  # lists x dims
    rotation: np.ndarray  # dims x dims, orthogonal

    @classmethod
    def fit(cls, sample: np.ndarray, dims: int, seed: int = 0) -> Coder:
        """Centres by k-means over the sample, a rotation by orthogonalising a Gaussian matrix."""
        rng = np.random.default_rng(seed)
        q, r = np.linalg.qr(rng.standard_normal((dims, dims)))
        k = min(CENTRES, -(-len(sample) // 128))
        centres = sample[rng.permutation(len(sample))[:k]] if k else np.zeros((1, dims))
        for _ in range(FIT_ROUNDS if k > 1 else 0):
            near = nearest_centre(sample, centres)
            n = np.bincount(near, minlength=k)
            total = np.zeros_like(centres)
            np.add.at(total, near, sample)
            centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
        return cls(sample.mean(0, keepdims=True) if k == 1 else centres, q * np.sign(np.diag(r)))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, packed signs, length, agreement) of vectors; agreement is the inner product of a direction with its signs' direction."""
        own = nearest_centre(x, self.centres)
        rest = x - self.centres[own]
        length = np.sqrt((rest * rest).sum(1))
        turned = (rest / np.where(length > 0, length, 1)[:, None]) @ self.rotation.T
        agreement = np.where(length > 0, np.abs(turned).sum(1) / np.sqrt(x.shape[1]), 1)
        return own, np.packbits(turned > 0, axis=1), length, agreement


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), axis=1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, dims)


def _encoded(sent, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = sent.value
        for b in batches:
            if b.num_rows:
                own, code, length, agreement = coder.encode(_matrix(b.column("embedding"), dims))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, "int32"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(length), pa.array(agreement)], [x.split()[0] for x in FIELDS.split(", ")])

    return run


class Searcher:
    """Some queries' nearest so far, over batches of coded vectors."""

    def __init__(self, coder: Coder, tags: np.ndarray, queries: np.ndarray, within: np.ndarray, k: int, epsilon: float):
        self.coder, self.tags, self.q, self.k = coder, tags, queries, k
        self.within = within.copy()  # no more than so far is the k-th nearest
        dims = queries.shape[1]
        self.root, self.spread = np.sqrt(dims), epsilon / np.sqrt(max(dims - 1, 1))
        self.turned = queries @ coder.rotation.T
        self.turned_centres = coder.centres @ coder.rotation.T
        self.distance = np.full((len(tags), k), np.inf)
        self.none, self.id = np.ones((len(tags), k), bool), np.full((len(tags), k), np.iinfo("int64").max)
        self.measured = 0

    def take(self, tag: np.ndarray, none: np.ndarray, ids: np.ndarray, x: np.ndarray, own: np.ndarray, code: np.ndarray, length: np.ndarray, agreement: np.ndarray) -> None:
        """Look at a batch of vectors."""
        signs = np.unpackbits(code, axis=1, count=x.shape[1]).astype("float64") * 2 - 1
        error = np.sqrt(np.maximum(1 - agreement * agreement, 0)) / agreement * self.spread
        for c in np.unique(own):
            rows = np.flatnonzero(own == c)
            to_centre = np.sqrt(((self.q - self.coder.centres[c]) ** 2).sum(1))
            open_ = np.flatnonzero(to_centre - length[rows].max() <= self.within)
            s, n, e = signs[rows], length[rows], error[rows]
            base = s @ self.turned_centres[c]
            for at in range(0, len(open_), QUERY_BLOCK):
                some = open_[at : at + QUERY_BLOCK]
                near = to_centre[some][:, None]
                inner = (self.turned[some] @ s.T - base) / (self.root * agreement[rows])
                square = n * n + near * near - 2 * n * inner
                slack = 2 * n * e * near + 1e-9 * (n * n + near * near)
                if len(rows) > self.k:  # one more than k, as a query may meet itself
                    upper = np.partition(square + slack, self.k, axis=1)[:, self.k]
                    self.within[some] = np.minimum(self.within[some], np.sqrt(np.maximum(upper, 0)))
                i, j = np.nonzero(square - slack <= self.within[some][:, None] ** 2)
                self._measure(some[i], rows[j], tag, none, ids, x)

    def _measure(self, i: np.ndarray, j: np.ndarray, tag: np.ndarray, none: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        other = self.tags[i] != tag[j]
        i, j = i[other], j[other]
        self.measured += len(i)
        d = np.concatenate([np.zeros(0), *(np.sqrt(((x[j[a : a + PAIR_BLOCK]] - self.q[i[a : a + PAIR_BLOCK]]) ** 2).sum(1)) for a in range(0, len(i), PAIR_BLOCK))])
        better = d <= self.distance[i, -1]
        i, j, d = i[better], j[better], d[better]
        if not len(i):
            return
        hit = np.unique(i)
        of = np.concatenate([np.repeat(hit, self.k), i])
        all_ = [np.concatenate([a[hit].ravel(), b]) for a, b in ((self.distance, d), (self.none, none[j]), (self.id, ids[j]))]
        order = np.lexsort((all_[2], all_[1], all_[0], of))
        of = of[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        order, of, place = order[place < self.k], of[place < self.k], place[place < self.k]
        self.distance[of, place], self.none[of, place], self.id[of, place] = (a[order] for a in all_)
        self.within[hit] = np.minimum(self.within[hit], self.distance[hit, -1])


def _nearest(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Searcher(*sent.value)
        for b in batches:
            if b.num_rows:
                col = lambda c: b.column(c).to_numpy(zero_copy_only=False)  # noqa: E731, B023
                none = pa.compute.is_null(b.column("vec_id")).to_numpy(zero_copy_only=False)
                ids = pa.compute.fill_null(b.column("vec_id"), 0).to_numpy()
                code = np.frombuffer(b"".join(b.column("code").to_pylist()), "uint8").reshape(b.num_rows, -1)
                s.take(col("tag"), none, ids, _matrix(b.column("embedding"), s.q.shape[1]), col("list"), code, col("length"), col("agreement"))
        i, at = np.nonzero(np.isfinite(s.distance))
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(s.tags[i]), pa.array(s.id[i, at], mask=s.none[i, at]), pa.array(s.distance[i, at])], ["query", "vec_id", "score"])

    return run


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int | None = None) -> tuple[DataFrame, int]:
    """(tag, vec_id, embedding of doubles; stored, and the dims) of the rows that take part: not null, not zero, all components finite, dims long (None: the commonest length)."""
    v = F.col("embedding")
    good = v.isNotNull() & F.forall(v, lambda x: F.coalesce(x - x == 0, F.lit(False))) & F.exists(v, lambda x: x != 0)  # NaN equals NaN in Spark, but infinity less itself is NaN
    kept = rows.select(F.monotonically_increasing_id().alias("tag"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).where(good)
    kept = store(kept, "vectors")
    if dims is None:
        common = kept.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
        dims = common["dims"] if common else 0
    return kept.where(F.size("embedding") == dims), dims


def build(vectors: DataFrame, dims: int, seed: int = 0) -> tuple[DataFrame, Coder, np.ndarray, np.ndarray]:
    """(index, coder, tags and vectors of the sample): every vector is coded; the coder is fitted on SAMPLE_ROWS of them at most, chosen by hash."""
    sample = vectors.orderBy(F.xxhash64("tag"), "tag").limit(SAMPLE_ROWS).toPandas()
    x = np.array(sample["embedding"].tolist(), "float64").reshape(-1, dims)
    coder = Coder.fit(x, dims, seed)
    sent = vectors.sparkSession.sparkContext.broadcast(coder)
    return store(vectors.mapInArrow(_encoded(sent, dims), FIELDS), "vector-codes"), coder, sample["tag"].to_numpy("int64"), x


def first_bounds(tags: np.ndarray, queries: np.ndarray, sample_tags: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th distance to the sample's other rows; infinite if there are fewer."""
    out = np.full(len(tags), np.inf)
    for at in range(0, len(tags), QUERY_BLOCK):
        q = queries[at : at + QUERY_BLOCK]
        square = (q * q).sum(1)[:, None] + (sample * sample).sum(1) - 2 * q @ sample.T
        square[tags[at : at + QUERY_BLOCK, None] == sample_tags] = np.inf
        if len(sample) >= k:
            kth = np.partition(square, k - 1, axis=1)[:, k - 1]
            out[at : at + QUERY_BLOCK] = np.sqrt(np.maximum(kth, 0)) * (1 + 1e-6) + 1e-6
    return out


def neighbours(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", dims: int | None = None, epsilon: float = EPSILON, seed: int = 0, max_query_values: int = MAX_QUERY_VALUES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each row for which is_query (on vec_id) holds, nearest first, ties to the smaller vec_id (null last).

    score is the Euclidean distance in double precision. Vectors that are null, empty or zero, that hold a null or non-finite
    component, or whose length isn't dims (None: the commonest) take no part. Rows that repeat an identifier are rows of
    their own, so each finds the others. Fewer than k other rows: all of them. An empty table gives no rows. Other columns
    are ignored, whatever their names. epsilon is the width of the error bounds; recall against brute force is tested.
    """
    spark = rows.sparkSession
    vectors, dims = usable(rows, id_col, vector_col, dims)
    asked = vectors.where(is_query)
    rounds = -(-asked.count() * dims // max_query_values)
    found = spark.createDataFrame([], "query long, vec_id long, score double")
    if rounds:
        index, coder, sample_tags, sample = build(vectors, dims, seed)
    for r in range(rounds):
        part: pd.DataFrame = asked.where(F.pmod(F.xxhash64("tag"), F.lit(rounds)) == r).select("tag", "embedding").toPandas()
        if part.empty:
            continue
        tags, queries = part["tag"].to_numpy("int64"), np.array(part["embedding"].tolist(), "float64")
        sent = spark.sparkContext.broadcast((coder, tags, queries, first_bounds(tags, queries, sample_tags, sample, k), k, epsilon))
        found = found.unionByName(index.mapInArrow(_nearest(sent), "query long, vec_id long, score double"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("score", F.asc_nulls_last("vec_id")))
    top = found.withColumn("rank", place).where(F.col("rank") <= k)
    names = asked.select(F.col("tag"), F.col("vec_id").alias("query_id"))
    return top.join(names, F.col("query") == F.col("tag")).select("query_id", "rank", "vec_id", "score")


def op13_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE = r"""
WITH v AS (SELECT row_number() OVER () AS tag, vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     d AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score, q.tag FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.tag <> c.tag)
SELECT query_id, row_number() OVER (PARTITION BY tag ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score FROM d QUALIFY rank <= 10
"""

QUERIES = {"op13_vector_search": op13_vector_search}
ORACLES = {"op13_vector_search": ORACLE}
