"""Ranked lexical search by Fagin's threshold algorithm, over an index that is split by documents.

One scan of the documents makes the forward index: a row for each document with its number of terms and, for the terms that
items use, (term, occurrences). Each task of the search takes its documents in shards of bounded size, sorts a shard's
postings into one list a term by falling impact, and runs the threshold algorithm for each item: it reads the lists in
turn, some postings of each a round, looks the documents met there up in the forward index for their whole score, and stops
once the best score that a document not yet met could have, the sum of what was last read in each list, falls strictly
below the k-th score so far. The k best of a task carry over from shard to shard, so that later shards stop sooner. As
shards hold documents and not terms, the list of a frequent term is spread over all tasks; a task gives k rows an item at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import store, table
from .decontaminate import words_of

#: Rows (item, term) that one round of the search sends to all tasks (some 30 MB); more items are searched in more rounds.
MAX_QUERY_TERMS = 500_000
#: Postings to a shard; characters of text and rows that a task splits into terms at once.
SHARD_POSTINGS, CHUNK_CHARS, CHUNK_ROWS = 1_000_000, 2_000_000, 500
#: Postings read of each list in the first round; each round reads twice as many as the one before.
FIRST_READ = 16

#: Bytes of a term stay (0-9, a-z, 80-FF), A-Z are lower-cased, all others separate terms.
_FOLD = bytes(b if b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def term_counts(texts: list[bytes | None], ids: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms in all, starts, term, tf) of some texts: text i has the known terms term[starts[i]:starts[i + 1]], ascending."""
    words = [(t or b"").translate(_FOLD).split() for t in texts]
    n = np.fromiter(map(len, words), "int64", len(words))
    known = np.fromiter(map(ids.get, chain.from_iterable(words), repeat(-1)), "int64", int(n.sum()))
    owner = np.repeat(np.arange(len(n)), n)[known >= 0]
    key, tf = np.unique(owner * len(ids) + known[known >= 0], return_counts=True)
    doc, term = (key // len(ids), key % len(ids)) if ids else (key, key)
    return n, np.searchsorted(doc, np.arange(len(n) + 1)), term, tf


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of CHUNK_ROWS rows at most, cut after about CHUNK_CHARS bytes of text."""
    for b in batches:
        for at in range(0, b.num_rows, CHUNK_ROWS):
            part = b.slice(at, CHUNK_ROWS)
            texts = part.column("text").to_pylist()
            start = size = 0
            for i, t in enumerate(texts):
                size += len(t or b"")
                if size >= CHUNK_CHARS or i == len(texts) - 1:
                    yield part.slice(start, i + 1 - start), texts[start : i + 1]
                    start, size = i + 1, 0


def _forward(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = sent.value
        for b, texts in _pieces(batches):
            n, starts, term, tf = term_counts(texts, ids)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(starts, "int32"), pa.array(x, "int32"))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), lists(term), lists(tf)], ["doc_id", "n", "terms", "tfs"])

    return run


def forward_index(docs: DataFrame, ids: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms in all), terms and tfs (the known terms, by their numbers in ids, and their occurrences), stored."""
    sent = docs.sparkSession.sparkContext.broadcast(ids)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return store(base.mapInArrow(_forward(sent), "doc_id long, n long, terms array<int>, tfs array<int>"), "search-forward")


@dataclass
class Shard:
    """Postings by document (the forward index) and by term with falling impact."""

    ids: np.ndarray  # doc_id
    none: np.ndarray  # whether it is null
    starts: np.ndarray
    term: np.ndarray
    impact: np.ndarray
    list_starts: np.ndarray
    list_doc: np.ndarray
    list_impact: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, none: np.ndarray, n: np.ndarray, starts: np.ndarray, term: np.ndarray, tf: np.ndarray, n_docs: int, n_all: int, n_terms: int) -> Shard:
        m = 25 + 75 * n * n_docs // max(n_all, 1)
        owner = np.repeat(np.arange(len(n)), np.diff(starts))
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[owner])
        order = np.lexsort((-impact, term))
        return cls(ids, none, starts, term, impact, np.searchsorted(term[order], np.arange(n_terms + 1)), owner[order], impact[order])

    def scores(self, docs: np.ndarray, coef: np.ndarray) -> np.ndarray:
        """Random lookups: whole scores of docs, which have a posting each, by the forward index."""
        n = self.starts[docs + 1] - self.starts[docs]
        first = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(self.starts[docs] - first, n)
        return np.add.reduceat(coef[self.term[at]] * self.impact[at], first)


#: The best documents so far: scores, whether doc_id is null, doc_id; best first.
Best = tuple[np.ndarray, np.ndarray, np.ndarray]
NOTHING: Best = (np.zeros(0, "int64"), np.zeros(0, bool), np.zeros(0, "int64"))


def search(shard: Shard, terms: np.ndarray, coef: np.ndarray, k: int, best: Best = NOTHING) -> tuple[Best, int]:
    """(the k best of best and the shard by (score, doc_id, null last), postings read) for an item with terms; coef: by term, 0 for all others."""
    terms = terms[(coef[terms] > 0) & (shard.list_starts[terms + 1] > shard.list_starts[terms])]
    first, end, weight = shard.list_starts[terms], shard.list_starts[terms + 1], coef[terms]
    met = np.zeros(len(shard.ids), bool)
    depth, read, step = 0, 0, FIRST_READ
    while len(terms) and (first + depth < end).any():
        docs = np.concatenate([shard.list_doc[a + depth : min(a + depth + step, b)] for a, b in zip(first, end)])
        read += len(docs)
        docs = np.unique(docs[~met[docs]])
        if len(docs):
            met[docs] = True
            score, none, ids = (np.concatenate(x) for x in zip(best, (shard.scores(docs, coef), shard.none[docs], shard.ids[docs])))
            order = np.lexsort((ids, none, -score))[:k]
            best = score[order], none[order], ids[order]
        depth, step = depth + step, step * 2
        last = first + depth - 1
        threshold = int((weight * shard.list_impact[np.minimum(last, end - 1)])[last < end].sum())  # a list that is read to its end has nothing for others
        if len(best[0]) == k and threshold < best[0][-1]:
            break
    return best, read


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, none, n, starts, term, tf) of some documents with postings each, about SHARD_POSTINGS postings at once."""
    held, size = [], 0

    def joined() -> tuple[np.ndarray, ...]:
        t = pa.Table.from_batches(held).combine_chunks()
        one = lambda c: t[c].chunk(0)
        flat = lambda c: one(c).flatten().to_numpy(zero_copy_only=False).astype("int64")
        lengths = pa.compute.list_value_length(one("terms")).to_numpy(zero_copy_only=False).astype("int64")
        ids = pa.compute.fill_null(one("doc_id"), 0).to_numpy()
        return ids, pa.compute.is_null(one("doc_id")).to_numpy(zero_copy_only=False), one("n").to_numpy(), np.concatenate([[0], np.cumsum(lengths)]), flat("terms"), flat("tfs")

    for b in batches:
        for at in range(0, b.num_rows, CHUNK_ROWS):
            part = b.slice(at, CHUNK_ROWS)
            held.append(part)
            size += len(part.column("terms").flatten())
            if size >= SHARD_POSTINGS:
                yield joined()
                held, size = [], 0
    if size:
        yield joined()


def _best(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, starts, terms, times, weight, n_docs, n_all = sent.value
        best: list[Best] = [NOTHING] * len(items)
        for got in _shards(batches):
            shard, coef = Shard.of(*got, n_docs, n_all, len(weight)), np.zeros(len(weight), "int64")
            for i in range(len(items)):
                own = slice(starts[i], starts[i + 1])
                coef[terms[own]] = times[own] * weight[terms[own]]
                best[i], _ = search(shard, terms[own], coef, k, best[i])
                coef[terms[own]] = 0
        rows = [np.concatenate(x) for x in zip(*best)] if best else NOTHING
        if len(rows[0]):
            item = np.repeat(items, [len(x[0]) for x in best])
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(rows[2], mask=rows[1]), pa.array(rows[0])], ["tag", "doc_id", "score"])

    return run


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_query_terms: int = MAX_QUERY_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0, equal scores by ascending doc_id (null last).

    Null or empty texts have no terms: such documents are found by no item and don't count, such items find nothing.
    Repeated rows of docs are documents of their own, and repeated rows of items get a ranking each. Texts of any length are
    read whole. Empty tables give no rows; without documents nothing is found. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    tagged = items.select(F.col(item_col).alias("item_id"), F.monotonically_increasing_id().alias("tag"), words_of(F.col(item_text_col)).alias("words"))
    queries = store(tagged.select("item_id", "tag", F.explode("words").alias("term")).groupBy("item_id", "tag", "term").agg(F.count(F.lit(1)).alias("times")), "search-items")
    rounds = -(-queries.count() // max_query_terms)
    found = spark.createDataFrame([], "tag long, doc_id long, score long")
    for i in range(rounds):
        part = queries.where(F.pmod(F.xxhash64("tag"), F.lit(rounds)) == i).select("tag", "term", "times").toPandas().sort_values(["tag", "term"])
        if part.empty:
            continue
        ids = {t.encode(): at for at, t in enumerate(part["term"].unique())}
        index = forward_index(docs, ids, id_col, text_col)
        n_docs, n_all = index.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(ids))
        counted = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toPandas()
        df[counted["term"].to_numpy()] = counted["df"].to_numpy()
        weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype("int64")
        tags, starts = np.unique(part["tag"].to_numpy(), return_index=True)
        terms = np.array([ids[t.encode()] for t in part["term"]])
        sent = spark.sparkContext.broadcast((tags, np.append(starts, len(part)), terms, part["times"].to_numpy(), weight, n_docs, n_all))
        found = found.unionByName(index.where("size(terms) > 0").mapInArrow(_best(sent, k), "tag long, doc_id long, score long"))
    first = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    top = found.where("score > 0").withColumn("rank", first).where(F.col("rank") <= k)
    return top.join(queries.select(F.col("tag").alias("of"), "item_id").distinct(), F.col("tag") == F.col("of")).select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS tag, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
     b AS (SELECT item_id, unnest(list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark),
     q AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY item_id, term),
     s AS (SELECT count(*) AS n_docs, coalesce(sum(len(w)), 0)::BIGINT AS n_all FROM d WHERE len(w) > 0),
     p AS (SELECT tag, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d),
     tf AS (SELECT tag, doc_id, n, term, count(*) AS tf FROM p SEMI JOIN q USING (term) GROUP BY tag, doc_id, n, term),
     df AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, s GROUP BY term, n_docs),
     sc AS (SELECT item_id, tag, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_all))))::BIGINT AS score
            FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY item_id, tag, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM sc WHERE score > 0 QUALIFY rank <= 10
"""

QUERIES = {"op11_lexical_search": op11_lexical_search}
ORACLES = {"op11_lexical_search": ORACLE}
