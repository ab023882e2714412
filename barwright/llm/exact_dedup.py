"""Exact deduplication by a log-structured merge index.

Each task fills a memtable and flushes it twice: the log has an entry for every row, the run one entry for each digest, with
the row that stays so far and the number of rows, sorted by digest. Compaction merges the runs by ranges of digests, each in
order: of a digest the row with the most characters, then the smallest identifier stays. For lookups of later batches the
compacted level is laid out in folders by the leading bits of the digest, which are ranges of equal size: a digest names its
folder by itself, and no other folder is read.
Texts whose digest hits a group of two or more, found with a Bloom filter over the compacted index, are compared byte by byte
with the text that stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bloom, keep_rows, store, table, without_space

#: kind 0: the log's entry of a row; kind 1: a run's entry of a digest, whose row (n_chars, doc_id, tag) stays so far.
ENTRY = "kind int, run int, digest binary, n_chars long, doc_id long, tag long, n long"
#: Ways of sorting a group so that the row that stays comes first.
BEST = [("digest", "ascending"), ("n_chars", "descending"), ("doc_id", "ascending"), ("tag", "ascending")]


def _flush(memtable_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, number = [], 0, 0

        def made(kind: int, t: pa.Table, n: np.ndarray) -> list[pa.RecordBatch]:
            constant = lambda x: pa.array(np.full(len(t), x, "int32"))
            return pa.table([constant(kind), constant(number), *t.columns, pa.array(n, pa.int64())], [x.split()[0] for x in ENTRY.split(", ")]).to_batches()

        def flushed() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).sort_by(BEST)  # a null doc_id comes last
            yield from made(0, t, np.ones(len(t), "int64"))
            d = t["digest"].combine_chunks()
            first = np.flatnonzero(np.concatenate([[True], pa.compute.not_equal(d[1:], d[:-1]).to_numpy(zero_copy_only=False)]))
            yield from made(1, t.take(pa.array(first)), np.diff(np.append(first, len(t))))

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= memtable_rows:
                yield from flushed()
                held, rows, number = [], 0, number + 1
        if rows:
            yield from flushed()

    return run


def _bloom_options(ndv: int) -> dict[str, str]:
    return {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": str(ndv), "parquet.bloom.filter.max.bytes": str(1 << 20)}


def _digest(text, digest_bytes: int):
    return F.substring(F.unhex(F.sha2(without_space(text).cast("binary"), 256)), 1, digest_bytes)


def flush_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32, memtable_rows: int = 1 << 16) -> DataFrame:
    """Level 0, stored in the shared folder: the log (kind 0) and the runs (kind 1) of memtables of memtable_rows or more rows."""
    text = F.col(text_col)
    thin = docs.select(
        _digest(text, digest_bytes).alias("digest"),
        F.length(F.coalesce(text, F.lit(""))).cast("long").alias("n_chars"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("tag"),
    )
    return store(thin.mapInArrow(_flush(memtable_rows), ENTRY).sortWithinPartitions("kind", "run", "digest"), "lsm-level0", by=["kind"], **_bloom_options(memtable_rows))


def compact(level0: DataFrame) -> DataFrame:
    """Level 1: one entry a digest, in files of disjoint ranges; the longest text, then the smallest identifier stays (null comes last).

    A run has a digest once, so the ranges get an entry of it from each run at most, however many rows have it.
    """
    runs = level0.where("kind = 1").select("digest", "n_chars", "doc_id", "tag", "n")
    best = F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("i"), F.bitwise_not("tag").alias("t"))).alias("best")
    merged = runs.repartitionByRange("digest").sortWithinPartitions("digest").groupBy("digest").agg(best, F.sum("n").alias("group_size"))
    merged = merged.select("digest", "group_size", F.bitwise_not("best.i").alias("keep_id"), F.bitwise_not("best.t").alias("keep_tag"), F.col("best.n_chars").alias("keep_chars"))
    return store(merged.sortWithinPartitions("digest"), "lsm-level1", **_bloom_options(1 << 16))


def _part(digest: Column, bits: int) -> Column:
    """The leading bits of a digest as a number."""
    return F.shiftright(F.conv(F.hex(F.substring(digest, 1, 2)), 16, 10).cast("int"), 16 - bits).alias("part")


def publish(index: DataFrame, rows_per_part: int = 1 << 22, most_bits: int = 12) -> tuple[DataFrame, int]:
    """(the compacted index in folders by part, bits of a digest that name its part): one pass when an index is made, none when it is used."""
    n = index.count()
    bits = min(most_bits, max(0, (n - 1) // rows_per_part).bit_length())
    rows = index.select("digest", "keep_id", _part(F.col("digest"), bits))
    rows = rows.repartitionByRange("part", "digest").sortWithinPartitions("part", "digest")  # a part may be several files, each of a range
    return store(rows, "lsm-published", by=["part"], **_bloom_options(1 << 16)), bits


def lookup(published: DataFrame, bits: int, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """The rows of docs whose text is in a published index, with the identifier that stays there: for batches that arrive later.

    Only the parts that the batch's digests name are read; the driver gets the parts' numbers, 2^12 at most. Null text is
    empty. An empty batch or index gives no rows.
    """
    batch = docs.select(F.col(id_col), _digest(F.col(text_col), digest_bytes).alias("digest"))
    batch = store(batch.select("*", _part(F.col("digest"), bits)), "lsm-batch")
    parts = [r["part"] for r in batch.select("part").distinct().collect()]
    found = published.where(F.col("part").isin(parts))
    return batch.join(found, ["part", "digest"]).select(F.col(id_col), "keep_id")


def _verified(docs: DataFrame, index: DataFrame, id_col: str, text_col: str, digest_bytes: int) -> DataFrame | None:
    """The digests under which different texts met; None if there are none. Only texts of groups are shuffled."""
    groups = index.where("group_size > 1").select("digest", "keep_id", "keep_chars")
    if not (n := groups.count()):
        return None
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), _digest(F.col(text_col), digest_bytes).alias("digest"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hits = texts.where(bloom(groups, F.xxhash64("digest"), n)(F.xxhash64("digest")))
    of = groups.select(F.col("digest").alias("d"), "keep_id", "keep_chars")
    kept = hits.join(of, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).where("length(text) = keep_chars")  # one row a group: no key is hot
    kept = store(kept.groupBy("digest").agg(F.min(without_space(F.col("text"))).alias("keep_text")), "lsm-kept-texts")  # so that the next join deals its rows anew, and a hot digest's can be split
    other = hits.select("digest", without_space(F.col("text")).alias("text")).join(kept, "digest").where("text <> keep_text").select("digest")
    other = store(other, "lsm-mismatch")
    return None if other.isEmpty() else other.distinct()


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32, memtable_rows: int = 1 << 16) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, keep_id, group_size, kept, digest.

    Null text is empty, and empty texts are equal. A repeated row (same doc_id, same text) counts in group_size, and one
    of the repeats is kept. A null doc_id loses ties. An empty table gives no rows. Texts that share a digest but differ
    are grouped by the text itself. Other columns of docs are ignored, whatever their names.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    level0 = flush_runs(docs, "doc_id", "text", digest_bytes, memtable_rows)
    index = compact(level0)
    out = level0.where("kind = 0").join(index.select("digest", "keep_id", "keep_tag", "group_size"), "digest")
    out = out.select("doc_id", "n_chars", "keep_id", "group_size", (F.col("tag") == F.col("keep_tag")).alias("kept"), "digest")
    if (mixed := _verified(docs, index, "doc_id", "text", digest_bytes)) is None:
        return out
    again = docs.withColumn("digest", _digest(F.col("text"), digest_bytes)).join(mixed, "digest", "left_semi")
    again = store(again.withColumn("tag", F.monotonically_increasing_id()).select("*", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.sha2(without_space(F.col("text")).cast("binary"), 256).alias("sha"), without_space(F.col("text")).alias("norm")), "lsm-again")
    best = again.groupBy("norm").agg(F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("i"), F.bitwise_not("tag").alias("t"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
    redone = again.join(best, "norm").select("doc_id", "n_chars", F.bitwise_not("best.i").alias("keep_id"), "group_size", (F.col("tag") == F.bitwise_not("best.t")).alias("kept"), "digest")
    return out.join(mixed, "digest", "left_anti").select(redone.columns).unionByName(redone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, all its columns as they are.

    Null and empty texts are one group; of repeated rows one stays; a null doc_id stays only where its group has no other
    among its longest texts. An empty table gives no rows; clashing names of columns do no harm.
    """
    made = store(decide(docs, id_col, text_col), "lsm-decided")
    keys = {"__id": F.col(id_col).cast("long"), "__digest": _digest(F.col(text_col), 32), "__n": F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")}
    kept = made.where("doc_id <=> keep_id").groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.col("n_chars").alias("__n")).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("copies"))
    return keep_rows(docs, store(kept.where("kept").drop("kept"), "lsm-kept"), keys)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decide(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
     r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS rn, count(*) OVER (PARTITION BY norm) AS group_size
           FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""

QUERIES = {"op8_exact_dedup": op8_exact_dedup}
ORACLES = {"op8_exact_dedup": ORACLE}
