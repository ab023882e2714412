"""Near-duplicate groups by SuperMinHash signatures, banding, verification on whole shingle sets and union-find.

SuperMinHash: every shingle draws a random permutation of the slots, step by step; at step j it offers j + r, r in [0, 1),
to the slot that the permutation names, and a slot keeps its least offer. The ranks are correlated, which makes the
estimate's variance less than that of plain MinHash. Once no slot is above j + 1, no later step can change any slot, so a
document of many shingles stops after a step or two. Documents with equal sets are one class; classes that agree in a band
meet in a bucket. A bucket is compared with the member that has most neighbours, then with some others, while its members
are in different components; the pairs left at the end are all compared. A parity sketch of each set gives a lower bound of
how many shingles two sets don't share, so that pairs which can't be linked are left out inside the join, for certain. Links
are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bloom, discard, keep_rows, store, table
from .components import components

#: 24 bands of 4 slots: of pairs at a similarity of 0.85, a share of 2e-8 meets in no bucket; of pairs at 0.8, 5e-6.
BANDS, ROWS = 24, 4
#: Words whose hashes a task keeps at hand; words and rows that it handles at once (4096 rows at most).
CACHE_WORDS, CHUNK_WORDS, CHUNK_ROWS = 100_000, 200_000, 500
#: Rounds of comparing a bucket with some members: its most connected one first, then about HEADS, then four times as many in
#: each round, until the pairs left, of members in different components, are no more than REST times the rows of their buckets.
STARS, HEADS, REST = 2, 16, 200
#: Longs of a set's parity sketch.
PARITY = 16
#: Rows to a file of the tables between rounds.
FILE_ROWS = 50_000

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return h


def shingle_sets(texts: list[str | None], width: int, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): document i has the distinct sorted shingle hashes hashes[starts[i]:starts[i + 1]], of 52 bits; these are the full sets that links are confirmed on.

    A-Z are lower-cased; words are [^\\x20\\x09-\\x0D]+ (bytes.split). Fewer than width words are one shingle, none is none.
    At most 4096 texts.
    """
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    n = np.fromiter(map(len, words), "int64", len(words))
    flat = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), "uint64", int(n.sum()))
    count = np.where(n >= width, n - width + 1, (n > 0).astype("int64"))
    owner = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(owner)) + np.repeat(np.cumsum(n) - n - np.cumsum(count) + count, count)
    h = np.repeat(np.minimum(n, width), count).astype("uint64")
    short = n.min(initial=width) < width
    for k in range(width):
        if short:
            there = n[owner] > k
            h[there] = _mix(h[there] * _GOLD + flat[at[there] + k])
        else:
            h = _mix(h * _GOLD + flat[at + k])
    h = np.sort(owner.astype("uint64") << np.uint64(52) | h >> np.uint64(12))
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    h = h[new]
    return h & np.uint64((1 << 52) - 1), np.searchsorted(h, np.arange(len(n) + 1, dtype="uint64") << np.uint64(52))


def superminhash(h: np.ndarray, starts: np.ndarray, slots: int) -> np.ndarray:
    """Signatures (documents x slots) of non-empty sets."""
    docs = len(starts) - 1
    best = np.full(docs * slots, np.inf)
    owner = np.repeat(np.arange(docs), np.diff(starts))
    swaps: list[np.ndarray] = []
    for j in range(slots):
        x = _mix(h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype("int64")
        slot = k.copy()
        for t in range(j - 1, -1, -1):  # where earlier steps have moved what stood there
            slot[slot == swaps[t]] = t
        swaps.append(k)
        np.minimum.at(best, owner * slots + slot, j + (x >> np.uint64(32)).astype("float64") / 2**32)
        going = best.reshape(docs, slots).max(1) >= j + 1
        stay = going[owner]
        if not stay.all():
            h, owner, swaps = h[stay], owner[stay], [s[stay] for s in swaps]
            if not len(h):
                break
    return best.reshape(docs, slots)


def _class_ids(h: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """16 bytes that stand for each non-empty set."""
    a, b = np.add.reduceat(_mix(h ^ _M1), starts[:-1]), np.add.reduceat(_mix(h ^ _M2), starts[:-1])
    both = np.stack([a + np.diff(starts).astype("uint64"), b], 1)
    return [row.tobytes() for row in both]


def _parity(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(documents x PARITY) longs: bit x is the parity of the number of shingles whose hash is x modulo the number of bits."""
    docs, bits = len(starts) - 1, 64 * PARITY
    owner = np.repeat(np.arange(docs), np.diff(starts))
    odd = np.bincount(owner * bits + (h % np.uint64(bits)).astype("int64"), minlength=docs * bits) & 1
    return np.packbits(odd.astype("uint8").reshape(docs, bits), axis=1).view("int64")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of CHUNK_ROWS at most, cut after about CHUNK_WORDS words; a batch's texts become Python's a slice at a time."""
    for b in batches:
        for at in range(0, b.num_rows, CHUNK_ROWS):
            part = b.slice(at, CHUNK_ROWS)
            texts = part.column("text").to_pylist()
            start = size = 0
            for i, t in enumerate(texts):
                size += len(t or "") // 6 + 1
                if size >= CHUNK_WORDS or i == len(texts) - 1:
                    yield part.slice(start, i + 1 - start), texts[start : i + 1]
                    start, size = i + 1, 0


def _sketches(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b, texts in _chunks(batches):
            h, starts = shingle_sets(texts, width, hashes)
            n = np.diff(starts)
            full = np.flatnonzero(n)
            sid, keys, parity = [None] * len(texts), [None] * len(texts), np.zeros((len(texts), PARITY), "int64")
            if len(full):
                tight = np.concatenate([[0], np.cumsum(n[full])])
                sig = superminhash(h, tight, bands * rows).view("uint64").reshape(len(full), bands, rows)
                key = np.broadcast_to(np.arange(1, bands + 1, dtype="uint64"), (len(full), bands)) * _GOLD
                for r in range(rows):
                    key = _mix(key * _M2 + sig[:, :, r])
                parity[full] = _parity(h, tight)
                for i, s, k in zip(full, _class_ids(h, tight), key.view("int64")):
                    sid[i], keys[i] = s, k
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(n, "int64"), pa.array(sid, pa.binary()), pa.array(keys, pa.list_(pa.int64())), *[pa.array(parity[:, i]) for i in range(PARITY)]], ["doc_id", "row", "n", "sid", "bands", *[f"p{i}" for i in range(PARITY)]])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for _, texts in _chunks(batches):
            h, starts = shingle_sets(texts, width, hashes)
            full = np.flatnonzero(np.diff(starts))
            if len(full):
                tight = np.concatenate([[0], np.cumsum(np.diff(starts)[full])])
                yield pa.RecordBatch.from_arrays([pa.array(_class_ids(h, tight), pa.binary()), pa.ListArray.from_arrays(pa.array(tight, "int32"), pa.array(h.view("int64")))], ["sid", "shingles"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b and more) those with 100 * intersection >= percent * union. Only the sets of pairs are shuffled."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sid")).select(F.xxhash64("sid").alias("h")).distinct()
    sets = sets.where(bloom(ends, F.col("h"), ends.count())(F.xxhash64("sid")))
    left = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(right, "b").join(left, "a").withColumn("i", F.size(F.array_intersect("sa", "sb")).cast("long"))
    return both.where(F.col("i") * 100 >= (F.size("sa") + F.size("sb") - F.col("i")) * percent).select(pairs.columns)


def _apart(percent: int) -> Column:
    """Whether sets a and b (columns na, nb, a0.., b0..) can be linked at all: by their sizes, and by their parity sketches.

    Every shingle that only one of them has flips one bit, so the bits that differ are no more than those shingles.
    """
    na, nb = F.col("na"), F.col("nb")
    bits = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(1, PARITY)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
    return (na * 100 >= nb * percent) & (nb * 100 >= na * percent) & (bits * (100 + percent) <= (na + nb) * (100 - percent))


def _classes(sketch: DataFrame) -> DataFrame:
    """One row a set: sid, n, bands, row (of one of its documents), least (doc_id), lead (the first document) and the parity sketch."""
    first = lambda c: F.first(c).alias(c)
    return store(sketch.where("sid is not null").groupBy("sid").agg(first("n"), first("bands"), F.min("row").alias("row"), F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("lead"), *[first(f"p{i}") for i in range(PARITY)]), "near-classes")


def _links(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame | None:
    """(node, root) of the classes that meet another one in a bucket; None if there are none."""
    parity = [f"p{i}" for i in range(PARITY)]
    each = classes.select(F.explode("bands").alias("key"), "sid", "n")
    buckets = store(each.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "near-buckets")
    if not (n := buckets.count()):
        return None
    met = store(each.where(bloom(buckets, F.col("key"), n)(F.col("key"))).join(buckets, "key"), "near-met")
    degree = met.groupBy("sid").agg(F.sum("c").alias("degree"))
    at = store(met.join(degree, "sid").withColumn("comp", F.col("sid")), "near-at")
    wanted = store(classes.join(degree.select("sid"), "sid", "left_semi").drop("bands", "least", "lead"), "near-wanted")
    rows = bloom(wanted, F.col("row"), wanted.count())
    sets = docs.where(rows(F.col("row"))).select("text").mapInArrow(_sets(width), "sid binary, shingles array<long>")
    sets = store(sets.dropDuplicates(["sid"]), "near-sets")
    sketches = wanted.select("sid", *parity)
    labels, turn = wanted.select(F.col("sid").alias("node"), F.col("sid").alias("root")), 0
    while True:
        parts = at.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("degree", "sid", "n")).alias("top"))
        centre = F.max(F.struct("top.degree", "top.sid", "comp", "top.n")).alias("centre")
        still = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("k").alias("c"), F.sum(F.col("k") * F.col("k")).alias("c2"), F.max(F.struct("k", "comp"))["comp"].alias("most"), centre)
        still = store(still.where("parts > 1"), "near-still")
        left, rest, active, largest = still.agg(F.count(F.lit(1)), F.sum(F.col("c") * F.col("c") - F.col("c2")) / 2, F.sum("c"), F.max("c")).first()
        if not left:
            return labels
        last = turn >= STARS and (rest <= REST * active or HEADS * 4 ** (turn - 1) >= largest)
        others = at.join(still.select("key", "most"), "key")
        if turn == 0:
            heads = still.select("key", F.col("centre.sid").alias("sid"), F.col("centre.comp").alias("comp"), F.col("centre.n").alias("n"))
        elif not last:
            heads = others.where(F.pmod(F.xxhash64("sid", F.lit(turn)), F.col("c")) < HEADS * 4 ** (turn - 1)).select("key", "sid", "comp", "n")
        else:  # of two components one isn't the bucket's largest
            heads = others.where("comp <> most").select("key", "sid", "comp", "n")
        side = lambda df, x: df.join(sketches, "sid").select("key", F.col("sid").alias(x), F.col("comp").alias(f"c{x}"), F.col("n").alias(f"n{x}"), *[F.col(p).alias(f"{x}{i}") for i, p in enumerate(parity)])
        pairs = side(heads, "a").join(side(others, "b"), "key").where((F.col("ca") != F.col("cb")) & _apart(percent))
        turned = F.col("a") > F.col("b")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turned, F.col("cb")).otherwise(F.col("ca")).alias("ca"), F.when(turned, F.col("ca")).otherwise(F.col("cb")).alias("cb"))
        pairs = store(pairs.distinct(), "near-pairs")
        comps = components(_verified(pairs, sets, percent).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        discard(pairs)
        comps = comps.select(F.col("node").alias("was"), F.col("root").alias("now"))
        labels = labels.join(comps, F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root"))
        labels = store(labels.coalesce(-(-labels.count() // FILE_ROWS)), "near-labels")
        if last:
            return labels
        before = at
        at = others.join(comps, F.col("comp") == F.col("was"), "left").select("key", "sid", "n", "c", "degree", F.coalesce("now", "comp").alias("comp"))
        at = store(at.coalesce(-(-active // FILE_ROWS)), "near-at")
        discard(before)
        discard(still)
        turn += 1


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, row (hash of doc_id and text), stays.

    Links are pairs of documents whose sets of width-word shingles have a similarity of percent or more; component_id is
    the smallest doc_id that links reach. Null, empty and blank texts are linked with nothing. Repeated rows share a
    component. A null doc_id is never a component_id: a component of such rows alone has none, and its rows are kept.
    stays is true for the first document of each component by (doc_id nulls last, row) alone, and for texts without shingles.
    An empty table gives no rows. Other columns of docs are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col).cast("long"), text).alias("row"))
    sketch = store(base.mapInArrow(_sketches(width, bands, rows), "doc_id long, row long, n long, sid binary, bands array<long>, " + ", ".join(f"p{i} long" for i in range(PARITY))), "near-sketch")
    classes = _classes(sketch)
    labels = _links(base, classes, width, percent)
    of = classes.select("sid", F.col("least").alias("component_id"), "lead")
    if labels is not None:
        both = store(classes.select("sid", "least", "lead").join(labels, F.col("sid") == F.col("node"), "left"), "near-rooted")
        least = store(both.where("root is not null").groupBy("root").agg(F.min("least").alias("c"), F.min("lead").alias("l")), "near-least")
        of = both.join(least.withColumnRenamed("root", "r"), F.col("root") == F.col("r"), "left").select("sid", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("c")).alias("component_id"), F.when(F.col("root").isNull(), F.col("lead")).otherwise(F.col("l")).alias("lead"))
    of = store(of.withColumnRenamed("sid", "s"), "near-components")  # so that a hot set's documents can be split in the join
    out = sketch.select("doc_id", "row", F.col("n").alias("n_shingles"), "sid").join(of, F.col("sid") == F.col("s"), "left")
    out = out.withColumn("component_id", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    stays = F.col("sid").isNull() | F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("row") == F.col("lead.row"))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "row", stays.alias("stays"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each near-duplicate group, whatever its doc_ids, all its columns as they are.

    Null, empty and blank texts are in no group and stay; of repeated rows one stays; rows with a null doc_id stay where
    their group has no other. An empty table gives no rows; clashing names of columns do no harm.
    """
    made = groups(docs, id_col, text_col, width, percent).where("stays")
    keys = {"__id": F.col(id_col).cast("long"), "__row": F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))}
    kept = made.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.count(F.lit(1)).alias("copies"))
    return keep_rows(docs, store(kept, "near-kept"), keys)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op10_near_dedup": op10_near_dedup}
ORACLES: dict[str, str] = {}
