"""Alignment of two tokenizers' tokens: minimal groups as connected components, and counts of linked tokens over the corpus.

Tokens of either kind are nodes, those whose bytes overlap are joined: union-find gives the components, which are exactly the
minimal groups of tokens that cover the same bytes, as no token crosses a byte at which both kinds end and all others are
crossed by one. A group's members expand its links, the pairs of tokens whose ranges end together. Links are counted over
the corpus by a distributed count; of two tokens that end together one is a suffix of the other, so that the vocabularies
bound how many pairs there can be, however large the corpus: the counts travel to the documents, not the links to the counts.

Neither kind of token reaches over the start of white space that follows something else, if that starts with a space, tab or
line feed (checked against the pieces of either vocabulary). Texts are cut there, and a task tokenizes a unit once while it
remembers it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, store, table

#: Where the vocabularies lie; parameters of align().
BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Units that a task remembers, and the longest of them; characters and rows that it takes at once.
CACHE_UNITS, CACHE_LENGTH, CHUNK_CHARS, CHUNK_ROWS = 60_000, 64, 250_000, 200
#: Pairs of linked tokens whose counts travel to all tasks (some 60 MB); vocabularies that can have more are joined by shuffle.
MAX_PAIRS = 4_000_000

#: Fixed value: the pattern by which byte-level BPE splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A unit: white space, what follows, and more of both as long as the white space doesn't start with a space, tab or line feed.
UNIT = re.compile(r"\s+\S*(?:[^\S \n\t]\s*\S*)*")


class ByteBpe:
    """Byte-level BPE from a tokenizer file; special tokens' strings in a text are plain text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        shown = {chr(c): b for b, c in _byte_letters().items()}
        as_bytes = lambda token: bytes(shown[c] for c in token)
        self.bytes = [b""] * (max(model["vocab"].values()) + 1)
        ranks = {}
        for token, i in model["vocab"].items():
            if all(c in shown for c in token):
                self.bytes[i] = as_bytes(token)
        for i, token in enumerate(self.bytes):
            if len(token) == 1:
                ranks[token] = i
        order = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if order != sorted(order):
            raise ValueError("merges must be in the order of their tokens' numbers")
        ranks |= {self.bytes[i]: i for i in order}
        self.size = np.fromiter(map(len, self.bytes), "int64", len(self.bytes))
        self._encode = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> np.ndarray:
        return np.array(self._encode(text), "int64")


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: printing Latin-1 ones stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in own)}


class PieceBpe:
    """BPE over pieces; U+2581 is a space, <0xHH> a byte."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        if any(re.search("[^\\s▁][▁\n\t]", p) for p in pieces):
            raise ValueError("a piece has a space, tab or line feed after another character")
        self.bytes = [b"" if self._model.is_control(i) or self._model.is_unknown(i) else bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size = np.fromiter(map(len, self.bytes), "int64", len(self.bytes))
        self._before = self._model.encode("x")

    def encode(self, text: str) -> np.ndarray:
        """The tokens of a text that starts with white space; a letter before it takes the space that the model adds."""
        ids = self._model.encode("x" + text)
        if ids[: len(self._before)] != self._before:
            raise ValueError("the model joins a letter with the white space after it")
        return np.array(ids[len(self._before) :], "int64")


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each a, group of each b, links) from the tokens' byte ends over the same bytes; groups are numbered in order.

    Union-find over the bipartite graph of overlapping tokens. links: rows (a, b) of tokens that end together.
    """
    starts = np.concatenate([[0], ends_a[:-1]])
    first, last = np.searchsorted(ends_b, starts, "right"), np.searchsorted(ends_b, ends_a, "left")
    n = last - first + 1
    a = np.repeat(np.arange(len(ends_a)), n)
    b = np.arange(int(n.sum())) + np.repeat(first - np.cumsum(n) + n, n)
    parent = np.arange(len(ends_a) + len(ends_b))
    x, y = a, b + len(ends_a)
    while True:
        px, py = parent[x], parent[y]
        if not (apart := px != py).any():
            break
        np.minimum.at(parent, np.maximum(px, py)[apart], np.minimum(px, py)[apart])
        while (parent != (up := parent[parent])).any():
            parent = up
    number = np.unique(parent, return_inverse=True)[1]  # a group's root is its first a token
    together = ends_a[a] == ends_b[b]
    return number[: len(ends_a)], number[len(ends_a) :], np.stack([a[together], b[together]], 1)


#: A unit's share of a text: tokens of either kind, links (a * pieces + b, the bytes of an array), groups as text. None: bytes differ.
Entry = tuple[int, int, bytes, str] | None


class Aligner:
    """Both tokenizers, and what is known of the units met last."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        self.a, self.b = ByteBpe(byte_bpe), PieceBpe(piece_bpe)
        self.text_a, self.text_b = [str(i) for i in range(len(self.a.size))], [str(i) for i in range(len(self.b.size))]
        self.kind = np.dtype("int32" if len(self.a.size) * len(self.b.size) < 2**31 else "int64")  # of a link
        self.known: dict[str, Entry] = {}

    def entries(self, units: set[str]) -> dict[str, Entry]:
        """Of units that aren't known yet."""
        many = [u for u in units if not u[-1].isspace()]  # one after another these are a text of the same units
        ends = np.cumsum([len(u.encode()) for u in many])
        out = self._aligned("".join(many), ends) if many else []
        if out is None:  # somewhere the pieces' bytes differ from the text's
            return {u: self.entry(u) for u in units}
        return dict(zip(many, out)) | {u: self.entry(u) for u in units if u[-1].isspace()}

    def entry(self, unit: str) -> Entry:
        out = self._aligned(unit, np.array([len(unit.encode())]))
        return out[0] if out else None

    def _aligned(self, text: str, ends: np.ndarray) -> list[Entry] | None:
        """Entries of the units of text that end at ends; None if the tokens' bytes aren't the text's."""
        a, b = self.a.encode(text), self.b.encode(text)
        if b"".join(map(self.b.bytes.__getitem__, b.tolist())) != text.encode():
            return None
        ends_a, ends_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        of_a, of_b, links = groups(ends_a, ends_b)
        packed, width = (a[links[:, 0]] * len(self.b.size) + b[links[:, 1]]).astype(self.kind).tobytes(), self.kind.itemsize
        cut = lambda x: np.concatenate([[0], np.searchsorted(x, ends, "right")]).tolist()
        at_a, at_b, at_link = cut(ends_a), cut(ends_b), cut(ends_a[links[:, 0]])
        halves = []  # of each group
        for ids, of, text_of in ((a, of_a, self.text_a), (b, of_b, self.text_b)):
            edge = np.flatnonzero(np.diff(of, prepend=-1, append=of[-1] + 1)).tolist()
            names = [text_of[i] for i in ids.tolist()]
            halves.append([names[i] if j == i + 1 else ",".join(names[i:j]) for i, j in zip(edge, edge[1:])])
        whole = [f"{x}|{y}" for x, y in zip(*halves)]  # a group has one link, at its end
        return [(at_a[i + 1] - at_a[i], at_b[i + 1] - at_b[i], packed[width * at_link[i] : width * at_link[i + 1]], ";".join(whole[at_link[i] : at_link[i + 1]])) for i in range(len(ends))]

    def texts(self, texts: list[str | None]) -> list[Entry]:
        """Of whole texts; None where a text is null or empty, or its tokens' bytes aren't its own with a space before them."""
        split = [UNIT.findall(f" {t}") if t else () for t in texts]
        if len(self.known) > CACHE_UNITS:
            self.known.clear()
        here = self.known
        if new := {u for units in split for u in units}.difference(here):
            made = self.entries(new)
            here.update((u, e) for u, e in made.items() if len(u) <= CACHE_LENGTH)
            if len(long := [u for u in new if len(u) > CACHE_LENGTH]):
                here = _Both(here, {u: made[u] for u in long})
        out: list[Entry] = []
        for units in split:
            found = [here[u] for u in units]
            if not found or None in found:
                out.append(None)
                continue
            n_a, n_b, links, names = zip(*found)
            out.append((sum(n_a), sum(n_b), b"".join(links), ";".join(names)))
        return out


class _Both:
    """Short units from the cache, long ones of this chunk from a table that goes with it."""

    def __init__(self, short: dict, long: dict):
        self.short, self.long = short, long

    def __getitem__(self, unit: str) -> Entry:
        return self.long[unit] if len(unit) > CACHE_LENGTH else self.short[unit]


def _aligned(byte_bpe: str, piece_bpe: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for b in batches:
            aligner = aligner or Aligner(byte_bpe, piece_bpe)
            for part, texts in _pieces(b):
                got = aligner.texts(texts)
                links = np.frombuffer(b"".join(e[2] for e in got if e), aligner.kind)
                starts = np.concatenate([[0], np.cumsum([len(e[2]) // aligner.kind.itemsize if e else 0 for e in got])])
                count = lambda k: pa.array([e[k] if e else 0 for e in got], "int64")  # noqa: E731, B023
                sha = [hashlib.sha256(e[3].encode()).hexdigest() if e else "" for e in got]
                yield pa.RecordBatch.from_arrays([part.column("tag"), part.column("doc_id"), count(0), count(1), pa.ListArray.from_arrays(pa.array(starts, "int32"), pa.array(links)), pa.array(sha)], ["tag", "doc_id", "n_a", "n_b", "links", "groups_sha256"])

    return run


def _pieces(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of CHUNK_ROWS rows at most, cut after about CHUNK_CHARS characters."""
    for at in range(0, b.num_rows, CHUNK_ROWS):
        part = b.slice(at, CHUNK_ROWS)
        texts = part.column("text").to_pylist()
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= CHUNK_CHARS or i == len(texts) - 1:
                yield part.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0


def pair_bound(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of tokens can end together: one is the other's suffix, or they are equal."""
    count = lambda xs, ys: sum(ys.get(x[i:], 0) for x in xs for i in range(len(x)))
    times = lambda xs: {x: n for x, n in zip(*np.unique(np.array([x for x in xs if x], object), return_counts=True))}  # noqa: E731, C416
    in_a, in_b = times(a), times(b)
    return int(count(a, in_b) + count(b, in_a))


def tokens(docs: DataFrame, id_col: str, text_col: str, byte_bpe: str, piece_bpe: str, link: str) -> DataFrame:
    """tag (a row's number), doc_id, n_a, n_b, links (a * pieces + b for each, of the type link), groups_sha256; stored."""
    base = docs.select(F.monotonically_increasing_id().alias("tag"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return store(base.mapInArrow(_aligned(byte_bpe, piece_bpe), f"tag long, doc_id long, n_a long, n_b long, links array<{link}>, groups_sha256 string"), "align-tokens", compression="zstd")


def pair_counts(aligned: DataFrame, pieces: int) -> DataFrame:
    """link, count (occurrences in the corpus), best (whether no other pair of its b token has more); stored."""
    counts = aligned.select(F.explode("links").alias("link")).groupBy("link").agg(F.count(F.lit(1)).alias("count"))
    counts = store(counts.withColumn("b", F.col("link") % pieces), "align-counts")
    most = counts.groupBy(F.col("b").alias("of")).agg(F.max("count").alias("most"))
    return store(counts.join(most, F.col("b") == F.col("of")).select("link", "count", (F.col("count") == F.col("most")).alias("best")), "align-pairs")


#: What _summed gives.
ROWS = "doc_id long, n_a long, n_b long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link, count, best = sent.value
        for b in batches:
            n = pa.compute.list_value_length(b.column("links")).to_numpy(zero_copy_only=False).astype("int64")
            at = np.searchsorted(link, b.column("links").flatten().to_numpy(zero_copy_only=False))
            edge = np.concatenate([[0], np.cumsum(n)])
            over = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x[at])])[edge]))  # noqa: E731, B023
            made = {"n_links": pa.array(n), "n_best": over(best), "count_sum": over(count)}
            names = [x.split()[0] for x in ROWS.split(", ")]
            yield pa.RecordBatch.from_arrays([made[c] if c in made else b.column(c) for c in names], names)

    return run


def link_sums(aligned: DataFrame, pairs: DataFrame, bound: int, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """aligned with n_links, n_best and count_sum; the pairs' counts travel to the rows if the vocabularies have max_pairs at most."""
    if bound <= max_pairs:
        t = pairs.toPandas().sort_values("link")
        kind = np.dtype(dict(pairs.dtypes)["link"].replace("bigint", "int64"))
        sent = aligned.sparkSession.sparkContext.broadcast((t["link"].to_numpy(kind), t["count"].to_numpy("int64"), t["best"].to_numpy("int64")))
        return aligned.mapInArrow(_summed(sent), ROWS)
    each = aligned.select("tag", F.explode("links").alias("l")).groupBy("tag", "l").agg(F.count(F.lit(1)).alias("times"))
    each = join_groups(each, pairs, bound, max_pairs, [("l", "link")], F.xxhash64("tag"))
    sums = each.groupBy(F.col("tag").alias("of")).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("times") * F.col("count")).alias("c"))
    long = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    out = aligned.join(sums, F.col("tag") == F.col("of"), "left")
    return out.select("doc_id", "n_a", "n_b", F.size("links").cast("long").alias("n_links"), long("b").alias("n_best"), long("c").alias("count_sum"), "groups_sha256")


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text is tokenized with a space before it, without special tokens. Null and empty texts, and those whose pieces' bytes
    differ from their own (such as texts with U+2581), have no tokens: zeros and an empty digest, and no part in the counts.
    A group has one link, at its end. Repeated rows are rows of their own and count each. Texts of any length are read
    whole. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    a, b = ByteBpe(byte_bpe), PieceBpe(piece_bpe)
    aligned = tokens(docs, id_col, text_col, byte_bpe, piece_bpe, "int" if len(a.size) * len(b.size) < 2**31 else "bigint")
    rows = link_sums(aligned, pair_counts(aligned, len(b.size)), pair_bound(a.bytes, b.bytes), max_pairs)
    return rows.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256")


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


QUERIES = {"op12_token_align": op12_token_align}
ORACLES: dict[str, str] = {}
