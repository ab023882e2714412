"""Log-likelihood of whole documents under a gated recurrent language model with a class-factored softmax, in numpy.

Corpus counts are taken over every training document. Frequent words (the shortlist) are dealt to classes of equal mass
and predicted as P(class | state) * P(word | class, state); all other words fall into classes by their last three bytes and
have P(class | state) * (c + 1) / (N_k + V_k + 1), with c, N_k and V_k from the corpus counts, so that every word has a
chance and chances add up. The recurrent unit (GRU) is trained by truncated backpropagation over every training document
once: the documents, stored as symbols of two bytes, are dealt to rounds, those of a round to replicas on shards that grow with
the corpus, and the replicas' weights and moments are averaged after each round. A state runs through a whole document, carried
from window to window. Counts of words outside the broadcast head are joined by shuffle.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, store, table

HIDDEN, EMBED = 32, 16
#: Words with a weight vector of their own, in so many classes of so many words; classes of all other words.
CLASSES, CLASS_WORDS, TAIL_CLASSES = 32, 64, 32
SHORT = CLASSES * CLASS_WORDS
#: Most frequent words, at most so many, whose counts are broadcast (some 10 MB); counts of the rest are joined.
HEAD_WORDS = 131_072
#: Training: rounds, which share out all training documents; least words to a replica; streams and steps of a window.
ROUNDS, REPLICA_WORDS, STEPS = 8, 1_000_000, 32
#: A replica has about so many windows a round, of streams within these bounds; streams of a task that scores.
WINDOWS, LEAST_STREAMS, MOST_STREAMS, SCORE_STREAMS = 250, 16, 256, 256
#: Steps that streams lay out at once.
BLOCK_STEPS = 512
#: Adam's rate in the first round; later ones have less.
RATE = 0.01
#: Replicas whose weights one task adds up.
FAN_IN = 16
#: Distinct words that a task counts before it hands them on.
COUNT_WORDS = 250_000
END = b""


#: Texts that are split into words at once, and bytes of them (or one text that is longer).
CHUNK_ROWS, CHUNK_BYTES = 2_000, 2_000_000


def _chunks(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of CHUNK_ROWS rows at most, cut before they have over CHUNK_BYTES of text; kernels make several copies of a slice."""
    size = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype("int64")
    ends, at = np.cumsum(size), 0
    while at < b.num_rows:
        most = ends[at] - size[at] + CHUNK_BYTES
        stop = min(at + CHUNK_ROWS, max(at + 1, int(np.searchsorted(ends, most, "right"))))
        yield b.slice(at, stop - at)
        at = stop


def _released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; Arrow's free memory goes back when they have ended, as the worker lives on through later stages."""
    yield from batches
    pa.default_memory_pool().release_unused()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words [^\\x20\\x09-\\x0D]+ of all texts after A-Z are lower-cased, as binary; number of each text's). Null has none."""
    texts = texts.take(pa.array(np.arange(len(texts))))  # a slice of its own: kernels misread offsets that don't begin at 0
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, n = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype("int64")
    full = pc.greater(pc.binary_length(flat), 0)
    there = full.to_numpy(zero_copy_only=False)
    ends = np.cumsum(n)
    sums = np.concatenate([[0], np.cumsum(there)])
    return flat.filter(full).cast(pa.large_binary()), sums[ends] - sums[ends - n]


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text, mod 7, is 2. A null id is never held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


_CRC = np.array([zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)], "uint32")  # the table of crc32's step


def tail_class(words: pa.Array) -> np.ndarray:
    """crc32 of the last three bytes of words (large_binary), mod TAIL_CLASSES."""
    offsets = np.frombuffer(words.buffers()[1], "int64")[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"\0", "uint8")
    crc = np.full(len(words), 0xFFFFFFFF, "uint32")
    for back in (3, 2, 1):
        on = np.flatnonzero(np.diff(offsets) >= back)
        crc[on] = _CRC[(crc[on] ^ data[offsets[on + 1] - back]) & 0xFF] ^ (crc[on] >> 8)
    return ((crc ^ 0xFFFFFFFF) % TAIL_CLASSES).astype("int64")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[pa.Array, np.ndarray]] = []
    rows, ends = 0, 0

    def added() -> tuple[pa.Array, np.ndarray]:
        words = pa.concat_arrays([w for w, _ in held]).dictionary_encode()  # a third of the time of Arrow's group_by
        return words.dictionary, np.bincount(words.indices.to_numpy(), np.concatenate([c for _, c in held]), len(words.dictionary)).astype("int64")

    def made(words: pa.Array, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([words.cast(pa.binary()), pa.array(c)], ["token", "c"])

    for b in _released(batches):
        for part in _chunks(b):
            texts = part.column("text")
            c = pc.value_counts(words_of(texts)[0])
            held.append((c.field("values"), c.field("counts").to_numpy()))
            ends, rows = ends + len(texts), rows + len(c)
            if rows >= 2 * COUNT_WORDS:
                held = [added()]
                rows = len(held[0][0])
                if rows >= COUNT_WORDS:
                    yield made(*held[0])
                    held, rows = [], 0
    if ends:
        held.append((pa.array([END], pa.large_binary()), np.array([ends])))
        yield made(*added())


def count_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, c) over all rows of docs, stored; the end has the empty token."""
    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(_count, "token binary, c long")
    # a task's tokens hardly repeat, so that adding them up before the exchange would be for nothing
    return store(parts.repartition("token").groupBy("token").agg(F.sum("c").alias("c")), "lm-counts")


@dataclass
class Vocabulary:
    """The head of the counts by rank (the end is on the shortlist in any case), and sums over all of them."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    tail_n: np.ndarray
    tail_v: np.ndarray

    def __post_init__(self):
        n = len(self.words)
        short = min(SHORT, n)
        mass = np.cumsum(np.sqrt(self.counts[:short] + 1.0))
        at = np.minimum((mass / max(mass[-1], 1) * CLASSES).astype(int), CLASSES - 1)
        self.cls, self.slot = np.zeros(n, "int32"), np.full(n, -1, "int32")
        used = np.zeros(CLASSES, int)
        for i in range(short):
            k = at[i]
            while used[k] == CLASS_WORDS:
                k = (k + 1) % CLASSES
            self.cls[i], self.slot[i] = k, used[k]
            used[k] += 1
        self.cls[short:] = CLASSES + tail_class(pa.array(self.words[short:], pa.large_binary()))
        self.feed = np.where(self.slot >= 0, self.cls * CLASS_WORDS + self.slot, SHORT + self.cls - CLASSES).astype("uint16")
        self.log_denominator = np.log10(self.tail_n + self.tail_v + 1.0)
        self.base_denominator = np.log10(self.total + self.distinct + 1.0)


def vocabulary(counts: DataFrame) -> Vocabulary:
    words = counts.where("length(token) > 0")
    level = F.floor(F.log2("c") * 64)  # words of one level are in the head together or not at all; there are some thousand levels
    taken, least = 0, None
    for r in words.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("l")).collect():
        if taken + r["n"] >= HEAD_WORDS:
            break
        taken, least = taken + r["n"], r["l"]
    rows = (words.limit(0) if least is None else words.where(level >= least)).toPandas()
    by = counts.groupBy((F.crc32(F.substring("token", -3, 3)) % TAIL_CLASSES).alias("k"), (F.length("token") == 0).alias("end")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    end, total, distinct = sum(r["n"] for r in by if r["end"]), sum(r["n"] for r in by), sum(r["v"] for r in by)
    head = [(END, end), *zip(map(bytes, rows["token"]), rows["c"].tolist())]
    head.sort(key=lambda x: (x[0] != END, -x[1], x[0]))
    tail_n, tail_v = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    for r in by:
        tail_n[r["k"]] += r["n"]
        tail_v[r["k"]] += r["v"]
    there = [(w, c) for w, c in head[:SHORT] if c]  # these are predicted one by one
    own = tail_class(pa.array([w for w, _ in there], pa.large_binary()))
    np.subtract.at(tail_n, own, [c for _, c in there])
    np.subtract.at(tail_v, own, 1)
    return Vocabulary([w for w, _ in head], np.array([c for _, c in head], float), int(total), int(distinct), tail_n, tail_v)


SHAPES = {"emb": (SHORT + TAIL_CLASSES + 1, EMBED), "wx": (EMBED, 3 * HIDDEN), "wh": (HIDDEN, 3 * HIDDEN), "bx": (3 * HIDDEN,), "bh": (3 * HIDDEN,), "wc": (HIDDEN, CLASSES + TAIL_CLASSES), "bc": (CLASSES + TAIL_CLASSES,), "wo": (CLASSES, HIDDEN, CLASS_WORDS), "bo": (CLASSES, CLASS_WORDS)}
START = SHORT + TAIL_CLASSES
SIZE = sum(math.prod(s) for s in SHAPES.values())


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = math.prod(shape)
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def initial(v: Vocabulary, seed: int = 1) -> np.ndarray:
    """Small random weights; the biases say the corpus's own frequencies."""
    r = np.random.default_rng(seed)
    flat = np.zeros(SIZE, "float32")
    p = unpack(flat)
    p["emb"][:] = r.normal(0, 0.3, p["emb"].shape)
    p["wx"][:] = r.normal(0, EMBED**-0.5, p["wx"].shape)
    p["wh"][:] = r.normal(0, HIDDEN**-0.5, p["wh"].shape)
    p["bx"][HIDDEN : 2 * HIDDEN] = 1.0
    mass = np.concatenate([np.zeros(CLASSES), v.tail_n + 1.0])
    short = np.flatnonzero(v.slot >= 0)
    np.add.at(mass, v.cls[short], v.counts[short] + 1.0)
    p["bc"][:] = np.log(np.maximum(mass, 0.01) / mass.sum())
    p["bo"][:] = -30.0  # slots without a word
    p["bo"][v.cls[short], v.slot[short]] = np.log((v.counts[short] + 1.0) / mass[v.cls[short]])
    return flat


class Encoder:
    """Texts to symbols: a word of the shortlist is class * CLASS_WORDS + slot, any other SHORT + its tail class."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.head = pa.array(v.words, pa.large_binary())
        self.log_c1 = np.log10(v.counts + 1.0)
        self.known = v.counts > 0

    def encode(self, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """By text: symbols with the end's, known words, base score, score of tail words inside their classes, words outside the head; both scores leave out what the last have by their counts."""
        v, rows = self.v, len(texts)
        words, n = words_of(texts)
        rank = pc.fill_null(pc.index_in(words, value_set=self.head), -1).to_numpy(zero_copy_only=False)
        owner, deep = np.repeat(np.arange(rows), n), rank < 0
        rare = words.filter(pa.array(deep))
        symbols = v.feed[rank]
        symbols[deep] = SHORT + tail_class(rare)
        tail = symbols >= SHORT
        chance = self.log_c1[rank]
        chance[deep] = 0.0
        inner = chance - v.log_denominator[np.where(tail, symbols, SHORT) - SHORT]
        by = lambda x, on: np.bincount(owner[on], x[on], rows).astype(float)
        base = by(chance, slice(None)) + self.log_c1[0] - v.base_denominator * (n + 1)
        known = by(self.known[rank].astype(float), ~deep).astype("int64") + int(self.known[0])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[deep], minlength=rows))])
        parts = [np.append(x, v.feed[0]) for x in np.split(symbols, np.cumsum(n)[:-1])] if rows else []
        return parts, known, base, by(inner, tail), pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), rare)


#: Class and slot (-1: none) of each symbol.
CLASS_OF = np.concatenate([np.repeat(np.arange(CLASSES), CLASS_WORDS), CLASSES + np.arange(TAIL_CLASSES)]).astype("uint8")
SLOT_OF = np.concatenate([np.tile(np.arange(CLASS_WORDS), CLASSES), np.full(TAIL_CLASSES, -1)]).astype("int16")
#: Logits below this need no shift before exp.
SAFE = 80.0
#: Classes whose words' chances are worked out at once: their rows stay in the cache.
CLASS_BLOCK = 8


def _squash(x: np.ndarray, room: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place, between -1 and 1: the unit's squashing function, at a sixth of the time of tanh."""
    np.abs(x, out=room)
    room += 1
    x /= room
    return x


def _by_gate(x: np.ndarray) -> np.ndarray:
    """3 x rows x HIDDEN: what the columns of a matrix are for r, z and the new state."""
    return np.ascontiguousarray(x.reshape(len(x), 3, HIDDEN).transpose(1, 0, 2))


class Net:
    """The network over windows of streams. Its arrays are used again from window to window."""

    def __init__(self, flat: np.ndarray):
        self.flat, self.p, self.held = flat, unpack(flat), {}
        self.x = np.empty((3, len(self.p["emb"]), HIDDEN), flat.dtype)
        self.ones = {n: np.ones(n, flat.dtype) for n in (CLASS_WORDS, CLASSES + TAIL_CLASSES)}
        self.refresh()

    def refresh(self) -> None:
        """After a change of the weights."""
        p = self.p
        for k in range(3):
            at = slice(k * HIDDEN, (k + 1) * HIDDEN)
            np.matmul(p["emb"], p["wx"][:, at], out=self.x[k])
            self.x[k] += p["bx"][at] + p["bh"][at] if k < 2 else p["bx"][at]
        self.w = _by_gate(p["wh"])
        # the parts of a state lie within -1 and 1
        self.safe = bool((np.abs(p["wc"]).sum(0) + np.abs(p["bc"])).max() < SAFE and np.abs(p["wo"]).sum(1).max() + np.abs(p["bo"]).max() < SAFE)

    def room(self, name: str, *shape: int) -> np.ndarray:
        n = math.prod(shape)
        if name not in self.held or self.held[name].size < n:
            self.held[name] = np.empty(n, self.flat.dtype)
        return self.held[name][:n].reshape(shape)

    def take(self, name: str, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.take(rows, at, axis=0, out=self.room(name, len(at), rows.shape[1]), mode="clip")

    def states(self, feed: np.ndarray, fresh: np.ndarray, h: np.ndarray, trace: bool = False) -> np.ndarray:
        """States that predict each step, steps x streams x HIDDEN; with a trace, what the gradient needs stays in its arrays.

        The gates r, z and what the new state has of the old one stand in arrays of their own, one after another.
        """
        steps, n = feed.shape
        x = self.room("x", 3, steps * n, HIDDEN)
        for k in range(3):
            np.take(self.x[k], feed.ravel(), axis=0, out=x[k], mode="clip")
        x = x.reshape(3, steps, n, HIDDEN)
        kept = steps if trace else 1
        out, before = self.room("out", steps, n, HIDDEN), self.room("before", kept, n, HIDDEN)
        gates, news, rest = self.room("gates", kept, 3, n, HIDDEN), self.room("news", kept, n, HIDDEN), self.room("rest", 2, n, HIDDEN)
        bias, starts, stays = np.tile(self.p["bh"][2 * HIDDEN :], (n, 1)), fresh.any(1), ~fresh[:, :, None]
        for t in range(steps):
            at = t if trace else 0
            g, u, b = gates[at], news[at], before[at]
            if starts[t]:
                np.multiply(h, stays[t], out=b)
            else:
                b[:] = h
            np.matmul(b, self.w, out=g)
            rz = g[:2]
            rz += x[:2, t]
            _squash(rz, rest)
            rz *= 0.5
            rz += 0.5
            g[2] += bias
            np.multiply(g[0], g[2], out=u)
            u += x[2, t]
            _squash(u, rest[0])
            h = np.subtract(b, u, out=out[t])
            h *= g[1]
            h += u
        return out

    def exp_sums(self, q: np.ndarray) -> np.ndarray:
        """Logits become their exp, less a shift by row where that is needed; sums by row."""
        if not self.safe:
            q -= q.max(1)[:, None]
        np.exp(q, out=q)
        return q @ self.ones[q.shape[1]]

    def class_chances(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exp of the logits of all classes, sums by row)."""
        q = np.matmul(h, self.p["wc"], out=self.room("classes", len(h), CLASSES + TAIL_CLASSES))
        q += self.p["bc"]
        return q, self.exp_sums(q)

    def word_chances(self, h: np.ndarray, edges: list[int]) -> Iterator[tuple[range, slice, np.ndarray, np.ndarray]]:
        """(classes, their rows, exp of the logits of the words of each row's class, sums by row), by blocks of classes; edges are where the rows of a class begin."""
        for first in range(0, CLASSES, CLASS_BLOCK):
            a, b = edges[first], edges[first + CLASS_BLOCK]
            if a == b:
                continue
            q = self.room("words", b - a, CLASS_WORDS)
            there = [k for k in range(first, first + CLASS_BLOCK) if edges[k] < edges[k + 1]]
            for k in there:
                part = q[edges[k] - a : edges[k + 1] - a]
                np.matmul(h[edges[k] : edges[k + 1]], self.p["wo"][k], out=part)
                part += self.p["bo"][k]
            yield there, slice(a, b), q, self.exp_sums(q)

    def log_chances(self, h: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Natural log of P(class | h), times P(word | class, h) for words of the shortlist, by row."""
        order = np.argsort(CLASS_OF[symbols], kind="stable")
        h, symbols = self.take("sorted", h, order), symbols[order]
        cls, slot, rows = CLASS_OF[symbols], SLOT_OF[symbols], np.arange(len(h))
        own, sums = np.empty(len(h), h.dtype), np.empty(len(h), h.dtype)
        for a in range(0, len(h), 2048):  # a block of rows stays in the cache
            b = slice(a, a + 2048)
            q, sums[b] = self.class_chances(h[b])
            own[b] = q.reshape(-1).take(rows[: len(q)] * q.shape[1] + cls[b])
        own /= sums
        out = np.log(np.maximum(own, 1e-30, out=own), out=own)
        edges = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
        for _, b, q, sums in self.word_chances(h, edges):
            inner = q.reshape(-1).take(rows[: len(q)] * CLASS_WORDS + slot[b])
            inner /= sums
            out[b] += np.log(np.maximum(inner, 1e-30, out=inner), out=inner)
        given = np.empty_like(out)
        given[order] = out
        return given

    def gradient(self, feed, symbols, fresh, live, h0) -> tuple[float, np.ndarray, np.ndarray]:
        """(summed loss, gradient of the mean loss as a flat array, last state) of a window; h0 counts as given (truncation)."""
        p, kind = self.p, self.flat.dtype
        grad = self.room("grad", len(self.flat))
        grad[:] = 0
        d = unpack(grad)
        steps, n = feed.shape
        hs = self.states(feed, fresh, h0, True)
        on = np.flatnonzero(live)
        on = on[np.argsort(CLASS_OF[symbols.ravel()[on]], kind="stable")]
        h, s = self.take("sorted", hs.reshape(-1, HIDDEN), on), symbols.ravel()[on]
        c, o, rows = CLASS_OF[s], SLOT_OF[s], np.arange(len(on))
        ones = np.ones(max(len(on), steps * n), kind)
        q, sums = self.class_chances(h)
        q /= sums[:, None]
        at, own = rows * q.shape[1] + c, self.room("own", 2, len(on))
        own[1] = 1
        np.take(q.reshape(-1), at, out=own[0], mode="clip")
        q.reshape(-1)[at] -= 1
        np.matmul(h.T, q, out=d["wc"])
        d["bc"][:] = ones[: len(q)] @ q
        dh = self.room("dh", len(on) + 1, HIDDEN)  # the last row is what steps have that aren't live
        dh[-1] = 0
        np.matmul(q, p["wc"].T, out=dh[:-1])
        edges = np.searchsorted(c, np.arange(CLASSES + 1)).tolist()
        for there, b, q, sums in self.word_chances(h, edges):
            q /= sums[:, None]
            at = rows[: len(q)] * CLASS_WORDS + o[b]
            np.take(q.reshape(-1), at, out=own[1, b], mode="clip")
            q.reshape(-1)[at] -= 1
            back = self.room("back", len(q), HIDDEN)
            for k in there:
                one, part = slice(edges[k], edges[k + 1]), slice(edges[k] - b.start, edges[k + 1] - b.start)
                np.matmul(h[one].T, q[part], out=d["wo"][k])
                np.matmul(ones[one], q[part], out=d["bo"][k])
                np.matmul(q[part], p["wo"][k].T, out=back[part])
            dh[b] += back
        own += 1e-30
        loss = -np.log(own, out=own).sum()
        where = np.full(steps * n, len(on))
        where[on] = rows
        up = np.take(dh, where, axis=0, out=self.room("up", steps * n, HIDDEN), mode="clip")
        up = up.reshape(steps, n, HIDDEN)
        size, shape = up.size, up.shape
        before, u = self.held["before"][:size].reshape(shape), self.held["news"][:size].reshape(shape)
        g = self.held["gates"][: 3 * size].reshape(steps, 3, n, HIDDEN)
        r, z, inner = g[:, 0], g[:, 1], g[:, 2]
        rest = np.subtract(1, z, out=self.room("keep", *shape))
        to_z = np.minimum(z, rest, out=self.room("to_z", *shape))  # a gate g has the slope 2 min(g, 1 - g)^2
        to_z *= to_z
        to_z *= 2
        room = np.subtract(before, u, out=self.room("to_r", *shape))
        to_z *= room
        to_u = np.abs(u, out=self.room("to_u", *shape))  # and the new state the slope (1 - |u|)^2
        np.subtract(1, to_u, out=to_u)
        to_u *= to_u
        to_u *= rest
        to_r = np.subtract(1, r, out=room)
        np.minimum(r, to_r, out=to_r)
        to_r *= to_r
        to_r *= 2
        to_r *= inner
        dg = self.room("dg", 3, steps, n, HIDDEN)  # of the sums of r, z and, before r, the new state
        dx = self.room("dx", steps, n, HIDDEN)
        carry, parts, back, starts = np.zeros((n, HIDDEN), kind), self.room("parts", 3, n, HIDDEN), np.ascontiguousarray(self.w.transpose(0, 2, 1)), fresh.any(1)
        for t in range(steps - 1, -1, -1):
            dy = up[t]
            dy += carry
            du = np.multiply(dy, to_u[t], out=dx[t])
            np.multiply(du, to_r[t], out=dg[0, t])
            np.multiply(dy, to_z[t], out=dg[1, t])
            np.multiply(du, r[t], out=dg[2, t])
            np.matmul(dg[:, t], back, out=parts)
            np.multiply(dy, z[t], out=carry)
            for k in range(3):
                carry += parts[k]
            if starts[t]:
                carry *= ~fresh[t][:, None]
        flat, old = dg.reshape(3, -1, HIDDEN), before.reshape(-1, HIDDEN)
        wh, bh = d["wh"].reshape(HIDDEN, 3, HIDDEN), d["bh"].reshape(3, HIDDEN)
        for k in range(3):
            wh[:, k] = old.T @ flat[k]
            bh[k] = ones[: len(old)] @ flat[k]
        flat[2] = dx.reshape(-1, HIDDEN)
        order = np.argsort(feed.ravel(), kind="stable")
        of = feed.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        of = of[first]
        e, de = p["emb"][of], np.zeros((len(of), EMBED), kind)
        pair = np.result_type(kind, np.complex64)  # numpy adds up each column apart: two columns as one complex one take half the time
        wx, bx, ws = d["wx"].reshape(EMBED, 3, HIDDEN), d["bx"].reshape(3, HIDDEN), p["wx"].reshape(EMBED, 3, HIDDEN)
        for k in range(3):  # a symbol's rows are added up first
            sums = np.add.reduceat(self.take("by_feed", flat[k], order).view(pair), first, axis=0).view(kind)
            wx[:, k] = e.T @ sums
            bx[k] = ones[: len(sums)] @ sums
            de += sums @ ws[:, k].T
        d["emb"][of] = de
        grad /= max(1, len(on))
        return float(loss), grad, hs[-1].copy()


class Streams:
    """Documents side by side: each stream runs through one after another, and hands out windows of steps tokens.

    Where fewer streams are left, windows have as many more steps: a few long documents at the end would else take hundreds of windows of a few tokens.
    """

    def __init__(self, docs: Iterator[tuple[int, np.ndarray]], streams: int, steps: int, block: int = BLOCK_STEPS):
        self.docs, self.steps, self.block = docs, steps, -(-block // steps) * steps
        self.now: list = [None] * streams
        self.all = streams

    def windows(self):
        """(columns, feed, symbols, fresh, live, doc), arrays steps x streams; fresh where a document starts, feed the symbol before.

        columns: the streams of the window before that go on, when others have come to their end; else None. A document is
        (key, symbols).
        """
        more = True
        while more or any(self.now):
            n, steps = len(self.now), self.block
            feed, symbols = np.full((steps, n), START, "uint16"), np.zeros((steps, n), "uint16")
            fresh, live, doc = np.zeros((steps, n), bool), np.zeros((steps, n), bool), np.zeros((steps, n), "int32")
            for s in range(n):
                t = 0
                while t < steps:
                    if self.now[s] is None:
                        if (d := next(self.docs, None)) is None:
                            more = False
                            break
                        self.now[s] = (*d, 0)
                    key, x, at = self.now[s]
                    m = min(steps - t, len(x) - at)
                    if at == 0:
                        fresh[t, s] = True
                        feed[t + 1 : t + m, s] = x[: m - 1]
                    else:
                        feed[t : t + m, s] = x[at - 1 : at + m - 1]
                    symbols[t : t + m, s] = x[at : at + m]
                    live[t : t + m, s], doc[t : t + m, s] = True, key
                    t += m
                    self.now[s] = None if at + m == len(x) else (key, x, at + m)
            going = np.arange(n)
            a = 0
            while a < steps:
                on = np.flatnonzero(live[a, going])  # a stream is live up to its end
                if not len(on):
                    break
                columns = None if len(on) == len(going) else on
                going = going[on]
                part = slice(a, a + self.steps * (self.all // len(going)))
                cut = (part,) if len(going) == n else (part, going)
                yield columns, feed[cut], symbols[cut], fresh[cut], live[cut], doc[cut]
                a = part.stop
            self.now = [self.now[s] for s in going]


def train_replica(weights: np.ndarray, docs: Iterator[tuple[int, np.ndarray]], rate: float, streams: int, warm: bool = True) -> tuple[np.ndarray, int, float]:
    """(weights after a pass of Adam over the windows of docs, tokens seen, their summed loss). Weights are rows: weights, first and second moments.

    warm: the moments are those of earlier steps, not zeros.
    """
    weights = weights.copy()
    flat, m, v = weights
    net, h, seen, loss, step = Net(flat), np.zeros((streams, HIDDEN), "float32"), 0, 0.0, 1000 * warm
    for columns, feed, symbols, fresh, live, _ in Streams(docs, streams, STEPS).windows():
        x, grad, h = net.gradient(feed, symbols, fresh, live, h if columns is None else h[columns])
        loss, seen, step = loss + x, seen + int(np.count_nonzero(live)), step + 1
        size = float(np.sqrt(grad @ grad))
        if size > 1.0:
            grad /= size
        grad *= 0.1  # in place from here on, as every one of these arrays is larger than a cache
        m *= 0.9
        m += grad
        grad *= grad
        v *= 0.99
        v += grad
        np.sqrt(v, out=grad)
        grad *= (1 - 0.99**step) ** -0.5
        grad += 1e-6
        np.divide(m, grad, out=grad)
        grad *= rate / (1 - 0.9**step)
        flat -= grad
        net.refresh()
    return weights, seen, loss


MOVED = "seen long, loss double, moved binary"


def _moved(seen: int, loss: float, moved: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([float(loss)]), pa.array([moved.tobytes()], pa.binary())], ["seen", "loss", "moved"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means, weighted by the tokens seen, of what replicas came to."""
    total, seen, loss = 0.0, 0, 0.0
    for b in batches:
        for n, x, d in zip(b.column("seen").to_pylist(), b.column("loss").to_pylist(), b.column("moved")):
            total = total + np.frombuffer(d.as_py(), "float32").astype("float64") * n
            seen, loss = seen + n, loss + x
    if seen:
        yield _moved(seen, loss, (total / seen).astype("float32"))


def replicas(words: float) -> int:
    """Replicas of a round over so many words: one for each REPLICA_WORDS at first, then by the root, so that shards grow as well."""
    shards = words / REPLICA_WORDS
    return max(1, math.ceil(min(shards, 2 * math.sqrt(shards))))


ENCODED = "doc_id long, tag long, held_out boolean, seq long, turn int, n_tokens long, n_known long, base double, more double, symbols binary, rare array<binary>"


def _encode(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Encoder(sent.value)
        for b in _released(batches):
            for part in _chunks(b):
                symbols, known, base, more, rare = code.encode(part.column("text"))
                made = [pa.array(list(map(len, symbols)), pa.int64()), pa.array(known), pa.array(base), pa.array(more), pa.array([x.tobytes() for x in symbols], pa.binary()), rare.cast(pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], [x.split()[0] for x in ENCODED.split(", ")])

    return run


def encode(docs: DataFrame, v: Vocabulary, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """docs once as symbols, stored by turn: the round of training that sees a row, by a hash of the row; -1 for rows held out."""
    sent = docs.sparkSession.sparkContext.broadcast(v)
    held = held_out(F.col(id_col))
    seq = F.xxhash64(F.col(id_col), F.col(text_col))
    turn = F.when(held, -1).otherwise(F.pmod(seq, F.lit(rounds))).cast("int")
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("tag"), held.alias("held_out"), seq.alias("seq"), turn.alias("turn"), F.col(text_col).alias("text"))
    return store(thin.mapInArrow(_encode(sent), ENCODED), "lm-encoded", by=["turn"])


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    n = 0
    for b in _released(batches):
        for x in b.column("symbols"):
            yield n, np.frombuffer(x.as_buffer(), "uint16").copy()  # a view would keep the whole batch as long as a stream runs through it
            n += 1


def fit(encoded: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after all rounds; in each, every replica starts from the mean of the last and sees its shard of the round's rows.

    The rounds share out the rows that aren't held out, and none is left out: every document is trained on once.
    """
    spark = encoded.sparkSession
    weights = np.stack([initial(v), np.zeros(SIZE, "float32"), np.zeros(SIZE, "float32")])
    shards = replicas(v.total / rounds)
    streams = int(np.clip(v.total / rounds / shards / STEPS / WINDOWS, LEAST_STREAMS, MOST_STREAMS))
    # very long documents go first, or a stream would be left alone with one
    long = F.greatest(F.floor(F.log2("n_tokens")) - 11, F.lit(0))
    for k in range(rounds):
        start = spark.sparkContext.broadcast(weights)
        rate = RATE / (1 + 3 * k / rounds)

        def run(batches: Iterator[pa.RecordBatch], start=start, rate=rate, warm=k > 0) -> Iterator[pa.RecordBatch]:
            out, seen, loss = train_replica(start.value, _symbols(batches), rate, streams, warm)
            if seen:
                yield _moved(seen, loss, out)

        made, n = encoded.where(F.col("turn") == k).select("seq", "symbols", long.alias("long")).repartition(shards, "seq").sortWithinPartitions(F.desc("long"), "seq", "symbols").mapInArrow(run, MOVED), shards
        while True:
            n = -(-n // FAN_IN)
            made = made.repartition(n).mapInArrow(_added, MOVED)
            if n == 1:
                break
        moved = store(made, "lm-moves")
        for r in moved.collect():  # one row, or none where no row has this turn
            weights = np.frombuffer(r["moved"], "float32").reshape(3, SIZE).copy()
        discard(moved)
    return weights[0]


def score_documents(flat: np.ndarray, docs: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[int, float]]:
    """(key, natural log-likelihood of classes and shortlist words) of each document (key, symbols), as they end."""
    net, h = Net(flat), np.zeros((SCORE_STREAMS, HIDDEN), "float32")
    left: dict[int, int] = {}
    sums: dict[int, float] = {}

    def counted():
        for key, symbols in docs:
            left[key], sums[key] = len(symbols), 0.0
            yield key, symbols

    for columns, feed, symbols, fresh, live, doc in Streams(counted(), SCORE_STREAMS, STEPS).windows():
        hs = net.states(feed, fresh, h if columns is None else h[columns]).reshape(-1, HIDDEN)
        h, on = hs[-feed.shape[1] :].copy(), np.flatnonzero(live)
        parts = net.log_chances(hs if len(on) == len(hs) else hs[on], symbols.ravel()[on])
        keys = doc.ravel()[on]
        least = int(keys.min())
        n = np.bincount(keys - least)
        s = np.bincount(keys - least, parts)
        for i in np.flatnonzero(n).tolist():
            key = least + i
            sums[key] += s[i]
            left[key] -= int(n[i])
            if not left[key]:
                del left[key]
                yield key, float(sums.pop(key))


SCORED = "doc_id long, tag long, held_out boolean, n_tokens long, n_known long, base double, score double"


def _score(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts: dict[int, tuple] = {}
        names = ("doc_id", "tag", "held_out", "n_tokens", "n_known", "base", "more")
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

        def documents():
            n = 0
            for b in _released(batches):
                for *row, x in zip(*(b.column(c).to_pylist() for c in names), b.column("symbols")):
                    facts[n] = tuple(row)
                    yield n, np.frombuffer(x.as_buffer(), "uint16").copy()
                    n += 1

        done: list[tuple] = []

        def batch() -> pa.RecordBatch:
            c = list(zip(*done))
            done.clear()
            return pa.RecordBatch.from_arrays(list(map(pa.array, c, kinds)), [x.split()[0] for x in SCORED.split(", ")])

        for key, s in score_documents(weights.value, documents()):
            *row, more = facts.pop(key)
            done.append((*row, more + s / math.log(10)))
            if len(done) >= 500:
                yield batch()
        if done:
            yield batch()

    return run


def score(encoded: DataFrame, counts: DataFrame, flat: np.ndarray) -> DataFrame:
    """One row per encoded row: doc_id, held_out, n_tokens, n_known, base_score, score."""
    weights = encoded.sparkSession.sparkContext.broadcast(flat)
    scored = store(encoded.select("doc_id", "tag", "held_out", "n_tokens", "n_known", "base", "more", "symbols").mapInArrow(_score(weights), SCORED), "lm-scores")
    c = counts.select(F.col("token").alias("t"), "c")
    rare = encoded.select("tag", F.explode("rare").alias("token")).join(c, F.col("token") == F.col("t"), "left")
    rare = rare.groupBy(F.col("tag").alias("of")).agg(F.count("c").alias("k"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("s"))
    out = scored.join(rare, F.col("tag") == F.col("of"), "left")
    s = F.coalesce("s", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"), (F.col("base") + s).alias("base_score"), (F.col("score") + s).alias("score"))


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and weights from the rows that aren't held out; scores of all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text is empty; repeated rows count as rows. Without training rows every word is unknown: base_score is 0. An empty
    table gives no rows. Other columns of docs are ignored, whatever their names.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = count_tokens(docs.where(~held_out(F.col("doc_id"))))
    v = vocabulary(counts)
    encoded = encode(docs, v)
    out = score(encoded, counts, fit(encoded, v))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(v.total).cast("long").alias("train_tokens"), "base_score", "score")


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(table(spark, sf_dir, "documents"))


QUERIES = {"op9_language_model": op9_language_model}
ORACLES: dict[str, str] = {}
