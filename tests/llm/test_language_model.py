import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from barwright.llm import language_model as m



def tokens(text):
    """Words [^\\x20\\x09-\\x0D]+ after A-Z are lower-cased, then the end."""
    return [*(text or "").encode().lower().split(), b""]


SCHEMA = "doc_id long, text string, tag int, token string"


def corpus(n=150):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["the", "The", "a", "b", "c", "É", "w%d" % r.randint(0, 40)]) for _ in range(r.randint(0, 60))), 1, "x") for i in range(n)]
    return rows + [(n, None, 1, "x"), (n + 1, "", 1, "x"), (n + 2, "the " * 5000, 1, "x"), (3, rows[3][1], 1, "x"), (None, "the end", 1, "x")]


@pytest.fixture(scope="module")
def scored(spark):
    return m.train_and_score(spark.createDataFrame(corpus(), SCHEMA)).collect()


def test_counts_and_base(scored):
    rows = corpus()
    out = sorted(scored, key=lambda r: (r.doc_id is None, r.doc_id, r.n_tokens))
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = Counter(t for i, text, *_ in rows if not held(i) for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for i, text, *_ in rows:
        ts = tokens(text)
        want.append((i, held(i), len(ts), sum(counts[t] > 0 for t in ts), total, sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in ts)))
    want.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    assert len(out) == len(want)
    for a, b in zip(out, want):
        assert (a.doc_id, a.held_out, a.n_tokens, a.n_known, a.train_tokens) == b[:5]
        assert a.base_score == pytest.approx(b[5], rel=1e-9)
        assert a.score < 0 and math.isfinite(a.score)


def vocabulary(words):
    c = Counter(words)
    rows = sorted(((w, n) for w, n in c.items() if w), key=lambda x: (-x[1], x[0]))
    tail_n, tail_v = np.zeros(m.TAIL_CLASSES), np.zeros(m.TAIL_CLASSES)
    for w, n in rows[m.SHORT - 1 :]:
        k = zlib.crc32(w[-3:]) % m.TAIL_CLASSES
        tail_n[k] += n
        tail_v[k] += 1
    return m.Vocabulary([b"", *(w for w, _ in rows)], np.array([c[b""], *(n for _, n in rows)], float), sum(c.values()), len(c), tail_n, tail_v)


def test_chances_add_up():
    """Over classes, shortlist words, tail words of the corpus and one unknown word a class, P sums to 1 in any state."""
    r = random.Random(2)
    v = vocabulary([b"w%d" % int(r.expovariate(0.0015)) for _ in range(30_000)] + [b""] * 50)
    assert len(v.words) > m.SHORT
    net = m.Net(m.initial(v))
    h = np.random.default_rng(0).uniform(-1, 1, (1, m.HIDDEN)).astype("float32")
    for safe in (True, False):
        net.safe, total = safe, 0.0
        p = np.exp(net.log_chances(np.repeat(h, m.START, 0), np.arange(m.START, dtype="uint16")).astype(float))
        for s, c, k, o in zip(v.feed, v.counts, v.cls, v.slot):
            total += p[s] if o >= 0 else p[s] * (c + 1) / 10 ** v.log_denominator[k - m.CLASSES]
        for k in range(m.TAIL_CLASSES):
            total += p[m.SHORT + k] / 10 ** v.log_denominator[k]
        assert total == pytest.approx(1, abs=1e-3)


def test_symbols_and_base():
    """Words of the shortlist, of the tail and outside the head; the base score is that of the words of the head."""
    v = vocabulary([b"a"] * 5 + [b"b"] * 3 + [b""] * 2)
    (symbols, none), known, base, more, rare = m.Encoder(v).encode(pa.array(["B\txyz a ", None]))
    assert [m.SLOT_OF[x] >= 0 for x in symbols] == [True, False, True, True] and symbols[1] == m.SHORT + zlib.crc32(b"xyz") % m.TAIL_CLASSES
    assert none.tolist() == [v.feed[0]] and known.tolist() == [3, 1] and rare.to_pylist() == [[b"xyz"], []]
    assert base.tolist() == pytest.approx([math.log10(4) + math.log10(6) + math.log10(3) - 4 * math.log10(14), math.log10(3) - math.log10(14)])
    assert more.tolist() == pytest.approx([-v.log_denominator[symbols[1] - m.SHORT], 0])


def test_words_and_tail_classes():
    r = random.Random(9)
    texts = ["".join(r.choices("aBcÉ \t\n\x0b\x0c\r\x1c\u00a0\u2003", k=r.randint(0, 40))) for _ in range(300)] + ["", None, " ", "x" * 100_000]
    flat, n = m.words_of(pa.array(texts))
    want = [tokens(t)[:-1] for t in texts]
    assert flat.to_pylist() == [w for t in want for w in t] and n.tolist() == list(map(len, want))
    for kind in (pa.string(), pa.large_string()):  # slices as well
        flat, n = m.words_of(pa.array(texts, kind).slice(100, 150))
        assert flat.to_pylist() == [w for t in want[100:250] for w in t] and n.tolist() == list(map(len, want[100:250]))
    words = sorted({w for t in want for w in t} | {b"\xff", b"ab", b"\x00\x01\x02\x03"})
    assert m.tail_class(pa.array(words, pa.large_binary())).tolist() == [zlib.crc32(w[-3:]) % m.TAIL_CLASSES for w in words]
    assert m.tail_class(pa.array([], pa.large_binary())).tolist() == []


def some(r, code, lengths):
    texts = [" ".join(f"w{i}" for i in r.integers(0, 300, n)) for n in lengths]
    return list(enumerate(code.encode(pa.array(texts))[0]))


def test_gradient_by_differences():
    r = np.random.default_rng(5)
    v = vocabulary([b"w%d" % i for i in r.integers(0, 300, 5000)] + [b""] * 9)
    flat = m.initial(v).astype("float64")
    docs = some(r, m.Encoder(v), (3, 9, 20))
    _, feed, symbols, fresh, live, _ = next(m.Streams(iter(docs), 2, 12, 12).windows())
    h0 = r.uniform(-1, 1, (2, m.HIDDEN))
    loss = lambda x: m.Net(x).gradient(feed, symbols, fresh, live, h0)[0] / live.sum()
    grad = m.Net(flat).gradient(feed, symbols, fresh, live, h0)[1]
    parts, at = m.unpack(np.arange(m.SIZE)), []
    for name in m.SHAPES:  # the largest few of every part, and others
        own = parts[name].ravel()
        own = own[np.argsort(-np.abs(grad[own]))]
        at += [*own[:6], *own[r.integers(0, max(7, len(own) // 50), 6)]]
    for i in at:
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        assert (loss(up) - loss(down)) / 2e-4 == pytest.approx(grad[i], rel=1e-3, abs=1e-7)


def test_state_is_carried_through_windows(monkeypatch):
    """Scores of whole documents don't depend on the windows and blocks they are cut into, nor on which streams end first."""
    r = np.random.default_rng(6)
    v = vocabulary([b"w%d" % i for i in r.integers(0, 300, 5000)] + [b""] * 9)
    flat = m.initial(v)
    m.unpack(flat)["wc"][:] = r.normal(0, 1, (m.HIDDEN, m.CLASSES + m.TAIL_CLASSES))
    docs = some(r, m.Encoder(v), (1, 70, 200, 0, 33, 2000, 5))
    a = dict(m.score_documents(flat, iter(docs)))
    made = m.Streams
    monkeypatch.setattr(m, "Streams", lambda docs, n, steps: made(docs, n, steps, 21))
    monkeypatch.setattr(m, "STEPS", 7)
    monkeypatch.setattr(m, "SCORE_STREAMS", 3)
    b = dict(m.score_documents(flat, iter(docs)))
    net, h = m.Net(flat), np.zeros((1, m.HIDDEN), "float32")
    for key, x in docs:
        feed = np.concatenate([[m.START], x[:-1]]).astype("uint16")[:, None]
        c = net.log_chances(net.states(feed, np.zeros(feed.shape, bool), h)[:, 0], x).sum()
        assert a[key] == pytest.approx(c, rel=1e-4) and b[key] == pytest.approx(c, rel=1e-4)
    assert len(a) == len(b) == len(docs)


@pytest.mark.parametrize("sf, most", [("0.01", 0.96), ("0.1", 0.94)])
def test_held_out_gain(spark, sf, most):
    """On documents it hasn't learnt from, the model says more than the counts alone, and on nearly each of them."""
    out = m.op9_language_model(spark, f"/root/testdata/sf{sf}").where("held_out").toPandas()
    assert out["score"].sum() > most * out["base_score"].sum()
    assert (out["score"] < out["base_score"]).mean() < 0.03


def test_empty(spark):
    assert m.train_and_score(spark.createDataFrame([], SCHEMA)).count() == 0


def test_head_is_bounded(spark, monkeypatch):
    counts = spark.createDataFrame([(b"w%d" % i, 1 + 1000 // (i + 1)) for i in range(300)] + [(b"", 7)], "token binary, c long")
    for most in (1, 5, 100, 1000):
        monkeypatch.setattr(m, "HEAD_WORDS", most)
        v = m.vocabulary(counts)
        assert len(v.words) <= max(1, most) and v.words[0] == b"" and v.counts[1:].tolist() == sorted(v.counts[1:], reverse=True)
        assert (v.total, v.distinct) == (7 + sum(1 + 1000 // (i + 1) for i in range(300)), 301)
        assert set(v.words[1:]) == {b"w%d" % i for i in range(len(v.words) - 1)}


def test_moves_add_up():
    d = [np.array([1.0, 2.0], "float32"), np.array([3.0, -2.0], "float32")]
    one = list(m._added(iter([m._moved(2, 1.0, d[0]), m._moved(6, 3.0, d[1])])))
    two = next(m._added(iter(one))).to_pylist()[0]
    assert two["seen"] == 8 and np.frombuffer(two["moved"], "float32").tolist() == [2.5, -1.0]
    assert list(m._added(iter([]))) == []


def test_every_training_document_is_trained_on(spark, monkeypatch):
    """The rounds together see each document that isn't held out once, whole; a corpus of a few documents is trained on as well."""
    docs = spark.createDataFrame([(i, f"w{i % 7} only{i} " + "so " * (i % 5)) for i in range(140)], "doc_id long, text string")
    mine = [i for i in range(140) if zlib.crc32(str(i).encode()) % 7 != 2]
    v = m.vocabulary(m.count_tokens(docs.where(~m.held_out(docs.doc_id))))
    encoded = m.encode(docs, v)
    seen, moves = [], m.store
    monkeypatch.setattr(m, "store", lambda df, name, **more: seen.append(moves(df, name, **more)) or seen[-1])
    monkeypatch.setattr(m, "discard", lambda df: None)
    flat = m.fit(encoded, v)
    assert sum(r["seen"] for df in seen for r in df.select("seen").collect()) == sum(3 + i % 5 for i in mine) == v.total
    assert np.abs(flat - m.initial(v)).max() > 0
    few = docs.where("doc_id in (0, 1)")
    v = m.vocabulary(m.count_tokens(few))
    assert np.abs(m.fit(m.encode(few, v), v) - m.initial(v)).max() > 0


def test_a_word_of_one_document_in_sixteen_is_learnt(spark):
    """No share of the training documents is passed over: what any sixteenth of them alone says moves the weights of its word."""
    docs = spark.createDataFrame([(i, f"mark{i % 16} word other") for i in range(4000)], "doc_id long, text string")
    v = m.vocabulary(m.count_tokens(docs.where(~m.held_out(docs.doc_id))))
    flat = m.fit(m.encode(docs, v), v)
    before, after = m.unpack(m.initial(v))["emb"], m.unpack(flat)["emb"]
    for k in range(16):
        s = v.feed[v.words.index(b"mark%d" % k)]
        assert np.abs(after[s] - before[s]).max() > 1e-3


def test_shards_grow_with_the_corpus():
    n = [m.replicas(w) for w in (0, 1, 1e6, 1e7, 1e8, 1e9)]
    shard = [w / k for w, k in zip((1e6, 1e7, 1e8, 1e9), n[2:])]
    assert n[:2] == [1, 1] and n == sorted(n) and shard == sorted(shard) and shard[-1] > 10 * shard[0]


def test_few_streams_take_longer_windows():
    """Of a long document that outlasts the others, windows have as many more steps, not a few tokens each; every token is handed out once, in order."""
    docs = [(0, np.arange(20_000).astype("uint16")), *((i, np.arange(100).astype("uint16")) for i in range(1, 300))]
    met, windows = {k: [] for k, _ in docs}, 0
    for _, feed, symbols, fresh, live, doc in m.Streams(iter(docs), 16, 32).windows():
        windows += 1
        assert symbols.size <= 16 * 32
        for s in range(symbols.shape[1]):
            on = live[:, s]
            for k in np.unique(doc[on, s]).tolist():
                met[k].append(symbols[on & (doc[:, s] == k), s])
    assert all((np.concatenate(met[k]) == x).all() for k, x in docs)
    assert windows < 150  # 625 windows of 32 steps


def test_counts_are_handed_on_in_parts(monkeypatch):
    r = random.Random(4)
    texts = [" ".join("w%d" % r.randint(0, 400) for _ in range(r.randint(0, 50))) for _ in range(3000)]
    monkeypatch.setattr(m, "COUNT_WORDS", 100)
    met, parts = Counter(), 0
    for b in m._count(pa.table({"text": texts}).to_batches(max_chunksize=70)):
        parts += 1
        met.update(dict(zip(b.column("token").to_pylist(), b.column("c").to_pylist())))
    assert parts > 5 and met == Counter(t for x in texts for t in tokens(x))
