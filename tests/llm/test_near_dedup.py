import random
from itertools import combinations

import numpy as np
import pytest

from barwright.llm import near_dedup as m
from barwright.llm.components import components

LOW = {ord(a): b for a, b in zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}


def shingles(text, width):
    w = (text or "").translate(LOW).encode().split()
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            root[find(a)] = find(b)
    out = []
    for k, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        c = min(ids, default=None)
        out.append((d, len(sets[k]), c, d == c if c is not None else True))
    return sorted(out, key=repr)


def edited(r, words, share):
    return [r.choice(["new", "other", "x%d" % r.randint(0, 999)]) if r.random() < share else w for w in words]


def corpus(seed):
    r = random.Random(seed)
    rows, base = [], []
    for g in range(12):
        base = [r.choice(["the", "of", "w%d" % r.randint(0, 400)]) for _ in range(r.choice([3, 20, 60, 200]))]
        for _ in range(r.randint(1, 25)):
            base = edited(r, base, r.choice([0, 0.01, 0.03])) if r.random() < 0.3 else base  # chains
            rows.append((r.choice([" ", "\n", "  "])).join(edited(r, base, r.choice([0, 0, 0.01, 0.02, 0.05, 0.2]))))
    rows += [None, "", " \n", "one", "One", "one two", "one two", "a b c", "A B C", "É b c", "é b c", "same " * 50, "same " * 70]
    ids = list(range(len(rows)))
    r.shuffle(ids)
    out = [(i, t) for i, t in zip(ids, rows)] + [(None, rows[0]), (None, "alone alone now here"), (ids[3], rows[3])]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, text string, sid string, row int")


@pytest.mark.parametrize("seed, rest", [(1, 4), (2, 0), (3, 10**9)])
def test_brute_force(spark, monkeypatch, seed, rest):
    monkeypatch.setattr(m, "REST", rest)
    rows = corpus(seed)
    got = m.groups(frame(spark, rows), width=3, percent=85)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == brute(rows, 3, 85)


def test_defaults_and_keep_one(spark):
    rows = corpus(4)
    got = m.keep_one(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "sid", "row"]
    stay = [(d, t) for (d, t), (_, _, c, k) in ((x, next(b for b in brute(rows, 5, 80) if b[0] == x[0] and b[1] == len(shingles(x[1], 5)))) for x in rows) if k]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(set(stay), key=repr)


def test_small_sf(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = m.groups(df, width=3, percent=85)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == brute(rows, 3, 85)


def test_empty(spark):
    assert m.groups(frame(spark, [])).count() == 0
    assert [r.component_id for r in m.groups(frame(spark, [(1, None), (2, "")])).orderBy("doc_id").collect()] == [1, 2]


def test_superminhash_against_the_sequential_form():
    slots, r = 24, np.random.default_rng(1)
    for n in (1, 2, 30):
        h = r.integers(0, 2**52, n, dtype="uint64")
        want = np.full(slots, np.inf)
        for x in h:
            p = list(range(slots))
            for j in range(slots):
                z = m._mix(np.array([x + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)]))[0]
                k = j + (int(z) & 0xFFFFFFFF) * (slots - j) // 2**32
                p[j], p[k] = p[k], p[j]
                want[p[j]] = min(want[p[j]], j + (int(z) >> 32) / 2**32)
        assert np.array_equal(m.superminhash(h, np.array([0, n]), slots)[0], want)


def test_estimates_vary_less_than_those_of_minhash():
    r, slots, n, got = np.random.default_rng(2), 64, 40, []
    for _ in range(400):
        x = r.integers(0, 2**52, 80, dtype="uint64")
        sig = m.superminhash(np.concatenate([x[:40], x[20:60]]), np.array([0, n, 2 * n]), slots)
        got.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(got) - 1 / 3) < 0.01
    assert np.var(got) < 0.75 * (1 / 3) * (2 / 3) / slots


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 50)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(90)] + [(7, 7)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(500):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if k in got} and set(got) == {x for a, b in edges if a != b for x in (a, b)}


def test_parity_sketches_bound_what_sets_dont_share():
    r = np.random.default_rng(3)
    for n in (1, 30, 400, 5000):
        x = np.unique(r.integers(0, 2**52, n, dtype="uint64"))
        y = np.unique(np.concatenate([x[: n // 2], r.integers(0, 2**52, n // 3, dtype="uint64")]))
        p = m._parity(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])).view("uint64")
        bits = sum(int(a).bit_count() for a in p[0] ^ p[1])
        assert bits <= len(np.setxor1d(x, y)) and (n > 400 or bits >= 0.7 * len(np.setxor1d(x, y)))


def test_keep_one_leaves_one_of_each_group(spark):
    """Also of groups without any doc_id, and of groups whose near copies share the smallest doc_id."""
    words = lambda k: [f"{k}{i}" for i in range(60)]
    near = lambda k: [" ".join(words(k)), " ".join(words(k) + ["more"]), " ".join(words(k) + ["most"])]
    rows = [(None, t) for t in near("a")] + [(5, t) for t in near("b")] + [(7, near("c")[0]), (None, near("c")[1]), (None, ""), (9, None)]
    got = m.keep_one(frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id, (r.text or "")[:1]) for r in got if r.text) == [(False, 5, "b"), (False, 7, "c"), (True, None, "a")]
    assert sorted(repr(r.doc_id) for r in got if not r.text) == ["9", "None"]
