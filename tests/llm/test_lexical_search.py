"""Ranked search against plain Python over all documents, and the threshold algorithm against a full scan of a shard."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF, same

from barwright.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=10):
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    n_docs, n_all = sum(1 for _, c in counted if c), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 25 + 75 * c.total() * n_docs // max(n_all, 1)
            w = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            score = sum(w(t) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms_of(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in docs], "doc_id long, text string, rank string, score string, term int")
    return d, spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, tag int")


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def corpus(seed, n=400):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Ünder", "naïve", "日本", "a1b2"]
    p = 1 / np.arange(1, len(vocab) + 1)
    docs = [(int(i), " ".join(rng.choice(vocab, int(rng.integers(1, 40)), p=p / p.sum()))) for i in rng.permutation(n)]
    docs += docs[:20]  # repeated rows
    docs += [(None, docs[0][1]), (None, docs[0][1]), (9001, None), (9002, ""), (9003, ".,;!"), (9004, "W1-w2_w3 " * 3000)]
    items = [(i, " ".join(rng.choice(vocab, 6, p=p / p.sum()))) for i in range(12)] + [(90, "W1 w1, w1;w2"), (91, None), (92, ""), (93, "unheard words"), (94, "naïve ÜNDER Ünder"), (94, "naïve ÜNDER Ünder")]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs, items = corpus(seed)
    assert rows(ls.rank(*frames(spark, docs, items))) == brute(docs, items)


def test_small_rounds_and_shards(spark, monkeypatch):
    docs, items = corpus(3)
    assert rows(ls.rank(*frames(spark, docs, items), k=3, max_query_terms=15)) == brute(docs, items, 3)


def test_edges(spark):
    docs, items = corpus(4, 20)
    assert rows(ls.rank(*frames(spark, [], items))) == []
    assert rows(ls.rank(*frames(spark, docs, []))) == []
    assert rows(ls.rank(*frames(spark, [(1, None), (2, "")], items))) == []
    assert rows(ls.rank(*frames(spark, [(2, "same text"), (1, "same text"), (3, "other")], [(1, "text")]))) == brute([(2, "same text"), (1, "same text"), (3, "other")], [(1, "text")])


def shard_of(n_docs, n_terms, seed):
    rng = np.random.default_rng(seed)
    lists = [np.sort(rng.choice(n_terms, int(rng.integers(1, n_terms)), replace=False)) for _ in range(n_docs)]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    tf = rng.integers(1, 9, starts[-1])
    n = np.add.reduceat(tf, starts[:-1]) + rng.integers(0, 50, n_docs)
    return ls.Shard.of(rng.permutation(n_docs), np.zeros(n_docs, bool), n, starts, np.concatenate(lists), tf, n_docs, int(n.sum()), n_terms)


def test_threshold_stops_early_and_is_exact():
    shard, coef = shard_of(5000, 30, 5), np.zeros(30, "int64")
    coef[[3, 7]] = 900, 400
    (score, _, ids), read = ls.search(shard, np.array([3, 7]), coef, 10)
    everything = shard.scores(np.arange(5000), coef)
    order = np.lexsort((shard.ids, -everything))[:10]
    assert score.tolist() == everything[order].tolist() and ids.tolist() == shard.ids[order].tolist()
    in_lists = int((shard.list_starts[[4, 8]] - shard.list_starts[[3, 7]]).sum())
    assert read < in_lists / 3


def test_a_tie_at_the_threshold_goes_on():
    """Documents with equal scores beyond the first read: the smallest doc_ids win, so equality must not stop the search."""
    n = 500
    shard = ls.Shard.of(np.arange(n)[::-1].copy(), np.zeros(n, bool), np.ones(n, "int64"), np.arange(n + 1), np.zeros(n, "int64"), np.ones(n, "int64"), n, n, 1)
    (_, _, ids), read = ls.search(shard, np.array([0]), np.array([5]), 10)
    assert ids.tolist() == list(range(10)) and read == n


def test_query_equals_sql(spark):
    same(ls.op11_lexical_search(spark, SF), ls.ORACLE)
