"""Neighbours against brute force in double precision: recall, order, ties, vectors that take no part."""

import math

import numpy as np
import pytest
from conftest import SF, same
from pyspark.sql import functions as F

from barwright.llm import vector_search as vs

SCHEMA = "vec_id long, embedding array<float>, tag string, score int"


def brute(rows, is_query, k):
    """By rows (vec_id, vector); rows of the commonest length with finite, not all zero components."""
    good = [(n, i, np.array(v, "float64")) for n, (i, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for n, i, q in good:
        if i is not None and is_query(i):
            near = sorted((float(np.sqrt(((q - v) ** 2).sum())), j is None, j or 0) for m, j, v in good if m != n)[:k]
            out += [(i, r, None if none else j, d) for r, (d, none, j) in enumerate(near, 1)]
    return sorted(out, key=repr)


def found(spark, rows, k=10, every=5, **kw):
    df = spark.createDataFrame([(i, v, "t", 3) for i, v in rows], SCHEMA)
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vs.neighbours(df, F.col("vec_id") % every == 0, k, **kw).collect()), key=repr)


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:3] == y[:3] and math.isclose(x[3], y[3], rel_tol=1e-12, abs_tol=1e-12), (x, y)


def vectors(n, dims, seed, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    if clusters:
        x = x * 0.1 + rng.standard_normal((clusters, dims))[rng.integers(0, clusters, n)]
    return [[float(np.float32(c)) for c in v] for v in x]


@pytest.mark.parametrize(("dims", "clusters"), [(64, 0), (20, 12), (3, 0), (1, 0)])
def test_recall(spark, dims, clusters):
    rows = list(enumerate(vectors(1500, dims, 3, clusters)))
    want, got = brute(rows, lambda i: i % 5 == 0, 10), found(spark, rows)
    hit = len({x[::2] for x in want} & {x[::2] for x in got}) / len(want)
    assert len(got) == len(want) and hit >= 0.995


def test_copies_ties_nulls_and_repeats(spark):
    v = vectors(30, 8, 4)
    rows = [(i, v[i % 10]) for i in range(200)]  # copies: ties go to the smaller identifier
    rows += [(5, v[11]), (5, v[11]), (5, v[12]), (None, v[5]), (None, v[20])]
    rows += [(300, None), (305, []), (310, [0.0] * 8), (315, [*v[1][:7], None]), (320, [*v[1][:7], math.inf]), (325, [*v[1][:7], math.nan]), (330, v[1][:7])]
    part = [x for x in rows if x[0] != 330]
    close(found(spark, rows), brute(part, lambda i: i % 5 == 0, 10))


def test_few_rows_and_empty_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, None), (5, [0.0, 0.0])]) == []
    assert found(spark, [(0, [1.0, 2.0])]) == []
    rows = [(0, [1.0, 2.0]), (5, [1.0, 2.5]), (7, [3.0, 2.0])]
    close(found(spark, rows), brute(rows, lambda i: i % 5 == 0, 10))


def test_rounds_give_the_same(spark):
    rows = list(enumerate(vectors(600, 16, 5)))
    close(found(spark, rows, max_query_values=16 * 20), found(spark, rows))


def test_bounds_choose():
    """Of clustered vectors few are measured, whole lists are left out, and yet the nearest are found."""
    x = np.array(vectors(8000, 32, 6, 50))
    coder = vs.Coder.fit(x[:4000], 32)
    own, code, length, agreement = coder.encode(x)
    assert code.shape == (8000, 4) and np.allclose(coder.rotation @ coder.rotation.T, np.eye(32))
    queries = np.arange(0, 8000, 80)
    s = vs.Searcher(coder, queries, x[queries], vs.first_bounds(queries, x[queries], np.arange(2000), x[:2000], 10), 10, vs.EPSILON)
    for at in range(0, 8000, 1000):
        part = slice(at, at + 1000)
        s.take(np.arange(8000)[part], np.zeros(1000, bool), np.arange(8000)[part], x[part], own[part], code[part], length[part], agreement[part])
    exact = np.sort(np.sqrt(((x[queries][:, None] - x) ** 2).sum(2)), axis=1)[:, 1:11]
    assert np.mean(np.isclose(s.distance, exact)) > 0.995
    assert s.measured < 0.02 * len(queries) * len(x)


def test_estimates_lie_within_their_bounds():
    x = np.array(vectors(3000, 64, 7))
    coder = vs.Coder.fit(x[:1000], 64)
    own, code, length, agreement = coder.encode(x)
    q = np.array(vectors(1, 64, 8))[0]
    signs = np.unpackbits(code, axis=1, count=64) * 2.0 - 1
    rest = q - coder.centres[own]
    estimate = (signs * (rest @ coder.rotation.T)).sum(1) / 8 / agreement * length
    true = ((x - coder.centres[own]) * rest).sum(1)
    bound = length * np.sqrt((rest**2).sum(1)) * np.sqrt(1 - agreement**2) / agreement * vs.EPSILON / np.sqrt(63)
    assert np.mean(np.abs(estimate - true) <= bound) > 0.998 and abs(np.mean(estimate - true)) < 0.1


def test_query_equals_sql(spark):
    same(vs.op13_vector_search(spark, SF), vs.ORACLE)
