import random

import pytest

from barwright.llm import mixing as m


def brute_targets(sizes, weights, cap=3):
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        w = sum(weights[s] for s in sizes if s not in full)
        if not w:
            return {s: cap * sizes[s] for s in sizes}
        goal = {s: cap * sizes[s] if s in full else left * weights[s] / w for s in sizes}
        over = {s for s in sizes if s not in full and goal[s] > cap * sizes[s]}
        if not over:
            return goal
        full |= over


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, True) for i, t, s in rows], "doc_id long, text string, source string, size int, decided boolean")


def test_small_sf(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = m.mix(df).toPandas()
    texts = dict(df.select("doc_id", "text").collect())
    assert sorted(out.doc_id) == sorted(texts)
    for r in out.itertuples():
        assert r.size == len(texts[r.doc_id].encode().split())
    sizes = out.groupby("source")["size"].sum().to_dict()
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    goal = brute_targets(sizes, weights)
    for s, g in out.groupby("source"):
        assert g.target.nunique() == 1 and g.target.iloc[0] == pytest.approx(goal[s], rel=1e-9)
        assert (g.source_size == sizes[s]).all()
        assert (g.taken == g.copies * g["size"]).all() and (g.copies <= 3).all()
        assert abs(g.taken.sum() - goal[s]) <= max(0.01 * goal[s], 30)
    again = m.mix(df.repartition(5)).toPandas()
    assert sorted(zip(out.doc_id, out.taken)) == sorted(zip(again.doc_id, again.taken))


def test_cap_reshared(spark):
    r = random.Random(1)
    rows = [(i, "w " * r.randint(1, 40), s) for i, s in enumerate(["a"] * 10 + ["b"] * 500 + [None] * 300 + ["c"] * 4000)]
    out = m.mix(docs_of(spark, rows)).toPandas()
    out["source"] = out.source.fillna("~")
    sizes = out.groupby("source")["size"].sum().to_dict()
    goal = brute_targets(sizes, {"a": 5, "b": 2, "c": 1, "~": 5})
    assert goal["a"] == 3 * sizes["a"]
    for s, g in out.groupby("source"):
        assert g.target.iloc[0] == pytest.approx(goal[s])
        assert abs(g.taken.sum() - goal[s]) <= 40
    assert (out[out.source == "a"].copies == 3).all()
    big = out[out.source == "c"]
    n = big["copies"].sum() if goal["c"] < sizes["c"] else None
    assert n is None or abs(n - len(big) * goal["c"] / sizes["c"]) <= 3


def test_flight_keeps_balance_and_chances():
    dice, hits = random.Random(5), [0.0] * 6
    sizes = [9, 7, 7, 4, 2, 1]
    for _ in range(4000):
        held, p = [], [0.0] * 6
        for i, s in enumerate(sizes):
            held.append([i, s, 0.4])
            if len(held) == 3:
                m._move(held, dice)
                for u in held:
                    p[u[0]] = u[2]
                held = [u for u in held if m.EPS < u[2] < 1 - m.EPS]
        assert abs(sum(p) - 2.4) < 1e-6 and abs(sum(a * b for a, b in zip(p, sizes)) - 12) < 1e-6
        hits = [h + x for h, x in zip(hits, p)]
    assert all(abs(h / 4000 - 0.4) < 0.04 for h in hits)


def test_nulls_empty_repeats(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (3, "x y", None), (None, "q", "b"), (4, "long " * 200_000, "b")]
    out = m.mix(docs_of(spark, rows)).collect()
    assert len(out) == len(rows)
    assert all(r.taken == 0 for r in out if r.doc_id in (1, 2))
    assert m.mix(docs_of(spark, [])).count() == 0
    assert all(r.taken == 0 for r in m.mix(docs_of(spark, [(1, None, None), (2, " ", "s")])).collect())


def test_weights_by_name(spark):
    rows = [(i, "w w", "ab"[i % 2]) for i in range(400)]
    out = m.mix(docs_of(spark, rows), {"a": 3.0, "b": 1.0}).toPandas()
    assert out.groupby("source").taken.sum().to_dict() == {"a": 600, "b": 200}


def test_take(spark):
    r = random.Random(3)
    rows = [(i, "w%d " % i * r.randint(0, 9), s) for i, s in enumerate(["a"] * 40 + ["b"] * 300 + [None] * 30)]
    rows += [rows[2], rows[2], rows[60], (None, "x y", "b"), (None, "x y", "b"), (999, None, "a")]
    df = docs_of(spark, rows)
    made, out = m.mix(df).toPandas(), m.take(df)
    assert out.columns == [*df.columns, "copies", "taken"]
    out = out.toPandas()
    assert (out.copies > 0).all() and out.taken.sum() == made.taken.sum()
    assert sorted(out.doc_id.dropna()) == sorted(made[made.copies > 0].doc_id.dropna().unique())
    assert m.take(df.limit(0)).count() == 0
