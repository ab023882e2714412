import hashlib
import random
import re

from conftest import same

from barwright.llm import decontaminate as m

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {ord(a): b for a, b in zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}


def words(t):
    return WORD.findall((t or "").translate(LOW))


def brute(docs, items, width=10):
    wins = [(i, w[k : k + width]) for i, t in items if (w := words(t)) for k in range(max(len(w) - width, 0) + 1)]
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, g in wins:
            for p in range(len(w) - len(g) + 1):
                if w[p : p + len(g)] == g:
                    hit |= {*range(p, p + len(g))}
                    ids.add(i)
        ids = ",".join(sorted(map(str, ids)))
        out.append((d, len(w), len(hit), ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_oracle(spark):
    same(m.op7_decontaminate(spark, "/root/testdata/sf0.001"), m.ORACLE)


def case(seed):
    r = random.Random(seed)
    v = ["a", "b", "C", "d", "É", "é", "x1", "zz"]
    items = [(i, " ".join(r.choices(v, k=r.choice([0, 1, 2, 5, 10, 12, 30])))) for i in range(12)] + [(20, None), (21, "--"), (22, "a b c d a b c d a b c d a b"), (22, "b"), (23, "a b c d a b c d a b c d a b")]
    docs = [(i, r.choice([" ", ", ", "\n"]).join(r.choices(v, k=r.randint(0, 60)))) for i in range(60)]
    docs += [(100 + i, "zz " + (t or "") + " é-q") for i, t in items] + [(7, "a b c d a b c d a b c d a b"), (7, "a b c d a b c d a b c d a b"), (None, "b"), (300, None), (301, ""), (302, "a-b-c-d " * 20_000)]
    return docs, items


def test_brute_force(spark):
    for seed in (1, 2):
        docs, items = case(seed)
        d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, text string, words string, tag int")
        b = spark.createDataFrame([(*x, "q") for x in items], "item_id long, text string, window string")
        got = m.contamination(d, b)
        small = [x for x in docs if x[0] != 302]
        assert sorted((tuple(r) for r in got.where("doc_id is null or doc_id <> 302").collect()), key=repr) == brute(small, items)
        assert got.where("doc_id = 302").first()["n_words"] == 80_000


def test_joins_by_shuffle(spark, monkeypatch):
    """Beyond the limits of the broadcasts the rows are the same, and the documents are read once."""
    docs, items = case(3)
    docs, made, calls = docs[:-1], m.index, []
    monkeypatch.setattr(m, "MAX_BROADCAST", 0)
    monkeypatch.setattr(m, "MAX_BROADCAST_ITEMS", 0)
    monkeypatch.setattr(m, "index", lambda *a: calls.append(a) or made(*a))
    got = m.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items) and len(calls) == 1


def test_postings(spark):
    """Positions of the terms that windows use, and one row a document with a null term."""
    d = spark.createDataFrame([(7, ["a", "b", "a", "b", "c"]), (8, []), (9, ["a", "b"])], "tag long, words array<string>")
    terms = spark.createDataFrame([(["a", "b"],)], "words array<string>").select(m.F.xxhash64(m.F.get("words", m.F.lit(0)), m.F.get("words", m.F.lit(1))).alias("term"))
    got = sorted((r.tag, r.term is not None, r.pos) for r in m.index(d, terms, True, False).collect() if r.term is not None or r.tag == 8)
    assert got == [(7, True, 0), (7, True, 2), (8, False, None), (9, True, 0)]


def brute_near(docs, items, width, slop):
    out = set()
    counts = {}
    for _, t in docs:
        for w in words(t):
            counts[w] = counts.get(w, 0) + 1
    for d, t in docs:
        w = words(t)
        for i, it in items:
            iw = words(it)
            for k in range(max(len(iw) - width, 0) + 1) if iw else ():
                g = iw[k : k + width]
                if all(x in counts for x in g):
                    by = min(range(len(g)), key=lambda o: (counts[g[o]], o))
                    for p in range(len(w)):
                        if w[p] == g[by]:
                            low = max(p - by - slop, 0)
                            high = low + len(g) + 2 * slop
                            if set(g) <= set(w[low:high]):
                                out.add((d, low, min(high, len(w)), i))
    return out


def test_proximity_against_brute_force(spark):
    for seed in (5, 6):
        docs, items = case(seed)
        docs = [x for x in docs if x[0] not in (302, None)]
        got = m.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), width=6, slop=2)
        assert {(r.doc_id, r.start, r.stop, r.item_id) for r in got.collect()} == brute_near(docs, items, 6, 2)


def test_empty(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert m.contamination(d.limit(0), b).count() == 0
    assert [tuple(r)[:4] for r in m.contamination(d, b.limit(0)).collect()] == [(1, 2, 0, 0)]
    assert m.matches(d, b.limit(0)).count() == 0


def test_matches(spark):
    d = spark.createDataFrame([(1, "q one two three four r"), (2, "two x one three four"), (3, "one far far far far far far two three four")], "doc_id long, text string")
    b = spark.createDataFrame([(5, "one two three four")], "item_id long, text string")
    assert [(r.doc_id, r.start, r.stop, r.item_id) for r in m.matches(d, b).collect()] == [(1, 1, 5, 5)]
    assert sorted({r.doc_id for r in m.matches(d, b, slop=2).collect()}) == [1, 2]


def test_keep_clean(spark):
    docs, items = case(4)
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, text string, words string, hit_id int")
    out = m.keep_clean(d, spark.createDataFrame(items, "item_id long, text string"))
    dirty = {i for i, *_, hit in brute([x for x in docs if x[0] not in (None, 302)], items) if hit}
    kept = [r.doc_id for r in out.collect()]
    assert out.columns == d.columns
    assert sorted(x for x in kept if x not in (None, 302)) == sorted(i for i, _ in docs if i not in dirty and i not in (None, 302))
    assert m.keep_clean(d, spark.createDataFrame([], "item_id long, text string")).count() == len(docs)
