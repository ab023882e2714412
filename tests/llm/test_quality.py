import numpy as np
import pytest

from barwright.llm import quality as m

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = m.judge(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    good = out[out.quality == 1]
    bad = out[out.quality == 0]
    assert good.__kept.mean() > 0.99 and bad.__kept.mean() < 0.05


def test_posteriors_by_hand(spark, monkeypatch):
    monkeypatch.setattr(m, "train", lambda *a, **k: (None, 0.8))
    monkeypatch.setattr(m, "chance", lambda model, text: text.cast("double"))
    rows = [(h, p, x) for h, p, xs in [("a", "x", [0.9, 0.8, 0.9, 0.7]), ("a", "y", [0.2, 0.3]), ("b", "x", [0.9]), (None, "x", [0.6, 0.5]), ("b", None, [0.4])] for x in xs]
    df = spark.createDataFrame([(i, h, p, str(x)) for i, (h, p, x) in enumerate(rows)], "doc_id int, source string, lang string, text string")
    out = {r.doc_id: r for r in m.judge(df, df).collect()}

    def kappa(groups, mean):
        g = [(x, mu) for x, mu in zip(groups, mean) if len(x) > 1]
        n = sum(len(x) for x, _ in g)
        between = sum(len(x) * (np.mean(x) - mu) ** 2 for x, mu in g) / n
        within = sum(np.mean([p * (1 - p) for p in x]) for x, _ in g) / n
        return float(np.clip(sum(len(x) * mu * (1 - mu) for x, mu in g) / n / max(between - within, 1e-6) - 1, 2, 1e6))

    of = lambda h, p=0: [x for a, b, x in rows if a == h and (p == 0 or b == p)]
    mu = np.mean([x for *_, x in rows])
    hosts = sorted({h for h, *_ in rows}, key=str)
    k1 = kappa([of(h) for h in hosts], [mu] * len(hosts))
    paths = sorted({(h, p) for h, p, _ in rows}, key=str)
    k2 = kappa([of(*x) for x in paths], [(sum(of(h)) + k1 * mu) / (len(of(h)) + k1) for h, _ in paths])
    for i, (h, p, x) in enumerate(rows):
        host = (sum(of(h)) - x + k1 * mu) / (len(of(h)) - 1 + k1)
        path = (sum(of(h, p)) - x + k2 * host) / (len(of(h, p)) - 1 + k2)
        odds = x / (1 - x) / 4 * path / (1 - path)
        assert out[i]["__prior"] == pytest.approx(path) and out[i]["__posterior"] == pytest.approx(odds / (1 + odds))


def test_edges(spark):
    schema = "doc_id int, text string, source string, lang string, n int, s double"
    df = spark.createDataFrame([(1, None, None, None, 0, 0.0), (1, "", "a", None, 0, 0.0), (2, "w " * 300_000, "a", "b", 0, 0.0), (2, "w", "a", "b", 0, 0.0)], schema)
    none = spark.createDataFrame([], "doc_id int, quality int")
    assert m.judge(df, none).count() == 4
    assert m.keep_good(df, none).columns == df.columns
    assert m.judge(df.limit(0), none).count() == 0
    one = spark.createDataFrame([(2, 1), (2, None)], "doc_id int, quality int")
    assert m.judge(df, one).count() == 4
