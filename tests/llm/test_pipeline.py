"""The pipeline's rows against plain Python, stage by stage."""

import re

import pytest
from test_decontaminate import brute as hits
from test_mixing import brute_targets
from test_near_dedup import brute as near

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(stages):
    docs, *kept, last = stages
    assert all(x.columns == docs.columns for x in kept)
    assert last.columns == [*docs.columns, "copies", "taken"]


def test_decisions(spark, stages):
    docs, good, distinct, dissimilar, unseen, mixed = ([tuple(r)[:2] for r in x.select("doc_id", "text", *x.columns[5:]).collect()] for x in stages)
    labels = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect())
    assert {i for i, _ in good} >= {i for i, _ in docs if labels.get(i) == 1} and not {i for i, _ in good} & {i for i, _ in docs if labels.get(i) == 0}
    of = {}
    for i, t in good:
        of.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    assert sorted(i for i, _ in distinct) == sorted(min(x)[1] for x in of.values())
    assert sorted(i for i, _ in dissimilar) == sorted(r[0] for r in near(distinct, 5, 80) if r[3])
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(i for i, _ in unseen) == sorted(r[0] for r in hits(dissimilar, items) if not r[-1])
    assert {i for i, _ in mixed} <= {i for i, _ in unseen}


def test_mix(stages):
    docs = stages[-2].toPandas()
    docs["size"] = docs.text.fillna("").map(lambda t: len(t.encode().split()))
    sizes = docs.groupby("source")["size"].sum().to_dict()
    goal = brute_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))})
    taken = stages[-1].toPandas().groupby("source").taken.sum().to_dict()
    longest = docs.groupby("source")["size"].max().to_dict()
    assert all(abs(taken.get(s, 0) - goal[s]) <= longest[s] for s in goal)


def test_run_equals_stages(spark, stages):
    assert sorted(tuple(r) for r in pipeline.run(spark, SF).collect()) == sorted(tuple(r) for r in stages[-1].collect())


def tables(spark, folder, docs, labels, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_nulls_repeats_and_empty_texts(spark, tmp_path):
    """Nulls in any column, empty and very long texts and repeated rows pass through all stages; each group of copies keeps one."""
    words = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, words, "en", "a", 5), (1, words, "en", "a", 5), (2, words + " ", "en", "a", 5), (3, None, None, None, None), (4, "", "en", None, 0), (None, "other words that are here once and no other place has them", "en", "b", 3)]
    docs += [(5, "leaked " + " ".join(f"b{i}" for i in range(12)), "en", "a", 9), (6, "long " + " ".join(f"w{i}" for i in range(60_000)), "en", "b", 9)]
    folder = tables(spark, tmp_path, docs, [(1, 1, 0), (None, None, None)], [(1, " ".join(f"b{i}" for i in range(12))), (2, None), (3, "")])
    got = pipeline.run(spark, folder).collect()
    ids = sorted((r.doc_id for r in got), key=str)
    assert 5 not in ids and ids.count(1) + ids.count(2) <= 1 and len(ids) == len(set(ids)) and all(r.copies >= 1 and r.taken > 0 for r in got)
    kept = [pipeline.good(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)]
    for _, stage in pipeline.STAGES[1:4]:
        kept.append(stage(spark, kept[-1], folder))
    assert kept[0].count() >= 6 and kept[3].columns == kept[0].columns and kept[3].where("doc_id = 5").count() == 0 and kept[3].where("text = '' or text is null").count() <= 1


def test_empty_tables(spark, tmp_path):
    assert pipeline.run(spark, tables(spark, tmp_path, [], [], [])).count() == 0
