import random
import re
from collections import defaultdict

import pytest
from conftest import same

from barwright.llm import exact_dedup as m

SCHEMA = "doc_id long, text string, digest string, kept int"


def brute(rows):
    groups = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        t = t or ""
        groups[t.translate({ord(c): None for c in " \t\n\x0b\x0c\r"})].append((-len(t), d is None, d, i))
    out = []
    for g in groups.values():
        best = min((x[:3] for x in g), key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out += [(rows[x[3]][0], best, len(g)) for x in g]
    return sorted(out, key=repr)


def test_oracle(spark):
    same(m.op8_exact_dedup(spark, "/root/testdata/sf0.01"), m.ORACLE, "/root/testdata/sf0.01")


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_cases(spark, digest_bytes):
    r = random.Random(3)
    rows = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \n"), (7, "x" * 300_000), (7, "x" * 300_000), (8, "ab"), (None, "zz"), (9, "zz"), (None, "q"), (10, "a\u00a0b")]
    rows += [(100 + i, "".join(r.choices("abc ", k=3))) for i in range(300)]
    docs = spark.createDataFrame([(d, t, "clash", 0) for d, t in rows], SCHEMA)
    got = m.decide(docs, digest_bytes=digest_bytes, memtable_rows=50)
    out = got.collect()
    assert sorted([(x.doc_id, x.keep_id, x.group_size) for x in out], key=repr) == brute(rows)
    assert sum(x.kept for x in out) == len({k for _, k, _ in brute(rows)} | {None}) - (None not in {k for _, k, _ in brute(rows)})
    assert all(x.kept is False for x in out if x.doc_id != x.keep_id)


def test_keep_one(spark):
    rows = [(1, "a b"), (2, "ab"), (3, "c"), (3, "c"), (3, "d"), (None, "e"), (None, "e"), (4, None), (5, "")]
    docs = spark.createDataFrame([(d, t, "clash", 0) for d, t in rows], SCHEMA)
    out = m.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(((x.doc_id, x.text) for x in out.collect()), key=repr) == sorted([(1, "a b"), (3, "c"), (3, "d"), (None, "e"), (4, None)], key=repr)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert m.decide(docs).count() == 0
    assert m.keep_one(docs).count() == 0


def test_runs_and_ranges(spark):
    """A run has a digest once, in order; the files of the compacted level have disjoint ranges and add up to all rows."""
    r = random.Random(5)
    docs = spark.createDataFrame([(i, r.choice("abcdefgh") * r.randint(0, 40)) for i in range(3000)], "doc_id long, text string").repartition(3)
    level0 = m.flush_runs(docs, memtable_rows=200)
    rows = level0.where("kind = 1").select("digest", "n", "run", m.F.spark_partition_id().alias("p"), m.F.input_file_name().alias("f")).collect()
    by = defaultdict(list)
    for x in rows:
        by[x.f, x.run].append(bytes(x.digest))
    assert len(by) >= 3 and all(d == sorted(set(d)) for d in by.values()) and sum(x.n for x in rows) == 3000 == level0.where("kind = 0").count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    index = m.compact(level0)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ranges = sorted(tuple(map(bytes, x)) for x in index.groupBy(m.F.input_file_name()).agg(m.F.min("digest"), m.F.max("digest")).select(m.F.col("min(digest)"), m.F.col("max(digest)")).collect())
    assert len(ranges) > 1 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:])) and index.agg(m.F.sum("group_size")).first()[0] == 3000


def test_lookup(spark):
    old = spark.createDataFrame([(1, "a b", "", 0), (2, "c", "", 0), *((100 + i, f"t{i}", "", 0) for i in range(500))], SCHEMA)
    new = spark.createDataFrame([(11, "ab", "", 0), (12, "d", "", 0), (13, "a  b", "", 0)], SCHEMA)
    published, bits = m.publish(m.compact(m.flush_runs(old)), rows_per_part=40)
    assert bits == 4 and published.select("part").distinct().count() == 16
    found = m.lookup(published, bits, new)
    assert sorted(tuple(r) for r in found.collect()) == [(11, 1), (13, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    named = {r.part for r in new.select(m._part(m._digest(new.text, 32), bits)).collect()}
    listed = re.search(r"PartitionFilters: \[part#\d+ IN \(([\d,]+)\)", plan)
    assert {int(x) for x in listed[1].split(",")} == named and len(named) == 2  # of 16 parts those of two digests, and no others
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert m.lookup(published, bits, new.limit(0)).count() == 0
    assert m.lookup(*m.publish(m.compact(m.flush_runs(old.limit(0)))), new).count() == 0
