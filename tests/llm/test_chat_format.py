import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.llm import chat_format as m

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model():
    r = random.Random(2)
    line = lambda n: " ".join(["word"] * r.randint(1, n))
    made = []
    for _ in range(200):
        made.append([(role, "\n".join(line(60 if role == "assistant" else 12) for _ in range(r.randint(1, 5 if role == "assistant" else 2)))) for role in (["system"] if r.random() < 0.3 else []) + ["user", "assistant"] * r.randint(1, 3)])
    return m.fit(made)


def score(model, codes, path):
    s = model.first[path[0]] + model.emit[codes[0]][path[0]]
    for t in range(1, len(codes)):
        s += model.step[path[t - 1]][path[t]] + model.emit[codes[t]][path[t]]
    return s


def codes_of(r, n):
    return np.array([r.randrange(m.CODES) for _ in range(n)])


def test_fitted_chances_add_up(model):
    assert np.exp(model.first[: m.N]).sum() == pytest.approx(1) and np.exp(model.step).sum(1) == pytest.approx(np.ones(2 * m.N))
    assert np.exp(model.emit).sum(0) == pytest.approx(np.ones(2 * m.N))
    assert model.step[1, 2] > model.step[1, 0] and model.step[2, 2 + m.N] > model.step[1, 1 + m.N]  # a user is answered; answers have more lines
    even = m.fit([])
    assert np.ptp(even.first[: m.N]) == 0 and np.ptp(even.emit[:, m.N :]) < 1e-9


def test_viterbi_is_the_best_of_all_paths(model):
    r = random.Random(3)
    for n in (1, 2, 4, 5):
        codes = codes_of(r, n)
        best = max(score(model, codes, p) for p in itertools.product(range(2 * m.N), repeat=n))
        assert abs(score(model, codes, m.viterbi(model, codes)) - best) < 1e-9


def test_chained_segments_equal_one_run(model):
    r = random.Random(4)
    for _ in range(30):
        codes = codes_of(r, 40)
        cuts = [0, *sorted(r.sample(range(1, 40), r.randint(1, 6))), 40]
        parts = [codes[a:b] for a, b in zip(cuts, cuts[1:])]
        ends = m.chain([m.segment_table(model, p) for p in parts])
        joined = np.concatenate([m.viterbi(model, p, *e) for p, e in zip(parts, ends)])
        assert abs(score(model, codes, joined) - score(model, codes, m.viterbi(model, codes))) < 1e-9


def test_markers():
    role = lambda s: m.read_line(s)[0] // 2 // len(m.KINDS)
    for line, want in [("User: hi", 1), ("ASSISTANT: x", 2), ("### Instruction:", 1), ("<|im_start|>system", 0), ("<|assistant|>", 2), ("**Human:** hi", 1), ("[system] be brief", 0), ("- hi", m.BARE), ("Speaker 2: hi", m.BARE), ("userland: x", m.NO_MARK), ("Note: x", m.NO_MARK), ("", m.NO_MARK)]:
        assert role(line) == want, line
    assert m.read_line("Q: why?<|im_end|>", True) == ((1 * len(m.KINDS) + 1) * 2 + 1, "why?")
    assert [m.KINDS[m.read_line("x" * n)[0] // 2 % len(m.KINDS)] for n in (0, 1, 20, 21, 160, 321)] == ["blank", "20", "20", "40", "160", "more"]


def local(model, rows):
    """(conv, ord, line, role, starts, text) and whole turns by one Viterbi run over each conversation."""
    out, whole, alone = [], [], object()
    for conv in dict.fromkeys(x[0] for x in rows):
        own = [x for x in rows if x[0] == conv]
        read = [[m.read_line(line, i == 0) for i, line in enumerate((t or "").split("\n"))] for _, _, t in own]
        states = m.viterbi(model, np.array([c for p in read for c, _ in p]))
        at = 0
        for (_, order, _), p in zip(own, read):
            for i, (_, text) in enumerate(p):
                s = states[at + i]
                if i and s >= m.N:
                    if alone is out[-1]:  # a marker on a line of its own gives no blank line
                        out[-1][-1], alone = text, None
                    else:
                        out[-1][-1] += "\n" + text
                else:
                    out.append([conv if conv is None else str(conv), order, i, m.ROLES[s % m.N], bool(s < m.N), text])
                    alone = out[-1] if s < m.N and not text.strip() and p[i][0] // 2 // len(m.KINDS) != m.NO_MARK else None
            at += len(p)
    for f in out:
        if f[4]:
            whole.append([*f[:4], f[5]])
        else:
            whole[-1][-1] += "\n" + f[5]
    return sorted(map(tuple, out), key=repr), sorted(map(tuple, whole), key=repr)


def test_conversation_over_many_tasks(spark, model):
    r = random.Random(5)
    names = ["User: ", "Assistant: ", "- ", "", "System: ", "A: ", "Speaker 1: "]
    rows = [(7, i, "\n".join(r.choice(names) + r.choice(["why?", "word " * 60, "", "1. item", "some words that are not many"]) for _ in range(r.randint(1, 4)))) for i in range(600)]
    rows += [(8, i, "User: first" if i == 0 else "going on" * 3) for i in range(400)]
    rows += [(c, i, r.choice(names) + "text %d" % i) for c in range(30) for i in range(r.randint(1, 5)) if c not in (7, 8)]
    df = spark.createDataFrame([(*x, "clash", True) for x in rows], "conv_id int, turn int, text string, role string, part boolean").repartition(5)
    some = m.Model(model.first, model.step, model.emit.copy())
    some.emit[1::2, m.N :] += 8.0  # pieces go on with turns, so that turns run over several of them, and over tasks
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    f = m.parse(df, some)
    out = [(x.conv, x.ord, x.line, x.role, x.starts, x.text) for x in f.collect()]
    whole = [(x.conv, x.ord, x.line, x.role, x.text) for x in m.turns(f).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    fragments, turns = local(some, rows)
    assert sorted(out, key=repr) == fragments and sorted(whole, key=repr) == turns
    assert len(turns) < len(fragments) and f.select("part").distinct().count() > 1


def test_edges(spark, model):
    schema = "conv_id int, turn int, text string"
    empty = m.parse(spark.createDataFrame([], schema), model)
    assert empty.count() == 0 and m.turns(empty).count() == 0
    assert np.ptp(m.train(spark.createDataFrame([], schema + ", role string")).first[: m.N]) == 0
    rows = [(None, None, None), (None, 0, "User: a"), (1, 0, ""), (2, 0, "User: a"), (2, 0, "User: a"), (3, None, "w " * 200_000), (4, 1, "Bot: b\r\nc")]
    f = m.parse(spark.createDataFrame(rows, schema), model)
    out = f.orderBy("conv", "ord", "seq", "line").collect()
    assert sum(x.conv is None for x in out) == 2 and [x.rendered for x in out if x.conv == "2"] == ["<|user|>\na\n"] * 2
    assert [len(x.text) for x in out if x.conv == "3"] == [400_000]
    t = m.turns(f).collect()
    assert [x.rendered for x in t if x.conv == "4"] == ["<|assistant|>\nb\nc\n"] and len([x for x in t if x.conv == "2"]) == 2


def test_roles_of_held_out_conversations(spark):
    """Markers aside, the roles of conversations that the model wasn't fitted on: named, bare and no markers."""
    given = spark.read.parquet(f"{SF}/conversations.parquet")
    model = m.train(given.where("conv_id % 5 <> 0"))
    new = given.where("conv_id % 5 = 0")
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(m.STYLES))).alias("style")
    right = {}
    for name, text in (("styles", m.transcripts(new)), ("none", new), ("dashes", new.withColumn("text", F.concat(F.lit("- "), "text")))):
        out = m.turns(m.parse(text, model)).select(F.col("conv").cast("long").alias("conv_id"), F.col("ord").alias("turn"), F.col("role").alias("found"), "line")
        both = new.select("conv_id", "turn", "role", style).join(out.where("line = 0").drop("line"), ["conv_id", "turn"], "left").toPandas()
        right[name] = both
        if name != "styles":
            assert out.count() < 1.02 * len(both)
    s = right["styles"]
    named = s[s["style"] < len(m.STYLES) - 2]
    assert (named["role"] == named["found"]).mean() > 0.995
    rates = {k: (v["role"] == v["found"]).mean() for k, v in right.items()}
    print("\nroles", rates)
    assert rates["none"] > 0.85 and rates["dashes"] > 0.85
