from conftest import same

from barwright.llm import line_dedup as m


def test_oracle(spark):
    same(m.op4_line_dedup(spark, "/root/testdata/sf0.01"), m.ORACLE, "/root/testdata/sf0.01")


def test_cases(spark):
    rows = [(i, "h", f"own {i}\n menu \n\nmenu\nown {i}") for i in range(10)] + [(20, "g", "menu\nx"), (21, None, "menu"), (22, None, None), (23, "g", ""), (24, "h", "own 3"), (25, "h", "long " * 100_000 + "\nmenu")]
    rows += [(26, "r", "twice"), (26, "r", "twice")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id int, source string, text string, n_lines int")
    for limit in (10**6, 0):
        m.MAX_BROADCAST_LINES, old = limit, m.MAX_BROADCAST_LINES
        got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in m.drop_boilerplate(df, max_ratio=0.5).collect()}
        m.MAX_BROADCAST_LINES = old
        assert all(got[i] == (f"own {i}\n\nown {i}", 5, 2) for i in range(10))
        assert got[20] == ("menu\nx", 2, 0) and got[21] == ("menu", 1, 0) and got[22] == got[23] == ("", 0, 0) and got[24] == ("own 3", 1, 0)
        assert got[25] == ("long " * 100_000, 2, 1) and got[26] == ("twice", 1, 0)
    assert m.drop_boilerplate(df.limit(0)).count() == 0
