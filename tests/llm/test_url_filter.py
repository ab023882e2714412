from conftest import same

from barwright.llm import url_filter as m

RULES = [("block", "example.com", ""), ("allow", "a.example.com", "/x"), ("block", "a.example.com", "/x/y/"), ("allow", "example.org", "/"), ("block", "example.org", "/")]


def test_oracle(spark):
    same(m.op6_url_filter(spark, "/root/testdata/sf0.01"), m.ORACLE, "/root/testdata/sf0.01")


def brute(rules, host, path):
    fits = [(len(h.split(".")), len(p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else None


def test_trie_against_all_rules():
    import itertools
    import random

    r = random.Random(7)
    rules = [(v, h, p) for v, h, p in itertools.product(("allow", "block"), ("com", "b.com", "a.b.com"), ("", "/", "/x", "/x/", "/x/y", "/x/yy/z")) if r.random() < 0.67]
    t = m.UrlTrie(rules)
    for host in ("com", "b.com", "xb.com", "a.b.com", "q.a.b.com", "", ".com", "com."):
        for path in ("", "/", "/x", "/xx", "/x/", "/x/y", "/x/yyy", "/x/yy/z", "//", "/x//y"):
            assert t.match(host, path) == brute(rules, host, path), (host, path)


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.com", "http://a.example.com/x1?q", "http://a.example.com/x/y/z#f", "HTTP://b.com://c.net/d", "http://example.org/?u=http://x.com/", "x\n://a.com/b"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id int, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in m.judge(df, RULES).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"),
        3: ("a.example.com", "", "example.com", "block"), 4: ("a.example.com", "/x1", "a.example.com/x", "allow"),
        5: ("a.example.com", "/x/y/z", "a.example.com/x/y/", "block"), 6: ("b.com:", "//c.net/d", None, "allow"),
        7: ("example.org", "/", "example.org/", "block"), 8: ("a.com", "/b", None, "allow"),
    }


def test_empty(spark):
    assert m.judge(spark.createDataFrame([], "url string"), RULES).count() == 0


def test_repeats_long_urls_and_no_rules(spark):
    long = "http://" + "a." * 20_000 + "example.com/x/" + "s/" * 50_000
    df = spark.createDataFrame([(1, long, "v"), (1, long, "v"), (2, "http://example.org/", "v")], "page_id int, url string, verdict string")
    got = m.judge(df, RULES).orderBy("page_id").collect()
    assert len(got) == 3 and got[0] == got[1] and got[0].host.endswith(".a.example.com") and len(got[0].path) == 100_003 and got[0].rule is not None
    assert {(r.rule, r.verdict) for r in m.judge(df, [], default="block").collect()} == {(None, "block")}
