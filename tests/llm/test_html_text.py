import re

from barwright.llm import html_text as m


def article_of(html):
    a = html[html.index("<article>") + 9 : html.rindex("</article>")]
    return " ".join(re.sub(r"</?(p|h1|br)[^>]*>", " ", a).replace("<b>", "").replace("</b>", "").split())


def test_pages(spark):
    import html

    rows = m.op2_html_text(spark, "/root/testdata/sf0.01").collect()
    pages = dict(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html").collect())
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == html.unescape(article_of(pages[r.page_id])), r.page_id
        assert r.n_chars == len(r.text)


PARTS = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1><nav><a href="/">Home</a></nav></header><div class="cookie-banner">We use cookies &amp; more of them, please agree.</div>
<aside><p>Aside text that is quite long, longer than most paragraphs here.</p></aside><div id="sidebar-left">Side</div>
<main><article class="post comments-open"><h1>The &eacute; title</h1><p>First  para <b>bo</b>ld&nbsp;x
 y.</p><div class="ad-slot">Buy now</div><p>Ok.<br>Next &lt;line&gt;</p><form><label>Mail</label><input><button>Send</button></form>
<ul><li>one</li><li>two</li></ul><div class="related-posts"><a href="x">Other story</a></div><p class="notice">Notice!</p></article>
<section id="comments"><h3>2 comments</h3><article class="comment"><p>Great post, I liked it very much indeed, thanks.</p></article></section></main>
<footer>&copy; 2020</footer></body>"""


def test_parts():
    assert m.main_text(PARTS) == "The é title First para bold x y. Ok. Next <line> one two"


def test_without_article():
    body = "".join(f"<p>Paragraph {i} has a good many words in it, as articles do.</p><p>Short {i}.</p>" for i in range(6))
    page = f'<body><div class="menu"><a>A</a><a>B</a></div><div id="content">{body}</div><div><a href=1>x</a> <a href=2>y</a><a>z</a></div></body>'
    text = m.main_text(page)
    assert text.startswith("Paragraph 0") and text.endswith("Short 5.") and "Short 3." in text
    assert "A" not in text.split() and not text.endswith("z")


def test_odd_pages():
    assert m.main_text(None) == m.main_text("") == m.main_text("<nav>x</nav>") == ""
    assert m.main_text("<nav><ul><li>menu<article><p>Text one.") == "Text one."
    assert m.main_text('<div class="comments"><article><p>Not this.</p></article></div><article>This</article>') == "This"
    assert m.main_text("<article><p>a<p>b<div>c</article>") == "a b c"
    assert m.main_text("<b>" * 100_000 + "</i>" * 100_000 + "x") == "x"
    assert m.main_text("<article>&#8364; &notanentity; &amp;lt;</article>") == "€ ¬anentity; &lt;"
    assert m.main_text("plain words only") == "plain words only"
    long = "word " * 400_000
    assert m.main_text(f"<article><p>{long}</p></article>") == long.strip()


def test_frame(spark):
    rows = [(1, None, "t"), (2, "<article>a  b</article>", "t"), (2, "<article>a  b</article>", "t"), (3, "", "t")]
    df = spark.createDataFrame(rows, "page_id int, html string, text string")
    assert [(r.page_id, r.text, r.n_chars) for r in m.extract(df).orderBy("page_id").collect()] == [(1, "", 0), (2, "a b", 3), (2, "a b", 3), (3, "", 0)]
    assert m.extract(df.limit(0)).count() == 0


def test_one_long_block_does_not_drop_the_others():
    short = [" ".join(f"s{i}w{k}" for k in range(60)) for i in range(20)]
    long = "word " * 4000
    page = "<body>" + "".join(f"<div><p>{t}</p></div>" for t in [*short[:10], long, *short[10:]]) + "</body>"
    assert m.main_text(page) == " ".join(" ".join([*short[:10], long, *short[10:]]).split())


def bare(page):
    """The page without telling tags and names: all containers are div elements."""
    return re.sub(r"<(/?)(?:article|nav|footer)\b", r"<\1div", page).replace(' class="ad"', ' class="x1"')


def sample(spark):
    return [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]


def test_pages_without_telling_tags_and_names(spark):
    """Ratios alone give the same text as article elements do, but for some pages with an article as short as the advert."""
    pages = sample(spark)
    same = [m.main_text(bare(p)) == m.main_text(p) for p in pages]
    assert sum(same) > 0.93 * len(same)
    assert all(m.main_text(p) in m.main_text(bare(p)) for p in pages)


def test_smoothing_decides(spark, monkeypatch):
    """With the same smoothed ratio for all lines, or with none, pages without telling tags don't come out right."""
    pages = sample(spark)[:60]
    want = [m.main_text(p) for p in pages]
    right = lambda: sum(m.main_text(bare(p)) == w for p, w in zip(pages, want))
    assert right() > 54
    with_article = lambda: sum(m.main_text(p) == w for p, w in zip(pages, want))
    assert with_article() == len(pages)
    for constant in (0.0, 1.0, 50.0):
        monkeypatch.setattr(m, "smoothed", lambda r, c=constant: [c] * len(r))
        assert right() == 0 and with_article() == 0
    sections = "<body><div><a href=1>Home</a></div>" + "".join(f"<div><p>{'word ' * 50}</p></div><div><b>{i}</b></div>" for i in range(8)) + "</body>"
    monkeypatch.setattr(m, "smoothed", lambda r: r)
    rough = m.main_text(sections)
    monkeypatch.undo()
    assert "3" not in rough.split() and m.main_text(sections).split().count("word") == 400 and "3" in m.main_text(sections).split() and "Home" not in m.main_text(sections)


def test_footers_and_comments_without_names():
    prose = "".join(f"<p>{'some words of prose ' * 8}{i}.</p>" for i in range(5))
    page = f"<body><div>{prose}</div><div><h3>2 Comments</h3><div><p>{'I liked this very much ' * 6}</p></div></div><div><p>© 2020 Somebody, who has all of the rights to this page and more.</p></div></body>"
    text = m.main_text(page)
    assert text.endswith("4.") and "liked" not in text and "2020" not in text
    assert "Comments" in m.main_text(f"<article>{prose}<h2>Comments</h2><p>© 1999 is what the old page said.</p></article>")


def test_threshold_parts_two_clusters():
    assert m.threshold([1.0, 2.0, 50.0, 1.5, 49.0]) == 25.0 and m.threshold([1.0, 40.0, 41.0, 45.0]) == 22.5
    assert m.threshold([3.0]) == 1.5 and m.threshold([0.0, 0.0, 10.0, 4.0]) == 5.0


def test_ambiguous_names_do_not_drop_prose():
    prose = "".join(f"<p>{'some words of prose ' * 8}{i}.</p>" for i in range(5))
    line = "The price of a share rose when the search for a reply to the review was over, they said."
    for tag in ("p", "div", "section"):
        for name in ("share-price", "search", "login", "review-form", "widget", "related", "banner-image", "discussion", "reply"):
            assert line in m.main_text(f"<body><article>{prose}<{tag} class='{name}'>{line}</{tag}>{prose}</article></body>"), (tag, name)
        for name in ("ad-slot", "sponsored", "notice", "comment-list", "cookie-bar"):
            for page in (f"<article>{prose}<{tag} class='{name}'>{line}</{tag}>{prose}</article>", f"<div>{prose}<{tag} class='{name}'>{line}</{tag}>{prose}</div>"):
                text = m.main_text(f"<body>{page}</body>")
                assert line not in text and text.count("4.") == 2, (tag, name)
    assert "Other" not in m.main_text(f"<article>{prose}<div class='related'><a href=1>Other story</a> <a href=2>Other news</a></div></article>")


def test_footers_by_place_and_ratio():
    prose = "".join(f"<p>{'some words of prose ' * 8}{i}.</p>" for i in range(5))
    law = "Copyright 2020 was the year in which the law changed for authors, and so did the courts that heard them."
    assert law in m.main_text(f"<div><p>{law}</p>{prose}</div>") and law in m.main_text(f"<div>{prose}<p>{law}</p></div>") and law in m.main_text(f"<div>{prose}<p>{law}</p>{prose}</div>")
    for end in ("<p>© 2020 Somebody</p>", f"<div><p>{law}</p></div>", "<p>(c) 2020 Somebody</p><p>All rights</p>"):
        assert "2020" not in m.main_text(f"<body><div>{prose}</div>{end}</body>")


def test_nested_pages_take_linear_time():
    import time

    page = "<h2>Comments</h2>" + "<div><p>x" * 400_000  # 3.6 MB
    began = time.perf_counter()
    m.main_text(page)
    assert time.perf_counter() - began < 30  # it is some five seconds on a free machine; the climb over all regions took hours
