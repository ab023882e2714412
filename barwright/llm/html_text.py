"""Main text of HTML pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering of regions.

The events of html.parser cut a page into lines, one for each block of text. The ratio of a line is its characters outside
links to the tags since the line before, capped at that of prose. Elements and roles of navigation, headers, footers, asides
and forms hold no content. Class names and ids are evidence only: a line of adverts, notices or comments counts against its
neighbourhood, a line with a name that articles use as well (share, related, widget) keeps a quarter of its ratio unless it
is prose. Ratios are smoothed along the page, where nothing stands before and after it, and a line in an article or main
element scores half as much again; the threshold is the one that parts the scores into two clusters best, and half the
largest at most. A region (the article or main element around a line, else its nearest container) is content if lines over
the threshold have half of its characters or more; its lines are kept but for those whose name speaks against them inside an
article, or that stay under the threshold outside of one. So it is the smoothed ratio that decides, with and without
telling tags.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("body section div td th center".split())
#: Elements that hold no part of an article. Those of SOFT end where an article or main element starts inside them.
SOFT = frozenset("nav header form head title script style noscript template button select textarea option iframe svg canvas object menu dialog fieldset".split())
HARD = frozenset("footer aside".split())
ROLES = {"navigation": "soft", "banner": "soft", "search": "soft", "form": "soft", "alert": "soft", "alertdialog": "soft", "dialog": "soft", "menu": "soft", "menubar": "soft", "contentinfo": "hard", "complementary": "hard"}
#: Parts of class names and ids, split at -, _ and changes of case: of what is never an article's text, and of what may be.
NEVER = frozenset("ad ads adv advert adverts adbox adslot adunit sponsor sponsored nav navigation menu menus masthead topbar toolbar alert notice notices popup modal overlay consent gdpr sidebar comment comments commentary disqus footer copyright".split())
MAYBE = frozenset("banner banners promo promotion header search login signup subscribe subscription form share sharing social pagination pager skip related recommended recommendations respond reply replies discussion widget widgets".split())
PREFIXES = ("advert", "cookie", "breadcrumb", "newsletter", "navbar", "comment", "sidebar")
#: Names that hold for an article inside them as well; others end where an article or main element starts.
LASTING = frozenset("sidebar comment comments commentary disqus footer copyright related recommended recommendations respond reply replies discussion widget widgets".split())
NEGATIONS = ("no", "has", "with", "without", "is", "hide")
SIGMA, RADIUS = 1.0, 2
#: A line of more characters to a tag is prose as any other: its length must not raise the threshold over shorter paragraphs.
PROSE = 50.0
#: What a line in an article or main element scores to one elsewhere; a name's quarter; how a line that is never content counts to the page's largest ratio.
WITHIN, DOUBT, AGAINST = 1.5, 0.25, -0.5
#: Characters that a line has at least, a quarter of them in links at most, to be prose whatever an ambiguous name says.
PROSE_LENGTH = 60
#: Lines that begin a page's footer or are the heading of its comments, outside of articles.
_FOOTER = re.compile(r"(?:©|\(c\) *\d{4}|copyright (?:©|\(c\)|\d{4}))", re.IGNORECASE)
_COMMENTS = re.compile(r"(?:\d+ )?(?:reader )?(?:comments?|replies|responses)(?: ?\(\d+\))?:?|leave a (?:comment|reply)|join the discussion", re.IGNORECASE)
_KERNEL = [math.exp(-k * k / (2 * SIGMA * SIGMA)) for k in range(-RADIUS, RADIUS + 1)]
_KERNEL = [w / sum(_KERNEL) for w in _KERNEL]
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")


def _named(names: str) -> tuple[str, bool]:
    """('' | 'maybe' | 'never', whether the name holds for articles inside as well)."""
    found = ""
    for name in names.split():
        parts = [p.lower() for p in _PARTS.split(name) if p]
        if not parts or len(parts) > 1 and parts[0] in NEGATIONS:
            continue
        for p in parts:
            lasting = p in LASTING or p.startswith(("comment", "sidebar"))
            if p in NEVER or p.startswith(PREFIXES):
                return "never", lasting
            if p in MAYBE:
                found = ("maybe", lasting)
    return found or ("", False)


def _kind(tag: str, attrs: list[tuple[str, str | None]]) -> str:
    """'' for what may hold the article, else 'soft' or 'hard'."""
    if tag in SOFT:
        return "soft"
    if tag in HARD:
        return "hard"
    if not attrs or tag in ("html", "body", "main"):
        return ""
    a = {k: v or "" for k, v in attrs}
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return "hard"
    if (role := ROLES.get(a.get("role", "").lower())) and tag not in HEADINGS:
        return role
    if tag == "article":  # only a class of its own, as in comment lists
        return "hard" if any(n.lower() in LASTING for n in f"{a.get('class', '')} {a.get('id', '')}".split()) else ""
    return ""


def _name(tag: str, attrs: list[tuple[str, str | None]]) -> tuple[str, bool]:
    if not attrs or tag in ("html", "body", "main", "article") or tag in HEADINGS or tag in INLINE and tag != "span":
        return "", False
    return _named(" ".join(v or "" for k, v in attrs if k in ("class", "id")))


@dataclass
class Line:
    text: str
    tags: int
    linked: int
    kind: str
    region: int
    sort: str
    name: str = ""

    def plain(self) -> bool:
        """Whether nothing speaks against the line: no name, or prose under an ambiguous one."""
        return not self.name or self.name == "maybe" and len(self.text) >= PROSE_LENGTH and 4 * self.linked <= len(self.text)


class _Lines(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str, int, str, str, bool]] = []  # tag, kind of exclusion or '', region, kind of region, name, whether it lasts
        self.open: dict[str, int] = {}
        self.lines: list[Line] = []
        self.data: list[str] = []
        self.tags = self.linked = 0
        self.muted = [False]  # whether the heading of comments was met in the region, or before it in one around it

    def flush(self) -> None:
        if self.data:
            text = " ".join("".join(self.data).split())
            self.data = []
            if text:
                tag, kind, region, sort, name, _ = self.stack[-1] if self.stack else ("", "", 0, "", "", False)
                if not sort and not kind:
                    if tag in HEADINGS and _COMMENTS.fullmatch(text):
                        self.muted[region] = True
                    if self.muted[region]:
                        kind = "hard"
                self.lines.append(Line(text, self.tags, self.linked, kind, region, sort, name))
                self.tags = self.linked = 0

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()
        self.tags += 1
        if tag in VOID:
            return
        if tag == "a" and self.open.get("a"):
            self.handle_endtag("a")
            self.tags -= 1
        if tag in ("article", "main") and self.stack and self.stack[-1][1] == "soft":
            self.cut(next(i for i, x in enumerate(self.stack) if x[1]))
        _, kind, region, sort, name, lasting = self.stack[-1] if self.stack else ("", "", 0, "", "", False)
        own = _kind(tag, attrs)
        if kind != "hard" and own and not (sort == "article" and tag == "header"):
            kind = "hard" if own == "hard" else "soft"
        if tag in ("article", "main") and not lasting:
            name = ""
        said, lasts = _name(tag, attrs)
        if said and name != "never":
            name, lasting = said, lasting or lasts
        if tag == "article" or tag == "main" and sort != "article" or tag in CONTAINERS and not sort:
            self.muted.append(self.muted[region])
            region, sort = len(self.muted) - 1, tag if tag in ("article", "main") else sort
        self.stack.append((tag, kind, region, sort, name, lasting))
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        self.tags += 1
        if self.open.get(tag):
            at = next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag)
            if tag in INLINE:
                self.open[tag] -= 1
                del self.stack[at]
            else:
                self.cut(at)

    def cut(self, at: int) -> None:
        for x in self.stack[at:]:
            self.open[x[0]] -= 1
        del self.stack[at:]

    def handle_data(self, data):
        self.data.append(data)
        if self.open.get("a"):
            self.linked += len(data)


def smoothed(ratio: list[float]) -> list[float]:
    """Means of the lines around each, weighted by a Gaussian; outside the page there is nothing."""
    padded = [0.0] * RADIUS + ratio + [0.0] * RADIUS
    return [sum(w * x for w, x in zip(_KERNEL, padded[i : i + 2 * RADIUS + 1])) for i in range(len(ratio))]


def threshold(scores: list[float]) -> float:
    """The least score of the upper one of two clusters with the least variance inside them, but half the largest score at most."""
    s = sorted(scores)
    total, below, best, at = sum(s), 0.0, -1.0, s[0]
    for i in range(1, len(s)):
        below += s[i - 1]
        if s[i] > s[i - 1]:
            apart = i * (len(s) - i) * (below / i - (total - below) / (len(s) - i)) ** 2
            if apart > best:
                best, at = apart, s[i]
    return min(at, s[-1] / 2)


def _drop_footer(lines: list[Line], ratio: list[float]) -> None:
    """Mark the lines that begin a page's footer: no prose follows, and they are short or stand in a region without other prose."""
    prose: dict[int, int] = {}
    for x, r in zip(lines, ratio):
        if not x.kind and r >= PROSE / 2 and not _FOOTER.match(x.text):
            prose[x.region] = prose.get(x.region, 0) + 1
    for x, r in zip(reversed(lines), reversed(ratio)):
        if x.kind:
            continue
        if not x.sort and _FOOTER.match(x.text):
            if r < PROSE / 2 or not prose.get(x.region):
                x.kind = "hard"
        elif r >= PROSE / 2:
            return


def main_text(html: str | None) -> str:
    """The article's blocks in page order, white space in a block turned into one space, joined by one space; '' if none."""
    p = _Lines()
    p.feed(html or "")
    p.close()
    p.flush()
    ratio = [min(PROSE, max(0, len(x.text) - x.linked) / max(1, x.tags)) for x in p.lines]
    _drop_footer(p.lines, ratio)
    ratio = [0.0 if x.kind else r for x, r in zip(p.lines, ratio)]
    largest = max((r for x, r in zip(p.lines, ratio) if x.plain()), default=0.0)
    # inside an article such a line goes by itself and need not count against the lines around it
    ratio = [r if x.plain() or x.kind else DOUBT * r if x.name == "maybe" else 0.0 if x.sort else AGAINST * largest for x, r in zip(p.lines, ratio)]
    score = [0.0 if x.kind else max(0.0, s) * (WITHIN if x.sort else 1.0) for x, s in zip(p.lines, smoothed(ratio))]
    if not any(score):
        return ""
    least = threshold([s for x, s in zip(p.lines, score) if not x.kind])
    size: dict[int, list[int]] = {}
    for x, s in zip(p.lines, score):
        if not x.kind and x.plain():
            n = size.setdefault(x.region, [0, 0])
            n[0] += len(x.text)
            n[1] += len(x.text) * (s >= least)
    content = {region for region, (n, over) in size.items() if 2 * over >= n}
    keep = lambda x, s: not x.kind and (x.region in content if x.plain() else not x.sort and s >= least)
    return " ".join(x.text for x, s in zip(p.lines, score) if keep(x, s))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text, the main text of the whole html, and n_chars, its code points.

    Null and empty html, and pages without an article, give an empty text. Repeated rows are rows of their own, and an empty
    table gives no rows. Columns named text or n_chars are replaced.
    """

    @F.pandas_udf("string")
    def text_of(html: pd.Series) -> pd.Series:
        return html.map(main_text)

    out = pages.withColumn("__text", text_of(F.col(html_col)))
    out = out.drop(*[c for c in ("text", "n_chars") if c in pages.columns])
    return out.withColumnRenamed("__text", "text").withColumn("n_chars", F.length("text").cast("long"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES = {"op2_html_text": op2_html_text}
ORACLES: dict[str, str] = {}
