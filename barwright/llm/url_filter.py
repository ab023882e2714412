"""URL filter: a trie over reversed host labels and path segments, sent to the executors, longest match first."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A rule list beyond this many entries is refused: the trie is broadcast.
MAX_RULES = 2_000_000


def _segments(path: str) -> list[str]:
    """'/en/x' -> ['/', 'en/', 'x']: each segment keeps its slash, so that a last one without it stands for a prefix."""
    return path.replace("/", "/\0").rstrip("\0").split("\0") if path else []


class UrlTrie:
    """Allow and block entries (host, path), by host labels from the right, then path segments.

    The entry with the longest host wins, then the one with the longest path; of an allow and a block entry for the same
    host and path, block wins. A last path segment without a slash fits every segment that starts with it.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for n, (verdict, host, path) in enumerate(rules):
            if n >= MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules")
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict {verdict!r}")
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(("path",), {})
            *whole, last = _segments(path) or [""]
            for s in whole:
                node = node.setdefault(s, {})
            entry = node.setdefault(("ends",), {})
            if entry.get(last, ("", ""))[1] != "block":
                entry[last] = (host + path, verdict)

    @staticmethod
    def _best(node: dict, segments: list[str]) -> tuple[str, str] | None:
        found = None
        for k in range(len(segments) + 1):
            here = segments[k] if k < len(segments) else ""
            if ends := node.get(("ends",)):
                for cut in range(len(here), -1, -1):
                    if hit := ends.get(here[:cut]):
                        found = hit
                        break
            if k == len(segments) or (node := node.get(here)) is None:
                break
        return found

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest entry that fits, or None."""
        node, found, segments = self.root, None, None
        for label in reversed(host.split(".")):
            if (node := node.get(label)) is None:
                break
            if paths := node.get(("path",)):
                segments = _segments(path) if segments is None else segments
                found = self._best(paths, segments) or found
        return found


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there to ?, # or the end. Both empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(urls: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", default: str = "allow") -> DataFrame:
    """urls with host, path, rule and verdict; without a rule that fits, rule is null and the verdict the default.

    Null, empty and malformed urls have an empty host and path. Urls of any length are read whole, one label and segment
    after another. Repeated rows are judged each by itself and alike. An empty table gives no rows; without rules all get
    the default. Columns of urls named as one of the four are replaced, others stay.
    """
    trie = urls.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def matched(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        t = trie.value
        return pd.DataFrame([t.match(h, p) or (None, default) for h, p in zip(host, path)], columns=["rule", "verdict"])

    host, path = host_and_path(F.col(url_col))
    out = urls.withColumns({"__host": host, "__path": path}).drop(*[c for c in ("host", "path", "rule", "verdict") if c in urls.columns and c != url_col])
    out = out.withColumn("__m", matched("__host", "__path"))
    return out.withColumns({"host": F.col("__host"), "path": F.col("__path"), "rule": F.col("__m.rule"), "verdict": F.col("__m.verdict")}).drop("__host", "__path", "__m")


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     h AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS h0, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
     t AS (SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h),
     v AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                          WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                          WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
                          WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' END AS rule FROM t)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM v
"""

QUERIES = {"op6_url_filter": op6_url_filter}
ORACLES = {"op6_url_filter": ORACLE}
