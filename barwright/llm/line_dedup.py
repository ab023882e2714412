"""Site-relative line frequency: a line in more than a share of its host's pages is boilerplate and goes.

Lines are counted once a page by a 64-bit hash, so that their texts are not shuffled. A host has few boilerplate lines:
each takes a share of its pages, so there are no more than the mean number of lines a page over that share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, small, store, table

#: Boilerplate lines of all hosts that are broadcast; more are joined by shuffle, host by host.
MAX_BROADCAST_LINES = 1_000_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(" \t\r\x0b\x0c")))


def boilerplate(pages: DataFrame, host_col: str, text_col: str, max_ratio: float, min_pages: int) -> DataFrame:
    """(host, line: hash of the trimmed line, pages, ratio) of the lines that go."""
    p = pages.select(F.col(host_col).alias("host"), F.array_distinct(F.transform(F.filter(_lines(F.col(text_col)), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")) != ""), _key)).alias("lines"))
    total = pages.groupBy(F.col(host_col).alias("h")).agg(F.count(F.lit(1)).alias("total"))
    total = store(total, "lines-hosts")
    counts = p.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    counts = counts.join(small(total, total.count(), MAX_BROADCAST_LINES), F.col("host").eqNullSafe(F.col("h"))).withColumn("ratio", F.col("pages") / F.col("total"))
    return counts.where(F.col("ratio") > max_ratio).select("host", "line", "pages", "ratio")


def drop_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = 0.05, min_pages: int = 3) -> DataFrame:
    """pages with the text less its boilerplate lines, n_lines (of the text before) and n_dropped.

    A line is what stands between line feeds, and counts without the white space at its ends; blank lines always stay. A
    page counts each line once. A null host is a host; null text is empty and has no lines; repeated rows are pages of
    their own. A line stays if fewer than min_pages pages have it. Columns named n_lines or n_dropped are replaced.
    """
    found = store(boilerplate(pages, host_col, text_col, max_ratio, min_pages), "lines-boilerplate")
    sets = found.groupBy(F.col("host").alias("__host")).agg(F.collect_set("line").alias("__gone"))
    lines = _lines(F.col(text_col))
    out = pages.drop(*[c for c in ("n_lines", "n_dropped") if c in pages.columns])
    out = join_groups(out, sets, found.count(), MAX_BROADCAST_LINES, [(host_col, "__host")], F.xxhash64(F.col(text_col)), "left")
    left = F.when(F.col("__gone").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains("__gone", _key(x)) | (F.btrim(x, F.lit(" \t\r\x0b\x0c")) == "")))
    out = out.withColumn("__left", left).withColumn("n_lines", F.when(F.coalesce(F.length(text_col), F.lit(0)) == 0, 0).otherwise(F.size(lines)).cast("long"))
    out = out.withColumn("n_dropped", F.when(F.col("n_lines") == 0, 0).otherwise(F.col("n_lines") - F.size("__left")).cast("long"))
    return out.withColumn(text_col, F.array_join("__left", "\n")).drop("__host", "__gone", "__left")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


ORACLE = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
     k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS key FROM l),
     h AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
     g AS (SELECT k.source, key FROM k JOIN h ON k.source IS NOT DISTINCT FROM h.source WHERE key <> ''
           GROUP BY k.source, key, total HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT doc_id)::DOUBLE / total > 0.05),
     m AS (SELECT k.*, g.key IS NOT NULL AS gone FROM k LEFT JOIN g ON k.source IS NOT DISTINCT FROM g.source AND k.key = g.key),
     s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM m GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN coalesce(length(d.text), 0) = 0 THEN 0 ELSE n END AS n_lines, n_dropped, s.text FROM documents d JOIN s USING (doc_id)
"""

QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLES = {"op4_line_dedup": ORACLE}
