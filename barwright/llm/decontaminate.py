"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions alone.

Test items become windows of ten words. The index is one stored table of postings (document, position, term), made in one scan
of the documents and lying where the documents lie, so that the list of a frequent term is spread over all tasks; it has the
terms that windows use and no others. For phrases a term is a pair of neighbouring words (or a word, for items of one word),
for proximity a word. A window's terms are ranked by the length of their lists. The list of the rarest, moved back by its
offset in the window, names the places where the window may start; the list of the second rarest, moved likewise, is
intersected with these, then those of all others. A window with a term that no document has is not looked up. Terms are known
by 64-bit hashes; a phrase of ten words is a match of nine lists. No text is read after the postings are stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, small, store, table

#: Terms, windows and documents with candidates that are broadcast (some 50 MB at most); more are joined by shuffle.
MAX_BROADCAST = 1_000_000
#: Rows of (window, item) that are broadcast; more are joined by shuffle.
MAX_BROADCAST_ITEMS = 200_000


def words_of(text: Column) -> Column:
    """A-Z lower-cased, then the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+; null has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def windows_of(items: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = 10) -> tuple[DataFrame, DataFrame]:
    """(windows: window, words; owners: window, item_id), stored. An item of fewer words, but not none, is one window."""
    w = items.select(F.col(item_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).where("size(words) > 0")
    last = F.greatest(F.size("words") - width, F.lit(0))
    w = w.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("at")).select("item_id", F.slice("words", F.col("at") + 1, F.lit(width)).alias("words"))
    w = w.withColumn("window", F.md5(F.concat_ws(" ", "words")))
    return store(w.groupBy("window").agg(F.first("words").alias("words")), "decon-windows"), store(w.select("window", "item_id").distinct(), "decon-owners")


def _terms(windows: DataFrame, pairs: bool) -> DataFrame:
    """Each window's terms: window, size (words), offset, term. Without pairs a repeated word counts at its first place."""
    t = windows.select("window", F.size("words").alias("size"), "words", F.posexplode("words").alias("offset", "word"))
    if not pairs:
        return t.groupBy("window", "size", F.xxhash64("word").alias("term")).agg(F.min("offset").alias("offset")).select("window", "size", "offset", "term")
    after = F.get("words", F.col("offset") + 1)
    return t.where(after.isNotNull() | (F.col("size") == 1)).select("window", "size", "offset", F.when(after.isNull(), F.xxhash64("word")).otherwise(F.xxhash64("word", after)).alias("term"))


def index(docs: DataFrame, terms: DataFrame, pairs: bool, singles: bool) -> DataFrame:
    """The postings of terms (term) in docs (tag, words and more), stored: docs' other columns, n_words, pos, term.

    Every document has a row with a null term besides, so that the table also lists the documents.
    """
    keep = [F.col(c) for c in docs.columns if c != "words"] + [F.size("words").cast("long").alias("n_words")]
    p = docs.select(*keep, "words", F.posexplode_outer("words").alias("pos", "word"))
    after = F.get("words", F.col("pos") + 1)
    word = F.when(F.col("word").isNotNull(), F.xxhash64("word"))
    pair = F.when(after.isNotNull(), F.xxhash64("word", after))
    names = [*(c for c in docs.columns if c != "words"), "n_words"]
    own = F.lit(0)
    if pairs and singles:
        p = p.select(*names, "pos", F.posexplode(F.array(pair, word)).alias("own", "term"))
        own = F.col("own")
    else:
        p = p.select(*names, "pos", (pair if pairs else word).alias("term"))
    known = small(terms.select(F.col("term").alias("known")).distinct(), terms.count(), MAX_BROADCAST)
    first = (F.coalesce("pos", F.lit(0)) == 0) & (own == 0)
    p = p.join(known, F.col("term") == F.col("known"), "left").where(F.col("known").isNotNull() | first)
    # the first word gives the document's own row, and one more for its posting if it has one
    rows = F.when(first & F.col("known").isNotNull(), F.array(F.lit(None).cast("long"), F.col("known"))).otherwise(F.array("known"))
    return store(p.select(*names, "pos", F.explode(rows).alias("term")), "decon-postings")


def _ranked(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """terms of the windows whose terms all have postings, with rank (1: the shortest list) and the number of their window's terms."""
    n = postings.where("term is not null").groupBy(F.col("term").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("window")
    t = terms.join(n, F.col("term") == F.col("t"), "left").withColumns({"lists": F.count(F.lit(1)).over(of), "there": F.count("n").over(of)}).where("there = lists")
    return store(t.withColumn("rank", F.row_number().over(of.orderBy("n", "offset"))).select("window", "size", "offset", "term", "rank", "lists"), "decon-ranked")


def _intersect(postings: DataFrame, ranked: DataFrame, slop: int) -> DataFrame:
    """(tag, window, size, start, n_words) of the places where every list of a window has its posting, from the rarest list on.

    With slop, start is where the window would stand by its rarest word, and a posting counts up to slop words before and
    after that place.
    """
    lists = postings.where("term is not null").select("tag", "n_words", "pos", "term")
    first = ranked.where("rank = 1").select("window", "size", "lists", F.col("offset").alias("by"), F.col("term").alias("sought"))
    at = lists.join(small(first, first.count(), MAX_BROADCAST), F.col("term") == F.col("sought")).withColumn("start", F.col("pos") - F.col("by"))
    at = at if slop else at.where("start >= 0")
    at = store(at.select("tag", "window", "size", "lists", "start", "n_words").distinct(), "decon-places")
    low = F.greatest(F.col("start") - slop, F.lit(0))
    for ranks, needed in (("rank = 2", F.least(F.col("lists") - 1, F.lit(1))), ("rank > 2", F.greatest(F.col("lists") - 2, F.lit(0)))):
        open_ = at.where(needed > 0)
        if open_.isEmpty():
            continue
        tags = open_.select(F.col("tag").alias("of")).distinct()
        own = lists.join(small(tags, tags.count(), MAX_BROADCAST), F.col("tag") == F.col("of"), "left_semi").select(F.col("tag").alias("t"), F.col("pos").alias("p"), F.col("term").alias("x"))
        other = ranked.where(ranks).select(F.col("window").alias("w"), "offset", "term")
        wanted = open_.join(small(other, other.count(), MAX_BROADCAST), F.col("window") == F.col("w"))
        same = (F.col("tag") == F.col("t")) & (F.col("term") == F.col("x"))
        if slop:
            found = wanted.join(own, same & (F.col("p") >= low) & (F.col("p") < low + F.col("size") + 2 * slop), "left_semi")
        else:
            found = wanted.join(own, same & (F.col("p") == F.col("start") + F.col("offset")), "left_semi")
        found = found.groupBy("tag", "window", "size", "lists", "start", "n_words").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == needed).drop("k")
        at = store(found.unionByName(at.where(needed == 0)), "decon-places")
    return at.select("tag", "window", "size", "start", "n_words")


def _search(docs: DataFrame, windows: DataFrame, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """(postings, places) of the windows in docs (words and more), which get a tag."""
    pairs = slop == 0
    terms = store(_terms(windows, pairs), "decon-terms")
    singles = pairs and not windows.where("size(words) = 1").isEmpty()
    postings = index(docs.withColumn("tag", F.monotonically_increasing_id()), terms, pairs, singles)
    return postings, _intersect(postings, _ranked(terms, postings), slop)


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, slop: int = 0) -> DataFrame:
    """Phrase matches (slop 0) or proximity matches: doc_id, start, stop, window, item_id, in words of the document, stop excluded.

    A proximity match has all words of a window, in any order, within slop words before and after the place where the
    window would stand, judged from its rarest word. Null or empty texts and empty tables give no rows; repeated rows give
    rows of their own.
    """
    windows, owners = windows_of(items, item_col, item_text_col, width)
    postings, places = _search(docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words")), windows, slop)
    ids = postings.where("term is null").select(F.col("tag").alias("of"), "doc_id")
    low = F.greatest(F.col("start") - slop, F.lit(0))
    stop = F.least(low + F.col("size") + 2 * slop, F.col("n_words")).cast("int")
    found = places.select("tag", low.alias("start"), stop.alias("stop"), "window").join(ids, F.col("tag") == F.col("of"))
    return found.join(small(owners, owners.count(), MAX_BROADCAST_ITEMS), "window").select("doc_id", "start", "stop", "window", "item_id")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null or empty text has no words and is clean; items without words are ignored; repeated rows are rows of their own.
    Other columns are ignored, whatever their names.
    """
    windows, owners = windows_of(items, item_col, item_text_col, width)
    postings, places = _search(docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words")), windows)
    span = F.struct("start", (F.col("start") + F.col("size")).alias("stop"))
    spans = places.groupBy(F.col("tag").alias("of")).agg(F.array_sort(F.collect_set(span)).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("stop"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["stop"], s["stop"]).alias("stop"), (a["n"] + F.greatest(s["stop"] - F.greatest(a["stop"], s["start"]), F.lit(0))).cast("long").alias("n")),
        lambda a: a["n"],
    )
    named = places.select("tag", "window").distinct().join(small(owners, owners.count(), MAX_BROADCAST_ITEMS), "window")
    named = named.groupBy(F.col("tag").alias("by")).agg(F.collect_set("item_id").alias("items"))
    named = named.select("by", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",").cast("binary"), 256).alias("items_sha256"))
    hits = store(spans.select("of", covered.alias("n_hit")).join(named, F.col("of") == F.col("by"), "left").drop("by"), "decon-hits")
    rows = postings.where("term is null").select("tag", "doc_id", "n_words")
    out = rows.join(small(hits, hits.count(), MAX_BROADCAST_ITEMS), F.col("tag") == F.col("of"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10) -> DataFrame:
    """The rows of docs in which no window of any item occurs, with docs' own columns.

    Null and empty texts stay; repeated rows stay or go together; without items all rows stay; an empty table gives no rows.
    """
    windows, _ = windows_of(items, item_col, item_text_col, width)
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    postings, places = _search(docs.select(F.col(id_col).alias("hit_id"), row.alias("hit_row"), words_of(F.col(text_col)).alias("words")), windows)
    dirty = places.select(F.col("tag").alias("of")).distinct()
    hits = postings.where("term is null").join(small(dirty, dirty.count(), MAX_BROADCAST), F.col("tag") == F.col("of"), "left_semi").select("hit_id", "hit_row").distinct()
    hits = store(hits, "decon-dirty")
    hits = small(hits.toDF("__hit_id", "__hit_row"), hits.count(), MAX_BROADCAST_ITEMS)
    return docs.join(hits, F.col(id_col).eqNullSafe(F.col("__hit_id")) & (row == F.col("__hit_row")), "left_anti")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
     b AS (SELECT item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
     bw AS (SELECT item_id, unnest(range(greatest(len(w) - 10, 0) + 1)) AS i, w FROM b WHERE len(w) > 0),
     win AS (SELECT DISTINCT item_id, w[i + 1:i + 10] AS g FROM bw),
     sizes AS (SELECT DISTINCT len(g) AS n FROM win),
     dp AS (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS p FROM d, sizes WHERE len(w) >= n),
     hit AS (SELECT doc_id, p, n, item_id FROM (SELECT doc_id, p, n, w[p + 1:p + n] AS g FROM dp) JOIN win USING (g)),
     pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
     its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLES = {"op7_decontaminate": ORACLE}
