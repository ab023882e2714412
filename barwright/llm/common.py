"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A Bloom filter that travels to the executors has at most so many bits (16 MB), whatever the input.
FILTER_BITS = 1 << 27


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="barwright-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, by: list[str] | None = None, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder, in folders by the columns by, and read it back: later steps start from files that outlive executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**options).partitionBy(by or []).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table from store() that no later step reads."""
    spark = df.sparkSession
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Mark df for broadcast if its counted rows are within the limit; otherwise it joins by shuffle."""
    return F.broadcast(df) if rows <= limit else df


#: Parts that the rows of a hot group are dealt to where groups are joined by shuffle.
SALTS = 32


def join_groups(rows: DataFrame, groups: DataFrame, n: int, limit: int, pairs: list[tuple[str, str]], row: Column, how: str = "inner") -> DataFrame:
    """rows with the columns of groups where each pair (column of rows, column of groups) is equal, nulls too.

    n groups within the limit are broadcast. More are joined by shuffle, each SALTS times, and the rows of a group are dealt
    to SALTS parts by row, a hash of theirs, so that a hot group isn't one task's.
    """
    on = lambda a, b: [a[x].eqNullSafe(b[y]) for x, y in pairs]
    if n <= limit:
        right = F.broadcast(groups)
        return rows.join(right, on(rows, right), how)
    left = rows.withColumn("__part", F.pmod(row, F.lit(SALTS)))
    right = groups.withColumn("__of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*on(left, right), left["__part"] == right["__of"]], how).drop("__part", "__of")


def bloom(keys: DataFrame, key: Column, n: int) -> Callable[[Column], Column]:
    """A filter for hashes (long): true for all n keys, false for nearly all others. Its bits are gathered by word, FILTER_BITS at most."""
    bits = min(FILTER_BITS, 1 << max(12, (16 * n).bit_length()))
    at = lambda k: [F.pmod(F.xxhash64(F.lit(i), k), F.lit(bits)) for i in (1, 2, 3)]
    words = keys.select(F.explode(F.array(*at(key))).alias("bit")).groupBy(F.expr("cast(bit div 64 as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask")).toPandas()
    bitmap = np.zeros(bits // 64, "int64")
    bitmap[words["word"].to_numpy("int64")] = words["mask"].to_numpy("int64")
    sent = keys.sparkSession.sparkContext.broadcast(bitmap.view("uint64"))

    @F.pandas_udf("boolean")
    def may_hit(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        hit = np.ones(len(a), bool)
        for s in (a, b, c):
            x = s.to_numpy("int64")
            hit &= (sent.value[x >> 6] >> (x & 63).astype("uint64") & np.uint64(1)).astype(bool)
        return pd.Series(hit)

    return lambda k: may_hit(*at(k))


def keep_rows(docs: DataFrame, kept: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of docs whose keys (name: expression on docs) are among the rows of kept, with docs' own columns.

    kept has the columns of keys, and copies: how many rows of docs have these keys. Of rows that repeat, one stays.
    """
    tagged = docs.withColumns(keys)
    match = lambda other: [tagged[k].eqNullSafe(other[f"{k}_"]) for k in keys]
    right = kept.select(*[F.col(k).alias(f"{k}_") for k in keys], "copies")
    once = right.where("copies = 1")
    out = tagged.join(once, match(once), "left_semi")
    more = right.where("copies > 1")
    if not more.isEmpty():
        out = out.unionByName(tagged.join(more, match(more), "left_semi").dropDuplicates(list(keys)))
    return out.drop(*keys)


def without_space(text: Column) -> Column:
    """The text (null: empty) without its ASCII white space."""
    out = F.coalesce(text, F.lit(""))
    for c in ASCII_SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, all else as it is; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for a, b in zip(UPPER, LOWER):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
