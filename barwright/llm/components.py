"""Connected components of a table of links, by joins: union-find whose finds are pointer jumps over the whole forest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, store

#: Links to a file of the tables between rounds.
FILE_LINKS = 100_000


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to (node, root) for every node with a link to another one; root is the least node of its component.

    Each round points every node to the least node within two links, jumps pointers until all point to roots, and relabels
    the links by roots. At least half of the nodes that still have links cease to be roots in a round.
    """
    links = store(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    forests = []
    while n := links.count():
        files = -(-n // FILE_LINKS)
        both = links.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("to")))
        near = both.groupBy("node").agg(F.min("to").alias("to")).select(F.col("node").alias("n1"), F.least("node", "to").alias("l1"))
        near = store(near.coalesce(files), "near")  # so that the join deals both sides anew, and a hub's links can be split
        hooked = both.join(near, F.col("to") == F.col("n1")).groupBy("node").agg(F.min("l1").alias("l1")).select("node", F.least("node", "l1").alias("root"))
        roots = store(hooked.coalesce(files), "hooked")
        while True:
            up = lambda i, t: t.select(F.col("node").alias(f"n{i}"), F.col("root").alias(f"r{i}"))
            jumped = roots.join(up(2, roots), F.col("root") == F.col("n2")).join(up(3, roots), F.col("r2") == F.col("n3"))
            before, jumped = roots, store(jumped.select("node", F.col("r3").alias("root"), (F.col("r2") != F.col("r3")).alias("moved")).coalesce(files), "jumped")
            discard(before)
            roots = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        discard(near)
        forests.append(roots)
        of = lambda c: roots.select(F.col("node").alias(f"n{c}"), F.col("root").alias(f"r{c}"))  # noqa: E731, B023
        left = links.join(of("a"), F.col("a") == F.col("na")).join(of("b"), F.col("b") == F.col("nb")).where("ra <> rb")
        before, links = links, store(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct().coalesce(files), "links")
        discard(before)
    if not forests:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = forests[0]
    for f in forests[1:]:
        labels = labels.join(f.select(F.col("node").alias("n2"), F.col("root").alias("r2")), F.col("root") == F.col("n2"), "left").select("node", F.coalesce("r2", "root").alias("root"))
    return labels if len(forests) == 1 else store(labels, "labels")
