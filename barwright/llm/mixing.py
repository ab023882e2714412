"""Mixing sources to target weights by balanced sampling (the cube method).

Every document is taken floor(e) times and once more with probability e - floor(e), where e is the target of its source over
the source's size. Which documents are taken once more is drawn by the flight phase of the cube method: their probabilities
move inside the null space of the constraints (tokens, documents) until they are 0 or 1. Rows fly in blocks of a source;
the one or two that each block leaves undecided fly again with those of other blocks, level by level, until every source
has one block. That block holds back LANDING documents, spread over its sizes; with the one or two left by its flight they
are the landing problem of the source, solved by going through all choices.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, store, table

#: Rows of a block of the flight phase.
BLOCK_ROWS = 1024
#: Documents of a source that are held back from its last flight.
LANDING = 12
#: The table of sources is broadcast up to so many rows, and joined by shuffle beyond.
MAX_BROADCAST_SOURCES = 100_000
EPS = 1e-9


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null: 0."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.array_remove(parts, "")).cast("long")


def by_rank(weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> Callable[[DataFrame], DataFrame]:
    """Weights that repeat over the sources in code point order, null last."""

    def weigh(sources: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # one row a source
        return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank - 1, F.lit(len(weights))) + 1))

    return weigh


def targets(sources: DataFrame, cap: float = 3.0) -> DataFrame:
    """Adds target to (source, source_size, weight): shares of the sum of all sizes by weight, at most cap times source_size.

    What a source can't take is shared among the rest by weight until none is above. A source is at its cap once the level,
    target over weight, exceeds cap * source_size / weight, so the level is all that goes from round to round.
    """
    most = F.col("source_size") * cap
    total = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total[0]:
        return sources.withColumn("target", F.lit(0.0))
    level, held = total[0] / total[1], -1
    while True:
        full = most < F.col("weight") * level
        n, taken, weight = sources.agg(F.count_if(full), F.sum(F.when(full, most).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == held or not weight:
            return sources.withColumn("target", F.least(most.cast("double"), (F.col("weight") * level).cast("double")))
        held, level = n, (total[0] - taken) / weight


def _move(units: list[list], dice: random.Random) -> None:
    """A step of the flight phase for three units [row, size, p], in place: along the null vector of ((sizes), (1, 1, 1))."""
    (_, a, p), (_, b, q), (_, c, r) = units
    u = (b - c, c - a, a - b)
    if not any(u):
        u = (1, -1, 0)
    up = down = float("inf")
    for x, v in zip((p, q, r), u):
        if v > 0:
            up, down = min(up, (1 - x) / v), min(down, x / v)
        elif v < 0:
            up, down = min(up, -x / v), min(down, (x - 1) / v)
    step = up if dice.random() * (up + down) < down else -down
    for unit, v in zip(units, u):
        unit[2] += step * v


def _land(units: list[list], dice: random.Random) -> None:
    """Decide the landing problem, LANDING + 2 units at most: of all 0-1 choices, those whose tokens come within 0.2 % of the
    nearest possible are drawn from, by their likelihood and nearness in documents."""
    size, p = np.array([u[1] for u in units], float), np.array([u[2] for u in units], float)
    bits = (np.arange(1 << len(units))[:, None] >> np.arange(len(units)) & 1).astype(float)
    off = np.abs(bits @ size - p @ size)
    near = np.flatnonzero(off <= off.min() + 0.002 * (p @ size))
    fit = bits[near] @ np.log(p) + (1 - bits[near]) @ np.log1p(-p) - np.abs(bits[near].sum(1) - p.sum())
    chance = np.cumsum(np.exp(fit - fit.max()))
    choice = bits[near[min(np.searchsorted(chance, dice.random() * chance[-1]), len(near) - 1)]]
    for unit, x in zip(units, choice):
        unit[2] = float(x)


def _fly(level: int, seed: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block, large sizes first; a state of three units passes from batch to batch."""
        block, dice, held, back, seen, schema = None, None, [], [], 0, None

        def settled() -> list[tuple]:
            nonlocal held
            out = [(*u[0], float(round(u[2])), True) for u in held if not EPS < u[2] < 1 - EPS]
            held = [u for u in held if EPS < u[2] < 1 - EPS]
            return out

        def ended() -> list[tuple]:
            nonlocal held, back
            if back:
                _land(left := held + back, dice)
                held, back = left, []
            out = settled()
            out += [(*u[0], u[2], False) for u in held]
            held = []
            return out

        for batch in parts:
            schema = batch.schema
            at = {c: i for i, c in enumerate(schema.names)}
            rows: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key = (row[at["source"]], row[at["block"]])
                if key != block:
                    rows += ended()
                    block, dice, seen = key, random.Random(f"{seed}|{level}|{key!r}"), 0
                unit = [row, int(row[at["size"]]), float(row[at["p"]])]
                seen += 1
                if row[at["n"]] and EPS < unit[2] < 1 - EPS and len(back) < LANDING and seen * LANDING >= (len(back) + 0.5) * row[at["n"]]:
                    back.append(unit)
                    continue
                held.append(unit)
                rows += settled()
                if len(held) == 3:
                    _move(held, dice)
                    rows += settled()
            if rows:
                yield _batch(rows, schema)
        if rows := ended():
            yield _batch(rows, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """rows: what came in, with the new p and whether that is decided."""
    columns = dict(zip([*schema.names, "new", "decided"], zip(*rows)))
    columns["p"] = columns.pop("new")
    return pa.RecordBatch.from_arrays([pa.array(v, schema.field(k).type if k in schema.names else pa.bool_()) for k, v in columns.items()], list(columns))


UNIT = "doc_id long, source string, size long, order long, block long, p double, n long, decided boolean"


def _level(units: DataFrame, counts: DataFrame, n_sources: int, level: int, seed: int) -> DataFrame:
    """units (doc_id, source, size, order, p) through one level: decided, or with the p that it left."""
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("long")
    dealt = units.join(small(counts, n_sources, MAX_BROADCAST_SOURCES), units["source"].eqNullSafe(counts["__source"])).select(
        "doc_id", "source", "size", "order", F.pmod(F.xxhash64(F.lit(level), "order"), blocks).alias("block"), "p", F.when(blocks == 1, F.col("n")).otherwise(0).alias("n")
    )
    dealt = dealt.repartition("source", "block").sortWithinPartitions("source", "block", F.desc("size"), "order", F.col("doc_id"))
    return store(dealt.mapInArrow(_fly(level, seed), UNIT), f"mix-level{level}")


def mix(docs: DataFrame, weigh: Callable[[DataFrame], DataFrame] | dict = by_rank(), cap: float = 3.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:  # noqa: B008
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken (copies * size).

    weigh adds weight to the table of sources, or is a dict of weights by source (sources that it lacks weigh 0). Null text
    has size 0; a null source is a source; documents of size 0 are taken 0 times. Repeated rows are rows of their own. An
    empty table gives no rows. Runs with one seed agree: blocks and draws follow from doc_id, size and text alone.
    """
    return _mixed(docs, weigh, cap, seed, id_col, text_col, source_col).drop("order")


def _order(seed: int, id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))


def _mixed(docs: DataFrame, weigh: Callable[[DataFrame], DataFrame] | dict, cap: float, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), _order(seed, id_col, text_col).alias("order"))
    thin = store(thin, "mix-sizes")
    sources = thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    if isinstance(weigh, dict):
        pairs = [F.lit(x) for k, w in weigh.items() for x in (k, float(w))]
        table_of = F.create_map(*pairs)
        sources = sources.withColumn("weight", F.coalesce(F.try_element_at(table_of, F.coalesce("source", F.lit(""))), F.lit(0.0)))
    else:
        sources = weigh(sources)
    sources = store(targets(store(sources, "mix-sources"), cap), "mix-targets")
    n_sources = sources.count()
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    of = small(sources.select(F.col("source").alias("__source"), "source_size", "target", each.alias("e")), n_sources, MAX_BROADCAST_SOURCES)
    units = thin.select("doc_id", "source", "size", "order").join(of, F.col("source").eqNullSafe(F.col("__source")))
    units = units.withColumn("p", F.when(F.col("size") > 0, F.col("e") - F.floor(F.col("e") + EPS)).otherwise(0.0)).select("doc_id", "source", "size", "order", F.greatest("p", F.lit(0.0)).alias("p"))
    counts = sources.select(F.col("source").alias("__source"), "n")
    decided, level = None, 1
    while True:
        flown = _level(units, counts, n_sources, level, seed)
        done = flown.where("decided").select("doc_id", "source", "size", "order", F.col("p").cast("int").alias("more"))
        decided = done if decided is None else decided.unionByName(done)
        units = flown.where("not decided").select("doc_id", "source", "size", "order", "p")
        counts = store(units.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("source", "__source"), "mix-left")
        if counts.isEmpty():
            break
        level += 1
    out = decided.join(of, F.col("source").eqNullSafe(F.col("__source")))
    copies = F.when(F.col("size") > 0, F.floor(F.col("e") + EPS) + F.col("more")).otherwise(0).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "order")


def take(docs: DataFrame, weigh: Callable[[DataFrame], DataFrame] | dict = by_rank(), cap: float = 3.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:  # noqa: B008
    """The documents that the mix takes, with docs' own columns, copies (how often, 1 at least) and taken (words in all).

    Of rows that repeat (same doc_id, text and source) one stands for all, with the copies of all. Columns named copies or
    taken are replaced. An empty table gives no rows.
    """
    made = _mixed(docs, weigh, cap, seed, id_col, text_col, source_col).groupBy("doc_id", "source", "order")
    made = store(made.agg(F.sum("copies").alias("copies"), F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("rows")).where("copies > 0"), "mix-taken")
    made = made.toDF("__id", "__source", "__order", "copies", "taken", "__rows")
    own = docs.drop(*[c for c in ("copies", "taken") if c in docs.columns])
    same = F.col("__order") == _order(seed, id_col, text_col)
    same &= F.col("__id").eqNullSafe(F.col(id_col).cast("long")) & F.col("__source").eqNullSafe(F.col(source_col).cast("string"))
    out = own.join(made.where("__rows = 1"), same)
    if not (more := made.where("__rows > 1")).isEmpty():
        out = out.unionByName(own.join(more, same).dropDuplicates(["__id", "__source", "__order"]))
    return out.select(*[F.col(f"`{c}`") for c in own.columns], "copies", "taken")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op1_mixing": op1_mixing}
ORACLES: dict[str, str] = {}
