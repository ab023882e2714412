"""Audits: summaries of cycles, worst days, comparison of reports in long form, run logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import tier
from .market import legs_of_label


def cycle_summary(numbers: DataFrame) -> DataFrame:
    """cycle, n, mean, p50, p90, p99 of |resid|, median ratio to the spread, share with a gain, counts by tier; one pass."""
    x, ratio = F.abs("resid"), F.abs("resid") / F.when(F.col("spread") > 0, F.col("spread"))
    t = numbers.withColumn("tier", tier(F.col("resid"), F.col("spread")))
    p = F.percentile(x, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    g = t.groupBy("cycle").agg(
        F.count(F.lit(1)).alias("n"), F.avg("resid").alias("mean"), p.alias("p"), F.percentile(ratio, 0.5).alias("ratio_p50"), (F.count_if(F.greatest("gain_fwd", "gain_rev") > 0) / F.count(F.lit(1))).alias("gain_share"),
        *[F.count_if(F.col("tier") == k).alias(k) for k in ("clean", "noisy", "suspect", "unrated")],
    )
    return g.select("cycle", "n", "mean", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p90"), F.col("p")[2].alias("p99"), "ratio_p50", "gain_share", "clean", "noisy", "suspect", "unrated")


def stress_days(rows: DataFrame, by: Sequence[str], day: Column, value: str, least: int = 10, top: int = 5) -> DataFrame:
    """by, day, n, median of the days with least rows, the top of them by median, then the later day."""
    g = rows.groupBy(*by, day.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.percentile(value, 0.5).alias("median")).where(F.col("n") >= least)
    w = Window.partitionBy(*by).orderBy(F.desc("median"), F.desc("day"))
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def venue_gaps(missing: DataFrame) -> DataFrame:
    """instruments, hours: how many hours lack so many instruments at once. missing: instrument, ts."""
    return missing.groupBy("ts").agg(F.count_distinct("instrument").alias("instruments")).groupBy("instruments").agg(F.count(F.lit(1)).alias("hours"))


def compare_reports(golden: DataFrame, fresh: DataFrame, tolerance: float = 1e-9, unit: float = 1e-4, count_flips: int = 2) -> DataFrame:
    """path, kind, golden, fresh of the entries that differ. Reports are (path, number, text).

    FAIL: missing on one side, other text, or numbers apart; FLIP: numbers apart by a rounding unit at most (decimals) or
    count_flips at most (paths that end in _count).
    """
    g, f = golden.select("path", F.col("number").alias("gn"), F.col("text").alias("gt"), F.lit(True).alias("g")), fresh.select("path", F.col("number").alias("fn"), F.col("text").alias("ft"), F.lit(True).alias("f"))
    j = g.join(f, "path", "full_outer")
    off = F.abs(F.col("gn") - F.col("fn"))
    close = off <= tolerance * F.greatest(F.lit(1.0), F.abs("gn"))
    slack = F.when(F.col("path").endswith("_count"), F.lit(float(count_flips))).otherwise(F.lit(unit))
    kind = (
        F.when(F.col("g").isNull() | F.col("f").isNull(), "FAIL").when(~F.col("gt").eqNullSafe(F.col("ft")), "FAIL").when(F.col("gn").isNull() & F.col("fn").isNull(), F.lit(None))
        .when(F.col("gn").isNull() | F.col("fn").isNull(), "FAIL").when(close, F.lit(None)).when(off <= slack + tolerance, "FLIP").otherwise("FAIL")
    )
    text = lambda n, t: F.coalesce(F.col(t), F.col(n).cast("string"))
    return j.select("path", kind.alias("kind"), text("gn", "gt").alias("golden"), text("fn", "ft").alias("fresh")).where("kind IS NOT NULL")


def match_cycles(golden: DataFrame, fresh: DataFrame, fields: Sequence[str], signed: Sequence[str] = ("signed_mean",), tolerance: float = 1e-9, unit: float = 1e-4) -> DataFrame:
    """section, cycle, kind, why: how the cycles of two reports differ. Reports: section, pos (place in the list), cycle (label '+A -B'), fields (numbers).

    Cycles are matched by the set of their instruments, whatever their direction. FAIL: a label that can't be read, a second
    cycle of the same set on one side, one that the other side lacks, shared legs that disagree in direction, and numbers
    apart; FLIP: numbers apart by a rounding unit; INFO: another label, another order of the matched cycles. Signed fields
    of a reversed cycle are compared with their sign turned. A set is a key of sorted names, so that the join is by equality.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        x = df.withColumn("legs", legs_of_label(F.col("cycle")))
        names = F.array_sort(F.transform("legs", lambda e: e["instrument"]))
        x = x.withColumns({"key": F.array_join(names, " "), "way": F.map_from_entries("legs")})
        again = F.row_number().over(Window.partitionBy("section", "key").orderBy("pos"))
        return x.withColumn("again", again).select("section", *[F.col(c).alias(f"{name}_{c}") for c in ("pos", "cycle", "legs", "way", "again", *fields)], F.col("key").alias("key"))

    g, f = side(golden, "g"), side(fresh, "f")
    said = lambda df, cycle, kind, why: df.select("section", F.col(cycle).alias("cycle"), F.lit(kind).alias("kind"), F.lit(why).alias("why"))
    out = []
    for df, n, name in ((g, "g", "golden"), (f, "f", "fresh")):
        out.append(said(df.where(f"{n}_legs IS NULL"), f"{n}_cycle", "FAIL", f"unparseable cycle in {name}"))
        out.append(said(df.where(f"{n}_legs IS NOT NULL AND {n}_again > 1"), f"{n}_cycle", "FAIL", f"duplicate cycle in {name}"))
    once = lambda df, n: df.where(f"{n}_legs IS NOT NULL AND {n}_again = 1")
    j = once(g, "g").join(once(f, "f"), ["section", "key"], "full_outer")
    out.append(said(j.where("f_cycle IS NULL"), "g_cycle", "FAIL", "missing from fresh"))
    out.append(said(j.where("g_cycle IS NULL"), "f_cycle", "FAIL", "not in golden"))
    both = j.where("g_cycle IS NOT NULL AND f_cycle IS NOT NULL")
    ways = F.array_distinct(F.transform(F.map_keys("g_way"), lambda k: F.element_at("g_way", k) * F.element_at("f_way", k)))
    both = both.withColumn("sign", F.when(F.size(ways) == 1, F.get(ways, F.lit(0))))
    out.append(said(both.where("sign IS NULL"), "g_cycle", "FAIL", "shared legs disagree in direction"))
    ok = both.where("sign IS NOT NULL")
    out.append(said(ok.where("g_cycle <> f_cycle"), "g_cycle", "INFO", "label differs"))
    place = lambda c: F.row_number().over(Window.partitionBy("section").orderBy(c))  # noqa: E731  a report's cycles
    moved = both.select("section", (place("g_pos") != place("f_pos")).alias("moved")).groupBy("section").agg(F.bool_or("moved").alias("moved")).where("moved")
    out.append(moved.select("section", F.lit(None).cast("string").alias("cycle"), F.lit("INFO").alias("kind"), F.lit("order differs").alias("why")))
    number = lambda n, c: (F.col(f"{n}_{c}") * (F.col("sign") if n == "f" and c in signed else 1)).cast("double")
    entries = lambda n: ok.select(F.explode(F.array(*[F.struct(F.to_json(F.array("section", "g_cycle", F.lit(c))).alias("path"), number(n, c).alias("number"), F.lit(None).cast("string").alias("text")) for c in fields])).alias("e")).select("e.*")
    apart = compare_reports(entries("g"), entries("f"), tolerance, unit).withColumn("p", F.from_json("path", "array<string>"))
    out.append(apart.select(F.col("p")[0].alias("section"), F.col("p")[1].alias("cycle"), "kind", F.concat(F.col("p")[2], F.lit(" differs")).alias("why")))
    all_ = out[0]
    for x in out[1:]:
        all_ = all_.unionByName(x)
    return all_


LOG_SCHEMA = "record_type string, run_id string, seq long, ts timestamp_ntz, label string, seconds double, status string, note string, _corrupt string"


def read_log(spark, path: str) -> DataFrame:
    """A JSON-lines run log; lines that don't parse keep their text in _corrupt."""
    return spark.read.schema(LOG_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def merge_log(records: DataFrame) -> DataFrame:
    """run_id, started, ended, status, items, seconds (total, least, most) from start, note, item and end records; repeated (run_id, seq) count once."""
    once = records.where("run_id IS NOT NULL").dropDuplicates(["run_id", "seq"])
    kind = F.col("record_type")
    g = once.groupBy("run_id").agg(
        F.min(F.when(kind == "start", F.col("ts"))).alias("started"), F.max(F.when(kind == "end", F.col("ts"))).alias("ended"), F.max(F.when(kind == "end", F.col("status"))).alias("status"),
        F.count_if(kind == "item").alias("items"), F.sum(F.when(kind == "item", F.col("seconds"))).alias("total_s"), F.min(F.when(kind == "item", F.col("seconds"))).alias("least_s"), F.max(F.when(kind == "item", F.col("seconds"))).alias("most_s"),
    )
    return g.withColumn("status", F.coalesce("status", F.lit("unfinished")))


def unseen(source: DataFrame, target: DataFrame) -> DataFrame:
    """Records of source whose (run_id, seq) target lacks."""
    return source.join(target.select("run_id", "seq").distinct(), ["run_id", "seq"], "left_anti")
