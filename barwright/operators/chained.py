"""EMA, RSI and MACD of series too long for one task: segments run apart and are chained by their affine maps.

Every smoother here is y = a * y_before + b with a and b given by a row's place and values, the seed too: over the first n
values a = 1 and b = x / n. A segment of a series is then one pair (product of a, its end from 0), pairs of a series are
folded in order, and each segment runs once more from the value that it starts with. Only the pairs meet in one task.
A segment is any column that grows with ts, such as quarters("ts"). Series of null keys are series of their own; a missing
value makes all later ones null, as in indicators. Rows that share a ts have no defined order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEG = "__seg"
Maps = dict[str, tuple[np.ndarray, np.ndarray]]


def quarters(ts: Column | str) -> Column:
    """The calendar quarter as a number: some 2,000 hourly bars a segment."""
    return F.year(ts) * 4 + F.quarter(ts)


def weeks(ts: Column | str) -> Column:
    return F.floor(F.unix_date(F.to_date(ts)) / 7)


def smoother(x: np.ndarray, place: np.ndarray, n: int, alpha: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of the exponential smoother seeded by the mean of the first n values; rows of places under 0 pass their value on."""
    alpha = 2 / (n + 1) if alpha is None else alpha
    a = np.where(place < n, 1.0, 1 - alpha)
    return a, np.where(place < 0, 0.0, np.where(place < n, x / n, alpha * x))


def follow(maps: tuple[np.ndarray, np.ndarray], y: float) -> np.ndarray:
    """All values of the recurrence that starts from y."""
    out = np.empty(len(maps[0]))
    for i, (a, b) in enumerate(zip(maps[0].tolist(), maps[1].tolist())):
        y = out[i] = a * y + b
    return out


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """left with the other columns of right, whose keys are unique; null keys are equal."""
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(names)
    on = [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()]
    return left.join(right, on, "left").drop(*names.values())


def recur(bars: DataFrame, by: Sequence[str], segment: Column, value: str, names: Sequence[str], maps: Callable[[np.ndarray, np.ndarray, float], Maps], outs: Sequence[str], finish: Callable[[np.ndarray, dict[str, np.ndarray]], dict[str, np.ndarray]]) -> DataFrame:
    """bars with outs. maps(values, places, value before the first) gives (a, b) for each name; finish(places, recurrences) gives outs, NaN where null."""
    key, kept = [*by, SEG], bars.columns
    rows = bars.withColumn(SEG, segment.cast("long"))
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.max_by(value, "ts").cast("double").alias("__last"))
    w = Window.partitionBy(*by).orderBy(SEG)
    places = sizes.select(*key, F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"), F.lag("__last").over(w).alias("__before"))
    rows = _same(rows, places, key)
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    typed = lambda cs: ", ".join(f"`{c}` {fields[c]}" for c in cs)
    doubles = lambda cs: ", ".join(f"`{c}` double" for c in cs)

    def steps(s: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, Maps]:
        s = s.sort_values("ts", kind="stable").reset_index(drop=True)
        place = int(s["__first"].iloc[0]) + np.arange(len(s))
        before = s["__before"].iloc[0]
        return s, place, maps(s[value].to_numpy(float), place, float("nan") if before is None else float(before))

    def pair(s: pd.DataFrame) -> pd.DataFrame:
        s, _, m = steps(s)
        out = s[key].head(1).copy()
        for n in names:
            out[f"__a_{n}"], out[f"__b_{n}"] = np.prod(m[n][0]), follow(m[n], 0.0)[-1]
        return out

    def fold(s: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values(SEG).reset_index(drop=True)
        out = s[key].copy()
        for n in names:
            out[f"__y_{n}"] = np.concatenate([[0.0], follow((s[f"__a_{n}"].to_numpy(), s[f"__b_{n}"].to_numpy()), 0.0)])[: len(s)]
        return out

    def run(s: pd.DataFrame) -> pd.DataFrame:
        s, place, m = steps(s)
        got = finish(place, {n: follow(m[n], float(s[f"__y_{n}"].iloc[0])) for n in names})
        return s[kept].assign(**{c: got[c] for c in outs})

    pairs = rows.groupBy(*key).applyInPandas(pair, f"{typed(key)}, {doubles([f'__{x}_{n}' for n in names for x in 'ab'])}")
    starts = pairs.groupBy(*by).applyInPandas(fold, f"{typed(key)}, {doubles([f'__y_{n}' for n in names])}")
    out = _same(rows, starts, key).groupBy(*key).applyInPandas(run, f"{typed(kept)}, {doubles(outs)}")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in outs})


def ema(bars: DataFrame, n: int, by: Sequence[str], segment: Column, value: str = "mid", out: str = "ema") -> DataFrame:
    """As indicators.ema."""
    return recur(bars, by, segment, value, ["y"], lambda x, p, _: {"y": smoother(x, p, n)}, [out], lambda p, y: {out: np.where(p >= n - 1, y["y"], np.nan)})


def rsi(bars: DataFrame, n: int, by: Sequence[str], segment: Column, value: str = "mid", out: str = "rsi") -> DataFrame:
    """As indicators.rsi: smoothers over changes, of which a segment's first is against the segment before."""

    def maps(x: np.ndarray, place: np.ndarray, before: float) -> Maps:
        change, at = np.diff(x, prepend=before), place - 1
        return {"gain": smoother(np.maximum(change, 0), at, n, 1 / n), "loss": smoother(np.maximum(-change, 0), at, n, 1 / n)}

    def finish(place: np.ndarray, y: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        with np.errstate(divide="ignore", invalid="ignore"):
            strength = np.where(y["loss"] == 0, 100.0, 100 - 100 / (1 + y["gain"] / y["loss"]))
        return {out: np.where((place >= n) & ~np.isnan(y["gain"]), strength, np.nan)}

    return recur(bars, by, segment, value, ["gain", "loss"], maps, [out], finish)


def macd(bars: DataFrame, by: Sequence[str], segment: Column, fast: int = 12, slow: int = 26, signal: int = 9, value: str = "mid") -> DataFrame:
    """As indicators.macd: the line from two smoothers, then a smoother over the line; fast is below slow."""
    both = lambda x, p, _: {"fast": smoother(x, p, fast), "slow": smoother(x, p, slow)}
    line = recur(bars, by, segment, value, ["fast", "slow"], both, ["macd"], lambda p, y: {"macd": np.where(p >= max(fast, slow) - 1, y["fast"] - y["slow"], np.nan)})
    over = lambda x, p, _: {"y": smoother(x, p - (slow - 1), signal)}
    out = recur(line, by, segment, "macd", ["y"], over, ["macd_signal"], lambda p, y: {"macd_signal": np.where(p >= slow + signal - 2, y["y"], np.nan)})
    return out.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
