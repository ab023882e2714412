"""Column helpers: rounding for comparison, ratios that are null instead of an error, list statistics in windows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(col(c), digits)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(col(a), col(b))


def quotient(a: Column | str, b: Column | str) -> Column:
    """a / b as IEEE has it: infinite where only b is 0, NaN where both are; null only where a or b is."""
    a, b = col(a), col(b)
    by_zero = F.when(F.isnan(a) | (a == 0), math.nan).when(a > 0, math.inf).when(a < 0, -math.inf)
    return F.when(b != 0, F.try_divide(a, b)).when(b == 0, by_zero)


def ln(c: Column | str) -> Column:
    """Natural logarithm; of 0 it is -inf, where Spark's is null."""
    c = col(c)
    return F.when(c == 0, -math.inf).otherwise(F.log(c))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def median_of(values: Column) -> Column:
    """Median of a sorted array; null if it is empty."""
    n = F.size(values)
    mid = (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2
    return F.when(n > 0, mid)


def mean_of(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.size(values))


def sorted_window(c: Column | str, w) -> Column:
    """Sorted array of the non-null values of a frame."""
    return F.array_sort(F.collect_list(col(c)).over(w))


def trimmed_mean(values: Column, den: int = 5) -> Column:
    """Mean of a sorted array without size div den values at either end."""
    cut = F.floor(F.size(values) / den).cast("int")
    return F.when(F.size(values) > 0, mean_of(F.slice(values, cut + 1, F.greatest(F.size(values) - 2 * cut, F.lit(1)))))


def hodges_lehmann(values: Column) -> Column:
    """Median of the averages (x_i + x_j) / 2, i <= j."""
    pairs = F.flatten(F.transform(values, lambda x, i: F.transform(F.slice(values, i + 1, F.size(values)), lambda y: (x + y) / 2)))
    return let(F.sort_array(pairs), median_of)


def huber_location(values: Column, c: float = 1.345, rounds: int = 20, mad_scale: float = 1.4826) -> Column:
    """Huber's M-estimate from the median, with a fixed scale (MAD) and a fixed number of steps; the median if the scale is 0."""

    def located(med: Column) -> Column:
        return let(mad_scale * let(F.sort_array(F.transform(values, lambda x: F.abs(x - med))), median_of), lambda scale: F.when(scale > 0, steps(med, scale)).otherwise(med))

    def steps(med: Column, scale: Column) -> Column:
        def step(mu: Column, _: Column) -> Column:
            psi = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.greatest(F.lit(-c), F.least(F.lit(c), (x - mu) / scale)))
            return mu + scale * psi / F.size(values)

        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), med, step)

    return let(median_of(values), located)
