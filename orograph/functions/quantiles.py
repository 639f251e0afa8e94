"""Six quantile definitions and four rounding rules as named Column builders.

The definitions differ in which order statistic they take; picking the wrong one changes results without an error:

=====================  ==========================================================================
``linear``             linear interpolation at q * (n - 1)
``nearest_rank``       the value at round-half-up(q * (n - 1))
``floor_rank``         the value at floor(q * (n - 1))
``upper_median``       the value at n div 2
``weighted_median``    the first value whose running weight is half of the total or more (see operators.weighted)
``median``             mean of the two middle values
=====================  ==========================================================================

All are aggregates over non-null values; NaN and nulls are left out; an empty group gives null. The rank-based Column builders are exact and
hold a group's values in one row, as ``percentile`` holds its distinct values: they are for groups that cells or keys keep small. ``ranks`` gives
the same for groups of any size.
"""

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    """x where it is a finite number, else null."""
    x = _col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def linear(x, q: float) -> Column:
    return F.percentile(finite(x), F.lit(float(q)))


@F.arrow_udf(DoubleType())
def _between(lo: pa.Array, hi: pa.Array, part: pa.Array) -> pa.Array:
    rows = zip(lo.to_pylist(), hi.to_pylist(), part.to_pylist(), strict=True)
    return pa.array([None if a is None or b is None else a if d == 0 else math.fma(a, 1 - d, b * d) for a, b, d in rows], pa.float64())


def between(lo: Column, hi: Column, at: Column) -> Column:
    """What lies at the place ``at`` between the values at its floor and its ceiling: ``lo * (1 - d) + hi * d`` with one rounding of product and sum, as
    DuckDB's interpolated quantiles are computed. ``linear`` rounds the product too, so the two differ in last bits."""
    return _between(lo, hi, at - F.floor(at))


def fused(x, q: float) -> Column:
    """``linear`` with the last bits of ``between``; holds a group's values in one row."""
    values = F.array_sort(F.collect_list(finite(x)))
    at = F.lit(float(q)) * (F.size(values) - 1)
    pick = lambda i: F.get(values, i.cast("int"))
    return between(pick(F.floor(at)), pick(F.ceil(at)), at)


def placed_values(df: DataFrame, value: str, by) -> DataFrame:
    """df, which has a row for each distinct value of a group and its count ``c``, with ``__k`` (rows up to the value) and ``__n`` (of the group); other than
    finite values don't count. A group is sorted by one task, which doesn't hold it."""
    w, c = Window.partitionBy(*by), F.when(finite(value).isNotNull(), F.col("c")).otherwise(0)
    return df.withColumns({"__k": F.sum(c).over(w.orderBy(finite(value)).rowsBetween(Window.unboundedPreceding, 0)), "__n": F.sum(c).over(w)})


def fused_of(value: str, q: float) -> Column:
    """``fused`` as an aggregate of what ``placed_values`` gives."""
    at = F.lit(float(q)) * (F.max("__n") - 1)
    here = F.lit(float(q)) * (F.col("__n") - 1)
    end = lambda i: F.max(F.when((F.col("__k") > i) & (F.col("__k") - F.col("c") <= i), finite(value)))
    return between(end(F.floor(here)), end(F.ceil(here)), at)


def median(x) -> Column:
    return F.median(finite(x))


def _ranked(x, place) -> Column:
    values = F.array_sort(F.collect_list(finite(x)))
    n = F.size(values)
    return F.when(n > 0, F.element_at(values, (F.least(F.greatest(place(n), F.lit(0)), n - 1) + 1).cast("int")))


def nearest_rank(x, q: float) -> Column:
    return _ranked(x, lambda n: F.floor(F.lit(float(q)) * (n - 1) + 0.5))


def floor_rank(x, q: float) -> Column:
    return _ranked(x, lambda n: F.floor(F.lit(float(q)) * (n - 1)))


def upper_median(x) -> Column:
    return _ranked(x, lambda n: F.floor(n / 2))


NEAREST, FLOOR, UPPER = (lambda q, n: F.floor(q * (n - 1) + 0.5)), (lambda q, n: F.floor(q * (n - 1))), (lambda q, n: F.floor(n / 2))


def ranks(df: DataFrame, value, wanted: dict, by=()) -> DataFrame:
    """A row for each group ``by`` with the order statistics ``wanted``: name to (NEAREST, FLOOR or UPPER, q). Values are put in order by ranges over
    the cluster and the wanted places picked, so no group is held in one row or task."""
    from orograph.shared import numbered

    rows = df.select(*by, finite(value).alias("__v")).where("__v is not null")
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    placed = numbered(rows, [F.col("__v")], "__k", by)
    met = [placed[c].eqNullSafe(sizes[c]) for c in by]
    placed = placed.join(sizes, met).select(*(placed[c] for c in by), "__v", "__k", "__n") if by else placed.crossJoin(F.broadcast(sizes))
    pick = lambda rule, q: F.max(F.when(F.col("__k") == F.least(F.greatest(rule(F.lit(float(q)), F.col("__n")), F.lit(0)), F.col("__n") - 1), F.col("__v")))
    found = placed.groupBy(*by).agg(*(pick(*w).alias(name) for name, w in wanted.items()))
    if not by:
        return found
    groups = df.select(*by).distinct()
    met = [groups[c].eqNullSafe(found[c]) for c in by]
    return groups.join(found, met, "left").select(*(groups[c] for c in by), *wanted)


def percentiles(df: DataFrame, value, wanted: dict) -> DataFrame:
    """One row with the linear percentiles ``wanted`` (name to q) of a whole table, bit for bit those of ``linear``. Distinct values are counted, and their
    counts added up by ranges over the cluster, so no task holds all values."""
    from orograph.shared import running

    counts = df.select(finite(value).alias("__v")).where("__v is not null").groupBy("__v").agg(F.count(F.lit(1)).alias("__c"))
    placed = running(counts, [F.col("__v")], F.col("__c"), "__k")
    placed = placed.crossJoin(F.broadcast(placed.agg(F.sum("__c").alias("__n"))))
    ends, out = [], []
    for i, (name, q) in enumerate(wanted.items()):
        at = F.lit(float(q)) * (F.col("__n") - 1)
        for end, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            ends.append(F.max(F.when((F.col("__k") > place) & (F.col("__k") - F.col("__c") <= place), F.col("__v"))).alias(f"__{end}{i}"))
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        out.append(F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi).alias(name))
    return placed.agg(F.max("__n").alias("__n"), *ends).select(*out)


def round_half_up(x) -> Column:
    """Halves go towards positive infinity: -2.5 gives -2."""
    return F.floor(_col(x) + 0.5)


def fixed(x, digits: int) -> Column:
    """Rounded to some decimals, halves up, as a double."""
    scale = float(10**digits)
    return F.floor(_col(x) * scale + 0.5) / scale


def significant(x, digits: int = 5) -> Column:
    """Rounded to significant decimal digits; 0 stays 0."""
    x = _col(x).cast("double")
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale)


def half_even(x, digits: int = 0) -> Column:
    return F.bround(_col(x), digits)
