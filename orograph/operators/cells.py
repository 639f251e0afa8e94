"""Grid cells over survey points, and what a report says of their residuals.

Cells are keyed by ``floor(x / size), floor(y / size)``, negative coordinates included. All is aggregation with partial sums except
the exact percentiles of a cell, for which one task sorts the cell's distinct values: choose the cell so that it stays small however large the survey is."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.functions import quantiles as Q

SELECTIONS = ("all", "open", "open_border")


def bounding_box(df: DataFrame, *axes: str, by=()) -> DataFrame:
    """Least and greatest of each axis, and the count."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))))


def origin_offset(df: DataFrame, x="x", y="y", z="z") -> DataFrame:
    """The rounded middle of the box (halves to even) and the floor, to subtract from coordinates."""
    half = lambda c: F.bround((F.min(c) + F.max(c)) / 2)
    return df.agg(half(x).alias("dx"), half(y).alias("dy"), F.min(z).alias("dz"))


def occupied(df: DataFrame, x: Column, y: Column, size_x: float, size_y: float | None = None) -> DataFrame:
    return df.withColumns({"ix": F.floor(x / size_x).cast("int"), "iy": F.floor(y / (size_y or size_x)).cast("int")})


def grid_cells(df: DataFrame, x, y, z, size_x: float, size_y: float | None = None, low: float = 0.05, high: float = 0.95, least: int = 20,
               definition: str = "linear", point: str = "mean", border: bool = True) -> DataFrame:
    """``ix, iy, n, p5, p95, disp, cx, cy`` of cells with ``least`` points or more, and whether a neighbour is unoccupied.

    definition: the quantile's (``linear`` or ``nearest_rank``). point: ``mean`` of the points or ``centre`` of the cell. A
    neighbour counts as occupied with a single point."""
    x, y, z = (F.col(c) if isinstance(c, str) else c for c in (x, y, z))
    keyed = occupied(df.select(x.alias("x"), y.alias("y"), z.alias("z")), F.col("x"), F.col("y"), size_x, size_y)
    if definition == "linear":
        # equal values of a cell are one row
        counts = keyed.groupBy("ix", "iy", "z").agg(F.count(F.lit(1)).alias("c"), *(f(a).alias(f"{n}_{a}") for a in ("x", "y") for n, f in (("sum", F.sum), ("count", F.count))))
        ends = [Q.fused_of("z", q).alias(n) for n, q in (("p5", low), ("p95", high))]
        means = [(F.sum(f"sum_{a}") / F.sum(f"count_{a}")).alias(f"c{a}") for a in ("x", "y")]
        every = Q.placed_values(counts, "z", ("ix", "iy")).groupBy("ix", "iy").agg(F.sum("c").alias("n"), *ends, *means)
    else:
        quantile = {"nearest_rank": Q.nearest_rank, "floor_rank": Q.floor_rank}[definition]
        every = keyed.groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("n"), quantile("z", low).alias("p5"), quantile("z", high).alias("p95"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    if point == "centre":
        every = every.withColumns({"cx": (F.col("ix") + 0.5) * size_x, "cy": (F.col("iy") + 0.5) * (size_y or size_x)})
    every = every.withColumn("disp", F.col("p95") - F.col("p5"))
    return (marked_border(every) if border else every).where(F.col("n") >= least)


def marked_border(every: DataFrame) -> DataFrame:
    """Adds ``border`` where the cells themselves are all that are taken: each sends a mark to its four neighbours and its own row to itself,
    and one aggregation brings them together, so what the cells were computed from is read once."""
    own = F.struct(*every.columns)
    there = [F.struct((F.col("ix") + dx).alias("ix"), (F.col("iy") + dy).alias("iy"), F.lit(None).cast(every.select(own).schema[0].dataType).alias("own")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))]
    sent = every.select(F.explode(F.array(F.struct("ix", "iy", own.alias("own")), *there)).alias("s")).select("s.*")
    met = sent.groupBy("ix", "iy").agg(F.first("own", ignorenulls=True).alias("own"), F.count_if(F.col("own").isNull()).alias("k"))
    return met.where(F.col("own").isNotNull()).select("own.*", (F.col("k") < 4).alias("border"))


def with_border(cells: DataFrame, taken: DataFrame) -> DataFrame:
    """Adds ``border`` against a table of taken cells: fewer than four of a cell's side neighbours are in it. Neighbours announce themselves, so one
    aggregation by cell replaces four joins."""
    sides = F.array(*(F.struct((F.col("ix") + dx).alias("ix"), (F.col("iy") + dy).alias("iy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))))
    around = taken.select(F.explode(sides).alias("c")).groupBy(F.col("c.ix").alias("ix"), F.col("c.iy").alias("iy")).agg(F.count(F.lit(1)).alias("k"))
    return cells.join(around, ["ix", "iy"], "left").withColumn("border", F.coalesce("k", F.lit(0)) < 4).drop("k")


def is_open(dispersion: float, column: str = "disp") -> Column:
    """Open ground: little between the low and the high percentile. Strictly less."""
    return F.col(column) < dispersion


def summary(value: Column, where: Column | None = None, digits: int = 2, definition: str = "linear") -> Column:
    """struct<cells, median, q1, q3, iqr> of a selection, rounded; a count of 0 and nulls for an empty one."""
    v = value if where is None else F.when(where, value)
    quantile = {"linear": Q.fused, "nearest_rank": Q.nearest_rank, "floor_rank": Q.floor_rank}[definition]
    q1, q2, q3 = (quantile(v, q) for q in (0.25, 0.5, 0.75))
    return F.struct(F.count(v).alias("cells"), Q.fixed(q2, digits).alias("median"), Q.fixed(q1, digits).alias("q1"), Q.fixed(q3, digits).alias("q3"), Q.fixed(q3 - q1, digits).alias("iqr"))


def residual_summaries(cells: DataFrame, residual="res", dispersion: float = 1.0, by=(), definition: str = "linear") -> DataFrame:
    """One row for each of three overlapping selections (all, open ground, open ground at the border), from one pass."""
    r, op = F.col(residual), is_open(dispersion)
    wide = cells.groupBy(*by).agg(*(summary(r, w, definition=definition).alias(n) for n, w in zip(SELECTIONS, (F.lit(True), op, op & F.col("border")), strict=True)))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("selection"), F.col(n).alias("s")) for n in SELECTIONS)))
    return wide.select(*by, rows.alias("r")).select(*by, "r.selection", "r.s.*")


def quadrant(x="x", y="y") -> Column:
    """NE, NO, SE or SO; null on an axis."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.when((x > 0) & (y > 0), "NE").when((x < 0) & (y > 0), "NO").when((x > 0) & (y < 0), "SE").when((x < 0) & (y < 0), "SO")


def quadrant_summaries(cells: DataFrame, residual="res", x="x", y="y", definition: str = "linear") -> DataFrame:
    return cells.withColumn("quadrant", quadrant(x, y)).where(F.col("quadrant").isNotNull()).groupBy("quadrant").agg(summary(F.col(residual), definition=definition).alias("s")).select("quadrant", "s.*")


def plane_fit(df: DataFrame, x="x", y="y", r="res", by=(), least: int = 3) -> DataFrame:
    """Least squares of ``r = a x + b y + c`` by nine sums: ``points, a, b, c``; nulls below ``least`` points or if x, y lie on a line.

    Give centred x and y: the sums of squares then keep their digits."""
    x, y, r = F.col(x), F.col(y), F.col(r)
    s = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"), F.sum(r).alias("sr"), F.sum(x * r).alias("sxr"), F.sum(y * r).alias("syr"))
    c = {k: F.col(k) for k in s.columns}

    def det(a1, a2, a3, b1, b2, b3, c1, c2, c3):
        return a1 * (b2 * c3 - b3 * c2) - a2 * (b1 * c3 - b3 * c1) + a3 * (b1 * c2 - b2 * c1)

    whole = det(c["sxx"], c["sxy"], c["sx"], c["sxy"], c["syy"], c["sy"], c["sx"], c["sy"], c["n"])
    top_a = det(c["sxr"], c["sxy"], c["sx"], c["syr"], c["syy"], c["sy"], c["sr"], c["sy"], c["n"])
    top_b = det(c["sxx"], c["sxr"], c["sx"], c["sxy"], c["syr"], c["sy"], c["sx"], c["sr"], c["n"])
    top_c = det(c["sxx"], c["sxy"], c["sxr"], c["sxy"], c["syy"], c["syr"], c["sx"], c["sy"], c["sr"])
    ok = (c["n"] >= least) & (whole != 0)
    return s.select(*by, F.col("n").alias("points"), *(F.when(ok, t / whole).alias(k) for k, t in (("a", top_a), ("b", top_b), ("c", top_c))))


def after_fit(df: DataFrame, plane: DataFrame, x="x", y="y", r="res") -> DataFrame:
    """``iqr`` of what the plane leaves, and its tilt in degrees. The plane is one row."""
    left = df.crossJoin(F.broadcast(plane.select("a", "b", "c").limit(1)))
    rest = F.col(r) - (F.col("a") * F.col(x) + F.col("b") * F.col(y) + F.col("c"))
    return left.agg((Q.fused(rest, 0.75) - Q.fused(rest, 0.25)).alias("iqr"), F.degrees(F.atan(F.sqrt(F.first("a") ** 2 + F.first("b") ** 2))).alias("tilt"))


def suggested_adjustment(summaries: DataFrame) -> DataFrame:
    """The open ground's median if it has cells, else that of all."""
    pick = lambda n, c: F.max(F.when(F.col("selection") == n, F.col(c)))
    return summaries.agg(F.when(pick("open", "cells") > 0, pick("open", "median")).otherwise(pick("all", "median")).alias("adjustment"))


def error_report(df: DataFrame, error: str, z: str, ground: float = 0.2) -> DataFrame:
    """Median, p95 and the largest of errors and of their sizes, overall and below the z percentile ``ground``."""
    rows = df.crossJoin(F.broadcast(Q.percentiles(df, z, {"cut": ground})))
    e, low = F.abs(error), F.col(z) < F.col("cut")
    parts = [(n, w) for n, w in (("", F.lit(True)), ("ground_", low))]
    ends = rows.agg(*(F.max(F.when(w, e)).alias(f"{n}max") for n, w in parts), F.max(error).alias("max_signed"), F.min(error).alias("min_signed"))
    for n, w in parts:
        ends = ends.crossJoin(F.broadcast(Q.percentiles(rows.where(w).select(e.alias("e")), "e", {f"{n}median": 0.5, f"{n}p95": 0.95})))
    return ends.select(*(n + m for n, _ in parts for m in ("median", "p95", "max")), "max_signed", "min_signed")


def extreme_rows(df: DataFrame, x="x", y="y") -> DataFrame:
    """The rows at the four extremes, and the one nearest the middle of the box; ties go to the smaller row."""
    row = F.struct(*df.columns)
    box = df.agg(((F.min(x) + F.max(x)) / 2).alias("__mx"), ((F.min(y) + F.max(y)) / 2).alias("__my"))
    near = (F.col(x) - F.col("__mx")) ** 2 + (F.col(y) - F.col("__my")) ** 2
    pick = {"west": F.min(F.struct(F.col(x).alias("k"), row.alias("r"))), "east": F.min(F.struct((-F.col(x)).alias("k"), row.alias("r"))), "south": F.min(F.struct(F.col(y).alias("k"), row.alias("r"))), "north": F.min(F.struct((-F.col(y)).alias("k"), row.alias("r"))), "centre": F.min(F.struct(near.alias("k"), row.alias("r")))}
    one = df.crossJoin(F.broadcast(box)).agg(*(v.alias(k) for k, v in pick.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("place"), F.col(f"{k}.r").alias("r")) for k in pick))).alias("p")).select("p.place", "p.r.*")
