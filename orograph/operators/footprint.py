"""Footprints: triangles to grid cells, morphology, components, then one polygon for each survey.

The grid is sparse (only taken cells are rows), keyed by ``slug, ix, iy``. Rasterising, morphology and components are joins and
aggregations; the outline is followed by pointers that double their reach, and simplified by rounds that split all stretches at once."""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orograph.operators import links
from orograph.shared import settled

CELL = ["ix", "iy"]


def covered_cells(triangles: DataFrame, cell: float) -> DataFrame:
    """A row for each cell that a triangle (ax, ay, bx, by, cx, cy) marks: those whose centre is inside, and those of its three corners. A triangle
    within one cell marks it once; otherwise a cell may come several times, as its counts want."""
    idx = lambda v: F.floor(v / cell).cast("int")
    lo = {k: F.least(*(F.col(c + k) for c in "abc")) for k in "xy"}
    hi = {k: F.greatest(*(F.col(c + k) for c in "abc")) for k in "xy"}
    boxed = triangles.withColumns({"__x0": idx(lo["x"]), "__x1": idx(hi["x"]), "__y0": idx(lo["y"]), "__y1": idx(hi["y"])})
    px, py = (F.col("ix") + 0.5) * cell, (F.col("iy") + 0.5) * cell
    side = lambda p, q: (F.col(q + "x") - F.col(p + "x")) * (py - F.col(p + "y")) - (F.col(q + "y") - F.col(p + "y")) * (px - F.col(p + "x"))
    s = [side(p, q) for p, q in ("ab", "bc", "ca")]
    inside = ((s[0] >= 0) & (s[1] >= 0) & (s[2] >= 0)) | ((s[0] <= 0) & (s[1] <= 0) & (s[2] <= 0))
    one = (F.col("__x0") == F.col("__x1")) & (F.col("__y0") == F.col("__y1"))
    drop = ["__x0", "__x1", "__y0", "__y1"]
    single = boxed.where(one).withColumns({"ix": F.col("__x0"), "iy": F.col("__y0")}).drop(*drop)
    many = boxed.where(~one)
    # row by row of cells, those between the places where the row's middle line enters and leaves the triangle; one more on each side for rounding
    rows = many.withColumn("iy", F.explode(F.sequence("__y0", "__y1")))

    def crossing(p, q):
        dy = F.col(q + "y") - F.col(p + "y")
        return F.when(py.between(F.least(F.col(p + "y"), F.col(q + "y")), F.greatest(F.col(p + "y"), F.col(q + "y"))) & (dy != 0), F.col(p + "x") + (F.col(q + "x") - F.col(p + "x")) * (py - F.col(p + "y")) / dy)

    at = [crossing(p, q) for p, q in ("ab", "bc", "ca")]
    first, last = F.greatest(idx(F.least(*at)) - 1, F.col("__x0")), F.least(idx(F.greatest(*at)) + 1, F.col("__x1"))
    # where the line doesn't meet the triangle, nulls leave the row of the box to the test
    rows = rows.withColumns({"__x0": first, "__x1": last}).where("__x0 <= __x1")
    centres = rows.withColumn("ix", F.explode(F.sequence("__x0", "__x1"))).where(inside).drop(*drop)
    ends = F.array(*(F.struct(idx(F.col(c + "x")).alias("ix"), idx(F.col(c + "y")).alias("iy")) for c in "abc"))
    corner = many.withColumn("__e", F.explode(ends)).withColumns({"ix": F.col("__e.ix"), "iy": F.col("__e.iy")}).drop("__e", *drop)
    return single.unionByName(centres.select(*single.columns)).unionByName(corner.select(*single.columns))


def cell_counts(marks: DataFrame, by=("slug",), least: int = 1) -> DataFrame:
    return marks.groupBy(*by, *CELL).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def point_cells(points: DataFrame, cell: float, by=("slug",), least: int = 2) -> DataFrame:
    """The same from points."""
    return cell_counts(points.withColumns({"ix": F.floor(F.col("x") / cell).cast("int"), "iy": F.floor(F.col("y") / cell).cast("int")}), by, least)


def disk(radius: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]


def _spread(cells: DataFrame, radius: int, by) -> DataFrame:
    steps = F.array(*(F.struct((F.col("ix") + dx).alias("ix"), (F.col("iy") + dy).alias("iy")) for dx, dy in disk(radius)))
    return cells.select(*by, F.explode(steps).alias("c")).select(*by, "c.ix", "c.iy")


def dilate(cells: DataFrame, radius: int, by=("slug",)) -> DataFrame:
    return _spread(cells, radius, by).distinct()


def erode(cells: DataFrame, radius: int, by=("slug",)) -> DataFrame:
    """Cells whose whole disk is taken: each taken cell votes for its disk, and a full count stays. Beyond the grid all is empty."""
    return _spread(cells.select(*by, *CELL).distinct(), radius, by).groupBy(*by, *CELL).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(disk(radius))).select(*by, *CELL)


def opening(cells: DataFrame, radius: int = 1, by=("slug",)) -> DataFrame:
    return dilate(erode(cells, radius, by), radius, by) if radius else cells.select(*by, *CELL)


def closing(cells: DataFrame, radius: int = 3, by=("slug",)) -> DataFrame:
    return erode(dilate(cells, radius, by), radius, by) if radius else cells.select(*by, *CELL)


def components(cells: DataFrame, by=("slug",)) -> DataFrame:
    """Adds ``label``: the first cell, by rows from the smallest iy, of a cell's 4-connected component.

    Horizontal runs come first (a window numbers them), so what is iterated has a row for each run, not each cell."""
    w = Window.partitionBy(*by, "iy").orderBy("ix")
    placed = cells.select(*by, *CELL).distinct().withColumn("__k", F.col("ix") - F.row_number().over(w))
    runs = placed.groupBy(*by, "iy", "__k").agg(F.min("ix").alias("x0"), F.max("ix").alias("x1"))
    return placed.join(run_components(runs, by).select(*by, "iy", "__k", "label"), [*by, "iy", "__k"]).select(*by, *CELL, "label")


def run_components(runs: DataFrame, by=("slug",)) -> DataFrame:
    """Adds ``label`` to runs (iy, x0, x1): the first cell of a run's component. Runs that touch pass on the smaller label until none changes,
    jumping to the label of their label each round."""
    runs = settled(runs.withColumn("node", F.struct("iy", F.col("x0").alias("ix"))))
    a, b = runs.alias("a"), runs.alias("b")
    cond = (F.col("b.iy") == F.col("a.iy") + 1) & (F.col("a.x0") <= F.col("b.x1")) & (F.col("b.x0") <= F.col("a.x1"))
    for k in by:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    touch = a.join(b, cond).select(*(F.col(f"a.{k}").alias(k) for k in by), F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    edges = settled(touch.union(touch.select(*by, "v", "u")))
    label = settled(runs.select(*by, "node", F.col("node").alias("label")))
    while True:
        offer = edges.withColumnRenamed("u", "node").join(label, [*by, "node"]).select(*by, F.col("v").alias("node"), "label")
        best = offer.union(label.select(*by, "node", "label")).groupBy(*by, "node").agg(F.min("label").alias("label"))
        up = best.select(*by, F.col("node").alias("label"), F.col("label").alias("jump"))
        new = settled(best.join(up, [*by, "label"]).select(*by, "node", F.col("jump").alias("label")))
        old = label.withColumnRenamed("label", "was")
        changed = new.join(old, [*by, "node"]).where("label != was").limit(1).count()
        label = new
        if not changed:
            return runs.join(label, [*by, "node"]).drop("node")


def fill_holes(cells: DataFrame, by=("slug",)) -> DataFrame:
    """Adds the empty cells that are not reachable from outside.

    Works on the gaps between the runs of each row that has cells, so a stray cell far away costs nothing. What lies left and right of
    a row's cells is outside, as is a gap beside a row without cells; only the cells of true holes become rows."""
    own = settled(cells.select(*by, *CELL).distinct())
    w = Window.partitionBy(*by, "iy").orderBy("ix")
    gaps = own.withColumn("__next", F.lead("ix").over(w)).where(F.col("__next") > F.col("ix") + 1).select(*by, "iy", (F.col("ix") + 1).alias("x0"), (F.col("__next") - 1).alias("x1"), F.lit(False).alias("out"))
    rows = own.groupBy(*by, "iy").agg(F.min("ix").alias("lo"), F.max("ix").alias("hi"))
    far = (1 << 31) - 1
    side = F.explode(F.array(F.struct(F.lit(-far).alias("x0"), (F.col("lo") - 1).alias("x1")), F.struct((F.col("hi") + 1).alias("x0"), F.lit(far).alias("x1"))))
    sides = rows.select(*by, "iy", side.alias("s")).select(*by, "iy", "s.x0", "s.x1", F.lit(True).alias("out"))
    # how many of the two rows beside a row have cells
    beside = rows.select(*by, F.explode(F.array(F.col("iy") - 1, F.col("iy") + 1)).alias("iy")).groupBy(*by, "iy").agg(F.count(F.lit(1)).alias("beside"))
    runs = gaps.unionByName(sides).join(beside, [*by, "iy"], "left").withColumn("out", F.col("out") | (F.coalesce("beside", F.lit(0)) < 2)).drop("beside")
    parts = settled(run_components(runs, by))
    outside = parts.groupBy(*by, "label").agg(F.bool_or("out").alias("outside")).where("outside").select(*by, "label")
    holes = parts.join(outside, [*by, "label"], "left_anti")
    found = holes.select(*by, F.explode(F.sequence("x0", "x1")).alias("ix"), "iy")
    return own.unionByName(found.withColumn("ix", F.col("ix").cast(own.schema["ix"].dataType)).select(*own.columns))


def largest_component(cells: DataFrame, by=("slug",)) -> DataFrame:
    """The cells of the largest component; of equal ones that with the first cell by rows."""
    parts = settled(components(cells, by))
    size = parts.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"))
    best = size.groupBy(*by).agg(F.max_by("label", F.struct("n", (-F.col("label.iy")).alias("a"), (-F.col("label.ix")).alias("b"))).alias("label"))
    return parts.join(best, [*by, "label"]).select(*by, *CELL)


def outline_edges(cells: DataFrame, by=("slug",)) -> DataFrame:
    """Directed cell edges with the taken side on the left: ``x0, y0, x1, y1`` in cell corners. An edge that two taken cells share is met twice and goes."""
    x, y = F.col("ix"), F.col("iy")
    ends = (((x, y), (x + 1, y)), ((x + 1, y), (x + 1, y + 1)), ((x + 1, y + 1), (x, y + 1)), ((x, y + 1), (x, y)))
    sides = F.array(*(F.struct(p[0].alias("x0"), p[1].alias("y0"), q[0].alias("x1"), q[1].alias("y1")) for p, q in ends))
    each = cells.select(*by, F.explode(sides).alias("e")).select(*by, "e.*")
    a, b = (F.struct(F.col(p).alias("x"), F.col(q).alias("y")) for p, q in (("x0", "y0"), ("x1", "y1")))
    return each.groupBy(*by, F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).agg(F.count(F.lit(1)).alias("k"), F.first(F.struct("x0", "y0", "x1", "y1")).alias("e")).where("k = 1").select(*by, "e.*")


def outline(cells: DataFrame, by=("slug",)) -> DataFrame:
    """The ring around each group's cells: ``by, step, x, y, left_edges``, corners from the first cell by rows on, with the cells on the left.

    At a corner where two cells meet diagonally two edges leave; the edge of the cell in the higher row is taken and the other is dropped, so
    what hangs on such a corner alone may be left out: ``left_edges`` tells how many corners were. Each corner points to the next; the ring is what is
    reached from its start, in as many rounds as the logarithm of its length."""
    by = list(by)
    edges = outline_edges(cells, by)
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    # the row of the cell that has the edge: only a left or upper edge lies at a corner of the row above
    row = F.when((x1 > x0) | (y1 > y0), y0).when(y0 == y1, y0 - 1).otherwise(y1)
    node = F.struct(y0.alias("y"), x0.alias("x"))
    nexts = edges.groupBy(*by, node.alias("node")).agg(F.max_by(F.struct(y1.alias("y"), x1.alias("x")), F.struct(row, x0)).alias("next")).transform(settled)
    starts = edges.where(x1 > x0).groupBy(*by).agg(F.min(node).alias("node"))
    ring = links.reached(nexts, starts, by)
    here = nexts.groupBy(*by).agg(F.count(F.lit(1)).alias("__all")).join(ring.groupBy(*by).agg(F.count(F.lit(1)).alias("__met")), by)
    return ring.join(here, by).select(*by, "step", F.col("node.x").alias("x"), F.col("node.y").alias("y"), (F.col("__all") - F.col("__met")).cast("int").alias("left_edges"))


def significance(points: DataFrame, tolerance: float, by=("slug",), step="step") -> DataFrame:
    """``by, step, sig`` of the points (by, step, x, y) of closed rings that Douglas-Peucker keeps for some tolerance not below the given one: a point is
    kept for every tolerance less than ``sig``. A ring is cut at the point farthest from its first; these two are always kept (infinite).

    A split of a stretch is its point farthest from the line through the stretch's ends (of equal ones the first), and it holds for the tolerances below both its
    own distance and those of all splits around it. A round splits all open stretches of all rings, so a ring of any length takes as many rounds as splits nest."""
    by, x, y = list(by), F.col("x"), F.col("y")
    rows = points.select(*by, F.col(step).alias("step"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    first = rows.where("step = 0").select(*by, x.alias("__x"), y.alias("__y"))
    sizes = rows.groupBy(*by).agg((F.max("step") + 1).alias("__n"))
    far = rows.join(first, by).groupBy(*by).agg(F.max(F.struct(F.hypot(x - F.col("__x"), y - F.col("__y")).alias("d"), (-F.col("step")).alias("s"), x.alias("x"), y.alias("y"))).alias("f")).select(*by, (-F.col("f.s")).alias("__k"), F.col("f.x").alias("__fx"), F.col("f.y").alias("__fy"))
    all_ = rows.join(first, by).join(sizes, by).join(far, by)
    upper = F.col("step") > F.col("__k")
    ends = [(F.when(upper, b).otherwise(a)).alias(n) for n, a, b in (("a", F.lit(0).cast("long"), F.col("__k")), ("b", F.col("__k"), F.col("__n")), ("ax", F.col("__x"), F.col("__fx")), ("ay", F.col("__y"), F.col("__fy")), ("bx", F.col("__fx"), F.col("__x")), ("by", F.col("__fy"), F.col("__y")))]
    endless = F.lit(float("inf"))
    found = rows.join(far, by).where("step = 0 or step = __k").select(*by, "step", endless.alias("sig"))
    open_ = all_.where("step <> 0 and step <> __k").select(*by, "step", "x", "y", *ends, endless.alias("around")).transform(settled)
    while open_.limit(1).count():
        dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
        length = F.hypot(dx, dy)
        d = F.abs(dx * (F.col("ay") - y) - (F.col("ax") - x) * dy) / F.when(length == 0, 1e-9).otherwise(length)
        best = open_.withColumn("__d", d).groupBy(*by, "a").agg(F.max(F.struct(F.col("__d").alias("d"), (-F.col("step")).alias("s"), x.alias("x"), y.alias("y"))).alias("m"))
        best = best.where(F.col("m.d") > tolerance).select(*by, "a", (-F.col("m.s")).alias("__k"), F.col("m.d").alias("__d"), F.col("m.x").alias("__mx"), F.col("m.y").alias("__my"))
        cut = open_.join(best, [*by, "a"]).withColumn("around", F.least("around", "__d")).transform(settled)
        found = found.unionByName(cut.where("step = __k").select(*by, "step", F.col("around").alias("sig")))
        upper = F.col("step") > F.col("__k")
        side = lambda n, lower, higher: F.when(upper, higher).otherwise(lower).alias(n)
        open_ = cut.where("step <> __k").select(
            *by, "step", "x", "y", side("a", F.col("a"), F.col("__k")), side("b", F.col("__k"), F.col("b")), side("ax", F.col("ax"), F.col("__mx")), side("ay", F.col("ay"), F.col("__my")),
            side("bx", F.col("__mx"), F.col("bx")), side("by", F.col("__my"), F.col("by")), "around").transform(settled)
    return found


def simplified(points: DataFrame, cell: float, most: int = 96, greatest: float = 3.0, by=("slug",)) -> DataFrame:
    """``by, step, x, y, tolerance`` of the kept points of closed rings. A ring's tolerance starts at half a cell and grows by a quarter until ``most`` points are left,
    but never beyond ``greatest``: as each point's significance is known, points are counted for all tolerances at once."""
    by, steps = list(by), [cell / 2]
    while steps[-1] * 1.25 <= greatest:
        steps.append(steps[-1] * 1.25)
    sig = significance(points, steps[0], by).transform(settled)
    counts = sig.groupBy(*by).agg(*(F.count(F.when(F.col("sig") > t, 1)).alias(f"__n{i}") for i, t in enumerate(steps)))
    chosen = F.coalesce(*(F.when(F.col(f"__n{i}") <= most, t) for i, t in enumerate(steps)), F.lit(steps[-1]))
    kept = sig.join(counts.select(*by, chosen.alias("tolerance")), by).where(F.col("sig") > F.col("tolerance")).select(*by, "step", "tolerance")
    return points.join(kept, [*by, "step"]).select(*by, "step", "x", "y", "tolerance")


RING = "array<struct<lon:double,lat:double>>"


def polygons(cells: DataFrame, origins: DataFrame, cell: float = 2.0, most: int = 96, greatest: float = 3.0) -> DataFrame:
    """``slug, ring, vertices, area_m2, tolerance, left_edges`` of each survey: counter-clockwise, closed, 7 decimals; left_edges above 0 warn of diagonal
    corners (see ``outline``). origins: slug, lon0, lat0 of the metres' origin. Takes one component a survey. Only the points that are kept meet in one row."""
    area = cells.groupBy("slug").agg((F.count(F.lit(1)) * cell * cell).cast("long").alias("area_m2"))
    ring = outline(cells).transform(settled)
    metres = ring.select("slug", "step", (F.col("x") * float(cell)).alias("x"), (F.col("y") * float(cell)).alias("y"))
    kept = simplified(metres, cell, most, greatest)
    k = 180 / math.pi / 6378137.0
    points = kept.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("step", "x", "y"))).alias("p"), F.max("tolerance").alias("tolerance"))
    turned = F.concat(F.slice("p", 2, F.size("p")), F.slice("p", 1, 1))
    twice = F.aggregate(F.zip_with("p", turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)
    points = points.withColumn("p", F.when(twice < 0, F.reverse("p")).otherwise(F.col("p"))).join(origins, "slug").join(area, "slug")
    points = points.join(ring.groupBy("slug").agg(F.max("left_edges").alias("left_edges")), "slug")
    place = lambda p: F.struct(F.round(F.col("lon0") + p["x"] * k / F.cos(F.radians("lat0")), 7).alias("lon"), F.round(F.col("lat0") + p["y"] * k, 7).alias("lat"))
    closed = F.concat(F.transform("p", place), F.array(place(F.get("p", F.lit(0)))))
    return points.select("slug", closed.alias("ring"), F.size("p").alias("vertices"), "area_m2", "tolerance", "left_edges")


def footprints(triangles: DataFrame, origins: DataFrame, cell: float = 2.0, close: int = 3, open_: int = 1, least: int = 1, most: int = 96, greatest: float = 3.0) -> DataFrame:
    """All of it: triangles (slug and corners in local metres) to polygons."""
    taken = settled(cell_counts(covered_cells(triangles, cell).select("slug", *CELL), least=least))
    mask = settled(closing(settled(opening(taken, open_)), close))
    return polygons(settled(largest_component(settled(fill_holes(mask)))), origins, cell, most, greatest)
