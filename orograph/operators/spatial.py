"""Rings (``array<struct<lon, lat>>``, closed) against points, boxes and one another, as Column expressions and joins with boxes first."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.functions import geodesy as G
from orograph.functions import quantiles as Q
from orograph.functions.mesh import multiple_of_four
from orograph.operators import copies, cover, links
from orograph.shared import Ranges, settled

#: A ring's box is cut into about as many cells by as many.
PARTS = 4
BOX = ("__x0", "__y0", "__x1", "__y1")


def edges(ring: Column) -> Column:
    """Each point with the next, wrapping; the closing point of a closed ring makes no edge of its own."""
    open_ = F.when(F.element_at(ring, 1) == F.element_at(ring, -1), F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)
    turned = F.concat(F.slice(open_, 2, F.size(open_)), F.slice(open_, 1, 1))
    return F.zip_with(open_, turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def ring_area(ring: Column) -> Column:
    """Signed, in squares of the coordinates' unit: positive counter-clockwise."""
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"]) / 2


def ring_box(ring: Column) -> Column:
    lon, lat = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    return F.struct(F.array_min(lon).alias("x0"), F.array_min(lat).alias("y0"), F.array_max(lon).alias("x1"), F.array_max(lat).alias("y1"))


def contains(ring: Column, lon: Column, lat: Column) -> Column:
    """Even-odd rule."""
    crosses = lambda e: ((e["a"]["lat"] > lat) != (e["b"]["lat"] > lat)) & (lon < (e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) / (e["b"]["lat"] - e["a"]["lat"]) + e["a"]["lon"])
    return F.aggregate(edges(ring), F.lit(False), lambda s, e: s != F.coalesce(crosses(e), F.lit(False)))


def mean_point(ring: Column) -> tuple[Column, Column]:
    """The mean of all points; a closed ring's first counts twice."""
    n = F.size(ring)
    return tuple(F.aggregate(ring, F.lit(0.0), lambda s, p, k=k: s + p[k]) / n for k in ("lon", "lat"))


def edge_distance(ring: Column, lon: Column, lat: Column) -> Column:
    """Metres to the nearest edge, in metres about the point."""

    def far(e):
        ax, ay = G.local_metres(e["a"]["lon"], e["a"]["lat"], lon, lat)
        bx, by = G.local_metres(e["b"]["lon"], e["b"]["lat"], lon, lat)
        dx, dy = bx - ax, by - ay
        size = dx * dx + dy * dy
        t = F.when(size > 0, F.least(F.greatest(-(ax * dx + ay * dy) / size, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        return F.sqrt(F.pow(ax + t * dx, 2.0) + F.pow(ay + t * dy, 2.0))

    return F.array_min(F.transform(edges(ring), far))


def sink_weight(ring: Column, lon: Column, lat: Column, ramp: float) -> Column:
    """0 outside, 1 from ``ramp`` metres inside on, linear between; the box is tried first."""
    box = ring_box(ring)
    within = lon.between(box["x0"], box["x1"]) & lat.between(box["y0"], box["y1"])
    return F.when(~within, 0.0).when(~contains(ring, lon, lat), 0.0).otherwise(F.least(F.lit(1.0), edge_distance(ring, lon, lat) / ramp))


def sunk_height(height: Column, weight: Column, zoom: Column, depth: float = 12.0, least_zoom: int = 12) -> Column:
    return F.when(zoom >= least_zoom, height - depth * F.coalesce(weight, F.lit(0.0))).otherwise(height)


def boxes_touching(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """Pairs (a_id, b_id) of boxes that overlap or touch; both have x0, y0, x1, y1 and id. cell: the side of the finest cells, about that of the
    smaller boxes; larger ones lie in coarser cells (``cover``)."""
    return cover.touching(a, b, cell)


def _met(points: DataFrame, rings: DataFrame, cell: float, margin: float = 0.0, kept: DataFrame | None = None) -> DataFrame:
    """Points (lon, lat and more) with the rings (ring and more) in whose box, widened by a margin, they may be. kept: the same rings in packs, as the points are."""
    box = ring_box(F.col("ring"))
    sides = dict(zip(BOX, (box["x0"] - margin, box["y0"] - margin, box["x1"] + margin, box["y1"] + margin), strict=True))
    used = cover.levels(rings, *sides.values(), cell, PARTS)
    p = cover.with_point_cells(points, F.col("lon"), F.col("lat"), used, cell)
    r = cover.with_box_cells((rings if kept is None else kept).withColumns(sides), *(F.col(c) for c in BOX), cell, PARTS)
    j = p.join(r, cover.CELL) if kept is None else copies.met(p, r, cover.CELL)
    # boxes are told once a ring, so most that a cell brings together costs two comparisons
    return j.where(F.col("lon").between(F.col(BOX[0]), F.col(BOX[2])) & F.col("lat").between(F.col(BOX[1]), F.col(BOX[3])))


def points_in_rings(points: DataFrame, rings: DataFrame, cell: float) -> DataFrame:
    """Pairs (pid, rid) of points (pid, lon, lat) within rings (rid, ring). Equal places and equal rings are tested in packs (``copies``)."""
    rings = rings.select("rid", "ring")
    packs = copies.packed(points.select("pid", "lon", "lat"), "pid", ("lon", "lat"), "pids")
    met = _met(packs, rings, cell, kept=copies.packed(rings, "rid", ("ring",), "rids"))
    return copies.unpacked(met.where(contains(F.col("ring"), F.col("lon"), F.col("lat"))), "pids", "rids")


def _places(points: DataFrame, rings: DataFrame, cell: float, margin: float = 0.0) -> DataFrame:
    """Each place (lon, lat) of points with each ring that it may be in: equal places and equal rings once, as for a greatest or any of all rings copies tell nothing new."""
    return _met(points.select("lon", "lat").distinct(), rings.select("ring").distinct(), cell, margin)


def weights(points: DataFrame, rings: DataFrame, cell: float, ramp: float) -> DataFrame:
    """The greatest sink weight of each point over all rings; 0 where none has it."""
    w = _places(points, rings, cell).groupBy("lon", "lat").agg(F.max(sink_weight(F.col("ring"), F.col("lon"), F.col("lat"), ramp)).alias("__weight"))
    return points.join(w, ["lon", "lat"], "left").select(*points.columns, F.coalesce("__weight", F.lit(0.0)).alias("weight"))


def outside_rings(points: DataFrame, rings: DataFrame, cell: float, margin_m: float) -> DataFrame:
    """The points that are neither within a ring nor nearer than ``margin_m`` to one."""
    degrees = margin_m / 111_000 / 0.5  # wide enough up to 60 degrees of latitude
    near = contains(F.col("ring"), F.col("lon"), F.col("lat")) | (edge_distance(F.col("ring"), F.col("lon"), F.col("lat")) <= margin_m)
    met = _places(points, rings, cell, degrees).where(near).select("lon", "lat").distinct()
    return points.join(met, ["lon", "lat"], "left_anti").select(*points.columns)


def enclosing_circle(ring: Column, least: float = 60.0) -> Column:
    """struct<lon, lat, radius>: about the middle of the box; null for a null ring."""
    b = ring_box(ring)
    lon, lat = (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2

    def far(p):
        e, n = G.local_metres(p["lon"], p["lat"], lon, lat)
        return F.sqrt(e * e + n * n)

    return F.when(ring.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat"), F.greatest(F.array_max(F.transform(ring, far)), F.lit(least)).alias("radius")))


def extent(df: DataFrame, lon="lon", lat="lat", by=()) -> DataFrame:
    return df.groupBy(*by).agg(F.min(lon).alias("west"), F.min(lat).alias("south"), F.max(lon).alias("east"), F.max(lat).alias("north"))


def edge_points(rings: DataFrame, step: float, inward: float = 0.0) -> DataFrame:
    """Points along each ring's edges (metres: x, y in ``ring``'s lon, lat), every ``step`` from half a step on, moved inward along the left normal: ``rid, edge, k, x, y``."""
    e = rings.select("rid", F.posexplode(edges(F.col("ring"))).alias("edge", "e"))
    dx, dy = F.col("e.b.lon") - F.col("e.a.lon"), F.col("e.b.lat") - F.col("e.a.lat")
    e = e.withColumns({"dx": dx, "dy": dy, "size": F.sqrt(dx * dx + dy * dy)}).where(F.col("size") > step / 2)
    e = e.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil((F.col("size") - step / 2) / step).cast("int") - 1)))
    t = (F.col("k") + 0.5) * step / F.col("size")
    return e.select("rid", "edge", "k", (F.col("e.a.lon") + t * F.col("dx") - F.col("dy") / F.col("size") * inward).alias("x"), (F.col("e.a.lat") + t * F.col("dy") + F.col("dx") / F.col("size") * inward).alias("y"))


def border_quantiles(samples: DataFrame, residual="res", by=("rid",)) -> DataFrame:
    """``n`` and five floor-rank quantiles of each ring's samples. Samples are ranked by ranges, so a ring may have any number of them."""
    found = Q.ranks(samples, residual, {f"p{q}": (Q.FLOOR, q / 100) for q in (10, 25, 50, 75, 90)}, by)
    sizes = samples.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.count(Q.finite(residual)).alias("n"))
    met = [found[c].eqNullSafe(sizes[f"__{c}"]) for c in by]
    return found.join(sizes, met).select(*by, "n", *(f"p{q}" for q in (10, 25, 50, 75, 90)))


def ground_at_ring(heights: DataFrame, fallback: DataFrame, by="slug") -> DataFrame:
    """The upper median of terrain heights at a ring's points; the mesh's lowest point where none is known."""
    found = Q.ranks(heights, "height", {"ground": (Q.UPPER, 0.5)}, (by,))
    return fallback.join(found, by, "left").select(by, F.coalesce("ground", "lowest").alias("ground"))


def _clipped(points: Column, axis: str, edge: float, less: bool) -> Column:
    """Corners of the part of a polygon on one side of a line along the other axis (Sutherland-Hodgman)."""
    other = "lat" if axis == "lon" else "lon"
    inside = lambda p: p[axis] <= edge if less else p[axis] >= edge

    def step(a, b):
        across = a[other] + (b[other] - a[other]) * (F.lit(edge) - a[axis]) / (b[axis] - a[axis])
        at = {axis: F.lit(float(edge)), other: across}
        cut = F.struct(at["lon"].alias("lon"), at["lat"].alias("lat"))
        return F.filter(F.array(F.when(inside(a), a), F.when(inside(a) != inside(b), cut)), lambda p: p.isNotNull())

    return F.flatten(F.zip_with(points, F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1)), step))


def circle_ring(x: Column, y: Column, radius: Column, sides: int = 16) -> Column:
    """What stands for a survey without a footprint."""
    turn = lambda f, k: f(k * (2 * math.pi / sides))
    return F.transform(F.sequence(F.lit(0), F.lit(sides - 1)), lambda k: F.struct((x + radius * turn(F.cos, k)).alias("lon"), (y + radius * turn(F.sin, k)).alias("lat")))


def visible_fraction(rings: DataFrame, x0: float, y0: float, x1: float, y1: float, margin: float = 0.0) -> DataFrame:
    """``rid, fraction``: the share of a view's area that a ring takes, in view coordinates (lon, lat fields); margin widens the view by that
    share of its sides. Where the ring is null a circle about (x, y) with ``radius`` stands for it. A view without area gives 0."""
    mx, my = (x1 - x0) * margin, (y1 - y0) * margin
    x0, x1, y0, y1 = x0 - mx, x1 + mx, y0 - my, y1 + my
    if x1 <= x0 or y1 <= y0:
        return rings.select("rid", F.lit(0.0).alias("fraction"))
    ring = F.coalesce("ring", circle_ring(F.col("x"), F.col("y"), F.col("radius"))) if "radius" in rings.columns else F.col("ring")
    out = rings.select("rid", ring.alias("__p"))
    for axis, edge, less in (("lon", x0, False), ("lon", x1, True), ("lat", y0, False), ("lat", y1, True)):
        out = out.select("rid", _clipped(F.col("__p"), axis, edge, less).alias("__p"))
    p = F.col("__p")
    turned = F.concat(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1))
    twice = F.aggregate(F.zip_with(p, turned, lambda a, b: a["lon"] * b["lat"] - b["lon"] * a["lat"]), F.lit(0.0), lambda s, v: s + v)
    return out.select("rid", F.when(F.size(p) < 3, 0.0).otherwise(F.abs(twice) / 2 / ((x1 - x0) * (y1 - y0))).alias("fraction"))


def proximity_groups(points: DataFrame, view="view", radius: float = 30.0) -> DataFrame:
    """Greedy groups within a view (view, pid, priority, x, y): each point, by priority and pid, joins the first group whose first point is nearer than
    ``radius``, else it founds one: ``view, pid, leader``.

    Exact without a walk. In cells so small that all points of one are within the radius, at most one point founds a group. A round looks at each
    cell's first undecided point: it founds a group if it comes before those of all cells in reach, since then no undecided point can forestall it. What
    is within the radius of a founder is decided. Each view may have any number of points; a cell's neighbours are 24."""
    side = radius * 0.7
    rows = Ranges(points.select(view, "pid", "priority", "x", "y"), ["priority", "pid"], [view]).total(F.lit(1).cast("long"), "rank").frame()
    cell = [F.floor(F.col(c) / side).alias(n) for c, n in (("x", "cx"), ("y", "cy"))]
    rows = rows.select(view, "pid", "x", "y", "rank", *cell).transform(settled)
    reach = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)))

    def spread(t: DataFrame, *columns) -> DataFrame:
        return t.withColumn("__d", F.explode(reach)).select(view, (F.col("cx") + F.col("__d.i")).alias("cx"), (F.col("cy") + F.col("__d.j")).alias("cy"), *columns)

    key, open_, founders = [view, "cx", "cy"], rows, None
    while open_.limit(1).count():
        heads = open_.groupBy(*key).agg(F.min(F.struct("rank", "pid", "x", "y")).alias("h"))
        least = spread(heads, F.col("h.rank").alias("r")).groupBy(*key).agg(F.min("r").alias("least"))
        new = heads.join(least, key).where(F.col("h.rank") == F.col("least")).select(*key, F.col("h.pid").alias("leader"), F.col("h.rank").alias("lrank"), F.col("h.x").alias("lx"), F.col("h.y").alias("ly")).transform(settled)
        founders = new if founders is None else founders.unionByName(new)
        near = open_.join(spread(new, "lx", "ly"), key).where(F.hypot(F.col("x") - F.col("lx"), F.col("y") - F.col("ly")) < radius)
        open_ = open_.join(near.select(view, "rank").distinct(), [view, "rank"], "left_anti").transform(settled)
    if founders is None:
        return rows.select(view, "pid", F.col("pid").alias("leader"))
    met = rows.join(spread(founders, "leader", "lrank", "lx", "ly"), key).where((F.hypot(F.col("x") - F.col("lx"), F.col("y") - F.col("ly")) < radius) & (F.col("lrank") <= F.col("rank")))
    return met.groupBy(view, "pid", "rank").agg(F.min_by("leader", "lrank").alias("leader")).select(view, "pid", "leader")


#: Half a mark's side, and the gaps on its side and behind its label, in pixels.
HALF, NEAR, FAR = 13, 15, 21
#: Cells in which labels meet, in pixels.
LABEL_CELL = (64.0, 32.0)


def place_labels(marks: DataFrame, view="view", width="view_width") -> DataFrame:
    """A side for each mark's label (view, pid, priority, x, y, label_px): right, else left, else hidden, by what stands already when marks come by priority
    and pid; ``side``. Marks beyond the view (0 to ``width`` and, if there is such a column, to ``view_height``) or without a place are outside and block
    nothing; no label_px counts as 0.

    Exact without a walk. A side that leaves the view or meets an earlier mark is no choice from the start. Then a round places each label whose first choice
    is, in all cells that it covers, the first of those who could still stand there: nobody before it can take the place any more. What it covers is no choice
    for others. A round's joins have one new label a cell, so they are as long as the choices; there are as many rounds as labels wait for one another in a chain."""
    rows = Ranges(marks.select(view, "pid", "priority", "x", "y", "label_px", width, *(c for c in ("view_height",) if c in marks.columns)), ["priority", "pid"], [view])
    rows = rows.total(F.lit(1).cast("long"), "rank").frame().withColumn("v", F.concat(F.when(F.col(view).isNull(), "-").otherwise("+"), F.coalesce(F.col(view).cast("string"), F.lit(""))))
    x, y, label = F.col("x"), F.col("y"), F.greatest(F.coalesce("label_px", F.lit(0)), F.lit(0))
    inside = (x >= 0) & (y >= 0) & (x <= F.col(width))
    inside = inside & (y <= F.col("view_height")) if "view_height" in marks.columns else inside
    rows = rows.withColumn("__in", F.coalesce(inside, F.lit(False))).transform(settled)
    on = rows.where("__in")

    side = lambda k, a, b, fits: F.when(fits, F.struct(F.lit(k).alias("side"), a.cast("double").alias("x0"), b.cast("double").alias("x1")))
    right, left = x + FAR + label, x - FAR - label
    choices = F.filter(F.array(side(0, x + NEAR, right, right < F.col(width)), side(1, left, x - NEAR, left > 0)), lambda c: c.isNotNull())
    choices = on.select("v", "rank", F.col("y").cast("double").alias("y"), F.explode(choices).alias("c")).select("v", "rank", "y", "c.*")
    choices = _without_marks(choices, on.select("v", "rank", "x", "y"))

    wide, high = LABEL_CELL
    key, one = ["v", "cx", "cy"], ["v", "rank", "side"]
    open_, placed = _in_cells(choices, wide, high, F.col("x0"), F.col("x1"), F.col("y") - HALF, F.col("y") + HALF).transform(settled), None
    while open_.limit(1).count():
        least = open_.groupBy(*key).agg(F.min("rank").alias("least"))
        sides = open_.join(least, key).groupBy(*one).agg(F.min(F.col("rank") == F.col("least")).alias("first"))
        chosen = sides.groupBy("v", "rank").agg(F.min(F.struct("side", "first")).alias("c")).where("c.first").select("v", "rank", F.col("c.side").alias("side")).transform(settled)
        placed = chosen if placed is None else placed.unionByName(chosen)
        rest = open_.join(chosen.select("v", "rank"), ["v", "rank"], "left_anti")
        new = open_.join(chosen, one).select(*key, F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("y").alias("b"))
        hit = (F.col("x0") < F.col("a1")) & (F.col("x1") > F.col("a0")) & (F.abs(F.col("y") - F.col("b")) < 2 * HALF)
        open_ = rest.join(rest.join(new, key).where(hit).select(*one).distinct(), one, "left_anti").transform(settled)
    if placed is None:
        placed = choices.select(*one)
    named = F.when(~F.col("__in"), "outside").when(F.col("side") == 0, "right").when(F.col("side") == 1, "left").otherwise("hidden")
    return rows.join(placed, ["v", "rank"], "left").select(view, "pid", named.alias("side"))


def _in_cells(boxes: DataFrame, wide: float, high: float, x0: Column, x1: Column, y0: Column, y1: Column) -> DataFrame:
    """A row for each cell (``cx, cy``) that a box covers."""
    span = lambda a, b, size: F.sequence(F.floor(a / size), F.floor(b / size))
    return boxes.withColumn("cx", F.explode(span(x0, x1, wide))).withColumn("cy", F.explode(span(y0, y1, high)))


def _without_marks(choices: DataFrame, marks: DataFrame) -> DataFrame:
    """The choices (v, rank, side, x0, x1, y) that no earlier mark's square touches: a mark's centre within HALF of the label. Cells that lie wholly in reach are told
    by their first mark, so crowded places cost a row a cell; only marks of cells on the rim are looked at one by one."""
    size, one, key = 2.0 * HALF, ["v", "rank", "side"], ["v", "cx", "cy"]
    x0, x1, y0, y1 = F.col("x0") - HALF, F.col("x1") + HALF, F.col("y") - 2 * HALF, F.col("y") + 2 * HALF
    places = marks.select("v", F.col("rank").alias("by"), F.col("x").alias("mx"), F.col("y").alias("my"), F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    met = _in_cells(choices, size, size, x0, x1, y0, y1).join(places.groupBy(*key).agg(F.min("by").alias("least")), key).where("least < rank").transform(settled)
    whole = (F.col("cx") * size > x0) & ((F.col("cx") + 1) * size <= x1) & (F.col("cy") * size > y0) & ((F.col("cy") + 1) * size <= y1)
    gone = met.where(whole).select(*one).distinct()
    rim = met.join(gone, one, "left_anti").join(places, key)
    touched = rim.where((F.col("by") < F.col("rank")) & (F.col("mx") > x0) & (F.col("mx") < x1) & (F.col("my") > y0) & (F.col("my") < y1)).select(*one).distinct()
    return choices.join(gone.unionByName(touched), one, "left_anti")


def shelf_pack(items: DataFrame, by="atlas", width: int | None = None) -> DataFrame:
    """Places of rectangles (by, item, w, h; whole numbers) on shelves of an atlas: ``by, item, x, y``. Tallest first, of equal heights by item; a shelf ends where
    the next rectangle would pass the width, and is as high as its first. Without a width it is the side of a square of 1.15 times the atlas's area, or the widest
    rectangle, rounded to a multiple of four.

    The first item of the shelf behind the one that would start at an item follows from running widths; which of these shelves there are, from
    ``links.reached``. An atlas may have any number of items."""
    sides = items.groupBy(by).agg(F.sum(F.col("w") * F.col("h")).alias("__area"), F.max("w").alias("__most"))
    own = F.lit(width).cast("long") if width is not None else multiple_of_four(F.greatest(F.col("__most").cast("double"), F.sqrt(F.col("__area") * 1.15))).cast("long")
    order = [F.col("h").desc(), F.col("item")]
    rows = Ranges(items.select(by, "item", "w", "h"), order, [by]).total(F.lit(1).cast("long"), "node").total(F.col("w").cast("long"), "value").frame().transform(settled)
    wide = rows.join(sides.select(by, own.alias("__width")), by)
    probes = wide.select(by, F.col("node").alias("probe"), (F.col("value") - F.col("w") + F.col("__width") + 1).alias("bound"))
    nexts = links.first_at_least(rows.select(by, "node", "value"), probes, [by]).select(by, F.col("probe").alias("node"), F.col("node").alias("next"))
    starts = links.reached(nexts, rows.groupBy(by).agg(F.min("node").alias("node")), [by]).select(by, "node", F.lit(True).alias("__new"))
    shelf = F.col("__new").isNotNull()
    placed = Ranges(rows.join(starts, [by, "node"], "left"), ["node"], [by])
    placed.latest(F.when(shelf, F.col("value") - F.col("w")), "__from").latest(F.when(shelf, F.col("h")), "__high").total(F.when(shelf, F.col("h")).otherwise(0), "__top")
    found = placed.frame()
    return found.select(by, "item", (F.col("value") - F.col("w") - F.col("__from")).cast("int").alias("x"), (F.col("__top") - F.col("__high")).cast("int").alias("y"))
