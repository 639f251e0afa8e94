"""Morphology and components on a sparse grid: a cell for each embedding, by its first two components in steps of 0.05."""

from pyspark.sql import functions as F

from orograph.operators import footprint, spatial
from orograph.plans.tables import query, table
from orograph.shared import settled


def grid(spark, sf_dir):
    cell = lambda i: F.floor(F.get("embedding", F.lit(i)).cast("double") / 0.05).cast("int")
    return table(spark, sf_dir, "embeddings").select(F.lit("s").alias("slug"), cell(0).alias("ix"), cell(1).alias("iy")).distinct()


G = "g AS (SELECT DISTINCT CAST(floor(CAST(embedding[1] AS DOUBLE) / 0.05::DOUBLE) AS INTEGER) ix, CAST(floor(CAST(embedding[2] AS DOUBLE) / 0.05::DOUBLE) AS INTEGER) iy FROM embeddings)"


def _disk(r):
    return f"(SELECT dx, dy FROM range(-{r}, {r + 1}) a(dx), range(-{r}, {r + 1}) b(dy) WHERE dx * dx + dy * dy <= {r * r})"


def _dilate(t, r):
    return f"SELECT DISTINCT CAST(ix + dx AS INTEGER) ix, CAST(iy + dy AS INTEGER) iy FROM {t}, {_disk(r)}"


def _erode(t, r):
    return f"SELECT CAST(ix + dx AS INTEGER) ix, CAST(iy + dy AS INTEGER) iy FROM {t}, {_disk(r)} GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM {_disk(r)})"


@query(f"WITH {G} " + _dilate("g", 2))
def geo02_dilate(spark, sf_dir):
    return footprint.dilate(grid(spark, sf_dir), 2).select("ix", "iy")


@query(f"WITH {G}, d AS ({_dilate('g', 1)}) " + _erode("d", 1))
def geo02_close(spark, sf_dir):
    return footprint.closing(grid(spark, sf_dir), 1).select("ix", "iy")


@query(f"WITH {G}, d AS ({_dilate('g', 2)}), e AS ({_erode('d', 1)}) " + _dilate("e", 1))
def geo02_open(spark, sf_dir):
    """Of the grid grown by two, so that something is left."""
    return footprint.opening(footprint.dilate(grid(spark, sf_dir), 2), 1).select("ix", "iy")


LABELS = f"""WITH RECURSIVE {G}, r(ix, iy, lx, ly) AS (SELECT ix, iy, ix, iy FROM g UNION SELECT g.ix, g.iy, r.lx, r.ly FROM r JOIN g ON abs(g.ix - r.ix) + abs(g.iy - r.iy) = 1), l AS (SELECT ix, iy, min(struct_pack(y := ly, x := lx)) m FROM r GROUP BY 1, 2)"""


@query(LABELS + " SELECT ix, iy, m.x label_x, m.y label_y FROM l")
def geo03_components(spark, sf_dir):
    return footprint.components(grid(spark, sf_dir)).select("ix", "iy", F.col("label.ix").alias("label_x"), F.col("label.iy").alias("label_y"))


@query(LABELS + ", s AS (SELECT m, count(*) n FROM l GROUP BY 1), b AS (SELECT m FROM s ORDER BY n DESC, m LIMIT 1) SELECT ix, iy FROM l JOIN b USING (m)")
def geo05_largest_component(spark, sf_dir):
    return footprint.largest_component(grid(spark, sf_dir)).select("ix", "iy")


@query(f"WITH RECURSIVE {G}, d AS ({_dilate('g', 1)}), x AS (SELECT min(ix) - 1 x0, max(ix) + 1 x1, min(iy) - 1 y0, max(iy) + 1 y1 FROM d), f AS (SELECT CAST(a.i AS INTEGER) ix, CAST(b.j AS INTEGER) iy FROM x, range(x0, x1 + 1) a(i), range(y0, y1 + 1) b(j) WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.ix = a.i AND d.iy = b.j)), o(ix, iy) AS (SELECT x0, y0 FROM x UNION SELECT f.ix, f.iy FROM o JOIN f ON abs(f.ix - o.ix) + abs(f.iy - o.iy) = 1) SELECT ix, iy FROM d UNION SELECT ix, iy FROM f WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.ix = f.ix AND o.iy = f.iy)")
def geo04_fill_holes(spark, sf_dir):
    return footprint.fill_holes(footprint.dilate(grid(spark, sf_dir), 1)).select("ix", "iy")


def triangles(lines, tid):
    """Up to six cells wide and eight high, one for each row of lines."""
    k = F.col("l_orderkey")
    x, y = (k % 37) * 1.7, (k % 23) * 1.3
    return lines.select(tid.alias("tid"), F.lit("s").alias("slug"), x.alias("ax"), y.alias("ay"), (x + F.col("l_quantity") / 10).alias("bx"), (y + 0.3).alias("by"), (x + 0.4).alias("cx"), (y + F.col("l_quantity") / 8).alias("cy"))


TRI = "t AS (SELECT l_orderkey * 10 + l_linenumber tid, l_orderkey % 37 * 1.7::DOUBLE ax, l_orderkey % 23 * 1.3::DOUBLE ay, l_orderkey % 37 * 1.7::DOUBLE + l_quantity / 10 bx, l_orderkey % 23 * 1.3::DOUBLE + 0.3::DOUBLE \"by\", l_orderkey % 37 * 1.7::DOUBLE + 0.4::DOUBLE cx, l_orderkey % 23 * 1.3::DOUBLE + l_quantity / 8 cy FROM lineitem)"
#: Cells and counts of the triangles t.
COVERED = """, b AS (SELECT *, CAST(floor(least(ax, bx, cx)) AS INTEGER) x0, CAST(floor(greatest(ax, bx, cx)) AS INTEGER) x1, CAST(floor(least(ay, "by", cy)) AS INTEGER) y0, CAST(floor(greatest(ay, "by", cy)) AS INTEGER) y1 FROM t),
 s AS (SELECT x0 ix, y0 iy FROM b WHERE x0 = x1 AND y0 = y1), m AS (SELECT * FROM b WHERE NOT (x0 = x1 AND y0 = y1)),
 c AS (SELECT m.*, CAST(i AS INTEGER) ix, CAST(j AS INTEGER) iy, i + 0.5 px, j + 0.5 py FROM m, LATERAL (SELECT unnest(range(x0, x1 + 1)) i), LATERAL (SELECT unnest(range(y0, y1 + 1)) j)),
 d AS (SELECT ix, iy, (bx - ax) * (py - ay) - ("by" - ay) * (px - ax) s1, (cx - bx) * (py - "by") - (cy - "by") * (px - bx) s2, (ax - cx) * (py - cy) - (ay - cy) * (px - cx) s3 FROM c),
 k AS (SELECT * FROM s UNION ALL SELECT ix, iy FROM d WHERE (s1 >= 0 AND s2 >= 0 AND s3 >= 0) OR (s1 <= 0 AND s2 <= 0 AND s3 <= 0) UNION ALL SELECT CAST(floor(ax) AS INTEGER), CAST(floor(ay) AS INTEGER) FROM m UNION ALL SELECT CAST(floor(bx) AS INTEGER), CAST(floor("by") AS INTEGER) FROM m UNION ALL SELECT CAST(floor(cx) AS INTEGER), CAST(floor(cy) AS INTEGER) FROM m)
 SELECT ix, iy, count(*) n FROM k GROUP BY 1, 2"""


@query(f"WITH {TRI}{COVERED}")
def geo01_rasterise(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return footprint.cell_counts(footprint.covered_cells(triangles(lines, F.col("l_orderkey") * 10 + F.col("l_linenumber")), 1.0)).select("ix", "iy", "n")


def _corners(spark, sf_dir, lines, tid, third):
    from orograph.operators.meshes import corners

    v = table(spark, sf_dir, "part").select(F.lit("t").alias("tile"), F.col("p_partkey").alias("vid"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    t = lines.select(F.lit("t").alias("tile"), tid.alias("tid"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), third.alias("c"))
    return corners(t, v, ("x", "y"))


@query("WITH v AS (SELECT l_orderkey * 10 + l_linenumber tid, l_partkey a, l_suppkey b, (l_partkey + 1) // 2 c FROM lineitem), p AS (SELECT p_partkey vid, p_size * 1.0::DOUBLE x, p_retailprice y FROM part) SELECT tid, pa.x ax, pa.y ay, pb.x bx, pb.y \"by\", pc.x cx, pc.y cy FROM v JOIN p pa ON v.a = pa.vid JOIN p pb ON v.b = pb.vid JOIN p pc ON v.c = pc.vid")
def jn03_corners(spark, sf_dir):
    """All lines as faces with three corners of their own."""
    tid, third = F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.floor((F.col("l_partkey") + 1) / 2)
    return _corners(spark, sf_dir, table(spark, sf_dir, "lineitem"), tid, third).select("tid", "ax", "ay", "bx", "by", "cx", "cy")


#: The corners of the cells d that an edge leaves: of two, the edge of the cell in the higher row. Then the way from the first cell by rows.
RING = """, b AS (SELECT d.ix, d.iy, s.* FROM d, (VALUES (0, 0, 1, 0, 0, -1), (1, 0, 1, 1, 1, 0), (1, 1, 0, 1, 0, 1), (0, 1, 0, 0, -1, 0)) s(ax, ay, bx, "by", ox, oy) WHERE NOT EXISTS (SELECT 1 FROM d o WHERE o.ix = d.ix + ox AND o.iy = d.iy + oy)),
 l AS (SELECT ix + ax x, iy + ay y, ix + bx nx, iy + "by" ny, row_number() OVER (PARTITION BY ix + ax, iy + ay ORDER BY iy DESC, ix DESC) k, ix, iy, ay, "by" FROM b),
 n AS (SELECT x, y, nx, ny FROM l WHERE k = 1), s AS (SELECT x, y FROM l WHERE ay = 0 AND "by" = 0 ORDER BY y, x LIMIT 1),
 w AS (SELECT 0 step, x, y, [x * 100000 + y] seen FROM s UNION ALL SELECT step + 1, nx, ny, list_append(seen, nx * 100000 + ny) FROM w JOIN n USING (x, y) WHERE NOT list_contains(seen, nx * 100000 + ny))"""


@query(f"WITH RECURSIVE {G}, d AS ({_dilate('g', 1)}){RING} SELECT CAST(step AS BIGINT) step, x, y, CAST((SELECT count(*) FROM n) - (SELECT count(*) FROM w) AS INTEGER) left_edges FROM w")
def geo06_outline(spark, sf_dir):
    """The ring around the grid, corner by corner."""
    return footprint.outline(footprint.dilate(grid(spark, sf_dir), 1)).select("step", "x", "y", "left_edges")


#: Douglas-Peucker on the ring w, stretch by stretch; each split begins a stretch.
SPLIT = """, z AS (SELECT count(*) n FROM w), o AS (SELECT x, y FROM w WHERE step = 0),
 m AS (SELECT max(struct_pack(d := sqrt((w.x - o.x) * (w.x - o.x) + (w.y - o.y) * (w.y - o.y)), s := -step)) m FROM w, o),
 q AS (SELECT CAST(step AS BIGINT) step, CAST(x AS DOUBLE) x, CAST(y AS DOUBLE) y FROM w UNION ALL SELECT n, o.x, o.y FROM o, z),
 gg AS (SELECT unnest([0, CAST(-m.s AS BIGINT)]) a, unnest([CAST(-m.s AS BIGINT), n]) b FROM m, z
  UNION ALL SELECT unnest([a, k]) a, unnest([k, b]) b FROM (SELECT a, b, -max(c).s k, max(c).d d FROM (
   SELECT gg.a, gg.b, struct_pack(d := abs((v.x - u.x) * (u.y - p.y) - (u.x - p.x) * (v.y - u.y)) / greatest(sqrt((v.x - u.x) * (v.x - u.x) + (v.y - u.y) * (v.y - u.y)), 1e-9), s := -p.step) c
   FROM gg JOIN q u ON u.step = gg.a JOIN q v ON v.step = gg.b JOIN q p ON p.step > gg.a AND p.step < gg.b) GROUP BY a, b) WHERE d > 0.5)"""


@query(f"WITH RECURSIVE {G}, d AS ({_dilate('g', 1)}){RING}{SPLIT} SELECT DISTINCT step, x, y, 0.5::DOUBLE tolerance FROM gg JOIN q ON step = a")
def geo07_simplified(spark, sf_dir):
    """The outline's points that half a cell of tolerance keeps."""
    ring = footprint.outline(footprint.dilate(grid(spark, sf_dir), 1)).select("slug", "step", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return footprint.simplified(settled(ring), 1.0, most=1_000_000).select("step", "x", "y", "tolerance")


@query(f"WITH RECURSIVE {G}, d AS ({_dilate('g', 1)}){RING}{SPLIT}, k AS (SELECT DISTINCT step, x, y FROM gg JOIN q ON step = a) SELECT count(*) vertices, (SELECT CAST(count(*) AS BIGINT) FROM d) area_m2, 0.5::DOUBLE tolerance, round(min(4.5::DOUBLE + y * 180 / pi() / 6378137.0::DOUBLE), 7) south, round(max(-74.0::DOUBLE + x * 180 / pi() / 6378137.0::DOUBLE / cos(radians(4.5::DOUBLE))), 7) east, true ccw FROM k")
def geo09_polygon(spark, sf_dir):
    """The closed polygon of the grid in degrees, counter-clockwise (GEO-08: its tolerance is the first of the search)."""
    origin = table(spark, sf_dir, "region").limit(1).select(F.lit("s").alias("slug"), F.lit(-74.0).alias("lon0"), F.lit(4.5).alias("lat0"))
    p = footprint.polygons(settled(footprint.dilate(grid(spark, sf_dir), 1)), origin, 1.0, most=1_000_000)
    closed = F.get("ring", F.lit(0)) == F.element_at("ring", -1)
    return p.select(F.col("vertices").cast("long").alias("vertices"), "area_m2", "tolerance", F.array_min("ring.lat").alias("south"), F.array_max("ring.lon").alias("east"), ((spatial.ring_area(F.col("ring")) > 0) & closed).alias("ccw"))
