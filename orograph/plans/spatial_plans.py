"""Rings, points and boxes: suppliers are surveys with a pentagon (dented at its last corner) each, customers are points among them."""

from pyspark.sql import functions as F

from orograph.operators import spatial
from orograph.plans.scalar_plans import PLACES, places
from orograph.plans.tables import query, table

#: Corners about a survey's middle, in multiples of its size.
CORNERS = ((1.0, 0.0), (0.3, 1.0), (-0.8, 0.6), (-0.8, -0.6), (0.3, -0.2))
CELL, RAMP, MARGIN = 0.05, 1500.0, 800.0


def _closed(points):
    return F.array(*points, points[0])


def rings(spark, sf_dir):
    """In degrees, among the places of customers."""
    k = F.col("s_suppkey")
    lon, lat, r = k % 20 / 20.0 - 74.5, k % 14 / 10.0 + 4.0, k % 5 * 0.004 + 0.02
    points = [F.struct((lon + r * cx).alias("lon"), (lat + r * cy).alias("lat")) for cx, cy in CORNERS]
    return table(spark, sf_dir, "supplier").select(k.alias("rid"), _closed(points).alias("ring"))


def flat_rings(spark, sf_dir):
    """In metres (or pixels), some far outside of a view of 1200 by 900; every seventh survey has no ring, only a middle and a radius."""
    k = F.col("s_suppkey")
    x, y, r = k % 23 * 60.0, k % 14 * 70.0, k % 5 * 25.0 + 40.0
    points = [F.struct((x + r * cx).alias("lon"), (y + r * cy).alias("lat")) for cx, cy in CORNERS]
    return table(spark, sf_dir, "supplier").select(k.alias("rid"), F.when(k % 7 != 0, _closed(points)).alias("ring"), x.alias("x"), y.alias("y"), r.alias("radius"))


VALUES = ", ".join(f"({i}, {x!r}::DOUBLE, {y!r}::DOUBLE)" for i, (x, y) in enumerate(CORNERS))
EDGES = f"""c AS (SELECT * FROM (VALUES {VALUES}) t(i, cx, cy)), v AS (SELECT rid, i, x0 + r * cx lon, y0 + r * cy lat FROM s, c),
 e AS (SELECT v.rid, v.i, v.lon ax, v.lat ay, w.lon bx, w.lat "by" FROM v JOIN v w ON v.rid = w.rid AND w.i = (v.i + 1) % {len(CORNERS)})"""
RINGS = "s AS (SELECT s_suppkey rid, s_suppkey % 20 / 20.0::DOUBLE - 74.5::DOUBLE x0, s_suppkey % 14 / 10.0::DOUBLE + 4.0::DOUBLE y0, s_suppkey % 5 * 0.004::DOUBLE + 0.02::DOUBLE r FROM supplier), " + EDGES
FLAT = "s AS (SELECT s_suppkey rid, s_suppkey % 23 * 60.0::DOUBLE x0, s_suppkey % 14 * 70.0::DOUBLE y0, s_suppkey % 5 * 25.0::DOUBLE + 40.0::DOUBLE r FROM supplier), " + EDGES
#: Of every point and ring: whether the point is inside, and metres to the nearest edge.
MET = PLACES + ", " + RINGS + """, m AS (SELECT p.id, p.lon, p.lat, e.*, radians(ax - lon) * 6378137.0::DOUBLE * cos(radians(lat)) ux, radians(ay - lat) * 6378137.0::DOUBLE uy, radians(bx - lon) * 6378137.0::DOUBLE * cos(radians(lat)) vx, radians("by" - lat) * 6378137.0::DOUBLE vy FROM p, e),
 n AS (SELECT *, least(greatest(-(ux * (vx - ux) + uy * (vy - uy)) / ((vx - ux) * (vx - ux) + (vy - uy) * (vy - uy)), 0.0), 1.0) t FROM m),
 d AS (SELECT id, rid, sum(CASE WHEN (ay > lat) <> ("by" > lat) AND lon < (bx - ax) * (lat - ay) / ("by" - ay) + ax THEN 1 ELSE 0 END) % 2 = 1 inside, min(sqrt(pow(ux + t * (vx - ux), 2) + pow(uy + t * (vy - uy), 2))) far FROM n GROUP BY 1, 2)"""


def survey_points(spark, sf_dir):
    return places(spark, sf_dir).withColumnRenamed("id", "pid")


@query(MET + " SELECT id pid, rid FROM d WHERE inside")
def jn07_points_in_rings(spark, sf_dir):
    return spatial.points_in_rings(survey_points(spark, sf_dir), rings(spark, sf_dir), CELL)


@query(MET + f" SELECT id pid FROM d GROUP BY 1 HAVING count(*) FILTER (WHERE inside OR far <= {MARGIN}) = 0")
def jn08_outside_rings(spark, sf_dir):
    return spatial.outside_rings(survey_points(spark, sf_dir), rings(spark, sf_dir), CELL, MARGIN).select("pid")


WEIGHT = MET + f", w AS (SELECT id, max(CASE WHEN inside THEN least(1.0, far / {RAMP}) ELSE 0 END) weight FROM d GROUP BY 1)"


@query(WEIGHT + " SELECT id pid, round(weight, 6) weight FROM w")
def agg33_ring_weights(spark, sf_dir):
    w = spatial.weights(survey_points(spark, sf_dir), rings(spark, sf_dir), CELL, RAMP)
    return w.select("pid", F.round("weight", 6).alias("weight"))


@query(WEIGHT + " SELECT p.id pid, round(CASE WHEN 10 + p.id % 4 >= 12 THEN h - 12 * weight ELSE h END, 4) sunk FROM p JOIN w ON p.id = w.id")
def sca24_sunk_height(spark, sf_dir):
    w = spatial.weights(survey_points(spark, sf_dir), rings(spark, sf_dir), CELL, RAMP)
    return w.select("pid", F.round(spatial.sunk_height(F.col("h"), F.col("weight"), F.col("pid") % 4 + 10), 4).alias("sunk"))


@query("WITH " + RINGS + ' SELECT rid, round(sum(ax * "by" - bx * ay) / 2, 9) area FROM e GROUP BY 1')
def agg25_ring_areas(spark, sf_dir):
    """Signed area of every survey's ring, in square degrees."""
    return rings(spark, sf_dir).select("rid", F.round(spatial.ring_area(F.col("ring")), 9).alias("area"))


@query("WITH " + RINGS + ", b AS (SELECT rid, (min(lon) + max(lon)) / 2 clon, (min(lat) + max(lat)) / 2 clat FROM v GROUP BY 1) SELECT v.rid, round(any_value(clon), 9) lon, round(any_value(clat), 9) lat, round(greatest(max(sqrt(pow(radians(lon - clon) * 6378137.0::DOUBLE * cos(radians(clat)), 2) + pow(radians(lat - clat) * 6378137.0::DOUBLE, 2))), 60.0), 4) radius FROM v JOIN b ON v.rid = b.rid GROUP BY 1")
def agg32_enclosing_circle(spark, sf_dir):
    c = rings(spark, sf_dir).select("rid", spatial.enclosing_circle(F.col("ring")).alias("c"))
    return c.select("rid", F.round("c.lon", 9).alias("lon"), F.round("c.lat", 9).alias("lat"), F.round("c.radius", 4).alias("radius"))


@query(PLACES + " SELECT id % 25 g, min(lon) west, min(lat) south, max(lon) east, max(lat) north FROM p GROUP BY 1")
def agg34_extents(spark, sf_dir):
    return spatial.extent(places(spark, sf_dir).withColumn("g", F.col("id") % 25), by=("g",))


@query("WITH " + FLAT + """, g AS (SELECT *, bx - ax dx, "by" - ay dy, sqrt((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)) size FROM e),
 k AS (SELECT *, unnest(range(CAST(ceil((size - 3.5) / 7.0) AS BIGINT))) k FROM g WHERE size > 3.5)
 SELECT rid, CAST(i AS INTEGER) edge, CAST(k AS INTEGER) k, round(ax + (k + 0.5) * 7.0 / size * dx - dy / size * 1.5, 6) x, round(ay + (k + 0.5) * 7.0 / size * dy + dx / size * 1.5, 6) y FROM k WHERE rid % 7 <> 0""")
def win02_edge_points(spark, sf_dir):
    """Every seven metres along each survey's ring, a metre and a half inside."""
    p = spatial.edge_points(flat_rings(spark, sf_dir).where("ring is not null"), 7.0, 1.5)
    return p.select("rid", "edge", "k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("WITH q AS (SELECT l_suppkey rid, list_sort(list(l_extendedprice / 1000 - l_quantity)) a, count(*) n FROM lineitem GROUP BY 1) SELECT rid, n, " + ", ".join(f"a[CAST(floor({q / 100} * (n - 1)) AS BIGINT) + 1] p{q}" for q in (10, 25, 50, 75, 90)) + " FROM q")
def agg28_border_quantiles(spark, sf_dir):
    samples = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("rid"), (F.col("l_extendedprice") / 1000 - F.col("l_quantity")).alias("res"))
    return spatial.border_quantiles(samples)


@query("SELECT c_custkey slug, coalesce(h, c_acctbal) ground FROM customer LEFT JOIN (SELECT o_custkey, list_sort(list(o_totalprice))[count(*) // 2 + 1] h FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def agg27_ground_at_ring(spark, sf_dir):
    heights = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("slug"), F.col("o_totalprice").alias("height"))
    lowest = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("slug"), F.col("c_acctbal").alias("lowest"))
    return spatial.ground_at_ring(heights, lowest)


BOX = "SELECT {k} id, {k} % 100 * 1.0::DOUBLE x0, {k} % 37 * 1.0::DOUBLE y0, {k} % 100 + {k} % 3 * 1.0::DOUBLE x1, {k} % 37 + {k} % 2 * 1.0::DOUBLE y1 FROM {t}"


def _boxes(df, key):
    k = F.col(key)
    return df.select(k.alias("id"), (k % 100 * 1.0).alias("x0"), (k % 37 * 1.0).alias("y0"), (k % 100 + k % 3 * 1.0).alias("x1"), (k % 37 + k % 2 * 1.0).alias("y1"))


@query("WITH a AS (" + BOX.format(k="c_custkey", t="customer") + "), b AS (" + BOX.format(k="s_suppkey", t="supplier") + ") SELECT a.id a_id, b.id b_id FROM a JOIN b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
def jn06_boxes_touching(spark, sf_dir):
    """Boxes of whole numbers, many of which only touch or are a point."""
    return spatial.boxes_touching(_boxes(table(spark, sf_dir, "customer"), "c_custkey"), _boxes(table(spark, sf_dir, "supplier"), "s_suppkey"), 3.0)


#: Sides from a thousandth of a cell to some thousand cells.
SIZED = "SELECT {k} id, {k} * 7919 % 10007 * 1.0::DOUBLE x0, {k} * 104729 % 9973 * 1.0::DOUBLE y0, {k} * 7919 % 10007 + 0.003::DOUBLE * pow(2, {k} % 21) x1, {k} * 104729 % 9973 + 0.003::DOUBLE * pow(2, {k} * 5 % 21) y1 FROM {t}"


def _sized_boxes(df, key):
    k = F.col(key)
    x0, y0 = k * 7919 % 10007 * 1.0, k * 104729 % 9973 * 1.0
    return df.select(k.alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + 0.003 * F.pow(F.lit(2.0), k % 21)).alias("x1"), (y0 + 0.003 * F.pow(F.lit(2.0), k * 5 % 21)).alias("y1"))


@query("WITH a AS (" + SIZED.format(k="c_custkey", t="customer") + "), b AS (" + SIZED.format(k="s_suppkey", t="supplier") + ") SELECT a.id a_id, b.id b_id FROM a JOIN b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
def jn06_boxes_of_all_sizes(spark, sf_dir):
    """Boxes whose sides differ by a factor of a million, in one hierarchy of cells."""
    return spatial.boxes_touching(_sized_boxes(table(spark, sf_dir, "customer"), "c_custkey"), _sized_boxes(table(spark, sf_dir, "supplier"), "s_suppkey"), 1.0)


@query(PLACES + ", s AS (SELECT s_suppkey rid, s_suppkey % 20 / 20.0::DOUBLE - 74.5::DOUBLE x0, s_suppkey % 14 / 10.0::DOUBLE + 4.0::DOUBLE y0, 0.0004::DOUBLE * pow(3, s_suppkey % 9) r FROM supplier), " + EDGES
       + """ SELECT id pid, rid FROM p, e GROUP BY 1, 2 HAVING sum(CASE WHEN (ay > lat) <> ("by" > lat) AND lon < (bx - ax) * (lat - ay) / ("by" - ay) + ax THEN 1 ELSE 0 END) % 2 = 1""")
def jn07_rings_of_all_sizes(spark, sf_dir):
    """Rings from a few tens of metres to a few hundred kilometres."""
    k = F.col("s_suppkey")
    lon, lat, r = k % 20 / 20.0 - 74.5, k % 14 / 10.0 + 4.0, 0.0004 * F.pow(F.lit(3.0), k % 9)
    points = [F.struct((lon + r * cx).alias("lon"), (lat + r * cy).alias("lat")) for cx, cy in CORNERS]
    return spatial.points_in_rings(survey_points(spark, sf_dir), table(spark, sf_dir, "supplier").select(k.alias("rid"), _closed(points).alias("ring")), 0.001)


VIEW = (300.0, 1200.0, 200.0, 900.0)


def _cut(axis: str, edge: float, less: bool) -> str:
    """A list of corners q cut by one side of the view."""
    inside = lambda p: f"{p}.{axis} {'<=' if less else '>='} {edge}"
    a, b, other = "q[i]", "q[i % len(q) + 1]", "y" if axis == "x" else "x"
    t = f"{a}.{other} + ({b}.{other} - {a}.{other}) * ({edge} - {a}.{axis}) / ({b}.{axis} - {a}.{axis})"
    at = f"{{'x': {edge}::DOUBLE, 'y': {t}}}" if axis == "x" else f"{{'x': {t}, 'y': {edge}::DOUBLE}}"
    return f"flatten(list_transform(range(1, len(q) + 1), lambda i: list_concat(CASE WHEN {inside(a)} THEN [{a}] END, CASE WHEN ({inside(a)}) <> ({inside(b)}) THEN [{at}] END)))"


@query("WITH " + FLAT + f""", q0 AS (SELECT rid, list({{'x': lon, 'y': lat}} ORDER BY i) q FROM v WHERE rid % 7 <> 0 GROUP BY 1 UNION ALL
 SELECT rid, list_transform(range(16), lambda j: {{'x': x0 + r * cos(j * pi() / 8), 'y': y0 + r * sin(j * pi() / 8)}}) FROM s WHERE rid % 7 = 0),
 q1 AS (SELECT rid, {_cut("x", VIEW[0], False)} q FROM q0), q2 AS (SELECT rid, {_cut("x", VIEW[1], True)} q FROM q1),
 q3 AS (SELECT rid, {_cut("y", VIEW[2], False)} q FROM q2), q4 AS (SELECT rid, {_cut("y", VIEW[3], True)} q FROM q3)
 SELECT rid, CASE WHEN len(q) < 3 THEN 0.0::DOUBLE ELSE round(abs(list_sum(list_transform(range(1, len(q) + 1), lambda i: q[i].x * q[i % len(q) + 1].y - q[i % len(q) + 1].x * q[i].y))) / 2 / {(VIEW[1] - VIEW[0]) * (VIEW[3] - VIEW[2])}::DOUBLE, 9) END fraction FROM q4""")
def geo10_visible_fraction(spark, sf_dir):
    """The share of a view that each survey takes; a circle of 16 sides stands for a missing ring."""
    x0, x1, y0, y1 = VIEW
    return spatial.visible_fraction(flat_rings(spark, sf_dir), x0, y0, x1, y1).select("rid", F.round("fraction", 9).alias("fraction"))


@query("""WITH RECURSIVE m AS (SELECT c_nationkey g, c_custkey pid, c_custkey * 7919 % 400 * 1.25::DOUBLE x, c_custkey * 104729 % 300 * 1.5::DOUBLE y, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 5, c_custkey) i FROM customer),
 w AS (SELECT g, i, pid, pid leader, [struct_pack(p := pid, x := x, y := y)] heads FROM m WHERE i = 1
  UNION ALL SELECT m.g, m.i, m.pid, coalesce(list_filter(heads, lambda h: sqrt((h.x - m.x) * (h.x - m.x) + (h.y - m.y) * (h.y - m.y)) < 30)[1].p, m.pid),
   CASE WHEN len(list_filter(heads, lambda h: sqrt((h.x - m.x) * (h.x - m.x) + (h.y - m.y) * (h.y - m.y)) < 30)) > 0 THEN heads ELSE list_append(heads, struct_pack(p := m.pid, x := m.x, y := m.y)) END FROM w JOIN m ON m.g = w.g AND m.i = w.i + 1)
 SELECT pid, leader FROM w""")
def jn10_proximity_groups(spark, sf_dir):
    """Markers within thirty pixels of a group's first one, in a view for each nation."""
    k = F.col("c_custkey")
    marks = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("view"), k.alias("pid"), (k % 5).alias("priority"), (k * 7919 % 400 * 1.25).alias("x"), (k * 104729 % 300 * 1.5).alias("y"))
    return spatial.proximity_groups(marks).select("pid", "leader")


@query("""WITH RECURSIVE t AS (SELECT p_partkey % 3 a, p_partkey item, p_partkey * 31 % 57 + 4 w, p_size * 2 h FROM part), b AS (SELECT a, CAST(4 * ceil(greatest(max(w), sqrt(sum(w * h) * 1.15)) / 4) AS BIGINT) width FROM t GROUP BY 1),
 n AS (SELECT t.*, width, row_number() OVER (PARTITION BY t.a ORDER BY h DESC, item) i FROM t JOIN b ON t.a = b.a),
 s AS (SELECT a, i, item, CAST(0 AS BIGINT) x, CAST(0 AS BIGINT) y, CAST(w AS BIGINT) far, CAST(h AS BIGINT) high FROM n WHERE i = 1
  UNION ALL SELECT n.a, n.i, n.item, CASE WHEN far + w > width THEN 0 ELSE far END, CASE WHEN far + w > width THEN y + high ELSE y END, CASE WHEN far + w > width THEN w ELSE far + w END, CASE WHEN far + w > width THEN h ELSE greatest(high, h) END FROM s JOIN n ON n.a = s.a AND n.i = s.i + 1)
 SELECT item, CAST(x AS INTEGER) x, CAST(y AS INTEGER) y FROM s""")
def win04_shelf_pack(spark, sf_dir):
    """Three atlases of textures on shelves."""
    k = F.col("p_partkey")
    return spatial.shelf_pack(table(spark, sf_dir, "part").select((k % 3).alias("atlas"), k.alias("item"), (k * 31 % 57 + 4).alias("w"), (F.col("p_size") * 2).cast("long").alias("h"))).select("item", "x", "y")


FREE = "len(list_filter(put, lambda o: NOT ({q}.x0 >= o.x1 OR {q}.x1 <= o.x0 OR {q}.y0 >= o.y1 OR {q}.y1 <= o.y0))) = 0"


@query("""WITH RECURSIVE m AS (SELECT c_nationkey g, c_custkey pid, c_custkey * 7919 % 1300 - 40.0::DOUBLE x, c_custkey * 104729 % 950 - 20.0::DOUBLE y, 20.0::DOUBLE + c_custkey % 9 * 12 px, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 5, c_custkey) i FROM customer),
 b AS (SELECT *, x < 0 OR y < 0 OR x > 1200 OR y > 900 gone, {'x0': x - 13, 'x1': x + 13, 'y0': y - 13, 'y1': y + 13} mark, {'x0': x + 15, 'x1': x + 21 + px, 'y0': y - 13, 'y1': y + 13} r, {'x0': x - 21 - px, 'x1': x - 15, 'y0': y - 13, 'y1': y + 13} l FROM m),
 w AS (SELECT g, CAST(0 AS BIGINT) i, CAST(NULL AS BIGINT) pid, '' side, CAST([] AS STRUCT(x0 DOUBLE, x1 DOUBLE, y0 DOUBLE, y1 DOUBLE)[]) put FROM (SELECT DISTINCT g FROM m)
  UNION ALL SELECT g, i, pid, side, CASE side WHEN 'outside' THEN put WHEN 'right' THEN list_concat(put, [mark, r]) WHEN 'left' THEN list_concat(put, [mark, l]) ELSE list_append(put, mark) END
  FROM (SELECT b.g, b.i, b.pid, mark, r, l, put, CASE WHEN gone THEN 'outside' WHEN """ + FREE.format(q="r") + " AND r.x1 < 1200 THEN 'right' WHEN " + FREE.format(q="l") + """ AND l.x0 > 0 THEN 'left' ELSE 'hidden' END side FROM w JOIN b ON b.g = w.g AND b.i = w.i + 1))
 SELECT pid, side FROM w WHERE i > 0""")
def jn11_place_labels(spark, sf_dir):
    """Labels of markers in a view for each nation, some beyond its borders."""
    k = F.col("c_custkey")
    marks = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("view"), k.alias("pid"), (k % 5).alias("priority"), (k * 7919 % 1300 - 40.0).alias("x"), (k * 104729 % 950 - 20.0).alias("y"), (k % 9 * 12 + 20.0).alias("label_px"),
        F.lit(1200.0).alias("view_width"), F.lit(900.0).alias("view_height"))
    return spatial.place_labels(marks).select("pid", "side")
