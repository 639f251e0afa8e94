"""Scalar functions over customers, orders, pages and events, with coordinates made from keys by a fixed formula."""

from pyspark.sql import functions as F

from orograph.functions import geodesy as G
from orograph.functions import matrix as M
from orograph.functions import mesh as ME
from orograph.functions import text as T
from orograph.functions import web
from orograph.operators import catalogue, meshes, requests, spatial
from orograph.plans.tables import query, table
from orograph.shared import numbered
from orograph.shared import settled

PI = "3.141592653589793"


def places(spark, sf_dir):
    """Customers at longitudes from -74.5 and latitudes from 4."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (k % 1000 / 1000.0 - 74.5).alias("lon"), (k % 700 / 500.0 + 4.0).alias("lat"), (k % 300 * 10.0).alias("h"))


PLACES = "WITH p AS (SELECT c_custkey id, c_custkey % 1000 / 1000.0::DOUBLE - 74.5 lon, c_custkey % 700 / 500.0::DOUBLE + 4.0 lat, c_custkey % 300 * 10.0::DOUBLE h FROM customer)"
E2 = repr(G.E2)
ECEF = PLACES + f", n AS (SELECT *, 6378137.0 / sqrt(1 - {E2} * sin(radians(lat)) * sin(radians(lat))) nn FROM p), e AS (SELECT id, lon, lat, h, (nn + h) * cos(radians(lat)) * cos(radians(lon)) x, (nn + h) * cos(radians(lat)) * sin(radians(lon)) y, (nn * (1 - {E2}) + h) * sin(radians(lat)) z FROM n)"


def _r(df, digits, *columns):
    return df.select("id", *(F.round(c, digits).alias(c) for c in columns))


def ecef(spark, sf_dir):
    x, y, z = G.to_ecef("lon", "lat", "h")
    return places(spark, sf_dir).withColumns({"x": x, "y": y, "z": z})


@query(ECEF + " SELECT id, round(x, 4) x, round(y, 4) y, round(z, 4) z FROM e")
def sca07_to_ecef(spark, sf_dir):
    return _r(ecef(spark, sf_dir), 4, "x", "y", "z")


@query(PLACES + " SELECT id, round(lon, 7) lon, round(lat, 7) lat, round(h, 3) h FROM p")
def sca08_from_ecef(spark, sf_dir):
    """There and back is where it started."""
    lon, lat, h = G.from_ecef("x", "y", "z", G.E2)
    return ecef(spark, sf_dir).select("id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"), F.round(h, 3).alias("h"))


LON0, LAT0 = -74.0, 4.7
AXES, ORIGIN = G.enu_axes(LON0, LAT0), G.ecef_of(LON0, LAT0)
ENU = ", ".join(f"round({a[0]!r} * (x - ({ORIGIN[0]!r})) + {a[1]!r} * (y - ({ORIGIN[1]!r})) + {a[2]!r} * (z - ({ORIGIN[2]!r})), 3) {n}" for a, n in zip(AXES, ("east", "north", "up"), strict=True))


@query(ECEF + f" SELECT id, {ENU} FROM e")
def sca10_enu(spark, sf_dir):
    e, n, u = G.to_enu("x", "y", "z", LON0, LAT0)
    return _r(ecef(spark, sf_dir).withColumns({"east": e, "north": n, "up": u}), 3, "east", "north", "up")


@query(PLACES + f" SELECT id, round(radians(lon - ({LON0})) * 6378137.0 * cos(radians({LAT0})), 4) e, round(radians(lat - {LAT0}) * 6378137.0, 4) n, round(lon, 9) lon2, round(lat, 9) lat2 FROM p")
def sca11_local_metres(spark, sf_dir):
    e, n = G.local_metres("lon", "lat", LON0, LAT0)
    df = places(spark, sf_dir).withColumns({"e": e, "n": n})
    lon, lat = G.from_local_metres("e", "n", LON0, LAT0)
    df = df.withColumns({"lon2": lon, "lat2": lat})
    return df.select("id", F.round("e", 4).alias("e"), F.round("n", 4).alias("n"), F.round("lon2", 9).alias("lon2"), F.round("lat2", 9).alias("lat2"))


TX, TY = "(lon + 180) / 360 * 32768.0", f"(1 - asinh(tan(radians(lat))) / {PI}) / 2 * 32768.0"


@query(PLACES + f" SELECT id, CAST(floor({TX}) AS BIGINT) tx, CAST(floor({TY}) AS BIGINT) ty, round(least(greatest(({TX} - floor({TX})) * 256, 0), 254.999), 4) px, round(least(greatest(({TY} - floor({TY})) * 256, 0), 254.999), 4) py FROM p")
def sca18_tile_and_pixel(spark, sf_dir):
    tx, ty = G.tile_of("lon", "lat", 15)
    px, py = G.pixel_of("lon", "lat", 15)
    return places(spark, sf_dir).select("id", tx.alias("tx"), ty.alias("ty"), F.round(px, 4).alias("px"), F.round(py, 4).alias("py"))


@query("SELECT c_custkey id, round(c_custkey % 512 / 512.0::DOUBLE * 360 - 180, 8) west, round(degrees(atan((exp(a) - exp(-a)) / 2)), 8) south, round((c_custkey % 512 + 1) / 512.0::DOUBLE * 360 - 180, 8) east, round(degrees(atan((exp(b) - exp(-b)) / 2)), 8) north FROM (SELECT c_custkey, " + PI + " * (1 - 2 * (c_custkey % 300 + 1) / 512.0::DOUBLE) a, " + PI + " * (1 - 2 * (c_custkey % 300) / 512.0::DOUBLE) b FROM customer)")
def sca19_tile_bounds(spark, sf_dir):
    k = F.col("c_custkey")
    w, s, e, n = G.tile_bounds(k % 512, k % 300, F.lit(9))
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.round(w, 8).alias("west"), F.round(s, 8).alias("south"), F.round(e, 8).alias("east"), F.round(n, 8).alias("north"))


@query("SELECT l_orderkey, l_linenumber, (l_partkey >> 16 & 255) * 256.0 + (l_partkey >> 8 & 255) + (l_partkey & 255) / 256.0::DOUBLE - 32768.0 h FROM lineitem")
def sca21_decode_height(spark, sf_dir):
    k = F.col("l_partkey")
    byte = lambda s: F.shiftright(k, s).bitwiseAND(F.lit(255))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.decode_height(byte(16), byte(8), byte(0)).alias("h"))


@query("WITH v AS (SELECT o_orderkey, CAST(least(greatest(floor((o_totalprice / 50 - 1000 + 32768.0) * 256 + 0.5), 0), 16777215) AS BIGINT) v FROM orders) SELECT o_orderkey, CAST(v >> 16 AS INTEGER) r, CAST(v >> 8 & 255 AS INTEGER) g, CAST(v & 255 AS INTEGER) b FROM v")
def sca22_encode_height(spark, sf_dir):
    r, g, b = G.encode_height(F.col("o_totalprice") / 50 - 1000)
    return table(spark, sf_dir, "orders").select("o_orderkey", r.alias("r"), g.alias("g"), b.alias("b"))


@query("WITH p AS (SELECT c_custkey id, c_custkey % 7 / 7.0::DOUBLE u, c_custkey % 5 / 5.0::DOUBLE v, CAST(c_custkey % 3 AS INTEGER) c, CAST(c_custkey // 3 % 3 AS INTEGER) r FROM customer) SELECT id, round((r * 4 + c) * (1 - u) * (1 - v) + (r * 4 + c + 1) * u * (1 - v) + ((r + 1) * 4 + c) * (1 - u) * v + ((r + 1) * 4 + c + 1) * u * v, 9) h FROM p")
def sca20_bilinear(spark, sf_dir):
    k = F.col("c_custkey")
    px, py = k % 3 + k % 7 / 7.0, F.floor(k / 3) % 3 + k % 5 / 5.0
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.round(G.bilinear(F.array(*(F.lit(float(i)) for i in range(16))), px, py, 4), 9).alias("h"))


@query("SELECT c_custkey id, c_custkey * 2.0::DOUBLE + 10 x, c_custkey % 7 * 2.0::DOUBLE + 20 y, c_custkey % 5 * 2.0::DOUBLE + 30 z FROM customer")
def sca12_matrix_product(spark, sf_dir):
    """A move after a scaling, applied to points."""
    m = M.product(M.literal(M.trs((10, 20, 30))), M.literal(M.trs(scale=(2, 2, 2))))
    k = F.col("c_custkey").cast("double")
    x, y, z = M.apply(m, k, k % 7, k % 5)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), x.alias("x"), y.alias("y"), z.alias("z"))


def _grouped(orders):
    from orograph.functions.quantiles import fixed

    return orders.select("o_orderkey", T.grouped_number(fixed("o_totalprice", 2)).alias("t"))


@query("SELECT o_orderkey, regexp_replace(regexp_replace(replace(replace(replace(format('{:,.2f}', floor(o_totalprice * 100 + 0.5) / 100), ',', '_'), '.', ','), '_', '.'), '0+$', ''), ',$', '') t FROM orders")
def sca01_grouped_number(spark, sf_dir):
    """Trailing zeros of the decimals aren't written, nor a comma before none."""
    return _grouped(table(spark, sf_dir, "orders"))


MONTHS = "['" + "','".join(T.MONTHS) + "']"


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN {MONTHS}[month(o_orderdate)] || ' de ' || year(o_orderdate) WHEN o_orderkey % 7 = 0 THEN '' ELSE day(o_orderdate) || ' de ' || {MONTHS}[month(o_orderdate)] || ' de ' || year(o_orderdate) END t FROM orders")
def sca05_survey_date(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 5 == 0, F.substring(day, 1, 7)).when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(day)
    return table(spark, sf_dir, "orders").select("o_orderkey", T.survey_date(text).alias("t"))


@query(f"SELECT o_orderkey, day(o_orderdate) || ' de ' || {MONTHS}[month(o_orderdate)] || ' de ' || year(o_orderdate) t FROM orders")
def sca04_long_date(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.long_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("t"))


PATHS = "p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN '/' || page_id || '/v2/a.json' WHEN 2 THEN './x/' || page_id || '.GLB' WHEN 3 THEN '' ELSE 'm/' || page_id || '.b3dm' END t FROM pages)"


def some_paths(spark, sf_dir):
    k = F.col("page_id")
    t = F.when(k % 5 == 0, F.col("url")).when(k % 5 == 1, F.concat(F.lit("/"), k, F.lit("/v2/a.json"))).when(k % 5 == 2, F.concat(F.lit("./x/"), k, F.lit(".GLB"))).when(k % 5 == 3, "").otherwise(F.concat(F.lit("m/"), k, F.lit(".b3dm")))
    return table(spark, sf_dir, "pages").select("page_id", t.alias("t"))


@query("WITH " + PATHS + " SELECT page_id, CASE WHEN t = '' THEN '' WHEN regexp_matches(t, '^https?://') OR starts_with(t, '/') THEN t ELSE 'https://tiles.example/' || regexp_replace(t, '^\\.?/+', '') END u FROM p")
def prj01_joined_url(spark, sf_dir):
    return some_paths(spark, sf_dir).select("page_id", T.joined_url("https://tiles.example/", "t").alias("u"))


TYPES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in web.CONTENT_TYPES.items())


@query("WITH " + PATHS + f" SELECT page_id, CASE lower(split_part(t, '.', -1)) {TYPES} ELSE 'text/plain' END kind, CASE WHEN regexp_matches(t, '^/[a-z0-9-]+/v\\d+/') THEN '{web.LONG_CACHE}' ELSE '{web.SHORT_CACHE}' END cache FROM p")
def sca32_33_type_and_cache(spark, sf_dir):
    return some_paths(spark, sf_dir).select("page_id", web.content_type("t", F.lit("text/plain")).alias("kind"), web.cache_policy("t").alias("cache"))


@query("WITH e AS (SELECT event_id, 1000 + event_id % 50 size, event_id % 100 a, event_id % 100 + event_id % 17 b, event_id % 4 k FROM events) SELECT event_id, CASE k WHEN 0 THEN 'bytes ' || a || '-' || b || '/' || size WHEN 1 THEN 'bytes ' || a || '-' || (size - 1) || '/' || size WHEN 2 THEN CASE WHEN a > 0 THEN 'bytes ' || (size - a) || '-' || (size - 1) || '/' || size END END r FROM e")
def sca34_byte_range(spark, sf_dir):
    k = F.col("event_id")
    a, b = k % 100, k % 100 + k % 17
    header = F.when(k % 4 == 0, F.concat(F.lit("bytes="), a, F.lit("-"), b)).when(k % 4 == 1, F.concat(F.lit("bytes="), a, F.lit("-"))).when(k % 4 == 2, F.concat(F.lit("bytes=-"), a)).otherwise("items=1-2")
    return table(spark, sf_dir, "events").select("event_id", web.byte_range(header, (k % 50 + 1000).cast("long"))["text"].alias("r"))


ORIGINS, PREVIEW = ("https://a.example", "http://localhost:3000"), r"^https://preview(-[a-z0-9-]+)?\.example$"


@query("WITH o AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'https://a.example' WHEN 1 THEN 'https://preview-' || event_id || '.example' WHEN 2 THEN 'https://b.example' WHEN 3 THEN '' END o FROM events) SELECT event_id, coalesce(o IN ('https://a.example', 'http://localhost:3000') OR regexp_matches(o, '^https://preview(-[a-z0-9-]+)?\\.example$'), false) ok FROM o")
def sca35_origins(spark, sf_dir):
    k = F.col("event_id") % 5
    origin = F.when(k == 0, "https://a.example").when(k == 1, F.concat(F.lit("https://preview-"), F.col("event_id"), F.lit(".example"))).when(k == 2, "https://b.example").when(k == 3, "")
    return table(spark, sf_dir, "events").select("event_id", web.is_allowed_origin(origin, ORIGINS, PREVIEW).alias("ok"))


def tile_requests(spark, sf_dir):
    """Requests made from events: a method, a path, a range and a tag from the id."""
    k = F.col("event_id")
    method = F.when(k % 17 == 0, "OPTIONS").when(k % 19 == 0, "POST").when(k % 11 == 0, "HEAD").otherwise("GET")
    path = F.when(k % 23 == 0, "/").when(k % 29 == 0, "/a/../b.json").when(k % 31 == 0, "/x%zz").when(k % 3 == 0, F.concat(F.lit("/t/v1/"), F.col("user_id") % 40, F.lit(".glb"))).otherwise(F.concat(F.lit("/t/"), F.col("user_id") % 60, F.lit(".json")))
    return table(spark, sf_dir, "events").select(k.alias("req_id"), method.alias("method"), path.alias("path"), F.lit(None).cast("string").alias("origin"), F.when(k % 13 == 0, "bytes=0-99").alias("range_header"), F.when(k % 7 == 0, F.lit("e7")).alias("if_none_match"))


REQUESTS = """r AS (SELECT event_id req_id, CASE WHEN event_id % 17 = 0 THEN 'OPTIONS' WHEN event_id % 19 = 0 THEN 'POST' WHEN event_id % 11 = 0 THEN 'HEAD' ELSE 'GET' END m,
 CASE WHEN event_id % 23 = 0 THEN '/' WHEN event_id % 29 = 0 THEN '/a/../b.json' WHEN event_id % 31 = 0 THEN '/x%zz' WHEN event_id % 3 = 0 THEN '/t/v1/' || (user_id % 40) || '.glb' ELSE '/t/' || (user_id % 60) || '.json' END p,
 event_id % 13 = 0 rg, event_id % 7 = 0 tag, user_id % 60 < 50 known, event_id % 3 = 0 ver, event_id % 23 = 0 OR event_id % 29 = 0 bad, event_id % 31 = 0 esc FROM events),
 s AS (SELECT *, CASE WHEN m = 'OPTIONS' THEN 204 WHEN m = 'POST' THEN 405 WHEN bad THEN 404 WHEN esc THEN 400 WHEN NOT ver AND NOT known THEN 404 WHEN m = 'GET' AND tag THEN 304 WHEN rg THEN 206 ELSE 200 END status FROM r)"""


def stored_objects(spark):
    ids = spark.range(60)
    glb = ids.where("id < 40").select(F.concat(F.lit("t/v1/"), "id", F.lit(".glb")).alias("key"))
    js = ids.where("id < 50").select(F.concat(F.lit("t/"), "id", F.lit(".json")).alias("key"))
    return glb.union(js).select("key", F.lit(1000).cast("long").alias("size"), F.lit(None).cast("string").alias("stored_type"), F.lit("e7").alias("etag"))


@query("WITH " + REQUESTS + " SELECT req_id, status FROM s")
def sca36_status(spark, sf_dir):
    return requests.answer(tile_requests(spark, sf_dir), stored_objects(spark)).select("req_id", "status")


@query("WITH " + REQUESTS + ", k AS (SELECT *, NOT bad AND NOT esc AND ver AND NOT rg AND status IN (200, 304) kept FROM s), w AS (SELECT *, coalesce(max(CASE WHEN kept AND m = 'GET' AND status = 200 THEN 1 ELSE 0 END) OVER (PARTITION BY p ORDER BY req_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) stored FROM k) SELECT req_id, CASE WHEN kept AND stored = 1 THEN 'HIT' WHEN m = 'GET' AND status IN (200, 206) THEN 'MISS' END x_cache FROM w")
def str07_edge_cache(spark, sf_dir):
    return requests.edge_cache(requests.answer(tile_requests(spark, sf_dir), stored_objects(spark))).select("req_id", "x_cache")


@query("SELECT status, n FROM (SELECT 'publicado' status, count(*) n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'en proceso', count(*) FROM orders WHERE o_orderstatus = 'O') WHERE n > 0")
def agg24_counts_by_status(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "publicado").when(F.col("o_orderstatus") == "O", "en proceso").alias("estado"))
    return catalogue.counts_by_status(rows).withColumnRenamed("estado", "status")


CARD = "SELECT c_custkey id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name || ', ' END || c_mktsegment lugar FROM customer"


@query("SELECT c_custkey id, 0 pos, 'Lugar' field, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_name || ', ' || c_mktsegment END AS value FROM customer UNION ALL SELECT c_custkey, 1, 'Captura', c_mktsegment FROM customer WHERE c_custkey % 2 = 0")
def prj04_card(spark, sf_dir):
    """Place (left out where the municipality starts with it) and capture; everything else of these surveys is unknown."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k.alias("slug"), F.col("c_name").alias("lugar"), F.when(k % 3 == 0, F.col("c_name")).otherwise(F.col("c_mktsegment")).alias("municipio"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit(False).alias("coordenadas_aprox"),
        F.lit(None).cast("long").alias("fotos"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("captura"), F.lit(None).cast("double").alias("altura_m"), F.lit(None).cast("double").alias("gsd_cm"), F.lit(None).cast("string").alias("dron"), F.lit("").alias("camara"), F.lit(None).cast("string").alias("licencia"))
    return catalogue.card_rows(rows).withColumnRenamed("slug", "id")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 AND o_custkey <= (SELECT max(c_custkey) FROM customer) THEN o_custkey END slug FROM orders")
def prj08_requested_keys(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("slug"))
    return catalogue.requested(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("slug")), known)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END DESC, reverse(CAST(o_orderkey AS VARCHAR))) place FROM orders")
def srt01_catalogue_order(spark, sf_dir):
    """The place of each survey by the order of ``catalogue.in_order``; keys are the order numbers' digits read backwards, which no sort by number gives."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("fecha"), F.reverse(F.col("o_orderkey").cast("string")).alias("slug"))
    return numbered(rows, catalogue.order(), "place").select("o_orderkey", (F.col("place") + 1).alias("place"))


@query("SELECT c_custkey id, round(((x1 * y2 - x2 * y1) + (x2 * y3 - x3 * y2) + (x3 * y1 - x1 * y3)) / 2, 6) area FROM (SELECT c_custkey, c_acctbal / 100 x1, c_nationkey * 1.0::DOUBLE y1, c_custkey % 17 * 1.5::DOUBLE x2, c_acctbal / 50 y2, c_custkey % 5 - 9.0::DOUBLE x3, c_custkey % 11 * 2.0::DOUBLE y3 FROM customer)")
def agg25_ring_area(spark, sf_dir):
    """Triangles of either direction, closed."""
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    p = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    first = p(b / 100, F.col("c_nationkey") * 1.0)
    ring = F.array(first, p(k % 17 * 1.5, b / 50), p(k % 5 - 9.0, k % 11 * 2.0), first)
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.round(spatial.ring_area(ring), 6).alias("area"))


BOX = "lon BETWEEN -74.2 AND -73.8 AND lat BETWEEN 4.4 AND 5.0"


def _in_ring(pts, ring):
    hits = spatial.points_in_rings(pts.select(F.col("id").alias("pid"), "lon", "lat"), ring, 0.1)
    return pts.join(hits.select(F.col("pid").alias("id"), F.lit(True).alias("hit")), "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("inside"))


@query(PLACES + " SELECT id, lon >= -74.2 AND lon < -73.8 AND lat >= 4.4 AND lat < 5.0 inside FROM p")
def jn07_point_in_ring(spark, sf_dir):
    """With points on the border: the left and the lower side are within, the others aren't."""
    p = lambda x, y: F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat"))
    ring = spark.range(1).select(F.col("id").alias("rid"), F.array(p(-74.2, 4.4), p(-73.8, 4.4), p(-73.8, 5.0), p(-74.2, 5.0), p(-74.2, 4.4)).alias("ring"))
    return _in_ring(places(spark, sf_dir), ring)


@query(PLACES + f" SELECT id, CASE WHEN lon > -74.2 AND lon < -73.8 AND lat > 4.4 AND lat < 5.0 THEN round(least(1, least(least((lon + 74.2), (-73.8 - lon)) * {PI} / 180 * 6378137.0 * cos(radians(lat)), least(lat - 4.4, 5.0 - lat) * {PI} / 180 * 6378137.0) / 5000), 4) ELSE 0 END w FROM p")
def sca23_sink_weight(spark, sf_dir):
    """With points on the border, where the ramp begins with 0."""
    p = lambda x, y: F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat"))
    ring = F.array(p(-74.2, 4.4), p(-73.8, 4.4), p(-73.8, 5.0), p(-74.2, 5.0), p(-74.2, 4.4))
    return places(spark, sf_dir).select("id", F.round(spatial.sink_weight(ring, F.col("lon"), F.col("lat"), 5000.0), 4).alias("w"))


def _small_rules(customers):
    k = F.col("c_custkey")
    kind = F.when(k % 4 == 0, "fill-extrusion").when(k % 4 == 1, "symbol").otherwise("line")
    return customers.select(k.alias("id"), ME.layer_group(kind).alias("grp"), ME.multiple_of_four(k % 50).alias("four"), ME.cache_budget_mb(k % 900, k % 9).alias("mb"))


@query("SELECT c_custkey id, CASE WHEN c_custkey % 4 = 0 THEN 'buildings' WHEN c_custkey % 4 = 1 THEN 'names' END grp, CAST(greatest(4, CEIL((c_custkey % 50) / 4.0) * 4) AS INTEGER) four, CASE WHEN c_custkey % 900 < 640 THEN 600 WHEN c_custkey % 9 <= 4 THEN 1024 ELSE 1536 END mb FROM customer")
def sca40_41_prj18_small_rules(spark, sf_dir):
    """With a size of 0, which takes four."""
    return _small_rules(table(spark, sf_dir, "customer"))


@query("SELECT o_orderkey, x - 2 * floor(x / 2) + 0 d FROM (SELECT o_orderkey, o_orderkey % 7 x FROM orders)")
def jn17_differences(spark, sf_dir):
    """How many places differ between an array and one with its first place changed for odd keys."""
    x = F.col("o_orderkey") % 7
    a = F.array(x, x + 1, x + 2)
    b = F.array(F.when(x % 2 == 1, x + 9).otherwise(x), x + 1, x + 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", meshes.count_differences(a, b).cast("double").alias("d"))


@query("SELECT c_custkey id, round((floor(c_custkey % 100 * 0.037::DOUBLE / 0.1::DOUBLE + 0.5) / 10)::DOUBLE, 6) q, CAST(c_custkey % 60 AS DOUBLE) + 0.5 parsed FROM customer")
def sca30_42_quantise_and_parse(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.concat(F.lit(" "), k % 60, F.lit(",5 "))
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.round(T.quantised(k % 100 * 0.037), 6).alias("q"), T.parsed_decimal(text).alias("parsed"))


@query("SELECT p_partkey id, kind = 'symbol' AND layer <> 'poi' AND NOT regexp_matches(layer, 'shield|one_way') AND NOT starts_with(layer, 'poi') place, CASE kind WHEN 'fill-extrusion' THEN 'buildings' WHEN 'symbol' THEN 'names' END layer_group FROM (SELECT p_partkey, ['symbol', 'line', 'fill-extrusion'][CAST(p_partkey % 3 + 1 AS INTEGER)] kind, ['poi', 'poi_z14', 'road_shield', 'one_way_arrow', 'town'][CAST(p_partkey % 5 + 1 AS INTEGER)] || CASE WHEN p_partkey % 2 = 0 AND p_partkey % 5 > 0 THEN '-' || p_brand ELSE '' END layer FROM part)")
def prj19_place_labels(spark, sf_dir):
    """Which layers of a style are labels of places."""
    from orograph.functions import mesh as M

    k = F.col("p_partkey")
    kinds, names = F.array(*map(F.lit, ("symbol", "line", "fill-extrusion"))), F.array(*map(F.lit, ("poi", "poi_z14", "road_shield", "one_way_arrow", "town")))
    layer = F.concat(F.get(names, (k % 5).cast("int")), F.when((k % 2 == 0) & (k % 5 > 0), F.concat(F.lit("-"), "p_brand")).otherwise(""))
    rows = table(spark, sf_dir, "part").select(k.alias("id"), F.get(kinds, (k % 3).cast("int")).alias("kind"), layer.alias("layer"))
    return rows.select("id", M.is_place_label(F.col("kind"), F.col("layer")).alias("place"), M.layer_group(F.col("kind")).alias("layer_group"))
