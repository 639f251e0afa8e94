"""Formulas and catalogue rules that the other modules don't show: georeferencing, cameras, texts and orders, over customers, orders and nations."""

import math

from pyspark.sql import functions as F

from orograph.functions import geodesy as G
from orograph.functions import matrix as M
from orograph.functions import text as T
from orograph.operators import catalogue, stateful, terrain, tiletree
from orograph.plans.event_plans import ORDER, E, keyed_events
from orograph.plans.scalar_plans import PLACES, places
from orograph.plans.tables import query, table


def _eighths(v: str) -> str:
    return f"replace(regexp_replace(regexp_replace(CAST(abs({v}) / 8 AS DECIMAL(12, 3))::VARCHAR, '0+$', ''), '\\.$', ''), '.', ',')"


@query(f"SELECT c_custkey id, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE {_eighths('c_custkey % 180 - 90')} || '° ' || CASE WHEN c_custkey % 180 >= 90 THEN 'N' ELSE 'S' END || ', ' || {_eighths('c_custkey % 360 - 180')} || '° ' || CASE WHEN c_custkey % 360 >= 180 THEN 'E' ELSE 'O' END END t FROM customer")
def sca02_coordinates(spark, sf_dir):
    """Eighths of a degree; each ninth place has no latitude."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), T.coordinates(F.when(k % 9 != 0, (k % 180 - 90) / 8.0), (k % 360 - 180) / 8.0).alias("t"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Con modelo 3D' WHEN 'O' THEN 'Modelo en proceso' ELSE o_orderstatus END t FROM orders")
def sca03_status_label(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "publicado").when(F.col("o_orderstatus") == "O", "en proceso").otherwise(F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.status_label(status).alias("t"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'https://set.example' ELSE CASE page_id % 3 WHEN 0 THEN 'http' ELSE 'https' END || '://' || page_id || '.example' END t FROM pages")
def sca06_base_url(spark, sf_dir):
    k = F.col("page_id")
    proto = F.when(k % 3 == 0, "http,https").when(k % 3 == 1, "")
    return table(spark, sf_dir, "pages").select("page_id", T.base_url(F.when(k % 4 == 0, "https://set.example").otherwise(""), proto, F.concat(k, F.lit(".example"))).alias("t"))


@query("SELECT c_custkey id, isfinite(v) AND v IS NOT NULL ok, CASE WHEN isfinite(v) THEN v END n FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 'inf'::DOUBLE WHEN 3 THEN -c_acctbal ELSE c_acctbal END v FROM customer)")
def sca43_number_guards(spark, sf_dir):
    k = F.col("c_custkey") % 5
    v = F.when(k == 1, float("nan")).when(k == 2, float("inf")).when(k == 3, -F.col("c_acctbal")).when(k == 4, F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), T.is_number(v).alias("ok"), T.number_or_null(v).alias("n"))


@query("SELECT c_custkey id, least(greatest(c_acctbal, least(0.0, c_custkey % 40 * 10.0 - 100)), greatest(100.0, c_custkey % 40 * 10.0 - 100)) v FROM customer")
def sca31_clamped(spark, sf_dir):
    """Into 0 to 100, or as far as the stored value lies outside."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), T.clamped("c_acctbal", 0.0, 100.0, F.col("c_custkey") % 40 * 10.0 - 100).alias("v"))


R = repr(math.pi / 180)
E2, EP2 = repr(G.E2), repr(G.E2 / (1 - G.E2))


@query(PLACES + f", q AS (SELECT id, radians(lon + 75) dl, radians(lat) la FROM p) SELECT id, round(degrees(atan(tan(dl) * sin(la)) * (1 + (dl * dl * cos(la) * cos(la) / 3) * (1 + 3 * ({EP2} * cos(la) * cos(la))))), 9) convergence, round(0.9996 * (1 + (dl * dl * cos(la) * cos(la) / 2) * (1 + {EP2} * cos(la) * cos(la))), 12) scale FROM q")
def sca16_convergence_and_scale(spark, sf_dir):
    c, k = G.convergence_and_scale("lon", "lat", -75.0)
    return places(spark, sf_dir).select("id", F.round(c, 9).alias("convergence"), F.round(k, 12).alias("scale"))


@query(PLACES + " SELECT id, round(lon, 7) lon, round(lat, 7) lat FROM p")
def sca25_utm_round_trip(spark, sf_dir):
    """To the zone's metres and back."""
    e, n = G.to_utm("lon", "lat", 18)
    lon, lat = G.from_utm("e", "n", 18)
    return places(spark, sf_dir).withColumns({"e": e, "n": n}).select("id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


def _meridian(lat: str) -> str:
    e = G.E2
    parts = [repr(1 - e / 4 - 3 * e**2 / 64 - 5 * e**3 / 256), repr(3 * e / 8 + 3 * e**2 / 32 + 45 * e**3 / 1024), repr(15 * e**2 / 256 + 45 * e**3 / 1024), repr(35 * e**3 / 3072)]
    return f"6378137.0::DOUBLE * ({parts[0]} * {lat} - {parts[1]} * sin(2 * {lat}) + {parts[2]} * sin(4 * {lat}) - {parts[3]} * sin(6 * {lat}))"


@query(PLACES + f""", q AS (SELECT id, radians(lat) la, tan(radians(lat)) * tan(radians(lat)) t, {EP2} * cos(radians(lat)) * cos(radians(lat)) w, radians(lon + 75) * cos(radians(lat)) a, 6378137.0::DOUBLE / sqrt(1 - {E2} * sin(radians(lat)) * sin(radians(lat))) n FROM p)
 SELECT id, round(0.9996::DOUBLE * n * (a + (1 - t + w) * pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * w - 58 * {EP2}) * pow(a, 5) / 120) + 500000.0, 3) e, round(0.9996::DOUBLE * ({_meridian("la")} + n * tan(la) * (a * a / 2 + (5 - t + 9 * w + 4 * w * w) * pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * w - 330 * {EP2}) * pow(a, 6) / 720)), 3) n FROM q""")
def sca25_to_utm(spark, sf_dir):
    e, n = G.to_utm("lon", "lat", 18)
    return places(spark, sf_dir).select("id", F.round(e, 3).alias("e"), F.round(n, 3).alias("n"))


@query("SELECT c_custkey id, c_acctbal + coalesce(a, 0) + 1.5 - CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE coalesce(g, 0) END v FROM (SELECT *, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 10 * 0.5::DOUBLE END a, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey * 2.0::DOUBLE END g FROM customer)")
def sca26_anchor_altitude(spark, sf_dir):
    k = F.col("c_custkey")
    v = G.anchor_altitude("c_acctbal", F.when(k % 3 != 0, k % 10 * 0.5), F.when(k % 5 != 0, F.col("c_nationkey") * 2.0), k % 2 == 0)
    return table(spark, sf_dir, "customer").select(k.alias("id"), v.alias("v"))


@query(PLACES + f" SELECT id, round(log2(2 * pi() * 6378137.0 * cos(radians(lat)) / (2 * (h + 50) * tan({math.radians(36.87) / 2!r}) / 900.0::DOUBLE * 512)), 9) zoom FROM p")
def sca27_zoom(spark, sf_dir):
    return places(spark, sf_dir).select("id", F.round(G.zoom_for_distance(F.col("h") + 50, "lat", 900.0), 9).alias("zoom"))


@query(f"SELECT id, round(r / sin(least(atan(t * greatest(h - b, 120.0) / h), atan(t * greatest(w - l, 160.0) / h))) * 0.95, 6) d FROM (SELECT c_custkey id, c_custkey % 90 + 60.0::DOUBLE r, tan(radians(36.87::DOUBLE) / 2) t, 400.0::DOUBLE + c_custkey % 600 h, 300.0::DOUBLE + c_custkey % 1100 w, c_custkey % 350 * 1.0::DOUBLE b, c_custkey % 420 * 1.0::DOUBLE l FROM customer)")
def sca28_framing_distance(spark, sf_dir):
    k = F.col("c_custkey")
    d = G.framing_distance(k % 90 + 60.0, 36.87, k % 1100 + 300.0, k % 600 + 400.0, k % 420 * 1.0, k % 350 * 1.0)
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.round(d, 6).alias("d"))


@query("SELECT c_custkey id, round(sqrt(pow(c_custkey % 97, 2) + pow(c_custkey % 89, 2) + pow(c_custkey % 83, 2)), 9) d FROM customer")
def sca29_camera_distance(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.round(G.camera_distance(*((k % m).cast("double") for m in (97, 89, 83))), 9).alias("d"))


@query("SELECT c_custkey id, c_custkey % 97 * 1.0::DOUBLE x, -(c_custkey % 83 * 1.0::DOUBLE) y, c_custkey % 89 * 1.0::DOUBLE z FROM customer")
def sca14_axis_swap(spark, sf_dir):
    k = F.col("c_custkey")
    x, y, z = M.y_up_to_z_up(*((k % m).cast("double") for m in (97, 89, 83)))
    return table(spark, sf_dir, "customer").select(k.alias("id"), x.alias("x"), y.alias("y"), z.alias("z"))


QX, QY, QZ, QW = 0.18, 0.36, 0.54, 0.7391887445030532


@query(f"""WITH v AS (SELECT c_custkey id, c_custkey % 97 * 2.0::DOUBLE a, c_custkey % 89 * 3.0::DOUBLE b, c_custkey % 83 * 0.5::DOUBLE c FROM customer),
 t AS (SELECT *, 2 * ({QY} * c - {QZ} * b) tx, 2 * ({QZ} * a - {QX} * c) ty, 2 * ({QX} * b - {QY} * a) tz FROM v)
 SELECT id, round(a + {QW} * tx + {QY} * tz - {QZ} * ty + 10, 6) x, round(b + {QW} * ty + {QZ} * tx - {QX} * tz + 20, 6) y, round(c + {QW} * tz + {QX} * ty - {QY} * tx + 30, 6) z FROM t""")
def sca13_translation_rotation_scale(spark, sf_dir):
    """The matrix against the rotation of a vector by twice the cross product with the quaternion."""
    k = F.col("c_custkey")
    x, y, z = M.apply(M.literal(M.trs((10, 20, 30), (QX, QY, QZ, QW), (2, 3, 0.5))), *((k % m).cast("double") for m in (97, 89, 83)))
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(z, 6).alias("z"))


A, B, PIVOT, OFFSET = 0.02, 0.05, 30.0, 7.0


def _levelled(x: str, y: str, z: str) -> str:
    """Rodrigues' formula for the turn that takes the plane's normal (A, B, 1) to the vertical, applied to (x, y, z)."""
    n = math.sqrt(A * A + B * B + 1)
    c, s = 1 / n, math.hypot(A, B) / n
    kx, ky = B / math.hypot(A, B), -A / math.hypot(A, B)
    dot = f"({kx!r} * ({x}) + {ky!r} * ({y}))"
    return f"{c!r} * ({x}) + {s!r} * ({ky!r} * ({z})) + {kx!r} * {dot} * {1 - c!r} rx, {c!r} * ({y}) - {s!r} * ({kx!r} * ({z})) + {ky!r} * {dot} * {1 - c!r} ry, {c!r} * ({z}) + {s!r} * ({kx!r} * ({y}) - {ky!r} * ({x})) rz"


@query("SELECT id, round(rx, 6) x, round(ry, 6) y, round(rz, 6) z FROM (SELECT c_custkey id, " + _levelled("(c_custkey % 97)::DOUBLE", "(c_custkey % 89)::DOUBLE", "(c_custkey % 83)::DOUBLE") + " FROM customer)")
def sca15_tilt(spark, sf_dir):
    k = F.col("c_custkey")
    x, y, z = M.apply(M.literal(M.tilt(A, B)), *((k % m).cast("double") for m in (97, 89, 83)))
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(z, 6).alias("z"))


SPIN, SCALE, LON, LAT, HEIGHT = -0.4, 1 / 0.99972, -74.1, 4.65, 2600.0


def _georeferenced() -> str:
    """The chain one step after the other: axes, levelling about the pivot, offset, scale, spin, then the place's axes and position."""
    lo, la = math.radians(LON), math.radians(LAT)
    n = G.A / math.sqrt(1 - G.E2 * math.sin(la) ** 2)
    cg, sg = math.cos(math.radians(SPIN)), math.sin(math.radians(SPIN))
    east, north, up = (-math.sin(lo), math.cos(lo), 0.0), (-math.sin(la) * math.cos(lo), -math.sin(la) * math.sin(lo), math.cos(la)), (math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la))
    at = ((n + HEIGHT) * math.cos(la) * math.cos(lo), (n + HEIGHT) * math.cos(la) * math.sin(lo), (n * (1 - G.E2) + HEIGHT) * math.sin(la))
    world = ", ".join(f"round({e!r} * x3 + {m!r} * y3 + {u!r} * z2 + ({p!r}), 3) {name}" for e, m, u, p, name in zip(east, north, up, at, "xyz", strict=True))
    return (f"WITH a AS (SELECT c_custkey id, c_custkey % 97 * 1.0::DOUBLE x, c_custkey % 83 * -1.0::DOUBLE y, c_custkey % 89 - {PIVOT}::DOUBLE z FROM customer), b AS (SELECT id, {_levelled('x', 'y', 'z')} FROM a),"
            f" c AS (SELECT id, {SCALE!r}::DOUBLE * rx x2, {SCALE!r}::DOUBLE * ry y2, rz + {PIVOT} + {OFFSET}::DOUBLE z2 FROM b), d AS (SELECT id, {cg!r} * x2 - ({sg!r}) * y2 x3, {sg!r} * x2 + {cg!r} * y2 y3, z2 FROM c) SELECT id, {world} FROM d")


@query(_georeferenced())
def sca17_georeference(spark, sf_dir):
    """Points of a model with y up through its root matrix."""
    m = M.georeference(G.enu_frame(LON, LAT, HEIGHT), "y", SPIN, SCALE, (0, 0, OFFSET), (A, B), PIVOT)
    k = F.col("c_custkey")
    x, y, z = M.apply(M.literal(m), *((k % v).cast("double") for v in (97, 89, 83)))
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(z, 3).alias("z"))


@query(PLACES + f""", f AS (SELECT radians({LON}::DOUBLE) lo, radians({LAT}::DOUBLE) la), g AS (SELECT *, 6378137.0::DOUBLE / sqrt(1 - {E2} * sin(la) * sin(la)) n FROM f)
 SELECT id, round(-sin(lo) * lon - sin(la) * cos(lo) * lat + cos(la) * cos(lo) * h + n * cos(la) * cos(lo), 4) x, round(cos(lo) * lon - sin(la) * sin(lo) * lat + cos(la) * sin(lo) * h + n * cos(la) * sin(lo), 4) y, round(cos(la) * lat + sin(la) * h + n * (1 - {E2}) * sin(la), 4) z FROM p, g""")
def sca09_enu_frame(spark, sf_dir):
    """The frame applied to east, north, up, for which any three numbers do."""
    x, y, z = M.apply(M.literal(G.enu_frame(LON, LAT)), F.col("lon"), F.col("lat"), F.col("h"))
    return places(spark, sf_dir).select("id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(z, 4).alias("z"))


@query(PLACES + ", t AS (SELECT id, floor((lon + 180) / 360 * 32) tx, floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 32) ty, least(greatest(((lon + 180) / 360 * 32 - floor((lon + 180) / 360 * 32)) * 4, 0.0), 2.999) px, least(greatest(((1 - asinh(tan(radians(lat))) / pi()) / 2 * 32 - floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 32)) * 4, 0.0), 2.999) py FROM p) SELECT id, round(tx * 100 + ty * 10 + floor(py) * 4 + floor(px) + (px - floor(px)) + 4 * (py - floor(py)), 6) terrain FROM t")
def jn04_with_terrain(spark, sf_dir):
    """Height tiles of four by four pixels whose heights grow along both axes, so that a sample between them is known."""
    ids = spark.range(32 * 32).select((F.col("id") / 32).cast("int").alias("x"), (F.col("id") % 32).cast("int").alias("y"))
    tiles = ids.select(F.lit(5).alias("z"), "x", "y", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.col("x") * 100.0 + F.col("y") * 10.0 + i).alias("heights"))
    return terrain.with_terrain(places(spark, sf_dir), tiles, 5, size=4).select("id", F.round("terrain", 6).alias("terrain"))


@query("SELECT (c_custkey % 7)::INTEGER ix, round(sum(c_custkey * sqrt(c_custkey)) / sum(c_custkey), 6) n FROM customer GROUP BY 1")
def udf02_user_function_over_tiles(spark, sf_dir):
    """A user's function on the heights of each tile: the mean of their roots, weighted by the heights."""
    k = F.col("c_custkey")
    tiles = table(spark, sf_dir, "customer").groupBy((k % 7).cast("int").alias("ix")).agg(F.collect_list(k.cast("double")).alias("heights"))
    return terrain.mapped_tiles(tiles, lambda h: float((h * h**0.5).sum() / h.sum()), "double", name="n").select("ix", F.round("n", 6).alias("n"))


SURVEYS = "WITH s AS (SELECT n_nationkey k, n_name slug, CASE WHEN n_nationkey % 4 <> 0 THEN strftime(DATE '2024-01-01' + CAST(n_nationkey * 9 % 50 AS INTEGER), '%Y-%m-%d') END fecha, CASE WHEN n_nationkey % 3 = 0 THEN 'publicado' ELSE 'en proceso' END estado, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE 'm' || n_regionkey END municipio, 'l' || n_nationkey lugar FROM nation)"


def surveys(spark, sf_dir):
    k = F.col("n_nationkey")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k * 9 % 50).cast("int")), "yyyy-MM-dd")
    return table(spark, sf_dir, "nation").select(
        k.alias("k"), F.col("n_name").alias("slug"), F.when(k % 4 != 0, day).alias("fecha"), F.when(k % 3 == 0, "publicado").otherwise("en proceso").alias("estado"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("m"), "n_regionkey")).alias("municipio"), F.concat(F.lit("l"), k).alias("lugar"))


@query(SURVEYS + " SELECT slug, coalesce(nullif(municipio, ''), lugar) place FROM s")
def prj07_first_text(spark, sf_dir):
    return surveys(spark, sf_dir).select("slug", catalogue.place_name().alias("place"))


@query(SURVEYS + " SELECT slug, row_number() OVER (ORDER BY CASE WHEN k = 7 THEN 0 WHEN k = 3 THEN 1 WHEN estado = 'publicado' THEN 2 ELSE 3 END, k) place FROM s")
def srt02_priority(spark, sf_dir):
    """The selected survey, the highlighted one, those with a model, the rest; within these as they come."""
    s = surveys(spark, sf_dir)
    names = {r["k"]: r["slug"] for r in s.where("k in (3, 7)").select("k", "slug").collect()}
    return catalogue.by_priority(s, names.get(7), names.get(3), F.col("estado") == "publicado", "k").select("slug", "place")


@query(SURVEYS + " SELECT coalesce(string_agg(slug, '+' ORDER BY slug), '-') \"key\" FROM s WHERE estado = 'publicado'")
def srt06_active_key(spark, sf_dir):
    return catalogue.active_key(surveys(spark, sf_dir), F.col("estado") == "publicado")


@query(SURVEYS + " SELECT coalesce(string_agg(slug, '+' ORDER BY slug), '-') \"key\" FROM s WHERE estado = 'borrado'")
def srt06_no_active_key(spark, sf_dir):
    """A state that no survey has."""
    return catalogue.active_key(surveys(spark, sf_dir), F.col("estado") == "borrado")


@query(SURVEYS + ", e AS (SELECT 0 part, '' d, '' slug, 'https://a.example/' loc UNION ALL SELECT 1, coalesce(fecha, ''), slug, 'https://a.example/vuelos/' || slug FROM s) SELECT '<?xml version=\"1.0\" encoding=\"UTF-8\"?><urlset xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\">' || string_agg('<url><loc>' || loc || '</loc></url>', '' ORDER BY part, d DESC, slug) || '</urlset>' xml FROM e")
def set01_sitemap(spark, sf_dir):
    return catalogue.sitemap(surveys(spark, sf_dir), "https://a.example")


@query(SURVEYS + " SELECT slug, k, CASE WHEN k % 2 = 0 THEN 'done' ELSE 'failed' END state, CASE WHEN k % 2 = 0 THEN k * 3 END files, CASE WHEN k % 3 = 0 THEN 'n' || k ELSE 'none' END note FROM s")
def src22_collected_reports(spark, sf_dir):
    """Reports of even surveys and notes on each third; what is missing says so."""
    s = surveys(spark, sf_dir)
    reports = s.where("k % 2 = 0").select("slug", (F.col("k") * 3).alias("files"))
    notes = s.where("k % 3 = 0").select("slug", F.concat(F.lit("n"), "k").alias("note"))
    return catalogue.collected_reports(s.select("slug", "k"), reports, notes, "none").select("slug", "k", "state", "files", "note")


@query("SELECT count(*) FILTER (WHERE k) surveys, floor(sum(CASE WHEN k THEN o_totalprice END) * 10 + 0.5) / 10 total_mb, sum(CASE WHEN k THEN o_custkey END)::BIGINT files, count(*) FILTER (WHERE NOT k) failed FROM (SELECT *, o_orderkey % 6 <> 0 k FROM orders)")
def agg20_report_totals(spark, sf_dir):
    state = F.when(F.col("o_orderkey") % 6 != 0, "done").otherwise("failed")
    return catalogue.report_totals(table(spark, sf_dir, "orders").select(state.alias("state"), F.col("o_totalprice").alias("total_mb"), F.col("o_custkey").alias("files")))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_custkey % 7 < 4 THEN o_custkey % 7 END, 0) style_id FROM orders")
def prj10_chosen_style(spark, sf_dir):
    """Four styles; what isn't one of them is the first."""
    styles = spark.range(4).select(F.col("id").alias("style_id"), F.col("id").alias("ord"))
    return catalogue.chosen_style(table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 7).alias("style_id")), styles)


@query("SELECT p_name path, row_number() OVER (ORDER BY p_retailprice DESC, p_name) place FROM part")
def srt05_by_size(spark, sf_dir):
    """Files of most bytes first; of equal ones by name."""
    files = table(spark, sf_dir, "part").select(F.col("p_name").alias("path"), F.col("p_retailprice").alias("bytes"))
    return tiletree.by_size(files).select("path", "place")


@query("SELECT p_name path, row_number() OVER (ORDER BY p_retailprice, p_name) place FROM part")
def srt07_job_order(spark, sf_dir):
    """Small jobs first."""
    files = table(spark, sf_dir, "part").select(F.col("p_name").alias("path"), F.col("p_retailprice").alias("bytes"))
    return tiletree.by_size(files, largest_first=False).select("path", "place")


@query("WITH " + E + " SELECT seq FROM e WHERE t = 'error' ORDER BY ts DESC, seq DESC LIMIT 5")
def srt04_last_failures(spark, sf_dir):
    return stateful.last_failures(keyed_events(spark, sf_dir)).select("seq")


@query("WITH " + E + f", s AS (SELECT *, seq % 3 = 0 loading FROM e), c AS (SELECT *, coalesce(lag(loading) OVER ({ORDER}), false) was FROM s), d AS (SELECT k, ts, loading FROM c WHERE loading <> was), n AS (SELECT *, lead(ts) OVER (PARTITION BY k ORDER BY ts) stop FROM d) SELECT k, ts + 1200 notice_at, stop until FROM n WHERE loading AND (stop IS NULL OR stop - ts > 1200)")
def str04_loading_notices(spark, sf_dir):
    """Loading that lasts more than 1.2 s; a user loads while the event's number is a multiple of three."""
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("ts", "seq")
    rows = keyed_events(spark, sf_dir).withColumn("loading", F.col("seq") % 3 == 0)
    changes = rows.withColumn("was", F.coalesce(F.lag("loading").over(w), F.lit(False))).where("loading != was")
    return stateful.loading_notices(changes).select(F.col("key").alias("k"), "notice_at", "until")


@query("WITH " + E + " SELECT seq, CAST(i AS INTEGER) i, round(v / 100.0::DOUBLE * exp(-i * 16.0::DOUBLE / 180.0::DOUBLE), 9) v FROM e, range(1, 1000) t(i) WHERE abs(v / 100.0::DOUBLE * exp(-i * 16.0::DOUBLE / 180.0::DOUBLE)) >= 0.02")
def win06_decay(spark, sf_dir):
    """A motion runs out from the speed of each event."""
    rows = keyed_events(spark, sf_dir).select("seq", F.posexplode(stateful.decay(F.col("radius_px") / 100, most=999)).alias("i", "v"))
    return rows.select("seq", (F.col("i") + 1).alias("i"), F.round("v", 9).alias("v"))


@query("SELECT o_orderkey id, 'o' kind FROM orders UNION ALL SELECT l_orderkey, 'l' FROM lineitem UNION ALL SELECT c_custkey, 'c' FROM customer")
def set02_concatenated(spark, sf_dir):
    """Pages of nodes one after the other, repeated rows kept."""
    page = lambda t, k, kind: table(spark, sf_dir, t).select(F.col(k).alias("id"), F.lit(kind).alias("kind"))
    return tiletree.concatenated(page("orders", "o_orderkey", "o"), page("lineitem", "l_orderkey", "l"), page("customer", "c_custkey", "c"))
