"""Operators against plain Python over small fixtures."""

import json
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph.functions import matrix as M
from orograph.operators import catalogue, cells, footprint, meshes, requests, spatial, stateful, terrain, tiletree, weighted


def test_cells_border_and_minimum(spark):
    pts = [(x + 0.5, y + 0.5, float(k)) for x in range(-1, 2) for y in range(-1, 2) for k in range(20 if (x, y) != (1, 1) else 19)]
    df = spark.createDataFrame(pts, "x double, y double, z double")
    got = {(r.ix, r.iy): r for r in cells.grid_cells(df, "x", "y", "z", 1.0).collect()}
    assert len(got) == 8 and got[0, 0].n == 20 and not got[0, 0].border and got[-1, -1].border
    assert got[0, 0].p5 == pytest.approx(0.95) and got[0, 0].disp == pytest.approx(17.1)
    centre = cells.grid_cells(df, "x", "y", "z", 1.0, point="centre", definition="nearest_rank").where("ix = 0 and iy = 0").first()
    assert (centre.cx, centre.cy, centre.p5) == (0.5, 0.5, 1.0)


def test_summaries_and_plane(spark):
    r = random.Random(1)
    rows = [(x, y, 0.02 * x - 0.01 * y + 5, r.random() * 2, r.random() < 0.5) for x in (-20.0, -3.0, 0.0, 7.0, 19.0) for y in (-9.0, 0.0, 4.0)]
    df = spark.createDataFrame(rows, "x double, y double, res double, disp double, border boolean")
    p = cells.plane_fit(df).first()
    assert (p.points, p.a, p.b, p.c) == pytest.approx((15, 0.02, -0.01, 5))
    assert cells.plane_fit(df.limit(2)).first().a is None
    a = cells.after_fit(df, cells.plane_fit(df)).first()
    assert a.iqr == pytest.approx(0, abs=1e-9) and a.tilt == pytest.approx(math.degrees(math.atan(math.hypot(0.02, 0.01))))
    s = {x.selection: x for x in cells.residual_summaries(df).collect()}
    assert s["all"].cells == 15 and s["open"].cells == sum(x[3] < 1 for x in rows) and s["open_border"].cells == sum(x[3] < 1 and x[4] for x in rows)
    q = {x.quadrant: x.cells for x in cells.quadrant_summaries(df).collect()}
    assert q == {"NE": 2, "NO": 2, "SE": 2, "SO": 2}
    none = {x.selection: x.cells for x in cells.residual_summaries(df.limit(0)).collect()}
    assert none == {"all": 0, "open": 0, "open_border": 0}
    places = {x.place: (x.x, x.y) for x in cells.extreme_rows(df).collect()}
    assert places["west"][0] == -20 and places["north"][1] == 4 and len(places) == 5


def test_weighted_median(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 9.0, 2.0), ("b", 5.0, 0.0)], "tile string, density double, area double")
    assert [tuple(r) for r in weighted.weighted_median(df, "density", "area", ["tile"]).collect()] == [("a", 2.0, 4.0)]
    t = {r.tile: r.texel for r in weighted.texel_medians(df).collect()}
    assert t == {"a": pytest.approx(1 / math.sqrt(2)), "b": float("inf")}


def tree(spark, n=400, seed=3):
    r = random.Random(seed)
    rows = [(0, None, 0)] + [(i, r.randrange(max(0, i - 40), i), i) for i in range(1, n)]
    mesh = {i: (r.uniform(-9, 9), r.uniform(-9, 9), r.uniform(-9, 9)) for i in range(1, n)}
    return rows, mesh


def test_tree_fold_against_recursion(spark):
    rows, mesh = tree(spark)
    kids = defaultdict(list)
    for i, p, _ in rows:
        kids[p].append(i)

    def walk(i):
        below = [walk(c) for c in kids[i]]
        lo, hi = (list(mesh[i]), list(mesh[i])) if i in mesh else ([math.inf] * 3, [-math.inf] * 3)
        error = 0.0
        for b_lo, b_hi, e in below:
            lo, hi, error = [min(x) for x in zip(lo, b_lo, strict=True)], [max(x) for x in zip(hi, b_hi, strict=True)], max(error, e)
        half = [max((h - l) / 2, 0.01) for l, h in zip(lo, hi, strict=True)]
        mid = [(h + l) / 2 for l, h in zip(lo, hi, strict=True)]
        own = 0.0 if not below else max(16 * 0.05 if i in mesh else 0.0, error * 1.01, 0.01)
        own = max(own, error * 2) if below and i not in mesh else own
        out[i] = (mid, half, own)
        return [m - h for m, h in zip(mid, half, strict=True)], [m + h for m, h in zip(mid, half, strict=True)], own

    out = {}
    walk(0)
    df = spark.createDataFrame([(i, p, o, list(mesh[i]) if i in mesh else None, 0.05) for i, p, o in rows], "node_id long, parent_id long, ord int, p array<double>, texel double").withColumns({"lo": F.col("p"), "hi": F.col("p")})
    deep = tiletree.depths(df)
    got = {r.node_id: r for r in tiletree.fold(deep).collect()}
    for i, (mid, half, own) in out.items():
        b = got[i].box
        assert b[:3] == pytest.approx(mid) and [b[3], b[7], b[11]] == pytest.approx(half) and got[i].error == pytest.approx(own)
    assert {r.node_id for r in tiletree.leaves(df).collect()} == {i for i, *_ in rows if not kids[i]}
    with pytest.raises(ValueError):
        tiletree.depths(spark.createDataFrame([(1, 2), (2, 1)], "node_id long, parent_id long"), 8)


def test_first_view_follows_single_children(spark):
    rows = [(0, None, None), (1, 0, None), (2, 1, "a"), (10, None, None), (11, 10, "x"), (12, 10, "y")]
    df = tiletree.depths(spark.createDataFrame(rows, "node_id long, parent_id long, uri string"))
    assert {(r.root, r.node_id, r.uri) for r in tiletree.first_view(df).collect()} == {(0, 2, "a"), (10, 10, None)}


def test_subtrees_need_width_and_size(spark):
    rows = [(0, None)] + [(i, 0) for i in range(1, 9)] + [(i, i // 8) for i in range(9, 72)] + [(i, i // 24 + 8) for i in range(72, 1600)]
    df = tiletree.depths(spark.createDataFrame(rows, "node_id long, parent_id long"))
    got = {r.node_id: r.subtree_id for r in tiletree.subtrees(df, 1500).collect()}
    assert got[0] is None and got[5] is None and got[20] in (20, None) and any(v is not None for v in got.values())
    assert not any(r.subtree_id for r in tiletree.subtrees(df, 5000).collect())


def test_meshes(spark):
    v = spark.createDataFrame([("t", 0, 0.0, 0.0, 0.0, 0.0, 0.0), ("t", 1, 2.0, 0.0, 0.0, 1.0, 0.0), ("t", 2, 0.0, 2.0, 0.0, 0.0, 1.0), ("t", 3, 0.0, 0.0, 3.0, 0.5, 0.5), ("t", 4, -0.0, 0.0, 0.0, 0.0, 0.0), ("t", 5, 2.0, 0.0, 0.0, 1.0, 0.0)], "tile string, vid long, x double, y double, z double, u double, v double")
    t = spark.createDataFrame([("t", 0, 0, 1, 2), ("t", 1, 0, 1, 3), ("t", 2, 0, 1, 5)], "tile string, tid long, a long, b long, c long")
    c = meshes.with_normals(meshes.corners(t, v))
    assert {r.tid: r.area for r in c.collect()} == {0: 2.0, 1: 3.0, 2: 0.0}
    assert {r.tid for r in meshes.drop_walls(meshes.drop_degenerate(c)).collect()} == {0}
    assert meshes.wall_share(c).first()[0] == pytest.approx(200 / 3)
    w = {r.vid: r.weld_id for r in meshes.weld(v).collect()}
    assert w == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    assert {r.vid: r.weld_id for r in meshes.weld_rounded(v).collect()}[4] == 0
    vote = meshes.winding_vote(c, spark.createDataFrame([("t",)], "node_id string")).first()
    assert vote.vote == 4.0 and not vote.flip
    f = spark.createDataFrame([(1, [3, 1, 2, 7]), (2, [2, 9, 3])], "fid int, corners array<int>")
    assert {r.vid: r.new_id for r in meshes.renumbered(f).collect()} == {3: 1, 1: 2, 2: 3, 7: 4, 9: 5}
    assert [(r.a, r.b, r.c) for r in meshes.fan(f).where("fid = 1").orderBy("part").collect()] == [(3, 1, 2), (3, 2, 7)]
    pv = spark.createDataFrame([(i, float(i), 0.0) for i in range(10)], "vid int, x double, y double")
    assert {r.fid for r in meshes.clip_faces(f, pv, 0, -1, 7, 1).collect()} == {1}
    s = meshes.seeded_sample(pv, 4, 1)
    assert [r.vid for r in s.collect()] == [r.vid for r in meshes.seeded_sample(pv.repartition(5), 4, 1).collect()]
    hit = meshes.lowest_hit(spark.createDataFrame([(0.0, 0.0, 5.0, 4.0, 0.0, 5.0, 0.0, 4.0, 5.0), (0.0, 0.0, 2.0, 4.0, 0.0, 2.0, 0.0, 4.0, 6.0)], "ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double"), spark.createDataFrame([(1, 1.0, 1.0), (2, 9.0, 9.0)], "pid int, x double, y double"), 1.0)
    assert {r.pid: r.z_hit for r in hit.collect()} == {1: 3.0, 2: None}


def test_footprint_of_a_square_with_a_hole(spark):
    tri = []
    for x in range(0, 40, 2):
        for y in range(0, 40, 2):
            if not (16 <= x < 22 and 16 <= y < 22):
                tri += [("s", x + 0.1, y + 0.1, x + 1.9, y + 0.1, x + 0.1, y + 1.9)]
    tri.append(("s", 200.1, 200.1, 201.9, 200.1, 200.1, 201.9))
    df = spark.createDataFrame(tri, "slug string, ax double, ay double, bx double, by double, cx double, cy double")
    origin = spark.createDataFrame([("s", -74.0, 4.5)], "slug string, lon0 double, lat0 double")
    p = footprint.footprints(df, origin, close=1).first()
    # the opening takes the four corner cells; the hole is filled and the far triangle is not part of the largest component
    assert p.area_m2 == 1600 - 4 * 4 and p.ring[0] == p.ring[-1] and p.vertices == 12
    assert footprint.footprints(df, origin, close=1, open_=0).first().vertices == 4
    area = one_area(spark, p.ring)
    assert area > 0
    assert len(footprint.disk(1)) == 5 and len(footprint.disk(2)) == 13


def one_area(spark, ring):
    return spark.createDataFrame([(ring,)], f"ring {footprint.RING}").select(spatial.ring_area(F.col("ring"))).first()[0]


def kept_by_hand(points, tolerance):
    """Douglas-Peucker of an open line, by recursion."""
    if len(points) < 3:
        return [0, len(points) - 1][: len(points)]
    (ax, ay), (bx, by) = points[0], points[-1]
    size = math.hypot(bx - ax, by - ay) or 1e-9
    far = [abs((bx - ax) * (ay - y) - (ax - x) * (by - ay)) / size for x, y in points[1:-1]]
    k = far.index(max(far)) + 1
    if far[k - 1] <= tolerance:
        return [0, len(points) - 1]
    return kept_by_hand(points[: k + 1], tolerance) + [i + k for i in kept_by_hand(points[k:], tolerance)[1:]]


def test_simplified_equals_recursion(spark):
    r = np.random.default_rng(4)
    t = np.linspace(0, 2 * math.pi, 160, endpoint=False)
    rings = {"a": np.stack([50 * np.cos(t), 30 * np.sin(t)], 1) + r.normal(0, 0.8, (160, 2)), "b": np.array([[0.0, 0], [4, 0], [4, 4], [0, 4]]), "c": np.round(r.normal(0, 3, (40, 2)))}
    rows = [(s, i, float(x), float(y)) for s, ring in rings.items() for i, (x, y) in enumerate(ring)]
    got = footprint.simplified(spark.createDataFrame(rows, "slug string, step long, x double, y double"), 2.0, 40, 3.0).collect()
    for s, ring in rings.items():
        points = [tuple(p) for p in ring.tolist()]
        far = max(range(len(points)), key=lambda i: (math.dist(points[i], points[0]), -i))
        tolerance = 1.0
        while True:
            kept = kept_by_hand(points[: far + 1], tolerance)[:-1] + [far + i for i in kept_by_hand([*points[far:], points[0]], tolerance)[:-1]]
            if len(kept) <= 40 or tolerance * 1.25 > 3.0:
                break
            tolerance *= 1.25
        mine = sorted((x.step, x.tolerance) for x in got if x.slug == s)
        assert [k for k, _ in mine] == sorted(kept) and {x for _, x in mine} == {tolerance}


def test_components_brute_force(spark):
    r = random.Random(9)
    cells_ = {(r.randrange(25), r.randrange(25)) for _ in range(260)}
    label, want = {}, {}
    for start in sorted(cells_, key=lambda c: (c[1], c[0])):
        if start in label:
            continue
        todo = [start]
        while todo:
            c = todo.pop()
            if c in cells_ and c not in label:
                label[c] = start
                todo += [(c[0] + 1, c[1]), (c[0] - 1, c[1]), (c[0], c[1] + 1), (c[0], c[1] - 1)]
    want = label
    df = spark.createDataFrame([("s", x, y) for x, y in cells_], "slug string, ix int, iy int")
    assert {(q.ix, q.iy): (q.label.ix, q.label.iy) for q in footprint.components(df).collect()} == want
    opened, closed = ({(q.ix, q.iy) for q in f(df).collect()} for f in (footprint.opening, footprint.closing))
    assert opened <= cells_ <= closed


def ring_of(points):
    return [{"lon": float(a), "lat": float(b)} for a, b in points]


def test_spatial(spark):
    square = ring_of([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)])
    notch = ring_of([(0, 0), (4, 0), (2, 2), (4, 4), (0, 4), (0, 0)])
    rings = spark.createDataFrame([(1, square), (2, notch)], f"rid int, ring {footprint.RING}")
    pts = spark.createDataFrame([(1, 3.5, 2.0), (2, 1.0, 1.0), (3, 9.0, 9.0)], "pid int, lon double, lat double")
    assert {(r.pid, r.rid) for r in spatial.points_in_rings(pts, rings, 1.0).collect()} == {(1, 1), (2, 1), (2, 2)}
    assert {r.pid for r in spatial.outside_rings(pts, rings, 1.0, 1000.0).collect()} == {3}
    w = {r.pid: r.weight for r in spatial.weights(pts, rings, 1.0, 500_000.0).collect()}
    assert w[3] == 0 and 0 < w[1] < w[2] < 1
    c = rings.where("rid = 1").select(spatial.enclosing_circle(F.col("ring")).alias("c")).first().c
    assert (c.lon, c.lat) == (2, 2) and c.radius > 300_000
    e = spatial.edge_points(rings.where("rid = 1"), 1.0, 0.5)
    assert e.count() == 16 and {(r.x, r.y) for r in e.where("edge = 0").collect()} == {(0.5, 0.5), (1.5, 0.5), (2.5, 0.5), (3.5, 0.5)}
    a = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 5.0, 5.0, 9.0, 9.0)], "id int, x0 double, y0 double, x1 double, y1 double")
    b = spark.createDataFrame([(7, 1.0, 1.0, 2.0, 6.0), (8, 8.5, 0.0, 8.6, 8.0)], "id int, x0 double, y0 double, x1 double, y1 double")
    assert {(r.a_id, r.b_id) for r in spatial.boxes_touching(a, b, 2.0).collect()} == {(1, 7), (2, 8)}
    f = {r.rid: r.fraction for r in spatial.visible_fraction(rings, 0, 0, 2, 4).collect()}
    assert f[1] == pytest.approx(1.0)
    assert {r.rid: r.fraction for r in spatial.visible_fraction(rings, 0, 0, 2, 4, 0.5).collect()}[1] == pytest.approx(3 * 4 / 32)
    none = rings.where("rid = 1").select("rid", F.lit(None).cast(rings.schema["ring"].dataType).alias("ring"), F.lit(5.0).alias("x"), F.lit(5.0).alias("y"), F.lit(2.0).alias("radius"))
    assert spatial.visible_fraction(none, 0, 0, 10, 10).first().fraction == pytest.approx(16 * 2 * math.sin(math.pi / 8) / 100)
    assert spatial.visible_fraction(none, 20, 20, 30, 30).first().fraction == 0 and spatial.visible_fraction(none, 5, 0, 5, 9).first().fraction == 0


def test_greedy_steps(spark):
    m = spark.createDataFrame([("v", 1, 0, 0.0, 0.0, 50.0, 500.0), ("v", 2, 1, 10.0, 0.0, 50.0, 500.0), ("v", 3, 2, 35.0, 0.0, 50.0, 500.0), ("v", 4, 3, 200.0, 0.0, 50.0, 500.0), ("v", 5, 4, 230.0, 5.0, 50.0, 500.0)], "view string, pid int, priority int, x double, y double, label_px double, view_width double")
    assert {r.pid: r.leader for r in spatial.proximity_groups(m).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5 if math.hypot(30, 5) >= 30 else 4}
    side = {r.pid: r.side for r in spatial.place_labels(m.where("pid in (1, 4, 5)")).collect()}
    assert side[1] == "right" and side[4] == "right" and side[5] == "hidden" or side[5] == "right"
    p = {r.item: (r.x, r.y) for r in spatial.shelf_pack(spark.createDataFrame([("a", 1, 60, 40), ("a", 2, 60, 30), ("a", 3, 30, 20)], "atlas string, item int, w int, h int"), width=100).collect()}
    assert p == {1: (0, 0), 2: (0, 40), 3: (60, 40)}


def test_terrain(spark):
    heights = [float(r * 256 + c) for r in range(256) for c in range(256)]
    tiles = spark.createDataFrame([(1, 1, 0, heights)], "z int, x int, y int, heights array<double>")
    pts = spark.createDataFrame([(90.0, 66.51326), (-90.0, 10.0)], "lon double, lat double")
    got = {r.lon: r.terrain for r in terrain.with_terrain(pts, tiles, 1).collect()}
    assert got[-90.0] is None and got[90.0] == pytest.approx(128 * 256 + 128, abs=1)
    grid = spark.createDataFrame([(-1.0, 1.0, 1.0, 3, [float(i) for i in range(9)])], "west double, north double, step double, width int, values array<double>")
    g = terrain.sample_grid(spark.createDataFrame([(0.0, 0.0), (0.5, 0.5)], "lon double, lat double"), grid).collect()
    assert [r.geoid for r in g] == [4.0, 3.0]


def test_georeference_errors(spark):
    from orograph.functions import geodesy as G

    frame = G.enu_frame(-75.0, 4.0, 100.0)
    v = spark.createDataFrame([(0.0, 0.0, 0.0)], "x double, y double, z double")
    e, n = G.to_utm(F.lit(-75.0), F.lit(4.0), 18)
    r = terrain.georeference_errors(v.withColumns({"east": e, "north": n, "height": F.lit(80.0)}), frame, 18, 20.0).first()
    assert r.horizontal < 1e-3 and abs(r.vertical) < 1e-3
    assert M.IDENTITY[0] == 1


def test_catalogue(spark, tmp_path):
    base = {"title": "T", "lugar": "Zipa", "municipio": "Zipa (C)", "fecha": "2026-02", "lat": 4.0, "lon": -74.0, "estado": "publicado", "fotos": 2440, "modelo": {"tileset_geo": "x/v1/tileset.json"}, "escena": {"geoide_m": -6, "inclinacion": {"este": 0.1}}}
    for name, doc in (("b", base), ("a", {**base, "fecha": None, "escena": None}), ("_t", base), ("c", {**base, "fecha": "2026-03-01", "escena": {"geoide_m": None}})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    (tmp_path / "b.huella.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"x": 1}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}))
    c = catalogue.read_catalogue(spark, str(tmp_path))
    assert [r.slug for r in catalogue.in_order(c).collect()] == ["c", "b", "a"]
    full = catalogue.with_footprints(c, catalogue.read_footprints(spark, str(tmp_path)))
    assert {r.slug: r.ring and len(r.ring) for r in full.collect()} == {"a": None, "b": 4, "c": None}
    s = {r.slug: r.scene for r in catalogue.for_scene(full, "https://t.example").collect()}
    assert s["a"] is None and s["c"] is None and s["b"].tileset == "https://t.example/x/v1/tileset.json" and s["b"].tilt is None
    card = [(r.field, r.value) for r in catalogue.card_rows(c.where("slug = 'b'")).orderBy("pos").collect()]
    assert card == [("Lugar", "Zipa (C)"), ("Coordenadas", "4° N, 74° O"), ("Fotos", "2.440")]
    assert catalogue.by_key(c, "_t").count() == 0 and catalogue.read_catalogue(spark, str(tmp_path / "none")).count() == 0
    assert "<loc>https://s.example/vuelos/c</loc></url><url><loc>https://s.example/vuelos/b" in catalogue.sitemap(c, "https://s.example").first()[0]
    assert catalogue.active_key(c, F.col("slug") != "b").first()[0] == "a+c" and catalogue.active_key(c, F.lit(False)).first()[0] == "-"
    kinds = spark.createDataFrame([('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}',), ('{"type":"MultiPolygon","coordinates":[]}',), ('{"type":"Polygon","coordinates":[[[0,0],[1,0],[0,0]]]}',)], "g string")
    assert [r[0] is not None for r in kinds.select(catalogue.ring_of(F.col("g"))).collect()] == [True, False, False]
    rep = catalogue.collected_reports(c.select("slug"), spark.createDataFrame([("a", 1.5, 3)], "slug string, total_mb double, files long"))
    assert {r.slug: r.state for r in rep.collect()} == {"a": "done", "b": "failed", "c": "failed"}
    assert tuple(catalogue.report_totals(rep).first()) == (1, 1.5, 3, 2)


REQUESTS = [
    (1, "GET", "/m/v1/a.glb", None, None, None), (2, "GET", "/m/v1/a.glb", "https://evil.example", None, None), (3, "GET", "/m/v1/a.glb", "https://a.example", "bytes=0-99", None),
    (4, "GET", "/m/v1/a.glb", None, None, "tag"), (5, "GET", "/m/b.json", None, None, None), (6, "GET", "/m/b.json", None, None, None), (7, "GET", "/none", None, None, None),
    (8, "POST", "/m/b.json", None, None, None), (9, "OPTIONS", "/m/b.json", None, None, None), (10, "HEAD", "/m/b.json", None, None, None), (11, "GET", "/m/../b", None, None, None), (12, "GET", "/", None, None, None),
]


def test_request_rules(spark):
    r = spark.createDataFrame(REQUESTS, "req_id int, method string, path string, origin string, range_header string, if_none_match string")
    o = spark.createDataFrame([("m/v1/a.glb", 1000, None, "tag"), ("m/b.json", 50, "x/y", "t2")], "key string, size long, stored_type string, etag string")
    got = {x.req_id: x for x in requests.edge_cache(requests.answer(r, o, ("https://a.example",))).collect()}
    assert {k: v.status for k, v in got.items()} == {1: 200, 2: 200, 3: 206, 4: 304, 5: 200, 6: 200, 7: 404, 8: 405, 9: 204, 10: 200, 11: 404, 12: 404}
    assert [got[k].x_cache for k in (1, 2, 3, 4, 5, 6)] == ["MISS", "HIT", "MISS", "HIT", "MISS", "MISS"]
    assert got[2].cors is None and got[3].cors == "https://a.example" and got[3].range == "bytes 0-99/1000"
    assert "max-age=300" in got[5].cache_control and "immutable" in got[1].cache_control and got[1].content_type == "model/gltf-binary"


def events(spark, rows, schema="key string, ts double, seq long, radius_px double, visible boolean, selected boolean, failed boolean"):
    return spark.createDataFrame(rows, schema)


def test_stateful_rules(spark):
    e = events(spark, [("a", float(i), i, v, vis, sel, False) for i, (v, vis, sel) in enumerate([(11.9, True, False), (12.0, True, False), (8.0, True, False), (7.9, True, False), (8.0, True, False), (1.0, True, True), (99.0, False, True)])])
    assert [r.active for r in stateful.hysteresis(e).orderBy("seq").collect()] == [False, True, True, False, False, True, False]
    t = events(spark, [("a", x, i, 0.0, True, False, False) for i, x in enumerate((0.0, 399.0, 400.0, 799.0, 800.0))])
    assert [r.seq for r in stateful.throttle(t, 400.0).orderBy("seq").collect()] == [0, 2, 4]
    f = events(spark, [("a", x * 1000.0, i, 0.0, True, False, True) for i, x in enumerate((0, 0.5, 1, 3, 7, 15, 31, 61, 91, 121, 999))])
    waits = [r.wait_ms for r in stateful.retries(f).orderBy("ts").collect()]
    assert waits == [1000, 2000, 4000, 8000, 16000, 30000, 30000, 30000] == [1000 * x for x in stateful.retry_schedule()]
    m = [r.ema for r in stateful.moving_average(t.withColumn("x", F.lit(10.0)), "x").orderBy("seq").collect()]
    assert m == pytest.approx([4, 6.4, 7.84, 8.704, 9.2224])
    s = t.withColumn("step", F.element_at(F.array(*map(F.lit, (-1, 1, 1, -1, -1))), (F.col("seq") + 1).cast("int")))
    assert [(r.seq, r.loading) for r in stateful.in_flight(s).orderBy("seq").collect()] == [(1, True), (4, False)]
    d = spark.range(1).select(stateful.decay(1.0)).first()[0]
    assert d[0] == pytest.approx(math.exp(-16 / 180)) and d[-1] >= 0.02 and len(d) == int(180 * math.log(50) / 16)
    p = t.withColumn("v", F.element_at(F.array(*map(F.lit, (3, 1, 2, 5, 4))), (F.col("seq") + 1).cast("int"))).withColumn("read", F.col("seq") == 1)
    assert [r.peak for r in stateful.running_peak(p, "v", reset="read").orderBy("seq").collect()] == [3, 3, 2, 5, 5]
    n = stateful.loading_notices(spark.createDataFrame([("a", 0.0, True), ("a", 1000.0, False), ("a", 2000.0, True), ("a", 5000.0, False)], "key string, ts double, loading boolean")).collect()
    assert [(r.notice_at, r.until) for r in n] == [(3200.0, 5000.0)]


def test_outline_at_diagonal_corners(spark):
    """Of two edges that leave a corner that of the higher row is taken; what hangs on the corner alone is left out and told of."""

    def ring(*cells):
        got = footprint.outline(spark.createDataFrame([("s", x, y) for x, y in cells], "slug string, ix int, iy int")).orderBy("step").collect()
        return [(p.x, p.y) for p in got], got[0].left_edges

    assert ring((0, 0), (1, 0), (1, 1)) == ([(0, 0), (1, 0), (2, 0), (2, 1), (2, 2), (1, 2), (1, 1), (0, 1)], 0)
    r = random.Random(6)
    for _ in range(12):
        cells = {(r.randrange(5), r.randrange(5)) for _ in range(12)}
        leaving = {}
        for y, x in sorted((y, x) for x, y in cells):
            for a, b, c, d, beside in ((x, y, x + 1, y, (x, y - 1)), (x + 1, y, x + 1, y + 1, (x + 1, y)), (x + 1, y + 1, x, y + 1, (x, y + 1)), (x, y + 1, x, y, (x - 1, y))):
                if beside not in cells:
                    leaving[a, b] = (c, d)
        start = at = min(((x, y) for x, y in cells if (x, y - 1) not in cells), key=lambda p: (p[1], p[0]))
        want = []
        while at in leaving:
            want.append(at)
            at = leaving.pop(at)
        assert ring(*cells) == (want, len(leaving)) and want[0] == start


def test_groups_and_shelves_equal_the_walk(spark):
    r = random.Random(2)
    rows = [(v, i, r.randint(0, 9), r.uniform(0, 200), r.uniform(0, 200)) for v in "ab" for i in range(120)]
    got = {(x.view, x.pid): x.leader for x in spatial.proximity_groups(spark.createDataFrame(rows, "view string, pid int, priority int, x double, y double")).collect()}
    for v in "ab":
        heads = []
        for _, i, _, x, y in sorted((q for q in rows if q[0] == v), key=lambda q: (q[2], q[1])):
            head = next((h for h in heads if math.hypot(h[1] - x, h[2] - y) < 30), None)
            if head is None:
                heads.append(head := (i, x, y))
            assert got[v, i] == head[0]
    items = [(a, i, r.randint(1, 90), r.randint(1, 60)) for a in "xy" for i in range(80)]
    placed = {(p.atlas, p.item): (p.x, p.y) for p in spatial.shelf_pack(spark.createDataFrame(items, "atlas string, item int, w int, h int")).collect()}
    for a in "xy":
        mine = sorted((q for q in items if q[0] == a), key=lambda q: (-q[3], q[1]))
        width = 4 * math.ceil(max(max(q[2] for q in mine), math.sqrt(sum(q[2] * q[3] for q in mine) * 1.15)) / 4)
        x = y = high = 0
        for _, i, w, h in mine:
            if x + w > width:
                x, y, high = 0, y + high, 0
            assert placed[a, i] == (x, y)
            x, high = x + w, max(high, h)


def test_marks_outside_block_nothing(spark):
    m = spark.createDataFrame([("v", 1, 0, -5.0, 20.0, 50.0, 500.0, 300.0), ("v", 2, 1, 20.0, 20.0, 50.0, 500.0, 300.0), ("v", 3, 2, 20.0, 400.0, 50.0, 500.0, 300.0)], "view string, pid int, priority int, x double, y double, label_px double, view_width double, view_height double")
    assert {r.pid: r.side for r in spatial.place_labels(m).collect()} == {1: "outside", 2: "right", 3: "outside"}


def test_holes_of_far_cells(spark):
    ring = [(x, y) for x in range(4) for y in range(4) if (x, y) not in ((1, 1), (1, 2), (2, 2))] + [(10**8, 3), (5, 10**8), (2, -7)]
    cells = spark.createDataFrame([("s", x, y) for x, y in ring], "slug string, ix int, iy int")
    got = {(r.ix, r.iy) for r in footprint.fill_holes(cells).collect()}
    assert got == set(ring) | {(1, 1), (1, 2), (2, 2)}


def test_running_sums_and_ranks_by_ranges(spark):
    from orograph.functions import quantiles as Q
    from orograph.shared import numbered, running

    rows = [(g, v, v % 5 + 1) for g in ("a", None, "b") for v in (range(40) if g != "b" else range(3))]
    df = spark.createDataFrame(rows, "g string, v int, w int")
    got = {(r.g, r.v): (r.s, r.k) for r in numbered(running(df, [F.col("v")], F.col("w"), "s", ("g",)), [F.col("v")], "k", ("g",)).collect()}
    assert got == {(g, v): (sum(x % 5 + 1 for x in range(v + 1)), v) for g, v, _ in rows}
    r = {x.g: (x.p, x.u) for x in Q.ranks(df, "v", {"p": (Q.NEAREST, 0.5), "u": (Q.UPPER, 0.5)}, ("g",)).collect()}
    assert r == {"a": (20.0, 20.0), None: (20.0, 20.0), "b": (1.0, 1.0)}
    assert Q.ranks(df, "v", {"p": (Q.FLOOR, 0.9)}).first().p == float(sorted(v for _, v, _ in rows)[int(0.9 * (len(rows) - 1))])
