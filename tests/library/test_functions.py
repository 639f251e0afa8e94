"""Functions against small hand-made cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph.functions import geodesy as G
from orograph.functions import matrix as M
from orograph.functions import mesh as ME
from orograph.functions import quantiles as Q
from orograph.functions import text as T
from orograph.functions import web


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_quantile_definitions(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)] + [(None,), (float("nan"),)], "x double")
    r = df.agg(Q.linear("x", 0.5), Q.nearest_rank("x", 0.5), Q.floor_rank("x", 0.5), Q.upper_median("x"), Q.median("x"), Q.nearest_rank("x", 1.0)).first()
    assert tuple(r) == (2.5, 3.0, 2.0, 3.0, 2.5, 4.0)
    empty = df.where("x > 9").agg(Q.linear("x", 0.5), Q.nearest_rank("x", 0.5), Q.upper_median("x")).first()
    assert tuple(empty) == (None, None, None)


def test_rounding_rules(spark):
    r = one(spark, Q.round_half_up(F.lit(-2.5)), Q.round_half_up(F.lit(2.5)), Q.fixed(F.lit(1.25), 1), Q.significant(F.lit(123456.7)), Q.significant(F.lit(-0.00012345678)), Q.significant(F.lit(0.0)), Q.half_even(F.lit(2.5)))
    assert tuple(map(float, r)) == pytest.approx((-2, 3, 1.3, 123460, -0.00012346, 0, 2))


def test_geodesy_round_trips(spark):
    rows = [(-74.1, 4.6, 2600.0), (12.5, -33.9, -40.0), (179.9, 71.2, 0.0)]
    df = spark.createDataFrame(rows, "lon double, lat double, h double")
    x, y, z = G.to_ecef("lon", "lat", "h")
    df = df.withColumns({"x": x, "y": y, "z": z})
    back = df.select(*G.from_ecef("x", "y", "z", G.E2)).collect()
    assert np.allclose([tuple(r) for r in back], rows, atol=1e-8)
    assert np.allclose([tuple(r) for r in df.select("x", "y", "z").collect()], [G.ecef_of(*r) for r in rows])
    e = df.limit(1).select(*G.to_enu("x", "y", "z", -74.1, 4.6, 2600.0)).first()
    assert max(map(abs, e)) < 1e-6


def test_utm_round_trip_and_known_point(spark):
    df = spark.createDataFrame([(-74.07, 4.71), (-75.0, 10.0), (-76.9, 2.2)], "lon double, lat double")
    e, n = G.to_utm("lon", "lat", 18)
    df = df.withColumns({"e": e, "n": n})
    r = df.collect()
    assert r[1].e == pytest.approx(500000.0, abs=1e-6)
    back = df.select(*G.from_utm("e", "n", 18)).collect()
    assert np.allclose([tuple(x) for x in back], [(-74.07, 4.71), (-75.0, 10.0), (-76.9, 2.2)], atol=1e-8)
    g, k = one(spark, *G.convergence_and_scale(F.lit(-75.0), F.lit(10.0), -75.0))
    assert g == 0 and k == pytest.approx(0.9996)


def test_tiles_and_heights(spark):
    r = one(spark, *G.tile_of(F.lit(0.0), F.lit(0.0), 1), *G.tile_bounds(F.lit(0), F.lit(0), F.lit(0)))
    assert tuple(r)[:2] == (1, 1) and tuple(r)[2:] == pytest.approx((-180, -85.05112878, 180, 85.05112878))
    for h, want in ((-32768.0, -32768.0), (0.0, 0.0), (2547.3, 2547.3), (40000.0, 32767.99609375)):
        c = one(spark, *(x.alias(n) for x, n in zip(G.encode_height(F.lit(h)), "rgb", strict=True)))
        assert one(spark, G.decode_height(F.lit(c.r), F.lit(c.g), F.lit(c.b)))[0] == pytest.approx(want, abs=1 / 256)
    flat = F.array(*(F.lit(float(i)) for i in range(9)))
    assert one(spark, G.bilinear(flat, F.lit(0.5), F.lit(1.5), 3))[0] == pytest.approx(5.0)


def test_camera_rules(spark):
    d = one(spark, G.framing_distance(F.lit(100.0), F.lit(60.0), F.lit(1000.0), F.lit(1000.0)))[0]
    assert d == pytest.approx(100 / math.sin(math.radians(30)) * 0.95)
    a, b = one(spark, G.zoom_for_distance(F.lit(1000.0), F.lit(0.0), 900), G.zoom_for_distance(F.lit(500.0), F.lit(0.0), 900))
    assert b - a == pytest.approx(1)
    assert one(spark, G.anchor_altitude(F.lit(10.0), F.lit(None).cast("double"), F.lit(3.0), F.lit(False)))[0] == 8.5
    assert one(spark, G.camera_distance(F.lit(3.0), F.lit(4.0), F.lit(12.0)))[0] == 13


def test_matrices(spark):
    a, b = M.trs((1, 2, 3), (0, 0, math.sin(0.3), math.cos(0.3)), (2, 2, 2)), M.trs((5, 6, 7))
    got = one(spark, M.product(M.literal(a), M.literal(b)))[0]
    assert np.allclose(M.as_numpy(got), M.as_numpy(a) @ M.as_numpy(b))
    assert M.tilt(0, 0) == M.IDENTITY
    t = M.as_numpy(M.tilt(0.02, -0.01))
    n = t[:3, :3] @ (np.array([0.02, -0.01, 1]) / np.linalg.norm([0.02, -0.01, 1]))
    assert np.allclose(n, [0, 0, 1])
    # the offset comes after the levelling, so the pivot moves by exactly the offset
    level = M.as_numpy(M.georeference(M.IDENTITY, "z", 0.0, 1.0, (1, 2, 3), (0.02, 0.05), 30.0))
    assert np.allclose(level @ [0, 0, 30, 1], [1, 2, 33, 1])
    chain = M.as_numpy(M.georeference(M.IDENTITY, "z", 0.0, 1.0, (1, 2, 3), (0.0, 0.0), 9.0))
    assert np.allclose(chain @ [0, 0, 0, 1], [1, 2, 3, 1])
    assert one(spark, *M.y_up_to_z_up(F.lit(1.0), F.lit(2.0), F.lit(3.0))) == (1.0, -3.0, 2.0)


def test_texts(spark):
    r = one(spark, T.grouped_number(F.lit(1234567.5)), T.grouped_number(F.lit(2440.0)), T.grouped_number(F.lit(0.95)), T.coordinates(F.lit(-4.5), F.lit(74.25)), T.coordinates(F.lit(None).cast("double"), F.lit(1.0)), T.long_date(F.lit("2026-01-31")), T.survey_date(F.lit("2026-02")), T.survey_date(F.lit(None).cast("string")))
    assert tuple(r) == ("1.234.567,5", "2.440", "0,95", "4,5° S, 74,25° E", "", "31 de enero de 2026", "febrero de 2026", "")
    u = one(spark, T.joined_url("https://b/", F.lit("./a/b")), T.joined_url("https://b", F.lit("/x")), T.joined_url("", F.lit("x")), T.joined_url("https://b", F.lit("")), T.joined_url("https://b", F.lit("http://c/d")))
    assert tuple(u) == ("https://b/a/b", "/x", "", "", "http://c/d")
    p = one(spark, T.parsed_decimal(F.lit(" 1,5 ")), T.parsed_decimal(F.lit("x")), T.quantised(F.lit(-0.04)), T.with_comma(F.lit(2.25)), T.clamped(F.lit(9.0), 0.0, 5.0, F.lit(7.0)), T.base_url(F.lit(""), F.lit("http,https"), F.lit("h")), T.status_label(F.lit("publicado")))
    assert tuple(p) == (1.5, None, 0.0, "2,3", 7.0, "http://h", "Con modelo 3D")


def test_web_rules(spark):
    r = one(spark, web.content_type(F.lit("a/b.GLB")), web.content_type(F.lit("a.x"), F.lit("t/s")), web.content_type(F.lit("a.x")), web.cache_policy(F.lit("/m/v3/a.json")) == web.LONG_CACHE, web.upload_policy(F.lit("a.json")) == web.SHORT_CACHE)
    assert tuple(r) == ("model/gltf-binary", "t/s", "application/octet-stream", True, True)
    b = [one(spark, web.byte_range(F.lit(h), F.lit(1000).cast("long"))["text"])[0] for h in ("bytes=0-99", "bytes=-100", "bytes=990-2000", "bytes=1000-", "bytes=-", "x")]
    assert b == ["bytes 0-99/1000", "bytes 900-999/1000", "bytes 990-999/1000", None, None, None]


def test_mesh_rules(spark):
    area = one(spark, ME.area_3d(*(F.lit(float(v)) for v in (0, 0, 0, 3, 0, 0, 0, 4, 0))), ME.area_uv(*(F.lit(v) for v in (0.0, 0.0, 1.0, 0.0, 0.0, 1.0))))
    assert tuple(area) == (6.0, 0.5)
    e = one(spark, ME.tile_error(F.lit(True), F.lit(0.1), F.lit(None).cast("double"), F.lit(True)), ME.tile_error(F.lit(False), F.lit(0.1), F.lit(1.0), F.lit(True)), ME.tile_error(F.lit(False), F.lit(float("inf")), F.lit(1.0), F.lit(False)), ME.tile_error(F.lit(False), F.lit(float("inf")), F.lit(0.0), F.lit(True)))
    assert tuple(e) == pytest.approx((0, 1.6, 2.0, 0.01))
    u = one(spark, *ME.remapped_uv(F.lit(0.5), F.lit(1.0), 10, 20, 40, 30, 100, 100), ME.texel_size(F.lit(0.0)), ME.texel_size(F.lit(4.0)))
    assert tuple(u) == (0.3, 0.5, float("inf"), 0.5)
    assert one(spark, ME.is_place_label(F.lit("symbol"), F.lit("road_shield")), ME.is_place_label(F.lit("symbol"), F.lit("place"))) == (False, True)
