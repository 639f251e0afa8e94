"""Readers and writers over files that the tests make."""

import gzip
import io
import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph.sources import archives, binaries, texts


def test_zip_source(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("nodepages/0.json", json.dumps({"nodes": [{"index": 0, "children": [1, 2], "obb": {"center": [1, 2, 3]}}, {"index": 1, "mesh": {"geometry": {"vertexCount": 3, "resource": 7}}}]}))
        z.writestr(zipfile.ZipInfo("stored.bin"), b"abc")
        z.writestr("packed.bin", b"x" * 5000, zipfile.ZIP_DEFLATED)
        z.writestr("g.json.gz", gzip.compress(b'{"a": 1}'))
        z.writestr("dir/", b"")
    archives.register(spark)
    df = spark.read.format("zip_entries").option("partitionbytes", "40").load(str(path))
    got = {r.name: bytes(r.content) for r in df.collect()}
    assert got["stored.bin"] == b"abc" and got["packed.bin"] == b"x" * 5000 and got["g.json.gz"] == b'{"a": 1}' and len(got) == 4
    assert df.rdd.getNumPartitions() > 1
    for uri in (f"file://{path}", f"file:{path}"):
        assert {r.name for r in spark.read.format("zip_entries").load(uri).collect()} == set(got)
    nodes = binaries.node_pages(df)
    assert {(r.node_id, r.vertex_count) for r in nodes.collect()} == {(0, None), (1, 3)}
    assert {(r.node_id, r.parent_id) for r in binaries.parents_of(nodes).collect()} == {(0, None), (1, 0)}


def test_zip64_directory(tmp_path):
    path = tmp_path / "b.zip"
    with zipfile.ZipFile(path, "w", allowZip64=True) as z, z.open("big", "w", force_zip64=True) as f:
        f.write(b"hello")
    raw = path.read_bytes()
    at = raw.rfind(b"PK\x05\x06")
    size, offset = struct.unpack_from("<II", raw, at + 12)
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, size, offset)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, at, 1)
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    f = io.BytesIO(raw[:at] + end64 + locator + end)
    (entry,) = archives.directory(f)
    assert archives.content(f, entry) == b"hello"
    with pytest.raises(ValueError):
        archives.directory(io.BytesIO(b"nothing here" * 9))


def png_by_hand(filter_):
    import zlib

    rgb = np.random.default_rng(filter_).integers(0, 256, (5, 7, 3)).astype(int)
    raw, above = b"", np.zeros((7, 3), int)
    for row in rgb:
        left = np.vstack([np.zeros((1, 3), int), row[:-1]])
        corner = np.vstack([np.zeros((1, 3), int), above[:-1]])
        p = left + above - corner
        d = [abs(p - left), abs(p - above), abs(p - corner)]
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], above, corner))
        guess = [np.zeros_like(row), left, above, (left + above) // 2, paeth][filter_]
        raw += bytes([filter_]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return rgb, binaries.PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("filter_", range(5))
def test_png_filters(filter_):
    rgb, data = png_by_hand(filter_)
    assert (binaries.png_pixels(data) == rgb).all()


def test_png_write_and_heights(spark):
    rgb = np.random.default_rng(1).integers(0, 256, (4, 6, 3)).astype(np.uint8)
    for f in (0, 1):
        assert (binaries.png_pixels(binaries.png_of(rgb, f)) == rgb).all()
    h = np.array([[0.0, 2547.3], [-32768.0, 40000.0]])
    df = spark.createDataFrame([(binaries.png_of_heights(h),), (b"no png",)], "content binary")
    got = [r[0] for r in df.select(binaries.as_udf(binaries.png_heights, "array<double>")("content")).collect()]
    assert got[0] == pytest.approx([0, 2547.3, -32768, 32768], abs=1 / 256) and got[1] is None


def test_geometry_and_glb(spark):
    xyz, uv = np.arange(9, dtype="<f4").reshape(3, 3), np.arange(6, dtype="<f4").reshape(3, 2) / 8
    data = struct.pack("<II", 3, 1) + xyz.tobytes() + uv.tobytes()
    v = binaries.vertices(spark.createDataFrame([("n1", data)], "name string, content binary")).orderBy("vid").collect()
    assert [(r.x, r.v) for r in v] == [(0, 0.125), (3, 0.375), (6, 0.625)]
    q = np.array([[0, 127, -127], [127, 0, 0], [-128, 127, 0]], np.int8)
    tri = np.array([0, 1, 2], np.uint16)
    blob = q.tobytes() + b"\0" * 3 + tri.tobytes() + b"\0\0"
    j = {"scenes": [{"nodes": [0]}], "nodes": [{"translation": [10, 0, 0], "children": [1]}, {"mesh": 0, "scale": [2, 2, 2]}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}],
         "accessors": [{"bufferView": 0, "componentType": 5120, "count": 3, "type": "VEC3", "normalized": True}, {"bufferView": 1, "componentType": 5123, "count": 3, "type": "SCALAR"}], "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": 9}, {"buffer": 0, "byteOffset": 12, "byteLength": 6}]}
    text = json.dumps(j).encode()
    text += b" " * (-len(text) % 4)
    glb = b"glTF" + struct.pack("<II", 2, 20 + len(text) + 8 + len(blob)) + struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(blob), b"BIN\0") + blob
    ((p, t),) = binaries.glb_meshes(glb)
    assert p.tolist() == [[10, 2, -2], [12, 0, 0], [8, 2, 0]] and t.tolist() == [[0, 1, 2]]
    table = b'{"BATCH_LENGTH":0}  '
    b3dm = b"b3dm" + struct.pack("<II", 1, 0) + struct.pack("<4I", len(table), 0, 0, 0) + table + glb
    assert binaries.glb_of_b3dm(b3dm) == glb
    j["bufferViews"][0]["byteOffset"] = 1000
    with pytest.raises(ValueError):
        binaries.glb_accessor(j, blob, 0)


def test_jpeg_headers():
    order = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i % 8 if (i // 8 + i % 8) % 2 == 0 else i // 8)))
    for quality in (40, 50, 75, 90):
        scale = 5000 / quality if quality < 50 else 200 - 2 * quality
        table = bytes(max(1, min(255, int((binaries.LUMINANCE[i] * scale + 50) // 100))) for i in order)
        data = b"\xff\xd8" + b"\xff\xdb" + struct.pack(">H", 67) + b"\0" + table + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 480, 640) + b"\1\1\x11\0"
        assert binaries.jpeg_size(data) == [640, 480] and abs(binaries.jpeg_quality(data) - quality) <= 1
    with pytest.raises(ValueError):
        binaries.jpeg_size(b"\xff\xd8\xff\xd9")


def test_layers():
    assert binaries.layer_problem({"layerType": "IntegratedMesh", "spatialReference": {"wkid": 4326}}) is None
    assert "Point" in binaries.layer_problem({"layerType": "Point"}) and "wkid" in binaries.layer_problem({"layerType": "IntegratedMesh", "spatialReference": {"wkid": 3857}})
    assert binaries.height_datum_warning({"spatialReference": {"vcsWkid": 1}}) and not binaries.height_datum_warning({"spatialReference": {"vcsWkid": 5773}})


OBJ = "mtllib m.mtl\nv 1.5 2.25 3 0.1 0.2\nv 10 20 30\nv 4 5 6\nvt 0.5 0.25\nusemtl a b\nf 1/1 2/1 3/1\nusemtl c\nf 1 2 3 1\n# end\n"


def test_obj_lines(spark, tmp_path):
    (tmp_path / "x.obj").write_text(OBJ)
    (tmp_path / "m.mtl").write_text("newmtl a b\n map_Kd t1.jpg\nnewmtl c\nKd 1 1 1\nmap_Kd t 2.jpg\n")
    lines = texts.numbered_lines(spark, str(tmp_path / "x.obj"))
    v = texts.obj_vertices(lines).orderBy("vid").collect()
    assert [(r.vid, r.x, r.rest) for r in v] == [(1, 1.5, "0.1 0.2"), (2, 10.0, ""), (3, 4.0, "")]
    f = texts.obj_faces(lines).orderBy("fid").collect()
    assert [(r.material, r.corners, r.textures) for r in f] == [("a b", [1, 2, 3], [1, 1, 1]), ("c", [1, 2, 3, 1], [None] * 4)]
    assert texts.obj_libraries(lines).first().library == "m.mtl" and texts.obj_texture_vertices(lines).first().u == 0.5
    m = texts.mtl_textures(texts.numbered_lines(spark, str(tmp_path / "m.mtl")))
    assert {(r.material, r.texture) for r in m.collect()} == {("a b", "t1.jpg"), ("c", "t 2.jpg")}
    moved = [r.value for r in texts.shifted_obj(lines, 0.5, 0.25, 1).orderBy("line").collect()]
    assert moved[1] == "v 1.0000 2.0000 2.0000 0.1 0.2" and moved[4] == "vt 0.5 0.25"


def test_tilesets_round_trip(spark, tmp_path):
    leaf = lambda u: {"boundingVolume": {"box": [0.0] * 12}, "geometricError": 0.0, "refine": "REPLACE", "content": {"uri": u}}
    doc = {"asset": {"version": "1.1"}, "geometricError": 4.0, "root": {**leaf("r"), "geometricError": 2.0, "transform": [float(i) for i in range(16)], "children": [leaf("a"), {**leaf("b"), "children": [leaf("c")]}]}}
    (tmp_path / "t.json").write_text(json.dumps(doc))
    nodes = texts.read_tilesets(spark, str(tmp_path / "t.json"))
    assert [(r.node_id, r.parent_id, r.ord, r.depth, r.uri) for r in nodes.orderBy("node_id").collect()] == [(0, None, 0, 0, "r"), (1, 0, 0, 1, "a"), (2, 0, 1, 1, "b"), (3, 2, 0, 2, "c")]
    texts.write_tilesets(nodes.withColumn("tileset", F.lit("t")), str(tmp_path / "out"))
    back = spark.read.option("wholetext", True).text(str(tmp_path / "out")).first().value
    assert json.loads(back) == doc
    turned = texts.with_root_transform(nodes, range(16, 32)).orderBy("node_id").collect()
    assert turned[0].transform[0] == 16.0 and turned[1].transform is None
    assert texts.pruned_nulls({"a": None, "b": [{"c": None, "d": 1}]}) == {"b": [{"d": 1}]}


def test_small_readers_and_writers(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"i": 3, "mn": [1, 2, 3], "bytes": 10, "tris": 4, "tex": "8x8", "ktx": true}\n')
    assert texts.read_progress(spark, str(tmp_path / "p.jsonl")).first().i == 3
    jobs = spark.createDataFrame([("a my file.slpk",), ("",), ("# x y",), ("b c",)], "value string")
    assert {(r.slug, r.file) for r in texts.job_list(jobs).collect()} == {("a", "my file.slpk"), ("b", "c")}
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.bin").write_bytes(b"12345")
    (tmp_path / "d" / "b.temp").write_bytes(b"1")
    assert [r.bytes for r in texts.file_sizes(spark, str(tmp_path / "d")).collect()] == [5]
    ring = [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]
    p = spark.createDataFrame([("s", [{"lon": a, "lat": b} for a, b in ring], 3, 7, 1.0)], "slug string, ring array<struct<lon:double,lat:double>>, vertices int, area_m2 long, tolerance double")
    texts.write_footprints(p, str(tmp_path / "f"))
    doc = json.loads(spark.read.text(str(tmp_path / "f")).first().value)
    assert doc["features"][0]["geometry"]["coordinates"] == [[list(x) for x in ring]]
    texts.write_report(p.select("slug", F.lit(None).cast("string").alias("none")), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first().value == '{"slug":"s"}'
    texts.write_versioned(p.select("slug"), str(tmp_path / "v"), "1")
    with pytest.raises(Exception, match="exist"):
        texts.write_versioned(p.select("slug"), str(tmp_path / "v"), "1")
