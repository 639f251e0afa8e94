"""Decoders of single small binaries, used by Arrow UDFs over ``binaryFile`` rows or archive entries: geometry buffers, glb and b3dm containers,
PNG and JPEG headers. Each is a plain function of bytes; ``as_udf`` makes it a column function. Bad input gives null or raises as told."""

import math
import json
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from orograph.sources import meshopt

#: Rows of a frame of vertices, about.
FRAME = 50_000
#: Fixed values of the formats.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
COMPONENTS = {5120: np.int8, 5121: np.uint8, 5122: np.int16, 5123: np.uint16, 5125: np.uint32, 5126: np.float32}
SHAPES = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT4": 16}
#: Fixed value: the luminance table of JPEG's Annex K.
LUMINANCE = [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]


def as_udf(function, returns: str):
    """A pandas UDF of a decoder, for columns of small binaries."""

    @F.pandas_udf(returns)
    def run(content: pd.Series) -> pd.Series:
        return content.map(lambda b: None if b is None else function(bytes(b)))

    return run


def geometry(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions (n, 3) and texture coordinates (n, 2) of a buffer: counts, then floats, little endian."""
    n = struct.unpack_from("<I", data)[0]
    return np.frombuffer(data, "<f4", 3 * n, 8).reshape(n, 3).astype(float), np.frombuffer(data, "<f4", 2 * n, 8 + 12 * n).reshape(n, 2).astype(float)


def geometry_of(xyz: np.ndarray, uv: np.ndarray) -> bytes:
    """The buffer of positions (n, 3) and texture coordinates (n, 2), as ``geometry`` reads it."""
    return struct.pack("<II", len(xyz), 1) + np.asarray(xyz, "<f4").tobytes() + np.asarray(uv, "<f4").tobytes()


def vertices(content_frame, name="name", content="content"):
    """``tile, vid, x, y, z, u, v`` of geometry buffers (name, content)."""

    def joined(tiles, parts):
        p, t = (np.concatenate([x[i] for x in parts]) for i in range(2))
        n = [len(x[0]) for x in parts]
        return pd.DataFrame({"tile": np.repeat(np.array(tiles, object), n), "vid": np.concatenate([np.arange(k) for k in n]), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "u": t[:, 0], "v": t[:, 1]})

    def run(frames):
        # small buffers leave in one frame
        for f in frames:
            tiles, parts, n = [], [], 0
            for tile, data in zip(f[name], f[content], strict=True):
                tiles.append(tile)
                parts.append(geometry(bytes(data)))
                n += len(parts[-1][0])
                if n >= FRAME:
                    yield joined(tiles, parts)
                    tiles, parts, n = [], [], 0
            if parts:
                yield joined(tiles, parts)

    return content_frame.select(name, content).mapInPandas(run, "tile string, vid long, x double, y double, z double, u double, v double")


def glb_parts(data: bytes) -> tuple[dict, bytes]:
    """The JSON and the binary chunk."""
    if data[:4] != b"glTF":
        raise ValueError("no glb")
    at, j, b = 12, None, b""
    while at + 8 <= len(data):
        n, kind = struct.unpack_from("<I4s", data, at)
        chunk = data[at + 8 : at + 8 + n]
        if kind == b"JSON":
            j = json.loads(chunk)
        elif kind == b"BIN\0":
            b = chunk
        at += 8 + n
    return j, b


def glb_accessor(j: dict, blob: bytes, index: int) -> np.ndarray:
    """An accessor's numbers as (count, components); normalised integers become fractions. Compressed views are decoded."""
    a = j["accessors"][index]
    view = j["bufferViews"][a["bufferView"]]
    kind, k = np.dtype(COMPONENTS[a["componentType"]]), SHAPES[a["type"]]
    packed = view.get("extensions", {}).get("EXT_meshopt_compression")
    if packed:
        blob, start, stride = meshopt.view(packed, blob), 0, packed["byteStride"]
    else:
        start, stride = view.get("byteOffset", 0), view.get("byteStride")
    start, step = start + a.get("byteOffset", 0), stride or kind.itemsize * k
    if a["count"] and start + (a["count"] - 1) * step + kind.itemsize * k > len(blob):
        raise ValueError("an accessor reaches beyond its buffer")
    raw = np.lib.stride_tricks.as_strided(np.frombuffer(blob, np.uint8)[start:], (a["count"], kind.itemsize * k), (step, 1))
    out = np.ascontiguousarray(raw).view(kind).reshape(-1, k).astype(float)
    return np.maximum(out / np.iinfo(kind).max, -1) if a.get("normalized") else out


def glb_meshes(data: bytes, stride: int = 1, with_triangles: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """World positions and triangles of every primitive, by the scene's nodes."""
    from orograph.functions import matrix

    j, blob = glb_parts(data)
    out = []

    def visit(i, world):
        node = j["nodes"][i]
        own = node.get("matrix") or matrix.trs(node.get("translation", (0, 0, 0)), node.get("rotation", (0, 0, 0, 1)), node.get("scale", (1, 1, 1)))
        world = world @ matrix.as_numpy(own)
        if "mesh" in node:
            for p in j["meshes"][node["mesh"]]["primitives"]:
                xyz = glb_accessor(j, blob, p["attributes"]["POSITION"])
                tri = glb_accessor(j, blob, p["indices"])[:, 0].astype(int).reshape(-1, 3) if "indices" in p else np.arange(len(xyz) // 3 * 3).reshape(-1, 3)
                xyz = xyz @ world[:3, :3].T + world[:3, 3]
                out.append((xyz[::stride], tri if with_triangles else tri[:0]))
        for c in node.get("children", ()):
            visit(c, world)

    scene = j.get("scenes", [{}])[j.get("scene", 0)]
    for root in scene.get("nodes", range(len(j.get("nodes", ())))):
        visit(root, np.eye(4))
    return out


def glb_of_b3dm(data: bytes) -> bytes:
    """The glb within a b3dm: behind the header and its four tables. A tile centre in the feature table is not supported."""
    if data[:4] != b"b3dm":
        raise ValueError("no b3dm")
    sizes = struct.unpack_from("<4I", data, 12)
    if sizes[0] and json.loads(data[28 : 28 + sizes[0]] or b"{}").get("RTC_CENTER"):
        raise ValueError("RTC_CENTER is not supported")
    return data[28 + sum(sizes) :]


def glb_of(xyz: np.ndarray, triangles: np.ndarray, translation=(0.0, 0.0, 0.0)) -> bytes:
    """A plain glb of one mesh: positions as floats, triangles as 32-bit indices, one node that is moved by ``translation``."""
    p, t = np.asarray(xyz, "<f4"), np.asarray(triangles, "<u4").reshape(-1)
    blob = p.tobytes() + t.tobytes()
    j = {
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0, "translation": [float(x) for x in translation]}], "buffers": [{"byteLength": len(blob)}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}], "bufferViews": [{"buffer": 0, "byteLength": p.nbytes}, {"buffer": 0, "byteOffset": p.nbytes, "byteLength": t.nbytes}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": len(p), "type": "VEC3", "min": p.min(0).tolist(), "max": p.max(0).tolist()}, {"bufferView": 1, "componentType": 5125, "count": len(t), "type": "SCALAR"}],
    }
    text = json.dumps(j).encode()
    text += b" " * (-len(text) % 4)
    blob += b"\0" * (-len(blob) % 4)
    return b"glTF" + struct.pack("<II", 2, 28 + len(text) + len(blob)) + struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(blob), b"BIN\0") + blob


def b3dm_of(glb: bytes, batch: int = 0) -> bytes:
    """A glb behind the header of a b3dm with a feature table that has the batch's length."""
    table = json.dumps({"BATCH_LENGTH": batch}).encode()
    table += b" " * (-(28 + len(table)) % 8)
    return b"b3dm" + struct.pack("<2I", 1, 28 + len(table) + len(glb)) + struct.pack("<4I", len(table), 0, 0, 0) + table + glb


def png_pixels(data: bytes) -> np.ndarray | None:
    """(height, width, 3) of an 8-bit PNG without interlacing; null for other kinds."""
    if data[:8] != PNG_SIGNATURE:
        return None
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(chunk)
        at += 12 + n
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 3, 4, 6):
        return None
    width, height, k = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * k)
    out, above = np.zeros((height, width, k), np.uint8), np.zeros((width, k), np.int16)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].reshape(width, k)
        if kind == 0:
            row = line.astype(np.int16)
        elif kind == 1:
            row = np.cumsum(line, 0, np.int64).astype(np.uint8).astype(np.int16)
        elif kind == 2:
            row = (line + above) & 255
        else:
            row, left, corner = np.empty((width, k), np.int16), np.zeros(k, np.int16), np.zeros(k, np.int16)
            for x in range(width):
                up = above[x]
                if kind == 3:
                    guess = (left + up) >> 1
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                left = row[x] = (line[x] + guess) & 255
                corner = up
        out[y], above = row, row.astype(np.int16)
    if head[3] == 3:
        return palette[out[..., 0]]
    return np.repeat(out[..., :1], 3, 2) if k < 3 else out[..., :3]


def png_heights(data: bytes) -> list[float] | None:
    """Row-major heights of an elevation tile; null where the PNG isn't readable."""
    rgb = png_pixels(data)
    return None if rgb is None else (rgb.astype(float) @ np.array([256.0, 1.0, 1 / 256]) - 32768.0).reshape(-1).tolist()


def png_of(rgb: np.ndarray, filter_: int = 1) -> bytes:
    """An RGB PNG; filter 1 (differences along a row) or 0 (none)."""
    h, w, _ = rgb.shape
    lines = rgb.astype(np.uint8).reshape(h, w, 3)
    if filter_ == 1:
        lines = np.concatenate([lines[:, :1], lines[:, 1:] - lines[:, :-1]], 1)
    raw = np.concatenate([np.full((h, 1), filter_, np.uint8), lines.reshape(h, w * 3)], 1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def png_of_heights(heights: np.ndarray) -> bytes:
    """An elevation tile of a square array of heights."""
    v = np.clip(np.floor((heights + 32768.0) * 256 + 0.5), 0, 0xFFFFFF).astype(np.int64)
    return png_of(np.stack([v >> 16, v >> 8 & 255, v & 255], -1).astype(np.uint8))


def _segments(data: bytes):
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        kind = data[at + 1]
        if kind in (0x01, 0xFF) or 0xD0 <= kind <= 0xD9:
            at += 1 if kind == 0xFF else 2
            continue
        n = struct.unpack_from(">H", data, at + 2)[0]
        yield kind, data[at + 4 : at + 2 + n]
        if kind == 0xDA:
            return
        at += 2 + n


def jpeg_size(data: bytes) -> list[int]:
    """Width and height; raises if there is no frame header."""
    for kind, body in _segments(data):
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", body, 1)
            return [w, h]
    raise ValueError("no frame header in the JPEG")


def jpeg_quality(data: bytes) -> int | None:
    """An estimate on the usual 1 to 100 scale from the first quantisation table: its sum against the standard one's, halves up; null without one."""
    for kind, body in _segments(data):
        if kind == 0xDB:
            wide, table = body[0] >> 4, body[1:]
            scale = float(np.frombuffer(table, ">u2" if wide else np.uint8, 64).sum()) / sum(LUMINANCE) * 100
            return math.floor(((200 - scale) / 2 if scale <= 100 else 5000 / scale) + 0.5)
    return None


def layer_problem(layer: dict) -> str | None:
    """Why a layer can't be read, or null: it must be an integrated mesh in geographic coordinates."""
    ref = layer.get("spatialReference", {})
    if layer.get("layerType") != "IntegratedMesh":
        return f"layer type {layer.get('layerType')} is not IntegratedMesh"
    return None if ref.get("latestWkid", ref.get("wkid")) == 4326 else f"wkid {ref.get('wkid')} is not 4326"


def height_datum_warning(layer: dict) -> str | None:
    vcs = layer.get("spatialReference", {}).get("vcsWkid")
    return None if vcs == 5773 else f"heights are in vcsWkid {vcs}, not 5773"


NODE = "struct<index:int,children:array<int>,obb:struct<center:array<double>>,mesh:struct<geometry:struct<vertexCount:int,resource:int>,material:struct<definition:int>>>"


def node_pages(entries, prefix: str = "nodepages/"):
    """The nodes of all pages (rows name, content), one row each."""
    pages = entries.where(F.col("name").startswith(prefix) & F.col("name").rlike(r"\d+\.json(\.gz)?$"))
    nodes = F.from_json(F.col("content").cast("string"), f"nodes array<{NODE}>")["nodes"]
    return pages.select(F.explode(nodes).alias("n")).select(F.col("n.index").alias("node_id"), F.col("n.children").alias("children"), F.col("n.obb.center").alias("center"), F.col("n.mesh.geometry.vertexCount").alias("vertex_count"), F.col("n.mesh.geometry.resource").alias("geometry"))


def parents_of(nodes):
    """``node_id, parent_id, ord`` from children lists."""
    links = nodes.select(F.col("node_id").alias("parent_id"), F.posexplode("children").alias("ord", "node_id"))
    return nodes.select("node_id").join(links, "node_id", "left").select("node_id", "parent_id", F.coalesce("ord", F.lit(0)).alias("ord"))
