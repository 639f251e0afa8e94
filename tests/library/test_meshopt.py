"""Compressed buffer views: known streams, round trips through an encoder of the tests, filters, and a glb whose views are all compressed."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph.sources import binaries, meshopt

TABLE = bytes([0x00, 0x76, 0x87, 0x56, 0x67, 0x78, 0xA9, 0x86, 0x65, 0x89, 0x68, 0x98, 0x01, 0x69, 0x00, 0x00])


def test_triangle_streams():
    old = bytes([0xE0, 0xF0, 0x10, 0xFE, 0xFF, 0xF0, 0x0C, 0xFF, 0x02, 0x02, 0x02]) + TABLE
    assert meshopt.triangles(old, 12).tolist() == [0, 1, 2, 2, 1, 3, 4, 6, 5, 7, 8, 9]
    new = bytes([0xE1, 0xF0, 0x10, 0xFE, 0x1F, 0x3D, 0x00, 0x0A]) + TABLE
    assert meshopt.triangles(new, 15).tolist() == [0, 1, 2, 2, 1, 3, 0, 1, 2, 2, 1, 5, 2, 1, 4]
    for broken in (b"", b"\xa0" + old[1:], old[:1]):
        with pytest.raises((ValueError, IndexError)):
            meshopt.triangles(broken, 12)


def test_index_stream():
    data = bytes([0xD1, 0x00, 0x04, 0xCD, 0x01, 0x04, 0x07, 0x98, 0x1F, 0, 0, 0, 0])
    assert meshopt.indices(data, 6).tolist() == [0, 1, 51, 2, 49, 1000]


def packed_attributes(rows: np.ndarray) -> bytes:
    """The smallest of the four widths for every group of 16."""
    count, stride = rows.shape
    step = min(8192 // stride & ~15, 256)
    out, last = b"\xa0", rows[0]
    for first in range(0, count, step):
        block = rows[first : first + step]
        for k in range(stride):
            d = np.diff(np.concatenate([last[k : k + 1], block[:, k]]).astype(int)).astype(np.int8).astype(int)
            z = ((d << 1) ^ (d >> 7)) & 255
            z = np.concatenate([z, np.zeros(-len(z) % 16, int)]).reshape(-1, 16)
            modes, body = [], b""
            for g in z:
                choices = [(0, b"")] if not g.any() else []
                for mode, bits in ((1, 2), (2, 4)):
                    most = (1 << bits) - 1
                    text = "".join(f"{min(v, most):0{bits}b}" for v in g)
                    choices.append((mode, int(text, 2).to_bytes(2 * bits, "big") + bytes(int(v) for v in g if v >= most)))
                mode, part = min([*choices, (3, bytes(g.tolist()))], key=lambda c: len(c[1]))
                modes.append(mode)
                body += part
            modes += [0] * (-len(modes) % 4)
            out += bytes(a | b << 2 | c << 4 | d << 6 for a, b, c, d in zip(*[iter(modes)] * 4, strict=True)) + body
        last = block[-1]
    return out + bytes(max(32 - stride, 0)) + rows[0].tobytes()


@pytest.mark.parametrize("count,stride", [(1, 4), (4, 12), (16, 8), (255, 16), (256, 4), (257, 8), (1000, 64), (3000, 4)])
def test_attribute_round_trip(count, stride):
    rng = np.random.default_rng(count)
    rows = np.cumsum(rng.integers(-3, 4, (count, stride)) * rng.integers(0, 2, stride), 0)
    rows[:, 0] = rng.integers(0, 256, count)
    rows = rows.astype(np.uint8)
    data = packed_attributes(rows)
    assert (meshopt.attributes(data, count, stride) == rows).all()
    with pytest.raises(ValueError):
        meshopt.attributes(data[: len(data) // 2], count * 3, stride)
    with pytest.raises(ValueError):
        meshopt.attributes(b"\xa1" + data[1:], count, stride)


def test_filters():
    e = np.array([[3, -2], [1, 5]])
    m = np.array([[7, -9], [0, 1 << 20]])
    v = ((e << 24) | (m & 0xFFFFFF)).astype("<i4").view(np.uint8).reshape(2, 8)
    assert np.array_equal(meshopt._filtered(v, "EXPONENTIAL").view("<f4"), (m * 2.0**e).astype("<f4"))
    rng = np.random.default_rng(0)
    n = rng.normal(size=(200, 3))
    n /= np.linalg.norm(n, axis=1)[:, None]
    o = n / np.abs(n).sum(1)[:, None]
    x, y = (np.where(o[:, 2] >= 0, o[:, i], (1 - np.abs(o[:, 1 - i])) * np.where(o[:, i] >= 0, 1, -1)) for i in (0, 1))
    rows = np.column_stack([np.rint(x * 2047), np.rint(y * 2047), np.full(200, 2047), np.arange(200)]).astype("<i2")
    got = meshopt._filtered(rows.view(np.uint8), "OCTAHEDRAL")
    assert np.abs(got[:, :3] / 32767 - n).max() < 2e-3 and (got[:, 3] == np.arange(200)).all()
    q = rng.normal(size=(200, 4))
    q /= np.linalg.norm(q, axis=1)[:, None]
    big = np.abs(q).argmax(1)
    q *= np.sign(q[np.arange(200), big])[:, None]
    rest = [q[np.arange(200), (big + k) & 3] for k in (1, 2, 3)]
    rows = np.column_stack([*(np.rint(c * np.sqrt(2) * 2047) for c in rest), 2044 | big]).astype("<i2")
    assert np.abs(meshopt._filtered(rows.view(np.uint8), "QUATERNION") / 32767 - q).max() < 2e-3
    with pytest.raises(ValueError):
        meshopt._filtered(rows.view(np.uint8), "OTHER")


def compressed_glb():
    """A quantised mesh whose positions and triangles are compressed, with an empty fallback buffer as writers leave it."""
    xyz = np.array([[0, 0, 0, 0], [100, 0, 0, 0], [0, 100, 0, 0], [100, 100, 50, 0]], "<u2")
    pos = packed_attributes(xyz.view(np.uint8).reshape(4, 8))
    pos += bytes(-len(pos) % 4)
    tri = bytes([0xE1, 0xF0, 0x10]) + TABLE
    exact = len(packed_attributes(xyz.view(np.uint8).reshape(4, 8)))
    ext = lambda at, n, stride, count, mode: {"buffer": 1, "byteLength": count * stride, "extensions": {"EXT_meshopt_compression": {"buffer": 0, "byteOffset": at, "byteLength": n, "byteStride": stride, "count": count, "mode": mode}}}
    j = {"scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0, "translation": [1, 0, 0], "scale": [0.5, 0.5, 0.5]}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}],
         "accessors": [{"bufferView": 0, "componentType": 5123, "count": 4, "type": "VEC3"}, {"bufferView": 1, "componentType": 5123, "count": 6, "type": "SCALAR"}],
         "bufferViews": [ext(0, exact, 8, 4, "ATTRIBUTES"), ext(len(pos), len(tri), 2, 6, "TRIANGLES")], "buffers": [{"byteLength": len(pos) + len(tri)}, {"byteLength": 44}]}
    blob = pos + tri
    blob += bytes(-len(blob) % 4)
    text = json.dumps(j).encode()
    text += b" " * (-len(text) % 4)
    return b"glTF" + struct.pack("<II", 2, 20 + len(text) + 8 + len(blob)) + struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(blob), b"BIN\0") + blob


def test_compressed_glb(spark):
    ((p, t),) = binaries.glb_meshes(compressed_glb())
    assert p.tolist() == [[1, 0, 0], [51, 0, 0], [1, 50, 0], [51, 50, 25]] and t.tolist() == [[0, 1, 2], [2, 1, 3]]
    df = spark.createDataFrame([("a", compressed_glb()), ("b", compressed_glb())], "name string, content binary")
    got = df.select(binaries.as_udf(lambda b: float(binaries.glb_meshes(b)[0][0][:, 2].max()), "double")("content").alias("top")).agg(F.sum("top")).first()[0]
    assert got == 50.0
