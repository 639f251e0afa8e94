"""Decoder of compressed glTF buffer views (the published EXT_meshopt_compression bit streams, version 0 of attributes): the three modes and the
three filters. Plain functions of bytes for ``binaries.glb_accessor``; broken streams raise ValueError."""

import numpy as np

#: Fixed values of the format.
ATTRIBUTES, TRIANGLES, INDICES = 0xA0, 0xE0, 0xD0
BLOCK_BYTES, BLOCK_ROWS, GROUP, TAIL = 8192, 256, 16, 32


def view(extension: dict, blob: bytes) -> bytes:
    """The plain bytes of a compressed view, count * byteStride of them. Its source must lie in the glb's own binary chunk."""
    if extension.get("buffer", 0) != 0:
        raise ValueError("a compressed view outside the binary chunk is not supported")
    start, count, stride = extension.get("byteOffset", 0), extension["count"], extension["byteStride"]
    data = blob[start : start + extension["byteLength"]]
    if len(data) < extension["byteLength"]:
        raise ValueError("a compressed view ends early")
    mode, kind = extension["mode"], extension.get("filter", "NONE")
    try:
        if mode == "ATTRIBUTES":
            return _filtered(attributes(data, count, stride), kind).tobytes()
        if mode in ("TRIANGLES", "INDICES") and stride in (2, 4):
            return (triangles if mode == "TRIANGLES" else indices)(data, count).astype(f"<u{stride}").tobytes()
    except IndexError as e:
        raise ValueError("a compressed view ends early") from e
    raise ValueError(f"mode {mode} with stride {stride} is not supported")


def attributes(data: bytes, count: int, stride: int) -> np.ndarray:
    """(count, stride) bytes. A block's columns follow one another; each is groups of 16 zigzag differences in 0, 2, 4 or 8 bits, where the
    largest 2- or 4-bit value stands for a whole byte behind its group."""
    if not data or data[0] != ATTRIBUTES:
        raise ValueError("no attribute stream of version 0")
    raw, end = np.frombuffer(data, np.uint8), len(data) - max(stride, TAIL)
    if end < 1:
        raise ValueError("a compressed view ends early")
    out, last, at = np.empty((count, stride), np.uint8), raw[len(raw) - stride :], 1
    step = min(BLOCK_BYTES // stride & ~(GROUP - 1), BLOCK_ROWS)
    for first in range(0, count, step):
        n = min(step, count - first)
        groups = -(-n // GROUP)
        for k in range(stride):
            modes = raw[at : at + -(-groups // 4)]
            modes = (modes[:, None] >> np.arange(0, 8, 2) & 3).reshape(-1)[:groups]
            at += -(-groups // 4)
            column = np.zeros((groups, GROUP), np.uint8)
            for g, mode in enumerate(modes.tolist()):
                if mode:
                    column[g], at = _group(raw, at, 1 << mode)
            if at > end:
                raise ValueError("a compressed view ends early")
            v = column.reshape(-1)[:n]
            out[first : first + n, k] = np.cumsum((v >> 1) ^ (0 - (v & 1)), dtype=np.uint8) + last[k]
        last = out[first + n - 1]
    return out


def _group(raw: np.ndarray, at: int, bits: int) -> tuple[np.ndarray, int]:
    """16 values of so many bits from the highest on, and where the next group begins."""
    behind = at + 2 * bits
    if bits == 8:
        return raw[at:behind], behind
    most = (1 << bits) - 1
    values = (raw[at:behind, None] >> np.arange(8 - bits, -1, -bits) & most).astype(np.uint8).reshape(-1)
    whole = np.flatnonzero(values == most)
    values[whole] = raw[behind : behind + len(whole)]
    return values, behind + len(whole)


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A number in groups of seven bits, lowest first, and the place behind it."""
    v = shift = 0
    while True:
        b = data[at]
        at += 1
        v |= (b & 127) << shift
        if b < 128:
            return v, at
        shift += 7


def indices(data: bytes, count: int) -> np.ndarray:
    """A list of indices: zigzag differences to the last one of either of two running values."""
    if not data or data[0] & 0xF0 != INDICES or data[0] & 15 > 1:
        raise ValueError("no index stream")
    out, last, at = np.empty(count, np.int64), [0, 0], 1
    for i in range(count):
        v, at = _number(data, at)
        d = v >> 1
        last[v & 1] += (d >> 1) ^ -(d & 1)
        out[i] = last[v & 1] & 0xFFFFFFFF
    return out


def triangles(data: bytes, count: int) -> np.ndarray:
    """Corner indices of count // 3 triangles: each continues one of the last 16 edges, or begins anew with next, recent or explicit vertices."""
    if not data or data[0] & 0xF0 != TRIANGLES or data[0] & 15 > 1 or count % 3:
        raise ValueError("no triangle stream")
    if len(data) < 1 + count // 3 + 16:
        raise IndexError("the stream ends early")
    recent = 13 if data[0] & 15 else 15
    table, at = len(data) - 16, 1 + count // 3
    edges, vertices, fresh, last = [], [], 0, 0
    out = []

    def explicit():
        nonlocal at, last
        v, at = _number(data, at)
        last = (last + ((v >> 1) ^ -(v & 1))) & 0xFFFFFFFF
        return last

    def following():
        nonlocal fresh
        fresh += 1
        return fresh - 1

    for code in data[1:at]:
        if code < 0xF0:
            a, b = edges[-1 - (code >> 4)]
            third = code & 15
            if 0 < third < recent:
                c = vertices[-1 - third]
            else:
                if third == 0:
                    c = following()
                elif third == 15:
                    c = explicit()
                else:
                    c = last = (last + (1 if third == 14 else -1)) & 0xFFFFFFFF
                vertices.append(c)
            edges += ((c, b), (a, c))
        else:
            if code < 0xFE:
                rule, first = data[table + (code & 15)], 0
            else:
                rule, first = data[at], 15 * (code & 1)
                at += 1
                if rule == 0:
                    fresh = 0
            second, third = rule >> 4, rule & 15
            # Vertices that are "next" get their numbers in order before explicit ones are read; recent ones count from before this triangle.
            known = [following() if k == 0 else None if k == 15 and code >= 0xFE else vertices[-k] for k in (first, second, third)]
            a, b, c = (explicit() if v is None else v for v in known)
            vertices += [v for v, k in zip((a, b, c), (first, second, third), strict=True) if k == 0 or (k == 15 and code >= 0xFE)]
            edges += ((b, a), (c, b), (a, c))
        out += (a, b, c)
        if len(edges) > 4096:
            edges, vertices = edges[-16:], vertices[-16:]
    return np.array(out, np.int64)


def _filtered(rows: np.ndarray, kind: str) -> np.ndarray:
    """The filter that stands behind an attribute stream, undone."""
    if kind == "NONE":
        return rows
    if kind == "EXPONENTIAL":
        v = np.ascontiguousarray(rows).view("<i4")
        return np.ldexp((v << 8 >> 8).astype(np.float32), v >> 24).astype("<f4")
    if kind == "OCTAHEDRAL":
        v = np.ascontiguousarray(rows).view(np.int8 if rows.shape[1] == 4 else "<i2")
        x, y, one = (v[:, i].astype(np.float32) for i in range(3))
        z = one - np.abs(x) - np.abs(y)
        fold = np.minimum(z, 0)
        x, y = x + np.where(x >= 0, fold, -fold), y + np.where(y >= 0, fold, -fold)
        scale = np.iinfo(v.dtype).max / np.sqrt(x * x + y * y + z * z)
        return np.column_stack([*(_whole(c * scale, v.dtype) for c in (x, y, z)), v[:, 3]])
    if kind == "QUATERNION":
        v = np.ascontiguousarray(rows).view("<i2")
        scale = np.float32(1 / np.sqrt(2)) / (v[:, 3] | 3).astype(np.float32)
        small = [v[:, i].astype(np.float32) * scale for i in range(3)]
        large = np.sqrt(np.maximum(1 - sum(c * c for c in small), 0))
        out, place, row = np.empty_like(v), v[:, 3] & 3, np.arange(len(v))
        for k, c in enumerate((large, *small)):
            out[row, (place + k) & 3] = _whole(c * 32767, v.dtype)
        return out
    raise ValueError(f"filter {kind} is not supported")


def _whole(x: np.ndarray, kind) -> np.ndarray:
    """The nearest whole numbers, halves away from zero."""
    return np.trunc(x + np.where(x >= 0, 0.5, -0.5)).astype(kind)
