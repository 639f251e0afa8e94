"""Geodetic conversions, tile arithmetic and elevation coding as Column expressions: no Python runs per row.

Angles are degrees, lengths metres. Local metres use a sphere of the ellipsoid's equatorial radius."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84.
A = 6378137.0
F_INV = 298.257223563
FLATTENING = 1 / F_INV
E2 = FLATTENING * (2 - FLATTENING)
E2_ROUNDED = 6.69437999014e-3


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def to_ecef(lon, lat, h, e2: float = E2) -> tuple[Column, Column, Column]:
    lon, lat, h = F.radians(_c(lon)), F.radians(_c(lat)), _c(h)
    n = A / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return (n + h) * F.cos(lat) * F.cos(lon), (n + h) * F.cos(lat) * F.sin(lon), (n * (1 - e2) + h) * F.sin(lat)


def from_ecef(x, y, z, e2: float = E2_ROUNDED, rounds: int = 5) -> tuple[Column, Column, Column]:
    """Longitude, latitude, height; the latitude by a fixed number of iterations, as a fold over a sequence."""
    x, y, z = _c(x), _c(y), _c(z)
    p = F.sqrt(x * x + y * y)

    def step(state, _):
        s = F.sin(state["lat"])
        n = A / F.sqrt(1 - e2 * s * s)
        h = p / F.cos(state["lat"]) - n
        return F.struct(F.atan2(z, p * (1 - e2 * n / (n + h))).alias("lat"), h.alias("h"))

    start = F.struct(F.atan2(z, p * (1 - e2)).alias("lat"), F.lit(0.0).alias("h"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    return F.degrees(F.atan2(y, x)), F.degrees(found["lat"]), found["h"]


def enu_axes(lon: float, lat: float) -> list[list[float]]:
    """East, north and up at a place, in earth-centred axes."""
    lo, la = math.radians(lon), math.radians(lat)
    return [[-math.sin(lo), math.cos(lo), 0.0], [-math.sin(la) * math.cos(lo), -math.sin(la) * math.sin(lo), math.cos(la)], [math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la)]]


def ecef_of(lon: float, lat: float, h: float = 0.0, e2: float = E2) -> list[float]:
    lo, la = math.radians(lon), math.radians(lat)
    n = A / math.sqrt(1 - e2 * math.sin(la) ** 2)
    return [(n + h) * math.cos(la) * math.cos(lo), (n + h) * math.cos(la) * math.sin(lo), (n * (1 - e2) + h) * math.sin(la)]


def enu_frame(lon: float, lat: float, h: float = 0.0) -> list[float]:
    """The 4x4 matrix, by columns, that takes east, north, up at a place to earth-centred coordinates."""
    e, n, u = enu_axes(lon, lat)
    return [*e, 0.0, *n, 0.0, *u, 0.0, *ecef_of(lon, lat, h), 1.0]


def to_enu(x, y, z, lon: float, lat: float, h: float = 0.0) -> tuple[Column, Column, Column]:
    """East, north and up of an earth-centred position, seen from a fixed place."""
    d = [_c(v) - o for v, o in zip((x, y, z), ecef_of(lon, lat, h), strict=True)]
    return tuple(a[0] * d[0] + a[1] * d[1] + a[2] * d[2] for a in enu_axes(lon, lat))


def local_metres(lon, lat, lon0, lat0) -> tuple[Column, Column]:
    lon, lat, lon0, lat0 = map(_c, (lon, lat, lon0, lat0))
    return F.radians(lon - lon0) * A * F.cos(F.radians(lat0)), F.radians(lat - lat0) * A


def from_local_metres(e, n, lon0, lat0) -> tuple[Column, Column]:
    e, n, lon0, lat0 = map(_c, (e, n, lon0, lat0))
    return lon0 + F.degrees(e / (A * F.cos(F.radians(lat0)))), lat0 + F.degrees(n / A)


def tile_position(lon, lat, z: int) -> tuple[Column, Column]:
    """Position in tiles of the web-mercator pyramid at level z; the integer part is the tile."""
    lat = F.radians(_c(lat))
    n = float(2**z)
    return (_c(lon) + 180) / 360 * n, (1 - F.asinh(F.tan(lat)) / math.pi) / 2 * n


def tile_of(lon, lat, z: int) -> tuple[Column, Column]:
    x, y = tile_position(lon, lat, z)
    return F.floor(x), F.floor(y)


def pixel_of(lon, lat, z: int, size: int = 256) -> tuple[Column, Column]:
    """Position in pixels within the tile, kept so far from the last edge that four neighbours exist."""
    x, y = tile_position(lon, lat, z)
    return tuple(F.least(F.greatest((v - F.floor(v)) * size, F.lit(0.0)), F.lit(size - 1 - 0.001)) for v in (x, y))


def tile_bounds(x, y, z) -> tuple[Column, Column, Column, Column]:
    """West, south, east, north."""
    x, y = _c(x), _c(y)
    n = F.pow(F.lit(2.0), _c(z))
    lat = lambda v: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * v / n))))
    return x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y)


def bilinear(heights, px, py, width: int = 256) -> Column:
    """A sample of a row-major array between four neighbours."""
    heights, px, py = _c(heights), _c(px), _c(py)
    c, r = F.floor(px).cast("int"), F.floor(py).cast("int")
    u, v = px - c, py - r
    at = lambda dr, dc: F.get(heights, (r + dr) * width + c + dc)
    return at(0, 0) * (1 - u) * (1 - v) + at(0, 1) * u * (1 - v) + at(1, 0) * (1 - u) * v + at(1, 1) * u * v


def decode_height(r, g, b) -> Column:
    return _c(r) * 256.0 + _c(g) + _c(b) / 256.0 - 32768.0


def encode_height(h) -> tuple[Column, Column, Column]:
    """Red, green and blue of a height, to 1/256 m, clamped to 24 bits."""
    v = F.least(F.greatest(F.floor((_c(h) + 32768.0) * 256.0 + 0.5), F.lit(0)), F.lit(0xFFFFFF)).cast("long")
    return F.shiftright(v, 16).cast("int"), F.shiftright(v, 8).bitwiseAND(F.lit(255)).cast("int"), v.bitwiseAND(F.lit(255)).cast("int")


def utm_central_meridian(zone: int) -> float:
    return zone * 6.0 - 183.0


#: Fixed values of the projection.
K0, FALSE_EAST = 0.9996, 500000.0


def _meridian(lat: Column) -> Column:
    e4, e6 = E2**2, E2**3
    return A * ((1 - E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * lat - (3 * E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * lat) + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * lat) - (35 * e6 / 3072) * F.sin(6 * lat))


def to_utm(lon, lat, zone: int) -> tuple[Column, Column]:
    """Easting and northing (northern hemisphere's origin) by the usual series; good to millimetres within a zone."""
    lo, la = F.radians(_c(lon) - utm_central_meridian(zone)), F.radians(_c(lat))
    ep2 = E2 / (1 - E2)
    s, c = F.sin(la), F.cos(la)
    n, t = A / F.sqrt(1 - E2 * s * s), F.tan(la) * F.tan(la)
    w, a = ep2 * c * c, lo * c
    east = K0 * n * (a + (1 - t + w) * F.pow(a, 3.0) / 6 + (5 - 18 * t + t * t + 72 * w - 58 * ep2) * F.pow(a, 5.0) / 120) + FALSE_EAST
    north = K0 * (_meridian(la) + n * F.tan(la) * (a * a / 2 + (5 - t + 9 * w + 4 * w * w) * F.pow(a, 4.0) / 24 + (61 - 58 * t + t * t + 600 * w - 330 * ep2) * F.pow(a, 6.0) / 720))
    return east, north


def from_utm(east, north, zone: int) -> tuple[Column, Column]:
    ep2 = E2 / (1 - E2)
    e1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    mu = _c(north) / K0 / (A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
    foot = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    s, c = F.sin(foot), F.cos(foot)
    n, t, w = A / F.sqrt(1 - E2 * s * s), F.tan(foot) * F.tan(foot), ep2 * c * c
    r = A * (1 - E2) / F.pow(1 - E2 * s * s, 1.5)
    d = (_c(east) - FALSE_EAST) / (n * K0)
    lat = foot - n * F.tan(foot) / r * (d * d / 2 - (5 + 3 * t + 10 * w - 4 * w * w - 9 * ep2) * F.pow(d, 4.0) / 24 + (61 + 90 * t + 298 * w + 45 * t * t - 252 * ep2 - 3 * w * w) * F.pow(d, 6.0) / 720)
    lon = (d - (1 + 2 * t + w) * F.pow(d, 3.0) / 6 + (5 - 2 * w + 28 * t - 3 * w * w + 8 * ep2 + 24 * t * t) * F.pow(d, 5.0) / 120) / c
    return F.degrees(lon) + utm_central_meridian(zone), F.degrees(lat)


def convergence_and_scale(lon, lat, meridian: float, k0: float = K0) -> tuple[Column, Column]:
    """Grid convergence (degrees) and point scale of a transverse Mercator grid."""
    d, la = F.radians(_c(lon) - meridian), F.radians(_c(lat))
    s, c = F.sin(la), F.cos(la)
    w = E2 / (1 - E2) * c * c
    return F.degrees(F.atan(F.tan(d) * s) * (1 + d * d * c * c / 3 * (1 + 3 * w))), k0 * (1 + d * d * c * c / 2 * (1 + w))


def anchor_altitude(base, adjust, ground, terrain_on, margin: float = 1.5) -> Column:
    """Where a model is set: above the terrain's surface, or above its own ground where no terrain is drawn."""
    return _c(base) + F.coalesce(_c(adjust), F.lit(0.0)) + margin - F.when(terrain_on, 0.0).otherwise(F.coalesce(_c(ground), F.lit(0.0)))


def zoom_for_distance(distance, lat, height_px: float, fov_degrees: float = 36.87, tile_px: float = 512.0) -> Column:
    """The map zoom at which a camera this far away sees the ground at the same scale."""
    metres = 2 * _c(distance) * math.tan(math.radians(fov_degrees) / 2) / height_px
    return F.log2(2 * math.pi * A * F.cos(F.radians(_c(lat))) / (metres * tile_px))


def framing_distance(radius, fov_degrees, width, height, left=0, bottom=0, fill: float = 0.95) -> Column:
    """How far a camera stands so that a circle fills the narrower angle of what panels leave free of the view."""
    t = F.tan(F.radians(_c(fov_degrees)) / 2)
    half_v = F.atan(t * F.greatest(_c(height) - _c(bottom), F.lit(120.0)) / _c(height))
    half_h = F.atan(t * F.greatest(_c(width) - _c(left), F.lit(160.0)) / _c(height))
    return _c(radius) / F.sin(F.least(half_v, half_h)) * fill


def camera_distance(x, y, z) -> Column:
    x, y, z = map(_c, (x, y, z))
    return F.sqrt(x * x + y * y + z * z)
