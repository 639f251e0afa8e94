"""Rules for requests to a store of tiles, as Column expressions: type, caching, ranges, origins and status."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
CONTENT_TYPES = {
    "json": "application/json", "geojson": "application/geo+json", "glb": "model/gltf-binary", "gltf": "model/gltf+json",
    "b3dm": "application/octet-stream", "i3dm": "application/octet-stream", "pnts": "application/octet-stream", "cmpt": "application/octet-stream",
    "subtree": "application/octet-stream", "bin": "application/octet-stream", "ktx2": "image/ktx2", "jpg": "image/jpeg", "jpeg": "image/jpeg",
    "png": "image/png", "webp": "image/webp",
}
VERSIONED = r"^/[a-z0-9-]+/v\d+/"
LONG_CACHE, SHORT_CACHE, MISSING_CACHE = "public, max-age=31536000, immutable", "public, max-age=300", "public, max-age=60"
DEFAULT_TYPE = "application/octet-stream"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def extension(path) -> Column:
    return F.lower(F.substring_index(_c(path), ".", -1))


def content_type(path, stored=None) -> Column:
    known = F.create_map(*(F.lit(v) for kv in CONTENT_TYPES.items() for v in kv))
    more = [] if stored is None else [F.nullif(_c(stored), F.lit(""))]
    return F.coalesce(known[extension(path)], *more, F.lit(DEFAULT_TYPE))


def is_versioned(path) -> Column:
    return _c(path).rlike(VERSIONED)


def cache_policy(path) -> Column:
    return F.when(is_versioned(path), LONG_CACHE).otherwise(SHORT_CACHE)


def upload_policy(path) -> Column:
    """At upload the extension decides: documents that change are kept shortly."""
    return F.when(extension(path).isin("json", "geojson"), SHORT_CACHE).otherwise(LONG_CACHE)


def byte_range(header, size) -> Column:
    """struct<start, length, text> of ``bytes=a-b``, ``bytes=a-`` or ``bytes=-n``; null for anything else or beyond the end."""
    header, size = _c(header), _c(size)
    part = lambda i: F.nullif(F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", i), F.lit("")).try_cast("bigint")
    a, b = part(1), part(2)
    start = F.when(a.isNotNull(), a).otherwise(F.greatest(size - b, F.lit(0)))
    length = F.when(a.isNotNull(), F.least(F.coalesce(b, size - 1), size - 1) - a + 1).otherwise(F.least(b, size))
    made = F.struct(start.alias("start"), length.alias("length"), F.concat(F.lit("bytes "), start, F.lit("-"), start + length - 1, F.lit("/"), size).alias("text"))
    return F.when(header.rlike(r"^bytes=(\d+-\d*|-\d+)$") & (length > 0) & (start < size), made)


def is_allowed_origin(origin, allowed=(), preview: str | None = None) -> Column:
    """Origins in a list or matching the pattern of preview deployments."""
    origin = F.coalesce(_c(origin), F.lit(""))
    ok = origin.isin(*allowed) if allowed else F.lit(False)
    return (origin != "") & (ok | origin.rlike(preview) if preview else ok)


def bad_path(path) -> Column:
    """Empty, a folder, or one that climbs."""
    key = F.substring(_c(path), 2, 1 << 30)
    return (key == "") | key.endswith("/") | F.array_contains(F.split(key, "/"), "..")


def has_broken_escape(path) -> Column:
    return _c(path).rlike(r"%(?![0-9A-Fa-f]{2})")


def status(method, path, found, range_header=None, size=None, if_none_match=None, etag=None) -> Column:
    """The response's status, by the first rule that holds."""
    method, found = _c(method), _c(found)
    out = F.when(method == "OPTIONS", 204).when(~method.isin("GET", "HEAD"), 405).when(has_broken_escape(path), 400).when(bad_path(path), 404).when(~F.coalesce(found, F.lit(False)), 404)
    if if_none_match is not None:
        out = out.when((method == "GET") & _c(if_none_match).eqNullSafe(_c(etag)) & _c(etag).isNotNull(), 304)
    if range_header is not None:
        out = out.when(byte_range(range_header, size).isNotNull(), 206)
    return out.otherwise(200)
