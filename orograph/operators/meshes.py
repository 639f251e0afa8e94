"""Meshes as tables: ``vertex(tile, vid, x, y, z, u, v)`` and ``triangle(tile, tid, a, b, c)``."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.functions import mesh as M
from orograph.operators import cover
from orograph.shared import Ranges, numbered


def corners(triangles: DataFrame, vertices: DataFrame, columns=("x", "y", "z"), first_id: int = 0) -> DataFrame:
    """Triangles with the columns of their three vertices as ``ax, ay, ...``: three joins on (tile, vertex). first_id: 1 where ids start at 1."""
    out = triangles
    for c in "abc":
        side = vertices.select("tile", (F.col("vid") + first_id).alias(c), *(F.col(k).alias(c + k) for k in columns))
        out = out.join(side, ["tile", c])
    return out


def corners_packed(triangles: DataFrame, packed: DataFrame, columns=("x", "y", "z")) -> DataFrame:
    """The same from one row a tile with arrays: one join, then array lookups."""
    out = triangles.join(packed, "tile")
    return out.select(*triangles.columns, *(F.get(F.col(k), F.col(c)).alias(c + k) for c in "abc" for k in columns))


def _xyz() -> list[Column]:
    return [F.col(c + k) for c in "abc" for k in "xyz"]


def with_normals(cornered: DataFrame) -> DataFrame:
    nx, ny, nz = M.cross(*_xyz())
    return cornered.withColumns({"nx": nx, "ny": ny, "nz": nz, "area": M.area_3d(*_xyz())})


def drop_degenerate(cornered: DataFrame, least: float = 1e-8) -> DataFrame:
    return cornered.where(M.area_3d(*_xyz()) >= least)


def drop_walls(normals: DataFrame, least_horizontal: float = 0.3) -> DataFrame:
    return normals.where(~M.is_wall(F.col("nx"), F.col("ny"), F.col("nz"), least_horizontal))


def wall_share(normals: DataFrame, least_horizontal: float = 0.3) -> DataFrame:
    return normals.agg((F.avg(M.is_wall(F.col("nx"), F.col("ny"), F.col("nz"), least_horizontal).cast("int")) * 100).alias("wall_percent"))


def densities(cornered_uv: DataFrame) -> DataFrame:
    """``area`` and ``density`` (texels per square metre) of triangles with tex_w and tex_h; degenerate ones go."""
    uv = M.area_uv(*(F.col(c + k) for c in "abc" for k in "uv"))
    return cornered_uv.withColumn("area", M.area_3d(*_xyz())).where("area >= 1e-8").withColumn("density", uv * F.col("tex_w") * F.col("tex_h") / F.col("area"))


def winding_vote(cornered: DataFrame, nodes: DataFrame, most_leaves: int = 40) -> DataFrame:
    """``vote`` and ``flip``: the sum of signed areas seen from above over the first leaves in node order; negative means that faces look down."""
    first = nodes.orderBy("node_id").limit(most_leaves).select(F.col("node_id").alias("tile"))
    nz = M.cross(*_xyz())[2]
    return cornered.join(F.broadcast(first), "tile", "left_semi").agg(F.coalesce(F.sum(nz), F.lit(0.0)).alias("vote")).withColumn("flip", F.col("vote") < 0)


def _bits(c: Column) -> Column:
    """Tells -0.0 from 0.0, which grouping by value would not."""
    return c.cast("string")


def weld(vertices: DataFrame, keys=("x", "y", "z", "u", "v"), order="vid", by=("tile",), exact: bool = True) -> DataFrame:
    """Adds ``weld_id``: equal vertices share one, numbered from 0 in the order of first appearance. exact: by bytes, so -0.0 and 0.0 differ."""
    names = [f"__{k}" for k in keys]
    keyed = vertices.select("*", *((_bits(F.col(k)) if exact else F.col(k)).alias(n) for k, n in zip(keys, names, strict=True)))
    firsts = keyed.groupBy(*by, *names).agg(F.min(order).alias("__first"))
    ids = numbered(firsts, ["__first", *names], "weld_id", by).select(*(F.col(k).alias(f"__n{k}") for k in (*by, *names)), "weld_id")
    cond = [F.col(k).eqNullSafe(F.col(f"__n{k}")) for k in (*by, *names)]
    return keyed.join(ids, cond).select(*vertices.columns, "weld_id")


def weld_rounded(vertices: DataFrame, step: float = 0.001, keys=("x", "y", "z")) -> DataFrame:
    """As weld, by coordinates rounded to a step."""
    r = {f"r_{k}": F.floor(F.col(k) / step + 0.5) for k in keys}
    return weld(vertices.withColumns(r), tuple(r), exact=False).drop(*r)


def uv_ranges(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("tile").agg(F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"), F.count(F.lit(1)).alias("vertices"))


def every_kth(df: DataFrame, k: int, position="vid") -> DataFrame:
    return df.where(F.pmod(F.col(position), F.lit(k)) == 0)


def stride_for(n: int, most: int = 3_000_000) -> int:
    return max(1, -(-n // most))


def seeded_sample(df: DataFrame, n: int, seed: int = 1, key="vid") -> DataFrame:
    """n rows without replacement, the same for a seed whatever the partitioning."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def sample_with_extremes(df: DataFrame, n: int, columns, seed: int = 1, key="vid") -> DataFrame:
    """A seeded sample and, of each column, the rows with its least and greatest value (of equal ones the first by key); no row twice."""
    found = seeded_sample(df, n, seed, key)
    ends = df.agg(*(f(F.struct(v.alias("v"), F.col(key).alias("k"))).alias(f"{name}{i}") for i, c in enumerate(columns) for name, f, v in (("lo", F.min, F.col(c)), ("hi", F.min, -F.col(c)))))
    keys = ends.select(F.explode(F.array(*(F.col(c)["k"] for c in ends.columns))).alias(key)).distinct()
    return found.unionByName(df.join(F.broadcast(keys), key, "left_semi").select(*df.columns)).dropDuplicates([key])


def distinct_textures(primitives: DataFrame) -> DataFrame:
    return primitives.select("texture").distinct()


def clip_faces(faces: DataFrame, vertices: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Faces (``fid, corners`` of vertex ids) all of whose corners are in the rectangle, edges included."""
    inside = vertices.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1)).select("vid")
    each = faces.select("fid", F.explode("corners").alias("vid"), F.size("corners").alias("k"))
    whole = each.join(inside, "vid").groupBy("fid", "k").agg(F.count(F.lit(1)).alias("in")).where("in = k")
    return faces.join(whole.select("fid"), "fid", "left_semi")


def renumbered(faces: DataFrame, position="fid") -> DataFrame:
    """Kept vertices numbered from 1 in the order in which faces first name them: ``vid, new_id``."""
    each = faces.select(F.col(position).alias("f"), F.posexplode("corners").alias("k", "vid"))
    first = each.groupBy("vid").agg(F.min(F.struct("f", "k")).alias("first"))
    return numbered(first, ["first"], "new_id").select("vid", (F.col("new_id") + 1).alias("new_id"))


def fan(faces: DataFrame) -> DataFrame:
    """Polygons to triangles about their first corner: ``fid, part, a, b, c``."""
    tri = F.transform(F.sequence(F.lit(1), F.size("corners") - 2), lambda i: F.struct(F.get("corners", F.lit(0)).alias("a"), F.get("corners", i).alias("b"), F.get("corners", i + 1).alias("c")))
    return faces.where(F.size("corners") >= 3).select("fid", F.posexplode(tri).alias("part", "t")).select("fid", "part", "t.*")


def with_material_size(triangles: DataFrame, sizes: DataFrame, key="material") -> DataFrame:
    """Texture sizes by material; triangles of a material without one go."""
    return triangles.join(sizes, key)


def users_of_textures(primitives: DataFrame, chunk: int = 100_000) -> DataFrame:
    """Texture to its primitives in order: ``texture, part, primitives``, ``chunk`` primitives in a part at most (the first part is 0), so that no
    texture's users have to fit in a row. Primitives are numbered by ranges."""
    rows = Ranges(primitives.select("texture", "primitive"), ["primitive"], ["texture"]).total(F.lit(1).cast("long"), "k").frame()
    parts = rows.groupBy("texture", F.floor((F.col("k") - 1) / chunk).alias("part"))
    return parts.agg(F.array_sort(F.collect_list("primitive")).alias("primitives"))


def count_differences(a: Column, b: Column) -> Column:
    """How many places of two arrays differ, missing ones included."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (~x.eqNullSafe(y)).cast("int")), F.lit(0), lambda s, v: s + v)


def lowest_hit(triangles: DataFrame, points: DataFrame, cell: float) -> DataFrame:
    """For each point (pid, x, y) the lowest z at which a vertical ray meets a triangle; null if none. Triangles and places, equal ones of points once,
    meet by the cells of ``cover``."""
    lo, hi = ([f(*(F.col(c + k) for c in "abc")) for k in "xy"] for f in (F.least, F.greatest))
    used = cover.levels(triangles, *lo, *hi, cell)
    p = cover.with_point_cells(points.select(F.col("x").alias("px"), F.col("y").alias("py")).distinct(), F.col("px"), F.col("py"), used, cell)
    j = p.join(cover.with_box_cells(triangles, *lo, *hi, cell), cover.CELL)
    d = (F.col("by") - F.col("cy")) * (F.col("ax") - F.col("cx")) + (F.col("cx") - F.col("bx")) * (F.col("ay") - F.col("cy"))
    s = ((F.col("by") - F.col("cy")) * (F.col("px") - F.col("cx")) + (F.col("cx") - F.col("bx")) * (F.col("py") - F.col("cy"))) / d
    t = ((F.col("cy") - F.col("ay")) * (F.col("px") - F.col("cx")) + (F.col("ax") - F.col("cx")) * (F.col("py") - F.col("cy"))) / d
    hits = j.where(d != 0).withColumns({"s": s, "t": t}).where("s >= 0 and t >= 0 and s + t <= 1")
    z = F.col("s") * F.col("az") + F.col("t") * F.col("bz") + (1 - F.col("s") - F.col("t")) * F.col("cz")
    lowest = hits.groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.min(z).alias("z_hit"))
    return points.join(lowest, ["x", "y"], "left").select(*points.columns, "z_hit")
