"""Height tiles ``(z, x, y, heights array of size*size)`` under points and cells."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.functions import geodesy as G
from orograph.functions import matrix


def with_terrain(points: DataFrame, tiles: DataFrame, z: int, lon="lon", lat="lat", size: int = 256, name: str = "terrain") -> DataFrame:
    """Points with the terrain's height by bilinear sampling; null where no tile is. An equi join on the computed tile; prune the
    tile table by its partition column z. Points of a tile meet it by Spark's choice of join, which splits a busy tile."""
    tx, ty = G.tile_of(lon, lat, z)
    px, py = G.pixel_of(lon, lat, z, size)
    level = tiles.where(F.col("z") == z).select(F.col("x").cast("long").alias("__tx"), F.col("y").cast("long").alias("__ty"), "heights")
    rows = points.withColumns({"__tx": tx.cast("long"), "__ty": ty.cast("long"), "__px": px, "__py": py}).join(level, ["__tx", "__ty"], "left")
    return rows.withColumn(name, G.bilinear("heights", "__px", "__py", size)).drop("__tx", "__ty", "__px", "__py", "heights")


def tiles_from_pixels(pixels: DataFrame, size: int = 256) -> DataFrame:
    """Height tiles from rows (z, x, y, row, col, r, g, b)."""
    at = F.struct((F.col("row") * size + F.col("col")).alias("i"), G.decode_height("r", "g", "b").alias("h"))
    return pixels.groupBy("z", "x", "y").agg(F.transform(F.array_sort(F.collect_list(at)), lambda p: p["h"]).alias("heights"))


def tiled_grid(grid: DataFrame, tile: int = 64) -> DataFrame:
    """Tiles (``tx, ty, west, north, step, heights``, ``tile + 1`` values wide and high) of regular grids (west, north, step, width, values row by row from
    the north). A tile's last row and column are the first of its neighbours (at the grid's edge its own once more), so sampling never needs two tiles."""
    rows = (F.size("values") / F.col("width")).cast("int")
    tiles = lambda n: F.sequence(F.lit(0), F.greatest(F.ceil((n - 1) / tile) - 1, F.lit(0)).cast("int"))
    at = grid.withColumn("__rows", rows).withColumn("tx", F.explode(tiles(F.col("width")))).withColumn("ty", F.explode(tiles(F.col("__rows"))))
    side = F.sequence(F.lit(0), F.lit(tile))
    r = lambda i: F.least(F.col("ty") * tile + i, F.col("__rows") - 1)
    c = lambda j: F.least(F.col("tx") * tile + j, F.col("width") - 1)
    heights = F.flatten(F.transform(side, lambda i: F.transform(side, lambda j: F.get("values", (r(i) * F.col("width") + c(j)).cast("int")))))
    return at.select("tx", "ty", "west", "north", "step", F.col("width"), F.col("__rows").alias("rows"), heights.alias("heights"))


def tiles_of_values(values: DataFrame, width: int, rows: int, tile: int = 64) -> DataFrame:
    """The same tiles (``tx, ty, heights``) of a grid that has a row for each value (``index`` from 0, row by row from the north, and ``value``): no row and no
    task has more of the grid than a tile. What is beyond the last whole row is left out."""

    def places(at, n: int):
        last = max(-(-(n - 1) // tile), 1) - 1
        found = F.filter(F.array(F.floor(at / tile) - 1, F.floor(at / tile)), lambda t: (t >= 0) & (t <= last) & (at - t * tile <= tile))
        to = lambda t: F.when((at == n - 1) & (t == last), F.lit(tile).cast("long")).otherwise(at - t * tile)
        return F.flatten(F.transform(found, lambda t: F.transform(F.sequence(at - t * tile, to(t)), lambda j: F.struct(t.cast("int").alias("t"), j.alias("j")))))

    at = values.where(F.col("index") < rows * width).withColumns({"__r": F.floor(F.col("index") / width), "__c": F.col("index") % width})
    at = at.withColumn("__x", F.explode(places(F.col("__c"), width))).withColumn("__y", F.explode(places(F.col("__r"), rows)))
    slot = F.struct((F.col("__y.j") * (tile + 1) + F.col("__x.j")).alias("i"), F.col("value").alias("v"))
    heights = F.transform(F.array_sort(F.collect_list(slot)), lambda p: p["v"])
    return at.groupBy(F.col("__x.t").alias("tx"), F.col("__y.t").alias("ty")).agg(heights.alias("heights"))


def sample_values(points: DataFrame, values: DataFrame, west: float, north: float, step: float, width: int, lon="lon", lat="lat", name: str = "geoid", tile: int = 64) -> DataFrame:
    """As ``sample_grid``, of a grid of any size that has a row for each value (``tiles_of_values``)."""
    rows = values.count() // width
    if not rows:
        return points.withColumn(name, F.lit(None).cast("double"))
    return sample_tiles(points, tiles_of_values(values, width, rows, tile), west, north, step, width, rows, lon=lon, lat=lat, name=name, tile=tile)


def sample_tiles(points: DataFrame, tiles: DataFrame, west: float, north: float, step: float, width: int, rows: int, lon="lon", lat="lat", name: str = "geoid", tile: int = 64) -> DataFrame:
    """Points with a value of a grid in tiles (``tiled_grid``), bilinear; beyond the grid its border holds. An equal join on the tile: the grid may be of
    any size, and a busy tile's points are Spark's to split."""
    px = F.least(F.greatest((F.col(lon) - west) / step, F.lit(0.0)), F.lit(width - 1.001))
    py = F.least(F.greatest((north - F.col(lat)) / step, F.lit(0.0)), F.lit(rows - 1.001))
    at = points.withColumns({"__px": px, "__py": py}).withColumns({"__tx": F.floor(F.col("__px") / tile).cast("int"), "__ty": F.floor(F.col("__py") / tile).cast("int")})
    met = at.join(tiles.select(F.col("tx").alias("__tx"), F.col("ty").alias("__ty"), F.col("heights").alias("__h")), ["__tx", "__ty"], "left")
    x, y = F.col("__px") - F.col("__tx") * tile, F.col("__py") - F.col("__ty") * tile
    c, r = F.floor(x).cast("int"), F.floor(y).cast("int")
    h = lambda dr, dc: F.get("__h", (r + dr) * (tile + 1) + c + dc)
    u, v = x - c, y - r
    value = h(0, 0) * (1 - u) * (1 - v) + h(0, 1) * u * (1 - v) + h(1, 0) * (1 - u) * v + h(1, 1) * u * v
    return met.withColumn(name, value).select(*points.columns, name)


def sample_grid(points: DataFrame, grid: DataFrame, lon="lon", lat="lat", name: str = "geoid", tile: int = 64) -> DataFrame:
    """Points with a value of one regular grid (a row: west, north, step, width, values row by row from the north), bilinear. The grid is cut into tiles
    that points meet by an equal join; only its size and corner go through the driver."""
    g = grid.select("west", "north", "step", "width", (F.size("values") / F.col("width")).cast("int").alias("rows")).first()
    if g is None:
        return points.withColumn(name, F.lit(None).cast("double"))
    return sample_tiles(points, tiled_grid(grid.limit(1), tile), *g, lon=lon, lat=lat, name=name, tile=tile)


def read_offsets(spark: SparkSession, folder: str, name: str = "offset.json") -> DataFrame:
    """``slug, offset, transform`` from a JSON document in each survey's folder; missing fields are null."""
    rows = spark.read.option("recursiveFileLookup", True).option("wholetext", True).option("pathGlobFilter", name).text(folder)
    doc = F.from_json("value", "offset array<double>, transform array<double>")
    slug = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.select(slug.alias("slug"), doc.alias("d")).select("slug", "d.offset", "d.transform")


def cell_residuals(cells: DataFrame, tiles: DataFrame, z: int, size: int = 256) -> DataFrame:
    """``res``: terrain less the mesh's ground (p5). Positive: the mesh is buried."""
    return with_terrain(cells, tiles, z, size=size).withColumn("res", F.col("terrain") - F.col("p5"))


def georeference_errors(vertices: DataFrame, root, zone: int, geoid: float) -> DataFrame:
    """``horizontal`` and ``vertical`` errors of vertices (x, y, z; expected east, north, height) taken through a root matrix (16 numbers)."""
    world = matrix.apply(matrix.literal(root), F.col("x"), F.col("y"), F.col("z"))
    lon, lat, h = G.from_ecef(*world)
    e, n = G.to_utm(lon, lat, zone)
    de, dn = e - F.col("east"), n - F.col("north")
    return vertices.withColumns({"horizontal": F.sqrt(de * de + dn * dn), "vertical": h - geoid - F.col("height")})


def rewritten_tiles(tiles: DataFrame, touched: DataFrame) -> DataFrame:
    """Only tiles that a footprint touches are worked on; others keep their bytes: adds ``is_touched`` by a join on (z, x, y)."""
    return tiles.join(touched.select("z", "x", "y").distinct().withColumn("is_touched", F.lit(True)), ["z", "x", "y"], "left").withColumn("is_touched", F.coalesce("is_touched", F.lit(False)))


def mapped_tiles(tiles: DataFrame, function, returns: str, heights: str = "heights", name: str = "mapped") -> DataFrame:
    """A user's function on the heights (a numpy array) of each tile, in Arrow batches: adds its result, of the Spark type ``returns``."""
    import pandas as pd

    @F.pandas_udf(returns)
    def run(values: pd.Series) -> pd.Series:
        return values.map(function)

    return tiles.withColumn(name, run(F.col(heights)))
