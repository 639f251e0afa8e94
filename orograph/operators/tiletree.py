"""Trees of tiles as node tables: ``node_id, parent_id, ord`` and what a tile has. Folds go level by level, each an aggregation and
a join, so a tree of any width is handled by the cluster; the driver only counts levels. Joins are merges by hint: what Spark expects of a table that was
written in between is far below its size, and a broadcast would take whole levels through the driver."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.functions import matrix
from orograph.functions import quantiles as Q
from orograph.functions.mesh import box_of, box_range, tile_error
from orograph.shared import numbered, settled


def leaves(nodes: DataFrame) -> DataFrame:
    parents = nodes.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("node_id")).distinct()
    return nodes.hint("merge").join(parents, "node_id", "left_anti")


def depths(nodes: DataFrame, most: int = 1000) -> DataFrame:
    """Adds ``depth`` (0 for a root) and ``root``. Every round doubles how far a node has looked up, so a tree of depth d takes
    log2(d) joins; stops at ``most`` levels, which a cycle would exceed."""
    state = nodes.select("node_id", F.col("parent_id").alias("up"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth"), F.coalesce("parent_id", "node_id").alias("root"))
    state, seen = state.transform(settled), 1
    while state.where(F.col("up").isNotNull()).limit(1).count():
        if seen > most:
            raise ValueError("the parents of some nodes form a cycle or a tree is too deep")
        above = state.select(F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("root").alias("r2"))
        state = state.hint("merge").join(above, "up", "left").select("node_id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.coalesce("r2", "root").alias("root")).transform(settled)
        seen *= 2
    # written once, as walks read it at every level
    return settled(nodes.hint("merge").join(state.select("node_id", "depth", "root"), "node_id"))


def transforms(nodes: DataFrame) -> DataFrame:
    """Adds ``world``: the product of all matrices from the root down to a node (null ones are the identity). nodes has depth."""
    done = nodes.where("depth = 0").withColumn("world", F.coalesce("transform", matrix.literal(matrix.IDENTITY)))
    level, deepest = done, nodes.agg(F.max("depth")).first()[0] or 0
    for d in range(1, deepest + 1):
        up = level.select(F.col("node_id").alias("parent_id"), F.col("world").alias("__up"))
        level = nodes.where(F.col("depth") == d).hint("merge").join(up, "parent_id").withColumn("world", matrix.product(F.col("__up"), F.col("transform"))).select(*done.columns).transform(settled)
        done = done.unionByName(level)
    return done


def fold(nodes: DataFrame, factor: float = 16.0) -> DataFrame:
    """``node_id, lo, hi, box, error, is_leaf``: boxes that hold those of all children, and errors that grow upwards, from the leaves to the root.

    nodes: node_id, parent_id, depth, lo and hi (arrays of 3, null without a mesh), texel."""
    deepest = nodes.agg(F.max("depth")).first()[0]
    below = parts = None
    for d in range(deepest if deepest is not None else -1, -1, -1):
        level = nodes.where(F.col("depth") == d)
        if below is None:
            level = level.withColumns({"__lo": F.lit(None).cast("array<double>"), "__hi": F.lit(None).cast("array<double>"), "__error": F.lit(None).cast("double")})
        else:
            ends = [box_range("box", k) for k in range(3)]
            up = below.groupBy(F.col("parent_id").alias("node_id")).agg(
                F.array(*(F.min(e[0]) for e in ends)).alias("__lo"), F.array(*(F.max(e[1]) for e in ends)).alias("__hi"), F.max("error").alias("__error"))
            level = level.hint("merge").join(up, "node_id", "left")
        lo = [F.least(F.get("lo", F.lit(k)), F.get("__lo", F.lit(k))) for k in range(3)]
        hi = [F.greatest(F.get("hi", F.lit(k)), F.get("__hi", F.lit(k))) for k in range(3)]
        leaf, mesh = F.col("__error").isNull(), F.col("lo").isNotNull()
        below = level.select("node_id", "parent_id", "depth", F.array(*lo).alias("lo"), F.array(*hi).alias("hi"), box_of(lo, hi).alias("box"), tile_error(leaf, F.when(mesh, F.col("texel")).otherwise(F.lit(float("inf"))), F.col("__error"), mesh, factor).alias("error"), leaf.alias("is_leaf")).transform(settled)
        parts = below if parts is None else parts.unionByName(below)
    return parts if parts is not None else nodes.sparkSession.createDataFrame([], "node_id long, parent_id long, depth int, lo array<double>, hi array<double>, box array<double>, error double, is_leaf boolean")


def rounded(tiles: DataFrame) -> DataFrame:
    """Boxes to millimetres, errors to five significant digits."""
    return tiles.withColumns({"box": F.transform("box", lambda v: Q.fixed(v, 3)), "error": Q.significant("error", 5)})


def level_statistics(tiles: DataFrame, level="depth") -> DataFrame:
    """Tiles, triangles, MB, least and greatest error, the upper median of finite texels (cm) and the kind of texture by level."""
    sums = tiles.groupBy(level).agg(
        F.count(F.lit(1)).alias("tiles"), F.sum(F.coalesce("tris", F.lit(0))).alias("tris"), Q.fixed(F.sum("bytes") / 1e6, 2).alias("mb"),
        Q.fixed(F.min("error"), 3).alias("error_min"), Q.fixed(F.max("error"), 3).alias("error_max"),
        F.when(F.bool_or("ktx"), "ktx2").when(F.count("tex_w") > 0, "jpeg").otherwise("-").alias("texture"))
    texel = Q.ranks(tiles.select(level, F.when(F.col("texel") != 0, F.col("texel") * 100).alias("cm")), "cm", {"cm": (Q.UPPER, 0.5)}, (level,))
    found = texel.select(F.col(level).alias("__level"), Q.fixed("cm", 2).alias("texel_cm"))
    out = sums.join(found, sums[level].eqNullSafe(found["__level"]), "left").drop("__level")
    return out.select(*(c for c in out.columns if c not in ("texel_cm", "texture")), "texel_cm", "texture")


def level_weights(tiles: DataFrame, level="depth", gpu_bytes_per_pixel: float = 5.33) -> DataFrame:
    """Bytes and texture megapixels by level: sums, the greatest of one tile, and an estimate of memory on the graphics card."""
    mpx = F.col("tex_w") * F.col("tex_h") / 1e6
    return tiles.groupBy(level).agg(F.count(F.lit(1)).alias("tiles"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("max_bytes"), F.sum(mpx).alias("mpx"), F.max(mpx).alias("max_mpx"), (F.sum(mpx) * gpu_bytes_per_pixel).alias("gpu_mb"))


def level_means(tiles: DataFrame, level="depth") -> DataFrame:
    """Mean bytes of a tile, of its texture and of the rest."""
    return tiles.groupBy(level).agg(F.avg("bytes").alias("mean_bytes"), F.avg("texture_bytes").alias("mean_texture"), F.avg(F.col("bytes") - F.col("texture_bytes")).alias("mean_geometry"))


def depth_report(tiles: DataFrame, order="dfs") -> DataFrame:
    """Tiles, bytes and the error of the tile met first, by depth."""
    return tiles.groupBy("depth").agg(F.count(F.lit(1)).alias("tiles"), F.sum("bytes").alias("bytes"), F.min_by("error", order).alias("first_error"))


def largest_tile(tiles: DataFrame, path="uri") -> DataFrame:
    """The tile of most bytes; of equal ones the last path."""
    return tiles.agg(F.max(F.struct("bytes", path)).alias("t")).select("t.*")


def coarsest(tiles: DataFrame) -> DataFrame:
    """Tiles and bytes at the least depth that has content."""
    least = tiles.agg(F.min("depth").alias("depth"))
    return tiles.join(F.broadcast(least), "depth").groupBy("depth").agg(F.count(F.lit(1)).alias("tiles"), F.sum("bytes").alias("bytes"))


def extensions(files: DataFrame, path="path") -> DataFrame:
    return files.agg(F.array_sort(F.collect_set(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))).alias("extensions"))


def totals(files: DataFrame, size="bytes", first: DataFrame | None = None, path="path") -> DataFrame:
    """Number of files, bytes and MB; with ``first`` (column ``uri``: the tiles that are met first, see ``first_view``) also their ``first_bytes``."""
    sums = files.agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"), Q.fixed(F.sum(size) / 1e6, 1).alias("mb"))
    if first is None:
        return sums
    shown = files.join(first.select(F.col("uri").alias(path)).distinct(), path, "left_semi").agg(F.coalesce(F.sum(size), F.lit(0)).alias("first_bytes"))
    return sums.crossJoin(F.broadcast(shown))


def first_view(nodes: DataFrame) -> DataFrame:
    """By tree, the first node with content on the way down from the root along only children: ``root, node_id, uri``."""
    children = nodes.groupBy(F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("k"), F.min("node_id").alias("only"))
    at = nodes.where("depth = 0").select("root", "node_id", "uri")
    found = None
    while at.limit(1).count():
        here = at.hint("merge").join(children, "node_id", "left").transform(settled)
        stop = here.where(F.col("uri").isNotNull() | F.coalesce(F.col("k") != 1, F.lit(True))).select("root", "node_id", "uri")
        found = stop if found is None else found.unionByName(stop)
        at = here.where(F.col("uri").isNull() & (F.col("k") == 1)).select("root", F.col("only").alias("node_id")).hint("merge").join(nodes.select("node_id", "uri"), "node_id").select("root", "node_id", "uri").transform(settled)
    return found if found is not None else at


def subtrees(nodes: DataFrame, least_tiles: int = 1500, least_level: int = 2, least_wide: int = 32) -> DataFrame:
    """Adds ``subtree_id``: in a tree of more than ``least_tiles`` nodes, the inner node at the first level of ``least_level`` or deeper
    that is at least ``least_wide`` wide below which a node lies; null elsewhere. A leaf at that level stays in the main file."""
    width = nodes.groupBy("root", "depth").agg(F.count(F.lit(1)).alias("wide"))
    cut = width.groupBy("root").agg(F.sum("wide").alias("tiles"), F.min(F.when((F.col("depth") >= least_level) & (F.col("wide") >= least_wide), F.col("depth"))).alias("cut")).where((F.col("tiles") > least_tiles) & F.col("cut").isNotNull())
    inner = nodes.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("node_id")).distinct()
    level = nodes.join(cut.select("root", "cut"), "root", "left")
    state = level.where(F.col("depth") == F.col("cut")).hint("merge").join(inner, "node_id", "left_semi").select("node_id", F.col("node_id").alias("subtree_id")).transform(settled)
    done = state
    while state.limit(1).count():
        state = nodes.hint("merge").join(state.withColumnRenamed("node_id", "parent_id"), "parent_id").select("node_id", "subtree_id").transform(settled)
        done = done.unionByName(state)
    return nodes.hint("merge").join(done, "node_id", "left")


def levels_bottom_up(nodes: DataFrame, leaf_table: DataFrame, combine) -> DataFrame:
    """Rebuilds a tree level by level: ``combine`` makes the rows of parents (with node_id) from the rows of their children (with
    parent_id); what it makes of one level is written before the next starts."""
    ids = nodes.select("node_id", "parent_id", "depth")
    deepest = ids.agg(F.max("depth")).first()[0] or 0
    leaves_ = leaf_table.hint("merge").join(ids, "node_id").transform(settled)
    done = leaves_
    level = leaves_.where(F.col("depth") == deepest)
    for d in range(deepest, 0, -1):
        made = combine(level).hint("merge").join(ids, "node_id").select(*leaves_.columns).transform(settled)
        done = done.unionByName(made)
        # what combine makes is one level up; leaves of that level join it
        level = leaves_.where(F.col("depth") == d - 1).unionByName(made)
    return done


def dfs_order(nodes: DataFrame, separator: str = "/") -> DataFrame:
    """Adds ``dfs``: a text that sorts as a depth-first walk by ``ord`` (a whole number of any size, 0 or more)."""
    key = F.lpad(F.col("ord").cast("string"), 19, "0")
    done = level = nodes.where("depth = 0").withColumn("dfs", key)
    for d in range(1, (nodes.agg(F.max("depth")).first()[0] or 0) + 1):
        up = level.select(F.col("node_id").alias("parent_id"), F.col("dfs").alias("__up"))
        level = nodes.where(F.col("depth") == d).hint("merge").join(up, "parent_id").withColumn("dfs", F.concat("__up", F.lit(separator), key)).select(*done.columns).transform(settled)
        done = done.unionByName(level)
    return done


def by_size(files: DataFrame, largest_first: bool = True, size="bytes", path="path") -> DataFrame:
    """Adds ``place`` (from 1): files by size, of equal ones by path. Smallest first is the order in which jobs are started."""
    order = [F.col(size).desc() if largest_first else F.col(size).asc(), F.col(path)]
    return numbered(files, order, "place").withColumn("place", F.col("place") + 1)


def concatenated(*pages: DataFrame) -> DataFrame:
    """All rows of all pages, by column names; columns that a page lacks are null."""
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
