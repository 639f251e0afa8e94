"""Sources and sinks over real files: each query writes files from the driver's tables into the shared folder, reads them again and returns what it finds."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructType

from orograph.functions import geodesy as G
from orograph.functions import mesh as M
from orograph.operators import catalogue, terrain, tiletree
from orograph.plans.tables import query, table
from orograph.plans.tree_plans import part_tree
from orograph.shared import numbered, scratch
from orograph.sources import archives, binaries, files, texts


def _text(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _line_files(rows, spark, what):
    """Writes lines (survey, place columns, value) as a text a survey, in parts of which each task writes those of its range; the folder."""
    path = scratch(spark, what)
    order = [c for c in rows.columns if c != "value"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("survey", "value").write.partitionBy("survey").text(path)
    return path


def _survey(kind: str = "int"):
    """The survey that a file's folder names."""
    return F.regexp_extract("file", "survey=([^/]+)/", 1).cast(kind).alias("survey")


# --- meshes as text -----------------------------------------------------------------------------------------------------------------


def obj_of_parts(spark, sf_dir):
    """An OBJ file for each size of part: a vertex for each part, with a colour behind its place."""
    p = table(spark, sf_dir, "part")
    v = F.concat_ws(" ", F.lit("v"), _text(F.col("p_partkey") / 8), _text("p_retailprice"), _text(F.col("p_size")), F.lit("0.5"), _text(F.col("p_partkey") % 3))
    first = p.select(F.col("p_size").alias("survey"), F.lit(0).alias("section"), F.lit(0).cast("long").alias("k"), F.concat(F.lit("mtllib m"), _text("p_size"), F.lit(".mtl")).alias("value")).distinct()
    rows = first.unionByName(p.select(F.col("p_size").alias("survey"), F.lit(1).alias("section"), F.col("p_partkey").alias("k"), v.alias("value")))
    rows = rows.unionByName(p.select(F.col("p_size").alias("survey"), F.lit(2).alias("section"), F.col("p_partkey").alias("k"), F.concat(F.lit("vt "), _text(F.col("p_partkey") % 16 / 16), F.lit(" 0.25")).alias("value")))
    return _line_files(rows, spark, "obj")


@query("SELECT p_size survey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) vid, p_partkey / 8.0::DOUBLE x, p_retailprice y, CAST(p_size AS DOUBLE) z, '0.5 ' || p_partkey % 3 rest FROM part")
def src09_obj_vertices(spark, sf_dir):
    found = texts.obj_vertices(texts.read_lines(spark, obj_of_parts(spark, sf_dir), parts=True))
    return found.select(_survey(), "vid", "x", "y", "z", "rest")


@query("SELECT p_size survey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) tid, p_partkey % 16 / 16.0::DOUBLE u, 0.25::DOUBLE v FROM part")
def src10_obj_texture_vertices(spark, sf_dir):
    return texts.obj_texture_vertices(texts.read_lines(spark, obj_of_parts(spark, sf_dir), parts=True)).select(_survey(), "tid", "u", "v")


@query("SELECT DISTINCT p_size survey, 'm' || p_size || '.mtl' \"library\" FROM part")
def src10_obj_libraries(spark, sf_dir):
    return texts.obj_libraries(texts.read_lines(spark, obj_of_parts(spark, sf_dir), parts=True)).select(_survey(), "library")


@query("SELECT p_size survey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) vid, round(p_partkey / 8.0::DOUBLE - 100.5, 4) x, round(p_retailprice - 0.125, 4) y, p_size + 7.0::DOUBLE z, '0.5 ' || p_partkey % 3 rest FROM part")
def snk08_shifted_obj(spark, sf_dir):
    """Moved, written again and read once more."""
    lines = texts.shifted_obj(texts.numbered_lines(spark, obj_of_parts(spark, sf_dir), parts=True), 100.5, 0.125, -7)
    again = _line_files(lines.select(_survey(), "line", "value"), spark, "shifted")
    return texts.obj_vertices(texts.read_lines(spark, again, parts=True)).select(_survey(), "vid", "x", "y", "z", "rest")


FACES = """f AS (SELECT l_linenumber survey, row_number() OVER w fid, count(CASE WHEN l_orderkey % 5 = 0 THEN 1 END) OVER (w ROWS UNBOUNDED PRECEDING) grp, l_orderkey k, l_partkey a, l_suppkey b, l_linenumber c FROM lineitem WINDOW w AS (PARTITION BY l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice)),
 g AS (SELECT * FROM f), m AS (SELECT survey, grp, 'stone ' || b material FROM g WHERE k % 5 = 0)"""


@query("WITH " + FACES + " SELECT g.survey, fid, material, a || ',' || b || ',' || c || CASE WHEN k % 2 = 0 THEN ',' || a ELSE '' END corners, CASE WHEN k % 3 = 0 THEN '' ELSE b || ',' || a || ',' || c || CASE WHEN k % 2 = 0 THEN ',' || c ELSE '' END END textures FROM g LEFT JOIN m ON g.survey = m.survey AND g.grp = m.grp")
def src10_obj_faces(spark, sf_dir):
    """An OBJ file for each line number: triangles and quads, some without texture coordinates, under a material that each fifth order changes (WIN-07)."""
    order = ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    l = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("survey"), F.col("l_orderkey").alias("k"), *order[1:], *(_text(c).alias(n) for c, n in (("l_partkey", "a"), ("l_suppkey", "b"), ("l_linenumber", "c"))))
    bare = F.col("k") % 3 == 0
    at = lambda p, q: F.when(bare, F.col(p)).otherwise(F.concat(p, F.lit("/"), q))
    face = F.concat_ws(" ", F.lit("f"), at("a", "b"), at("b", "a"), at("c", "c"), F.when(F.col("k") % 2 == 0, at("a", "c")))
    place = ("survey", "k", *order[1:])
    rows = l.select(*place, F.lit(1).alias("part"), face.alias("value")).unionByName(l.where("k % 5 = 0").select(*place, F.lit(0).alias("part"), F.concat(F.lit("usemtl stone "), "b").alias("value")))
    found = texts.obj_faces(texts.read_lines(spark, _line_files(rows, spark, "faces"), parts=True))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return found.select(_survey(), "fid", "material", joined("corners"), joined("textures"))


@query("SELECT s_nationkey survey, 'slate ' || s_suppkey material, 'tex ' || s_suppkey || '.jpg' texture FROM supplier")
def src11_mtl_textures(spark, sf_dir):
    """An MTL file for each nation."""
    lines = F.array(F.concat(F.lit("newmtl slate "), _text("s_suppkey")), F.lit("Kd 1 1 1"), F.concat(F.lit("  map_Kd tex "), _text("s_suppkey"), F.lit(".jpg")))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("survey"), F.col("s_suppkey").alias("k"), F.posexplode(lines).alias("at", "value"))
    return texts.mtl_textures(texts.read_lines(spark, _line_files(rows, spark, "mtl"), parts=True)).select(_survey(), "material", "texture")


@query("SELECT s_nationkey survey, 's' || s_suppkey slug, s_name || ' final.slpk' file FROM supplier")
def src23_job_list(spark, sf_dir):
    """Lists of jobs with comments and empty lines between them; names have blanks."""
    lines = F.array(F.lit("# a comment"), F.lit(""), F.concat(F.lit("s"), _text("s_suppkey"), F.lit(" "), "s_name", F.lit(" final.slpk")))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("survey"), F.col("s_suppkey").alias("k"), F.posexplode(lines).alias("at", "value"))
    read = texts.read_lines(spark, _line_files(rows, spark, "jobs"), parts=True)
    jobs = texts.job_list(read)
    return jobs.join(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), _text("s_suppkey")).alias("slug"), F.col("s_nationkey").alias("survey")), "slug").select("survey", "slug", "file")


# --- archives and the layers in them ------------------------------------------------------------------------------------------------


@query("SELECT o_orderpriority || '.zip' archive, 'e/' || o_orderkey || '.txt' AS \"name\", CAST(length(o_orderstatus || ' ' || o_orderkey) AS BIGINT) size, md5(o_orderstatus || ' ' || o_orderkey) content FROM orders")
def src05_zip_entries(spark, sf_dir):
    """An archive for each priority, an entry for each order; deflated, read in ranges of entries."""
    o = table(spark, sf_dir, "orders")
    path = scratch(spark, "zip")
    archives.write_archives(o.select(F.concat("o_orderpriority", F.lit(".zip")).alias("archive"), F.concat(F.lit("e/"), _text("o_orderkey"), F.lit(".txt")).alias("name"), F.concat_ws(" ", "o_orderstatus", _text("o_orderkey")).cast("binary").alias("content")), path)
    archives.register(spark)
    rows = spark.read.format("zip_entries").option("partitionbytes", str(1 << 20)).load(path)
    return rows.select(F.substring_index("archive", "/", -1).alias("archive"), "name", "size", F.md5("content").alias("content"))


def layer_archive(spark, sf_dir):
    """One archive of a scene layer: the parts' tree in pages of 64 nodes, and the layer's own document."""
    t = part_tree(spark, sf_dir)
    children = t.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("node_id").alias("c")))), lambda x: x["c"]).alias("children"))
    node = F.struct(
        F.col("node_id").alias("index"), "children", F.struct(F.array("x", "y", "z").alias("center")).alias("obb"),
        F.struct(F.struct((F.col("node_id") % 97 * 3).alias("vertexCount"), F.col("node_id").alias("resource")).alias("geometry")).alias("mesh"))
    pages = t.join(children, "node_id", "left").groupBy(F.floor(F.col("node_id") / 64).alias("page")).agg(F.to_json(F.struct(F.collect_list(node).alias("nodes"))).alias("content"))
    entries = pages.select(F.concat(F.lit("nodepages/"), _text("page"), F.lit(".json")).alias("name"), F.col("content").cast("binary").alias("content"))
    layer = F.lit('{"layerType":"IntegratedMesh","spatialReference":{"wkid":4326,"latestWkid":4326,"vcsWkid":5773}}').cast("binary")
    entries = entries.unionByName(table(spark, sf_dir, "region").limit(1).select(F.lit("3dSceneLayer.json").alias("name"), layer.alias("content")))
    path = scratch(spark, "slpk")
    archives.write_archives(entries.withColumn("archive", F.lit("layer.zip")), path)
    archives.register(spark)
    return spark.read.format("zip_entries").load(f"{path}/layer.zip")


TREE_ROWS = "r AS (SELECT p_partkey node_id, p_partkey // 10 parent_id, p_partkey % 10 ord FROM part WHERE p_partkey > 0), t AS (SELECT node_id, CAST(parent_id AS BIGINT) parent_id, CAST(ord AS INTEGER) ord FROM r UNION ALL SELECT 0, NULL, 0)"


@query("WITH " + TREE_ROWS + " SELECT node_id, parent_id, CAST(CASE WHEN parent_id = 0 THEN ord - 1 ELSE ord END AS INTEGER) ord, node_id % 97 * 3 vertex_count FROM t")
def src07_node_pages(spark, sf_dir):
    """Nodes and their parents from the pages of a layer's archive; the root isn't its own first child."""
    pages = layer_archive(spark, sf_dir).where(F.col("name").startswith("nodepages/"))
    nodes = binaries.node_pages(pages)
    found = binaries.parents_of(nodes).join(nodes.select("node_id", "vertex_count"), "node_id")
    return found.select(F.col("node_id").cast("long").alias("node_id"), F.col("parent_id").cast("long").alias("parent_id"), "ord", F.col("vertex_count").cast("long").alias("vertex_count"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'layer type Point is not IntegratedMesh' WHEN 1 THEN 'wkid 3857 is not 4326' END problem, CASE WHEN n_nationkey % 3 = 0 THEN 'heights are in vcsWkid 5703, not 5773' END warning FROM nation")
def src06_layer_check(spark, sf_dir):
    """A layer document for each nation, checked after it was written and read."""
    import json

    k = F.col("n_nationkey")
    ref = F.struct(F.when(k % 4 == 1, 3857).otherwise(4326).alias("wkid"), F.when(k % 3 == 0, 5703).otherwise(5773).alias("vcsWkid"))
    doc = F.to_json(F.struct(F.when(k % 4 == 0, "Point").otherwise("IntegratedMesh").alias("layerType"), ref.alias("spatialReference")))
    path = scratch(spark, "layers")
    files.write_files(table(spark, sf_dir, "nation").select(F.concat(_text(k), F.lit("/3dSceneLayer.json")).alias("path"), doc.cast("binary").alias("content")), path)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    problem = binaries.as_udf(lambda b: binaries.layer_problem(json.loads(b)), "string")
    warning = binaries.as_udf(lambda b: binaries.height_datum_warning(json.loads(b)), "string")
    return read.select(F.regexp_extract("path", "/([0-9]+)/3dSceneLayer", 1).cast("int").alias("n_nationkey"), problem("content").alias("problem"), warning("content").alias("warning"))


def _order_points(spark, sf_dir, letter):
    """A point for each line of an order, all numbers exact in single precision, and the archive of each thousand orders, whose lines are dealt to one partition."""
    l = table(spark, sf_dir, "lineitem").withColumn("archive", F.concat(F.lit(letter), _text(F.floor(F.col("l_orderkey") / 1000)), F.lit(".zip"))).repartition("archive")
    point = F.struct("l_linenumber", (F.col("l_partkey") / 8).alias("x"), F.col("l_quantity").alias("y"), (F.col("l_suppkey") / 4).alias("z"))
    return l.groupBy("archive", "l_orderkey").agg(F.array_sort(F.collect_list(point)).alias("p"))


@F.pandas_udf(BinaryType())
def _geometry(points: pd.Series) -> pd.Series:
    return points.map(lambda p: binaries.geometry_of([[q["x"], q["y"], q["z"]] for q in p], [[q["x"] / 2, q["z"]] for q in p]))


POINTS = "p AS (SELECT l_orderkey k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey) - 1 vid, l_partkey / 8.0::DOUBLE x, l_quantity y, l_suppkey / 4.0::DOUBLE z FROM lineitem)"


@query("WITH " + POINTS + " SELECT 'geometries/' || k tile, CAST(vid AS BIGINT) vid, x, y, z, x / 2 u, z v FROM p")
def src08_geometry(spark, sf_dir):
    """A geometry buffer for each order, in an archive for each thousand orders."""
    rows = _order_points(spark, sf_dir, "g").withColumn("name", F.concat(F.lit("geometries/"), _text("l_orderkey")))
    path = scratch(spark, "geometries")
    archives.write_archives(rows, path, packed=False, content=_geometry("p"), dealt=True)
    archives.register(spark)
    return binaries.vertices(spark.read.format("zip_entries").load(path))


@F.pandas_udf(BinaryType())
def _b3dm(points: pd.Series, key: pd.Series) -> pd.Series:
    def one(p, k):
        n = len(p)
        tri = [[i, (i + 1) % n, (i + 2) % n] for i in range(n)]
        return binaries.b3dm_of(binaries.glb_of([[q["x"], q["y"], q["z"]] for q in p], tri, (float(k % 16), 0.0, 0.5)), n)

    return pd.Series([one(p, k) for p, k in zip(points, key, strict=True)])


@F.pandas_udf(ArrayType(StructType().add("tid", IntegerType()).add("x", DoubleType()).add("y", DoubleType()).add("z", DoubleType())))
def _corners(content: pd.Series) -> pd.Series:
    def one(b):
        ((xyz, tri),) = binaries.glb_meshes(binaries.glb_of_b3dm(bytes(b)))
        return [{"tid": i, "x": float(p[0]), "y": float(p[1]), "z": float(p[2])} for i, t in enumerate(tri) for p in [xyz[t].mean(0)]]

    return content.map(one)


@query("WITH " + POINTS + ", n AS (SELECT *, count(*) OVER (PARTITION BY k) n FROM p), c AS (SELECT a.k, a.vid tid, (a.x + b.x + c.x) / 3 + a.k % 16 x, (a.y + b.y + c.y) / 3 y, (a.z + b.z + c.z) / 3 + 0.5 z FROM n a JOIN n b ON a.k = b.k AND b.vid = (a.vid + 1) % a.n JOIN n c ON a.k = c.k AND c.vid = (a.vid + 2) % a.n) SELECT k, CAST(tid AS INTEGER) tid, round(x, 6) x, round(y, 6) y, round(z, 6) z FROM c")
def src13_glb_meshes(spark, sf_dir):
    """A glb in a b3dm for each order, moved by its node: the middle of every triangle in the world (SRC-14, too)."""
    rows = _order_points(spark, sf_dir, "t").withColumn("name", F.concat(_text("l_orderkey"), F.lit(".b3dm")))
    path = scratch(spark, "b3dm")
    # deflated, as most of a small glb is its JSON
    archives.write_archives(rows, path, content=_b3dm("p", "l_orderkey"), dealt=True)
    archives.register(spark)
    read = spark.read.format("zip_entries").load(path).where(F.col("name").endswith(".b3dm"))
    found = read.select(F.substring_index("name", ".", 1).cast("long").alias("k"), F.explode(_corners("content")).alias("c"))
    return found.select("k", "c.tid", *(F.round(f"c.{a}", 6).alias(a) for a in "xyz"))


# --- images -------------------------------------------------------------------------------------------------------------------------

SIDE = 16


@F.pandas_udf(BinaryType())
def _png(heights: pd.Series) -> pd.Series:
    return heights.map(lambda h: binaries.png_of_heights(np.resize(np.array(h, float), (SIDE, SIDE))))


@query("WITH e AS (SELECT user_id u, value v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 i, count(*) OVER (PARTITION BY user_id) n FROM events WHERE value IS NOT NULL) SELECT u, CAST(p AS INTEGER) p, floor((v * 10 - 400 + 32768) * 256 + 0.5) / 256 - 32768 h FROM e JOIN range(256) r(p) ON p % n = i WHERE n <= 256")
def src15_png_heights(spark, sf_dir):
    """An elevation tile of 16 by 16 for each user's values, over and over, as a PNG: written (SNK-04), read, decoded."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("v")).where(F.size("v") <= SIDE * SIDE)
    path = scratch(spark, "png")
    files.write_files(e.select(F.concat(_text("user_id"), F.lit(".png")).alias("path"), _png(F.transform("v", lambda x: x["value"] * 10 - 400)).alias("content")), path)
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    heights = read.select(F.regexp_extract("path", r"([0-9]+)\.png$", 1).cast("long").alias("u"), F.posexplode(binaries.as_udf(binaries.png_heights, "array<double>")("content")).alias("p", "h"))
    return heights.select("u", "p", "h")


@F.pandas_udf(BinaryType())
def _jpeg(width: pd.Series, height: pd.Series, factor: pd.Series) -> pd.Series:
    """The headers of a JPEG whose quantisation table is the standard one's by a factor."""
    table_ = np.array(binaries.LUMINANCE)

    def one(w, h, f):
        body = bytes(np.clip(np.floor(table_ * f + 0.5), 1, 255).astype(np.uint8).tolist())
        return b"\xff\xd8\xff\xdb\x00\x43\x00" + body + b"\xff\xc0\x00\x0b\x08" + int(h).to_bytes(2, "big") + int(w).to_bytes(2, "big") + b"\x01\x01\x11\x00\xff\xd9"

    return pd.Series([one(*x) for x in zip(width, height, factor, strict=True)])


LUMINANCE = "[" + ", ".join(map(str, binaries.LUMINANCE)) + "]"


@query(f"WITH q AS (SELECT s_suppkey k, 0.1::DOUBLE * (1 + s_suppkey % 25) f FROM supplier), t AS (SELECT k, list_sum(list_transform({LUMINANCE}, lambda x: least(255, greatest(1, floor(x * f + 0.5))))) / list_sum({LUMINANCE}) * 100 s FROM q) SELECT k, CAST(256 + k % 7 * 128 AS INTEGER) w, CAST(64 + k % 9 * 32 AS INTEGER) h, CAST(floor(CASE WHEN s <= 100 THEN (200 - s) / 2 ELSE 5000 / s END + 0.5) AS INTEGER) quality FROM t")
def src18_19_jpeg(spark, sf_dir):
    """Sizes and qualities of images from their headers alone."""
    k = F.col("s_suppkey")
    path = scratch(spark, "jpeg")
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("a/b/"), _text(k), F.lit(".jpg")).alias("path"), _jpeg(256 + k % 7 * 128, 64 + k % 9 * 32, 0.1 * (1 + k % 25)).alias("content"))
    files.write_files(rows, path)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jpg").load(path)
    size = binaries.as_udf(binaries.jpeg_size, "array<int>")("content")
    return read.select(F.regexp_extract("path", r"([0-9]+)\.jpg$", 1).cast("long").alias("k"), F.get(size, F.lit(0)).alias("w"), F.get(size, F.lit(1)).alias("h"), binaries.as_udf(binaries.jpeg_quality, "int")("content").alias("quality"))


# --- tables beside the meshes -------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey i, p_size * 1.0::DOUBLE x0, p_size + 2.0::DOUBLE x1, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END texel, p_partkey * 7 bytes, p_partkey % 3 = 0 ktx FROM part")
def src20_progress_log(spark, sf_dir):
    """A log of JSON lines, fields missing where they are null."""
    k = F.col("p_partkey")
    size = F.col("p_size").cast("double")
    path = scratch(spark, "progress")
    table(spark, sf_dir, "part").select(k.alias("i"), F.array(size, size, size).alias("mn"), F.array(size + 2, size, size).alias("mx"), F.when(k % 4 != 0, F.col("p_retailprice")).alias("texel"), (k * 7).alias("bytes"), (k % 3 == 0).alias("ktx")).write.json(path)
    return texts.read_progress(spark, path).select("i", F.get("mn", F.lit(0)).alias("x0"), F.get("mx", F.lit(0)).alias("x1"), "texel", "bytes", "ktx")


@query("SELECT l_linenumber survey, count(*) n, round(sum(l_extendedprice), 2) x, min(l_quantity) y, max(l_discount) z FROM lineitem GROUP BY 1")
def src21_sample_files(spark, sf_dir):
    """Flat files of doubles, one for each hundred orders and line number, read in pieces."""
    l = table(spark, sf_dir, "lineitem").withColumn("part", F.floor(F.col("l_orderkey") / 4000))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        data = pdf[["l_extendedprice", "l_quantity", "l_discount"]].to_numpy("<f8").tobytes()
        return pd.DataFrame({"path": [f"survey={pdf.l_linenumber.iloc[0]}/{pdf.part.iloc[0]}.f64"], "content": [data]})

    path = scratch(spark, "samples")
    files.write_files(l.select("part", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount").groupBy("part", "l_linenumber").applyInPandas(packed, "path string, content binary"), path)
    read = spark.read.format("float_triples").option("partitionbytes", "65536").load(path)
    return read.groupBy(_survey()).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 2).alias("x"), F.min("y").alias("y"), F.max("z").alias("z"))


@query("SELECT s_suppkey k, s_acctbal a, -0.5::DOUBLE b, CAST(s_suppkey AS DOUBLE) tx FROM supplier")
def src24_offsets_and_transforms(spark, sf_dir):
    """Offsets and root matrices from JSON files beside each survey."""
    k = F.col("s_suppkey")
    matrix = F.array(*(F.lit(float(i % 5 == 0)) for i in range(12)), k.cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    doc = F.to_json(F.struct(F.array(F.col("s_acctbal"), F.lit(-0.5), F.lit(0.0)).alias("offset"), matrix.alias("transform")))
    path = scratch(spark, "offsets")
    files.write_files(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), _text(k), F.lit("/offset.json")).alias("path"), doc.cast("binary").alias("content")), path)
    found = terrain.read_offsets(spark, path)
    return found.select(F.expr("substring(slug, 2)").cast("long").alias("k"), F.get("offset", F.lit(0)).alias("a"), F.get("offset", F.lit(1)).alias("b"), F.get("transform", F.lit(12)).alias("tx"))


@query("SELECT s_suppkey k, CAST(length(s_name) + s_suppkey % 50 AS BIGINT) bytes FROM supplier WHERE s_suppkey % 10 <> 0")
def src26_file_sizes(spark, sf_dir):
    """Sizes of all files below a folder but temporary ones."""
    k = F.col("s_suppkey")
    path = scratch(spark, "sizes")
    name = F.concat(F.lit("d"), _text(k % 7), F.lit("/"), _text(k), F.when(k % 10 == 0, ".temp").otherwise(".bin"))
    files.write_files(table(spark, sf_dir, "supplier").select(name.alias("path"), F.concat("s_name", F.repeat(F.lit("x"), (k % 50).cast("int"))).cast("binary").alias("content")), path)
    return texts.file_sizes(spark, path).select(F.regexp_extract("path", r"([0-9]+)\.bin$", 1).cast("long").alias("k"), "bytes")


# --- trees, outlines, reports -------------------------------------------------------------------------------------------------------


@query("WITH " + TREE_ROWS + " SELECT CASE WHEN node_id > 0 THEN CAST(node_id AS VARCHAR) END uri, CASE WHEN parent_id > 0 THEN CAST(parent_id AS VARCHAR) END parent, node_id * 0.5::DOUBLE error FROM t")
def src12_tilesets(spark, sf_dir):
    """The tree of parts as a tileset document (SNK-01), written and read."""
    t = tiletree.depths(part_tree(spark, sf_dir))
    nodes = t.select(
        F.lit("parts").alias("tileset"), "node_id", "parent_id", "ord", "depth", F.when(F.col("node_id") > 0, _text("node_id")).alias("uri"), (F.col("node_id") * 0.5).alias("geometric_error"),
        F.array_repeat(F.lit(1.0), 12).alias("box"), F.when(F.col("node_id") == 7, F.array_repeat(F.lit(2.0), 16)).alias("transform"))
    path = scratch(spark, "tilesets")
    texts.write_tilesets(nodes, path)
    read = texts.read_tilesets(spark, path, parts=True)
    up = read.select(F.col("node_id").alias("parent_id"), F.col("uri").alias("parent"))
    return read.join(up, "parent_id", "left").select("uri", "parent", F.col("geometric_error").alias("error"))


@query("SELECT s_suppkey k, CAST(5 AS BIGINT) corners, round(s_suppkey % 20 / 20.0::DOUBLE, 7) lon, round(s_suppkey % 14 / 10.0::DOUBLE, 7) lat FROM supplier")
def snk03_footprints(spark, sf_dir):
    """Outlines as GeoJSON files, written together and read as rings (SRC-04)."""
    k = F.col("s_suppkey")
    at = lambda dx, dy: F.struct(F.round(k % 20 / 20 + dx, 7).alias("lon"), F.round(k % 14 / 10 + dy, 7).alias("lat"))
    ring = F.array(at(0, 0), at(0.01, 0), at(0.01, 0.01), at(0, 0.01), at(0, 0))
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), _text(k)).alias("slug"), ring.alias("ring"), F.lit(4).alias("vertices"), F.lit(9).cast("long").alias("area_m2"), F.lit(0.5).alias("tolerance"))
    path = scratch(spark, "outlines")
    texts.write_footprint_files(rows, path)
    found = catalogue.read_footprints(spark, path)
    return found.select(F.expr("substring(slug, 2)").cast("long").alias("k"), F.size("ring").cast("long").alias("corners"), F.get("ring", F.lit(0))["lon"].alias("lon"), F.get("ring", F.lit(0))["lat"].alias("lat"))


@query("SELECT s_suppkey k, s_name AS \"name\", CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END balance, CAST((s_suppkey % 3 = 0) AS INTEGER) left_out FROM supplier")
def snk05_report(spark, sf_dir):
    """Reports as JSON lines; a null field isn't written (SNK-13)."""
    k = F.col("s_suppkey")
    path = scratch(spark, "report")
    texts.write_report(table(spark, sf_dir, "supplier").select(k.alias("k"), F.col("s_name").alias("name"), F.when(k % 3 != 0, F.col("s_acctbal")).alias("balance")), path)
    lines = spark.read.text(path)
    doc = F.from_json("value", "k long, name string, balance double")
    return lines.select(doc.alias("d"), (~F.col("value").contains("balance")).cast("int").alias("left_out")).select("d.k", "d.name", "d.balance", "left_out")


@query("SELECT s_suppkey k, CAST(s_suppkey % 2 + 1 AS BIGINT) fields FROM supplier")
def snk13_pruned_nulls(spark, sf_dir):
    """Documents on disk without their null keys, at any depth; those that stood there are kept beside them."""
    k = F.col("s_suppkey")
    doc = F.to_json(F.struct(k.alias("k"), F.when(k % 2 == 1, F.struct(F.lit(None).cast("int").alias("a"), k.alias("b"))).alias("inner")), {"ignoreNullFields": "false"})
    path = scratch(spark, "prune")
    rows = table(spark, sf_dir, "supplier").select(F.concat(_text(k), F.lit(".json")).alias("path"), doc.cast("binary").alias("content"))
    files.write_files(rows, path)
    texts.prune_documents(spark, path)
    now, before = (spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(p).select(F.col("_metadata.file_name").alias("file"), "value") for p in (path, f"{path}.backup"))
    both = now.join(before.select("file", F.col("value").alias("was")), "file").where(F.col("was").contains("null"))
    pairs = F.size(F.regexp_extract_all("value", F.lit('"(k|b)":')))
    return both.where(~F.col("value").contains("null")).select(F.regexp_extract("file", "^([0-9]+)", 1).cast("long").alias("k"), pairs.cast("long").alias("fields"))


# --- the catalogue ------------------------------------------------------------------------------------------------------------------


def written_catalogue(spark, sf_dir):
    """A document for each supplier, some without a scene, some that are drafts; written and read (SRC-01, SRC-02)."""
    k = F.col("s_suppkey")
    doc = F.to_json(F.struct(
        F.col("s_name").alias("title"), F.concat(F.lit("Lugar "), _text(k % 5)).alias("lugar"), F.when(k % 4 != 0, F.concat(F.lit("Lugar "), _text(k % 5), F.lit(", Valle"))).alias("municipio"),
        F.when(k % 6 != 0, F.concat(F.lit("2024-0"), _text(k % 9 + 1), F.lit("-15"))).alias("fecha"), (k % 10 + 0.25).alias("lat"), (-(k % 60) - 0.5).alias("lon"), (k % 2 == 0).alias("coordenadas_aprox"),
        F.lit("M3E").alias("dron"), F.lit("Cam").alias("camara"), (k * 100).alias("fotos"), F.lit(120.0).alias("altura_m"), F.lit("nadir").alias("captura"), F.lit(2.5).alias("gsd_cm"), F.lit("listo").alias("estado"), F.lit("CC BY").alias("licencia"),
        F.struct(F.when(k % 3 != 0, F.concat(F.lit("t/"), _text(k), F.lit("/tileset.json"))).alias("tileset_geo")).alias("modelo"),
        F.struct(F.when(k % 5 != 0, k / 2).alias("geoide_m"), F.struct(F.lit(0.5).alias("este"), F.when(k % 2 == 0, 0.25).alias("norte"), F.lit(1.0).alias("z_pivote")).alias("inclinacion")).alias("escena")))
    path = scratch(spark, "catalogue")
    name = F.concat(F.when(k % 11 == 0, "_").otherwise(""), F.lit("s"), _text(k), F.lit(".json"))
    files.write_files(table(spark, sf_dir, "supplier").select(name.alias("path"), doc.cast("binary").alias("content")), path)
    return catalogue.read_catalogue(spark, path)


BASE = "https://tiles.example"
KNOWN = "k AS (SELECT s_suppkey k, 's' || s_suppkey slug FROM supplier WHERE s_suppkey % 11 <> 0)"


@query("WITH " + KNOWN + f" SELECT slug, s_name title, 'listo' estado, k % 3 <> 0 AND k % 5 <> 0 has_scene, CASE WHEN k % 3 <> 0 AND k % 5 <> 0 THEN '{BASE}/t/' || k || '/tileset.json' END tileset, CASE WHEN k % 3 <> 0 AND k % 5 <> 0 THEN k / 2.0::DOUBLE END geoid, CASE WHEN k % 3 <> 0 AND k % 5 <> 0 AND k % 2 = 0 THEN 0.5::DOUBLE END east FROM k JOIN supplier ON k = s_suppkey")
def prj03_scenes(spark, sf_dir):
    """What a scene is sent of each survey (PRJ-05), from documents on disk."""
    rows = catalogue.for_scene(written_catalogue(spark, sf_dir), BASE)
    return rows.select("slug", "title", "estado", F.col("scene").isNotNull().alias("has_scene"), "scene.tileset", "scene.geoid", F.col("scene.tilt.este").alias("east"))


CARD = """c AS (SELECT slug, unnest([{'field': 'Lugar', 'value': CASE WHEN k % 4 <> 0 THEN 'Lugar ' || k % 5 || ', Valle' ELSE 'Lugar ' || k % 5 END}, {'field': 'Fotos', 'value': NULL}, {'field': 'Captura', 'value': 'nadir'}, {'field': 'Dron', 'value': 'M3E'}, {'field': 'Cámara', 'value': 'Cam'}]) x FROM k)"""


@query("WITH " + KNOWN + ", " + CARD + " SELECT slug, x.field field, x.value AS \"value\" FROM c WHERE x.value IS NOT NULL")
def prj06_card_without_fields(spark, sf_dir):
    """The lines of every survey's card but for those that are named."""
    rows = catalogue.card_rows(written_catalogue(spark, sf_dir), without=("Coordenadas", "Fotos", "Altura de vuelo", "GSD", "Licencia del modelo"))
    return rows.select("slug", "field", "value")


@query("WITH " + KNOWN + " SELECT slug FROM k")
def prj09_paths(spark, sf_dir):
    return catalogue.paths(written_catalogue(spark, sf_dir))


@query("WITH " + KNOWN + " SELECT slug, s_name title FROM k JOIN supplier ON k = s_suppkey WHERE slug = 's7'")
def src03_by_key(spark, sf_dir):
    return catalogue.by_key(written_catalogue(spark, sf_dir), "s7").select("slug", "title")


@query("SELECT c_custkey k, round((c_custkey % 7) * 0.5::DOUBLE, 3) horizontal, round((c_custkey % 5) * 0.25::DOUBLE, 3) vertical FROM customer")
def geo17_georeference_errors(spark, sf_dir):
    """Vertices in the world's metres, each expected somewhat to the east of where it is and lower."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), (k % 100 / 50.0 - 74.9).alias("lon"), (k % 70 / 50.0 + 4.1).alias("lat"), (k % 300 + 2500.0).alias("h"))
    x, y, z = G.to_ecef(F.col("lon"), F.col("lat"), F.col("h"))
    east, north = G.to_utm(F.col("lon"), F.col("lat"), 18)
    k = F.col("k")
    rows = rows.select("k", x.alias("x"), y.alias("y"), z.alias("z"), (east + k % 7 * 0.5).alias("east"), north.alias("north"), (F.col("h") - 12.5 - k % 5 * 0.25).alias("height"))
    found = terrain.georeference_errors(rows, [float(i % 5 == 0) for i in range(16)], 18, 12.5)
    return found.select("k", F.round("horizontal", 3).alias("horizontal"), F.round("vertical", 3).alias("vertical"))


@query("""WITH v AS (SELECT list(p_retailprice ORDER BY p_partkey) h, count(*) n FROM part), g AS (SELECT h, 40 w, n // 40 r FROM v),
 p AS (SELECT c_custkey k, least(greatest((-74.1::DOUBLE + c_custkey % 57 * 0.0091::DOUBLE + 74.0) / 0.01::DOUBLE, 0), 38.999) px, least(greatest((5.0 - (5.05::DOUBLE - c_custkey % 61 * 0.0071::DOUBLE)) / 0.01::DOUBLE, 0), r - 1.001) py, h, w FROM customer, g),
 q AS (SELECT *, CAST(floor(px) AS BIGINT) c, CAST(floor(py) AS BIGINT) l, px - floor(px) u, py - floor(py) f FROM p)
 SELECT k, round(h[l * w + c + 1] * (1 - u) * (1 - f) + h[l * w + c + 2] * u * (1 - f) + h[(l + 1) * w + c + 1] * (1 - u) * f + h[(l + 1) * w + c + 2] * u * f, 5) geoid FROM q""")
def src17_geoid_grid(spark, sf_dir):
    """A regular grid of the parts' prices, forty wide, under points in and around it; cut into tiles with their neighbours' edges."""
    prices = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("value"))
    values = numbered(prices, ["p_partkey"], "index")
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(k.alias("k"), (k % 57 * 0.0091 - 74.1).alias("lon"), (F.lit(5.05) - k % 61 * 0.0071).alias("lat"))
    return terrain.sample_values(points, values, -74.0, 5.0, 0.01, 40, tile=16).select("k", F.round("geoid", 5).alias("geoid"))


@query("SELECT s_suppkey k, CAST(v AS VARCHAR) AS version, s_acctbal + v offset_x FROM supplier, (VALUES (1), (2)) t(v)")
def snk09_versions(spark, sf_dir):
    """Offsets written twice: the second version lies beside the first."""
    path = scratch(spark, "versions")
    for v in (1, 2):
        texts.write_versioned(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_acctbal") + v).alias("offset_x")), path, str(v))
    return spark.read.schema("k long, offset_x double, version string").json(path).select("k", "version", "offset_x")


@query("WITH " + TREE_ROWS + " SELECT CASE WHEN node_id > 0 THEN CAST(node_id AS VARCHAR) END uri, node_id = 0 is_root, CASE WHEN node_id = 0 THEN 112.0::DOUBLE END shift FROM t")
def snk10_root_transform(spark, sf_dir):
    """A tileset whose root gets a matrix, written and read: only the root has it."""
    t = tiletree.depths(part_tree(spark, sf_dir))
    nodes = t.select(F.lit("parts").alias("tileset"), "node_id", "parent_id", "ord", "depth", F.when(F.col("node_id") > 0, _text("node_id")).alias("uri"), F.lit(1.0).alias("geometric_error"), F.array_repeat(F.lit(1.0), 12).alias("box"), F.lit(None).cast("array<double>").alias("transform"))
    path = scratch(spark, "turned")
    texts.write_tilesets(texts.with_root_transform(nodes, range(100, 116)), path)
    return texts.read_tilesets(spark, path, parts=True).select("uri", F.col("parent_id").isNull().alias("is_root"), F.get("transform", F.lit(12)).alias("shift"))
