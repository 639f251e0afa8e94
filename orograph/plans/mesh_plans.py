"""Meshes: a line of an order is a triangle of its supplier's tile, or a vertex; parts are vertices of faces that orders name."""

from pyspark.sql import functions as F

from orograph.operators import meshes
from orograph.plans.tables import query, table


def triangles(spark, sf_dir):
    """Sloping ones; each eleventh order's stand upright, each thirteenth's have no area."""
    k, q = F.col("l_orderkey"), F.col("l_quantity") / 10
    x, y, z = k % 37 * 1.7, k % 23 * 1.3, F.col("l_discount") * 10
    wall, flat = k % 11 == 0, k % 13 == 0
    b = (x + F.when(wall, 1.0).otherwise(2.0), y + F.when(wall, 0.0).otherwise(0.3), z + F.when(wall, 0.0).otherwise(q))
    c = (x + F.when(wall, 0.0).otherwise(0.4), y + F.when(wall, 0.0).otherwise(2.5), z + F.when(wall, 3.0).otherwise(0.0))
    c = tuple(F.when(flat, u).otherwise(v) for u, v in zip(b, c, strict=True))
    named = [v.alias(p + n) for p, corner in (("a", (x, y, z)), ("b", b), ("c", c)) for n, v in zip("xyz", corner, strict=True)]
    return table(spark, sf_dir, "lineitem").select((k * 10 + F.col("l_linenumber")).alias("tid"), F.col("l_suppkey").alias("tile"), *named)


T = """WITH o AS (SELECT l_orderkey * 10 + l_linenumber tid, l_suppkey tile, l_orderkey k, l_quantity / 10 q, l_orderkey % 37 * 1.7::DOUBLE ax, l_orderkey % 23 * 1.3::DOUBLE ay, l_discount * 10 az FROM lineitem),
 w AS (SELECT *, ax + CASE WHEN k % 11 = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END bx, ay + CASE WHEN k % 11 = 0 THEN 0.0::DOUBLE ELSE 0.3::DOUBLE END "by", az + CASE WHEN k % 11 = 0 THEN 0.0::DOUBLE ELSE q END bz FROM o),
 t AS (SELECT tid, tile, ax, ay, az, bx, "by", bz, CASE WHEN k % 13 = 0 THEN bx ELSE ax + CASE WHEN k % 11 = 0 THEN 0.0::DOUBLE ELSE 0.4::DOUBLE END END cx, CASE WHEN k % 13 = 0 THEN "by" ELSE ay + CASE WHEN k % 11 = 0 THEN 0.0::DOUBLE ELSE 2.5::DOUBLE END END cy,
 CASE WHEN k % 13 = 0 THEN bz ELSE az + CASE WHEN k % 11 = 0 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END END cz FROM w),
 n AS (SELECT *, ("by" - ay) * (cz - az) - (bz - az) * (cy - ay) nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) ny, (bx - ax) * (cy - ay) - ("by" - ay) * (cx - ax) nz FROM t),
 m AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) size FROM n)"""
WALL = "(size = 0 OR abs(nz) / size < 0.3)"


@query(T + f" SELECT tid FROM m WHERE NOT {WALL}")
def prj12_without_walls(spark, sf_dir):
    return meshes.drop_walls(meshes.with_normals(triangles(spark, sf_dir))).select("tid")


@query(T + " SELECT tid FROM m WHERE size / 2 >= 1e-8")
def prj14_without_degenerate(spark, sf_dir):
    return meshes.drop_degenerate(triangles(spark, sf_dir)).select("tid")


@query(T + f" SELECT round(avg(CASE WHEN {WALL} THEN 1 ELSE 0 END) * 100, 9) wall_percent FROM m")
def agg26_wall_share(spark, sf_dir):
    return meshes.wall_share(meshes.with_normals(triangles(spark, sf_dir))).select(F.round("wall_percent", 9).alias("wall_percent"))


@query(T + " SELECT tid, round(size / 2, 9) area, round(nx, 9) nx, round(ny, 9) ny, round(nz, 9) nz FROM m")
def sca37_normals_and_areas(spark, sf_dir):
    return meshes.with_normals(triangles(spark, sf_dir)).select("tid", F.round("area", 9).alias("area"), *(F.round(c, 9).alias(c) for c in ("nx", "ny", "nz")))


@query(T + ", f AS (SELECT DISTINCT tile FROM t ORDER BY tile LIMIT 40) SELECT round(sum(nz), 4) vote, sum(nz) < 0 flip FROM m WHERE tile IN (SELECT tile FROM f)")
def agg21_winding_vote(spark, sf_dir):
    """Over the first forty tiles."""
    t = triangles(spark, sf_dir)
    vote = meshes.winding_vote(t, t.select(F.col("tile").alias("node_id")).distinct())
    return vote.select(F.round("vote", 4).alias("vote"), "flip")


@query("SELECT tid, CAST((n - 1) AS BIGINT) weld_id FROM (SELECT l_orderkey * 10 + l_linenumber tid, floor((l_quantity + l_tax / 90) / 0.001 + 0.5) x, floor(l_discount / 0.001 + 0.5) y FROM lineitem) JOIN (SELECT x, y, row_number() OVER (ORDER BY f, x, y) n FROM (SELECT floor((l_quantity + l_tax / 90) / 0.001 + 0.5) x, floor(l_discount / 0.001 + 0.5) y, min(l_orderkey * 10 + l_linenumber) f FROM lineitem GROUP BY 1, 2)) USING (x, y)")
def agg23_weld_rounded(spark, sf_dir):
    """Lines as vertices that differ by less than a millimetre in places."""
    v = table(spark, sf_dir, "lineitem").select(F.lit("t").alias("tile"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("vid"), (F.col("l_quantity") + F.col("l_tax") / 90).alias("x"), F.col("l_discount").alias("y"))
    return meshes.weld_rounded(v, keys=("x", "y")).select(F.col("vid").alias("tid"), "weld_id")


@query("SELECT l_suppkey tile, min(l_discount) u0, max(l_discount) u1, min(l_tax) v0, max(l_tax) v1, count(*) vertices FROM lineitem GROUP BY 1")
def agg30_uv_ranges(spark, sf_dir):
    return meshes.uv_ranges(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tile"), F.col("l_discount").alias("u"), F.col("l_tax").alias("v")))


def faces(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("fid"), F.array(k % 200 + 1, k * 7 % 200 + 1, k * 13 % 199 + 1).alias("corners"))


def part_vertices(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vid"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"))


FACES = "WITH f AS (SELECT o_orderkey fid, [o_orderkey % 200 + 1, o_orderkey * 7 % 200 + 1, o_orderkey * 13 % 199 + 1] c FROM orders), v AS (SELECT p_partkey vid, p_size * 1.0::DOUBLE x, p_retailprice / 100 y FROM part)"


@query(FACES + " SELECT fid FROM f, LATERAL (SELECT unnest(c) vid) u JOIN v USING (vid) WHERE x BETWEEN 10 AND 45 AND y BETWEEN 9.02 AND 9.15 GROUP BY 1 HAVING count(*) = 3")
def prj13_clipped_faces(spark, sf_dir):
    return meshes.clip_faces(faces(spark, sf_dir), part_vertices(spark, sf_dir), 10.0, 9.02, 45.0, 9.15).select("fid")


@query(FACES + ", u AS (SELECT fid, unnest(c) vid, unnest(range(3)) k FROM f), m AS (SELECT vid, min(struct_pack(f := fid, k := k)) first FROM u GROUP BY 1) SELECT vid, row_number() OVER (ORDER BY first) new_id FROM m")
def win08_renumbered(spark, sf_dir):
    return meshes.renumbered(faces(spark, sf_dir))


@query(FACES + " SELECT fid, 0 part, c[1] a, c[2] b, c[3] c FROM f")
def src10_fan(spark, sf_dir):
    return meshes.fan(faces(spark, sf_dir))


@query("SELECT l_orderkey * 10 + l_linenumber tid, s_nationkey * 16 tex_w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey % 3 <> 0")
def jn12_texture_sizes(spark, sf_dir):
    """Each third material has no texture; its triangles go."""
    sizes = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("material"), (F.col("s_nationkey") * 16).alias("tex_w"))
    t = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tid"), F.col("l_suppkey").alias("material"))
    return meshes.with_material_size(t, sizes).select("tid", "tex_w")


@query("SELECT texture, (k - 1) // 500 part, count(*) n, md5(string_agg(CAST(p AS VARCHAR), ',' ORDER BY p)) primitives FROM (SELECT l_suppkey texture, l_orderkey * 10 + l_linenumber p, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) k FROM lineitem) GROUP BY 1, 2")
def jn16_users_of_textures(spark, sf_dir):
    """Parts of five hundred."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("texture"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("primitive"))
    u = meshes.users_of_textures(p, 500)
    return u.select("texture", "part", F.size("primitives").cast("long").alias("n"), F.md5(F.array_join(F.transform("primitives", lambda x: x.cast("string")), ",")).alias("primitives"))


@query(T + """, p AS (SELECT c_custkey pid, c_custkey % 61 * 1.03::DOUBLE x, c_custkey % 29 * 1.01::DOUBLE y FROM customer),
 h AS (SELECT pid, x, y, az, bz, cz, ((("by" - cy) * (x - cx) + (cx - bx) * (y - cy)) / d) s, (((cy - ay) * (x - cx) + (ax - cx) * (y - cy)) / d) t FROM (SELECT *, ("by" - cy) * (ax - cx) + (cx - bx) * (ay - cy) d FROM t) JOIN p ON x BETWEEN least(ax, bx, cx) AND greatest(ax, bx, cx) AND y BETWEEN least(ay, "by", cy) AND greatest(ay, "by", cy) WHERE d <> 0),
 g AS (SELECT pid, min(s * az + t * bz + (1 - s - t) * cz) z FROM h WHERE s >= 0 AND t >= 0 AND s + t <= 1 GROUP BY 1) SELECT pid, round(z, 6) z_hit FROM p LEFT JOIN g USING (pid)""")
def jn15_lowest_hit(spark, sf_dir):
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(k.alias("pid"), (k % 61 * 1.03).alias("x"), (k % 29 * 1.01).alias("y"))
    return meshes.lowest_hit(triangles(spark, sf_dir), points, 1.0).select("pid", F.round("z_hit", 6).alias("z_hit"))


EXTREME = "(SELECT l_orderkey * 10 + l_linenumber FROM lineitem ORDER BY {c} {d}, 1 LIMIT 1)"


@query("WITH v AS (SELECT l_orderkey * 10 + l_linenumber vid FROM lineitem), s AS (SELECT vid FROM v ORDER BY md5('1:' || vid), vid LIMIT 500) SELECT vid FROM s UNION SELECT vid FROM v WHERE vid IN ("
       + ", ".join(EXTREME.format(c=c, d=d) for c in ("l_extendedprice", "l_quantity") for d in ("ASC", "DESC")) + ")")
def prj17_sample_with_extremes(spark, sf_dir):
    """Five hundred rows drawn by a seed, and the rows of the least and greatest price and quantity."""
    v = table(spark, sf_dir, "lineitem").withColumn("vid", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return meshes.sample_with_extremes(v, 500, ("l_extendedprice", "l_quantity")).select("vid")


@query("SELECT DISTINCT l_suppkey texture FROM lineitem")
def set03_distinct_textures(spark, sf_dir):
    return meshes.distinct_textures(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("texture")))
