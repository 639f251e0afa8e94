"""Trees over parts: a part's parent is its number divided by ten, so part 1 to 9 hang below 0. Folds, depths and splits are those of tile trees."""

from pyspark.sql import functions as F

from orograph.functions import matrix
from orograph.operators import tiletree
from orograph.plans.tables import query, table


def part_tree(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("node_id"), F.floor(k / 10).alias("parent_id"), (k % 10).cast("int").alias("ord"), F.col("p_retailprice").alias("bytes"), (k % 13 * 1.0).alias("x"), (k % 7 * 1.0).alias("y"), (k % 5 * 1.0).alias("z"), ((k % 101 + 1) / 1000).alias("texel"))
    ids = rows.select("node_id")
    # parents that are no parts themselves: only the root, 0
    root = rows.select(F.col("parent_id").alias("node_id")).distinct().hint("merge").join(ids, "node_id", "left_anti").select("node_id", F.lit(None).cast("long").alias("parent_id"), F.lit(0).alias("ord"), *(F.lit(None).cast("double").alias(c) for c in ("bytes", "x", "y", "z", "texel")))
    parent = F.when(F.col("node_id") == 0, None).otherwise(F.col("parent_id"))
    return rows.unionByName(root).withColumn("parent_id", parent)


TREE = "WITH RECURSIVE n AS (SELECT p_partkey node_id, CASE WHEN p_partkey > 0 THEN p_partkey // 10 END parent_id, p_retailprice bytes FROM part UNION ALL SELECT 0, NULL, NULL WHERE 0 NOT IN (SELECT p_partkey FROM part)), d AS (SELECT node_id, parent_id, bytes, 0 depth FROM n WHERE parent_id IS NULL UNION ALL SELECT n.node_id, n.parent_id, n.bytes, d.depth + 1 FROM n JOIN d ON n.parent_id = d.node_id)"


@query(TREE + " SELECT node_id, CAST(depth AS INTEGER) depth FROM d")
def geo11_depths(spark, sf_dir):
    return tiletree.depths(part_tree(spark, sf_dir)).select("node_id", "depth")


@query(TREE + " SELECT node_id FROM d WHERE node_id NOT IN (SELECT parent_id FROM d WHERE parent_id IS NOT NULL)")
def prj15_leaves(spark, sf_dir):
    return tiletree.leaves(part_tree(spark, sf_dir)).select("node_id")


@query(TREE + """, a AS (SELECT node_id, node_id anc FROM d UNION ALL SELECT a.node_id, d.parent_id FROM a JOIN d ON a.anc = d.node_id WHERE d.parent_id IS NOT NULL),
 b AS (SELECT anc node_id, min(node_id % 13) x0, max(node_id % 13) x1, min(node_id % 7) y0, max(node_id % 7) y1, min(node_id % 5) z0, max(node_id % 5) z1 FROM a WHERE node_id <> 0 GROUP BY 1)
 SELECT node_id, (x0 + x1) / 2.0::DOUBLE cx, (y0 + y1) / 2.0::DOUBLE cy, (z0 + z1) / 2.0::DOUBLE cz FROM b""")
def geo13_fold_boxes(spark, sf_dir):
    """Box centres; half sizes have a floor that grows boxes of single points, so the middle is what stays exact (rounded to 0.25)."""
    t = part_tree(spark, sf_dir)
    p = F.when(F.col("x").isNotNull(), F.array("x", "y", "z"))
    nodes = tiletree.depths(t.withColumns({"lo": p, "hi": p}))
    f = tiletree.fold(nodes)
    r = lambda i: F.round(F.get("box", F.lit(i)) * 4) / 4
    return f.select("node_id", r(0).alias("cx"), r(1).alias("cy"), r(2).alias("cz"))


def _fold_errors(deepest: int = 9) -> str:
    """Level by level from below: each node from the greatest error of its children."""
    levels = [f"e{deepest} AS (SELECT node_id, parent_id, true is_leaf, 0.0::DOUBLE error FROM d WHERE depth = {deepest})"]
    for k in range(deepest - 1, -1, -1):
        own = "greatest(CASE WHEN d.bytes IS NOT NULL THEN (d.node_id % 101 + 1) / 1000.0::DOUBLE * 16 ELSE 0 END, child * 1.01::DOUBLE, 0.01::DOUBLE)"
        levels.append(f"e{k} AS (SELECT d.node_id, d.parent_id, child IS NULL is_leaf, CASE WHEN child IS NULL THEN 0 WHEN d.bytes IS NULL THEN greatest({own}, child * 2) ELSE {own} END error FROM d LEFT JOIN (SELECT parent_id, max(error) child FROM e{k + 1} GROUP BY 1) c ON d.node_id = c.parent_id WHERE depth = {k})")
    union = " UNION ALL ".join(f"SELECT * FROM e{k}" for k in range(deepest + 1))
    return TREE + ", " + ", ".join(levels) + f" SELECT node_id, parent_id, CASE WHEN error = 0 THEN 0 ELSE floor(error * pow(10.0, 4 - floor(log10(error))) + 0.5) / pow(10.0, 4 - floor(log10(error))) END error, is_leaf FROM ({union})"


@query(_fold_errors())
def geo13_fold_errors(spark, sf_dir):
    """Errors strictly above those of all children."""
    t = part_tree(spark, sf_dir)
    p = F.when(F.col("x").isNotNull(), F.array("x", "y", "z"))
    return tiletree.rounded(tiletree.fold(tiletree.depths(t.withColumns({"lo": p, "hi": p})))).select("node_id", "parent_id", "error", "is_leaf")


@query(TREE + ", w AS (SELECT node_id, 0.0::DOUBLE x, 0.0::DOUBLE y, 0.0::DOUBLE a FROM d WHERE parent_id IS NULL UNION ALL SELECT d.node_id, w.x + cos(w.a), w.y + sin(w.a), w.a + d.node_id % 10 * 0.3::DOUBLE FROM d JOIN w ON d.parent_id = w.node_id) SELECT node_id, round(x, 9) x, round(y, 9) y, round(cos(a), 9) turn FROM w")
def geo12_transforms(spark, sf_dir):
    """Every node stands one before its parent, in its parent's direction, and turns by its place among its siblings."""
    a = F.col("ord") * 0.3
    rows = ((F.cos(a), F.sin(a), 0, 0), (-F.sin(a), F.cos(a), 0, 0), (0, 0, 1, 0), (1, 0, 0, 1))
    move = F.when(F.col("parent_id").isNotNull(), F.array(*(v if not isinstance(v, int) else F.lit(float(v)) for r in rows for v in r)))
    t = tiletree.transforms(tiletree.depths(part_tree(spark, sf_dir)).withColumn("transform", move))
    at = lambda i: F.round(F.get("world", F.lit(i)), 9)
    return t.select("node_id", at(12).alias("x"), at(13).alias("y"), at(0).alias("turn"))


@query(TREE + """, w AS (SELECT depth, count(*) wide FROM d GROUP BY 1), c AS (SELECT min(depth) FILTER (WHERE depth >= 2 AND wide >= 32) cut, sum(wide) n FROM w),
 s AS (SELECT node_id, node_id sub, depth FROM d, c WHERE depth = cut AND n > 1500 AND node_id IN (SELECT parent_id FROM d WHERE parent_id IS NOT NULL) UNION ALL SELECT d.node_id, s.sub, d.depth FROM d JOIN s ON d.parent_id = s.node_id)
 SELECT d.node_id, s.sub subtree_id FROM d LEFT JOIN s ON d.node_id = s.node_id""")
def snk02_subtrees(spark, sf_dir):
    return tiletree.subtrees(tiletree.depths(part_tree(spark, sf_dir))).select("node_id", "subtree_id")


@query(TREE + ", k AS (SELECT parent_id, count(*) k FROM d WHERE parent_id IS NOT NULL GROUP BY 1) SELECT 0 root, node_id FROM d WHERE node_id = (SELECT CASE WHEN (SELECT k FROM k WHERE parent_id = 0) = 1 THEN 1 ELSE 0 END)")
def geo16_first_view(spark, sf_dir):
    """The root has no content and several children, so it is where the walk stops."""
    nodes = tiletree.depths(part_tree(spark, sf_dir)).withColumn("uri", F.when(F.col("bytes").isNotNull(), F.col("node_id").cast("string")))
    return tiletree.first_view(nodes).select(F.col("root").cast("int").alias("root"), "node_id")


@query("SELECT s_suppkey * 10 root, s_suppkey * 10 + s_suppkey % 4 node_id, CASE WHEN s_suppkey % 3 <> 0 THEN 'u' || s_suppkey END uri FROM supplier")
def geo16_only_children(spark, sf_dir):
    """A tree for each supplier: some only children one below the other, then one with content, or one without that has two children."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").withColumn("n", k % 4)
    chain = s.select((k * 10).alias("root"), "n", k.alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("i"))
    chain = chain.select((F.col("root") + F.col("i")).alias("node_id"), F.when(F.col("i") > 0, F.col("root") + F.col("i") - 1).alias("parent_id"), F.when((F.col("i") == F.col("n")) & (F.col("k") % 3 != 0), F.concat(F.lit("u"), F.col("k").cast("string"))).alias("uri"))
    two = s.where(k % 3 == 0).select(F.explode(F.array(k * 10 + 8, k * 10 + 9)).alias("node_id"), (k * 10 + F.col("n")).alias("parent_id"), F.lit("x").alias("uri"))
    return tiletree.first_view(tiletree.depths(chain.unionByName(two))).select("root", "node_id", "uri")


@query(TREE + ", o AS (SELECT node_id, lpad('0', 19, '0') dfs FROM d WHERE parent_id IS NULL UNION ALL SELECT d.node_id, o.dfs || '/' || lpad(CAST(d.node_id % 10 AS VARCHAR), 19, '0') FROM d JOIN o ON d.parent_id = o.node_id) SELECT node_id, dfs FROM o")
def geo11_dfs_order(spark, sf_dir):
    return tiletree.dfs_order(tiletree.depths(part_tree(spark, sf_dir))).select("node_id", "dfs")


@query("SELECT p_partkey // 10 node_id, count(*) k, round(sum(p_retailprice), 2) bytes FROM part WHERE p_partkey > 0 GROUP BY 1")
def geo14_level_rebuild(spark, sf_dir):
    """One step: every node that has children, made from the children's own bytes. Node 0 is the root and no child. Level by level it is ``geo14_tree_rebuild``."""
    children = part_tree(spark, sf_dir).where("parent_id IS NOT NULL").select("parent_id", F.lit(1).cast("long").alias("k"), "bytes")
    return _joined(children).select("node_id", "k", F.round("bytes", 2).alias("bytes"))


def _joined(below):
    return below.groupBy(F.col("parent_id").alias("node_id")).agg(F.sum("k").alias("k"), F.sum("bytes").alias("bytes"))


@query(TREE + """, l AS (SELECT node_id, parent_id anc, bytes FROM d WHERE node_id NOT IN (SELECT parent_id FROM d WHERE parent_id IS NOT NULL) UNION ALL SELECT l.node_id, d.parent_id, l.bytes FROM l JOIN d ON l.anc = d.node_id WHERE d.parent_id IS NOT NULL)
 SELECT anc node_id, CAST(count(*) AS BIGINT) k, round(sum(bytes), 2) bytes FROM l WHERE anc IS NOT NULL GROUP BY 1""")
def geo14_tree_rebuild(spark, sf_dir):
    """Every inner node, made level by level from the leaves below it: their number and bytes."""
    nodes = tiletree.depths(part_tree(spark, sf_dir))
    leaf = tiletree.leaves(nodes).select("node_id", F.lit(1).cast("long").alias("k"), "bytes")
    made = tiletree.levels_bottom_up(nodes, leaf, _joined)
    return made.hint("merge").join(leaf.select("node_id"), "node_id", "left_anti").select("node_id", "k", F.round("bytes", 2).alias("bytes"))
