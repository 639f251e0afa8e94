"""Walks over trees send no level through the driver."""

from pyspark.sql import functions as F

from orograph.operators import tiletree


def test_no_level_is_broadcast(spark, monkeypatch):
    plans, inner = [], tiletree.settled

    def seen(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return inner(df)

    monkeypatch.setattr(tiletree, "settled", seen)
    rows = [(i, (i - 1) // 3 if i else None, i % 3, float(i), [float(i)] * 3) for i in range(40)]
    nodes = spark.createDataFrame(rows, "node_id long, parent_id long, ord int, texel double, p array<double>").withColumns({"lo": F.col("p"), "hi": F.col("p"), "transform": F.lit(None).cast("array<double>")})
    deep = tiletree.depths(nodes)
    assert {r.node_id: r.depth for r in deep.collect()}[39] == 3
    for walked in (tiletree.fold(deep), tiletree.transforms(deep), tiletree.dfs_order(deep), tiletree.subtrees(deep, 10, 1, 2), tiletree.leaves(deep)):
        plans.append(walked._jdf.queryExecution().sparkPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
