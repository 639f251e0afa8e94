"""Places, rings and boxes that are there many times are tested once, or in packs, and lose no pair."""

import pytest
from pyspark.sql import functions as F

from orograph.operators import spatial

SQUARE = [(0.0, 0.0), (0.1, 0.0), (0.1, 0.1), (0.0, 0.1), (0.0, 0.0)]
RING = "rid long, ring array<struct<lon:double,lat:double>>"


@pytest.fixture
def tested(spark, monkeypatch):
    """Counts the tests of a point against a ring."""
    seen = spark.sparkContext.accumulator(0)

    def counting(name):
        real = getattr(spatial, name)

        @F.udf("int")
        def count(x):
            seen.add(1)
            return 0

        monkeypatch.setattr(spatial, name, lambda ring, lon, lat, *more: F.when(count(lon) == 0, real(ring, lon, lat, *more)))
        return seen

    return counting


def copied(spark, points=150, rings=150):
    p = [(i, 0.05, 0.05, float(i)) for i in range(points)] + [(1000, 0.5, 0.5, 1.0), (1001, None, 0.05, 1.0), (1002, 0.06, 0.05, 1.0)]
    r = [(i, SQUARE) for i in range(rings)] + [(2000, [(x + 0.055, y) for x, y in SQUARE]), (2001, None)]
    return spark.createDataFrame(p, "pid long, lon double, lat double, h double"), spark.createDataFrame(r, RING)


def test_weights_test_equal_places_and_rings_once(spark, tested):
    points, rings = copied(spark)
    seen = tested("sink_weight")
    found = spatial.weights(points, rings, 0.05, 1500.0)
    assert found.columns == ["pid", "lon", "lat", "h", "weight"]
    got = {r.pid: r.weight for r in found.collect()}
    assert len(got) == 153 and {got[i] for i in range(150)} == {1.0} and got[1000] == got[1001] == 0 and got[1002] > 0.9
    assert 0 < seen.value <= 20


def test_outside_rings_tests_equal_places_and_rings_once(spark, tested):
    points, rings = copied(spark)
    seen = tested("edge_distance")
    assert sorted(r.pid for r in spatial.outside_rings(points, rings, 0.05, 800.0).collect()) == [1000, 1001]
    assert seen.value <= 20


def test_pairs_of_copies_are_tested_in_packs(spark, tested):
    points, rings = copied(spark)
    seen = tested("contains")
    got = spatial.points_in_rings(points.unionByName(points.where("pid = 3")), rings.unionByName(spark.createDataFrame([(None, SQUARE)], RING)), 0.05)
    assert got.columns == ["pid", "rid"] and [f.dataType.simpleString() for f in got.schema] == ["bigint", "bigint"]
    rows = [tuple(r) for r in got.collect()]
    want = [(p, r) for p in [*range(150), 3, 1002] for r in [*range(150), None]] + [(1002, 2000)]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert 0 < seen.value <= 300


def shuffled(df):
    """Rows that the joins of a finished frame made, by their metrics."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    todo, most = [plan], 0
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        p_ = p.plan() if name.endswith("QueryStageExec") else None
        children = [p_] if p_ is not None else [p.children().apply(i) for i in range(p.children().size())]
        if "Join" in name and p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        todo += children
    return most


def test_equal_boxes_meet_in_packs(spark):
    a = spark.createDataFrame([(i, 0.0, 0.0, 1.0, 1.0) for i in range(200)] + [(500, 1.0, 1.0, 1.0, 1.0), (501, 9.0, 9.0, 9.0, 9.0)], "id long, x0 double, y0 double, x1 double, y1 double")
    b = spark.createDataFrame([(i, 0.5, 0.5, 2.0, 1.5) for i in range(300)], a.schema)
    got = spatial.boxes_touching(a, b, 3.0)
    rows = got.collect()
    assert sorted((r.a_id, r.b_id) for r in rows) == [(i, j) for i in [*range(200), 500] for j in range(300)]
    assert 0 < shuffled(got) < 2000


def test_long_boxes_meet_few_that_they_do_not_touch(spark):
    """Boxes a thousand long and a thousandth high, all in one square."""
    a = spark.range(300).selectExpr("id", "0D x0", "id * 3D y0", "1000D x1", "id * 3D + 0.001D y1")
    b = spark.range(300).selectExpr("id", "0D x0", "id * 3D + 1D y0", "1000D x1", "id * 3D + 1.001D y1").unionByName(a.where("id = 7"))
    got = spatial.boxes_touching(a, b, 1.0)
    assert [tuple(r) for r in got.collect()] == [(7, 7)]


def test_lowest_hit_looks_at_equal_places_once(spark):
    from orograph.operators import meshes

    t = spark.range(200).selectExpr("id tid", "0D ax", "0D ay", "double(id) az", "2D bx", "0D by", "double(id) bz", "0D cx", "2D cy", "double(id) cz")
    p = spark.range(200).selectExpr("id pid", "0.5D x", "0.5D y").unionByName(spark.createDataFrame([(900, 5.0, 5.0), (901, None, 1.0)], "pid long, x double, y double"))
    got = meshes.lowest_hit(t, p, 1.0)
    assert got.columns == ["pid", "x", "y", "z_hit"]
    assert {r.pid: r.z_hit for r in got.collect()} == {i: 0.0 for i in range(200)} | {900: None, 901: None}
    assert 0 < shuffled(got) < 2000
