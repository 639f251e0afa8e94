"""Pairs that a spatial join finds are written out where they are found: none is moved, and no task has all of a cell that holds much."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orograph.operators import copies, spatial

BOXES = "id long, x0 double, y0 double, x1 double, y1 double"
RINGS = "rid long, ring array<struct<lon:double,lat:double>>"


def moved(df):
    """The most rows that an exchange of a finished frame wrote."""
    plan = df._jdf.queryExecution().executedPlan()
    todo, most = [plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan], 0
    while todo:
        p = todo.pop()
        if p.metrics().contains("shuffleRecordsWritten"):
            most = max(most, p.metrics().apply("shuffleRecordsWritten").value())
        todo += [p.plan()] if p.getClass().getSimpleName().endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
    return most


@pytest.fixture
def fine(monkeypatch):
    monkeypatch.setattr(copies, "LEAST", 50)
    monkeypatch.setattr(copies, "BLOCKS", 40)


def boxes(spark, n, seed):
    """Some of which all meet in one cell, some equal, one without a side, one id twice."""
    r = random.Random(seed)
    rows = [(i, x := r.uniform(0, 9), y := r.uniform(0, 9), x + 30.0, y + 30.0 + i % 3) for i in range(n)] + [(n + i, 50.0, 50.0, 50.5, 50.5) for i in range(70)]
    rows += [(5000, None, 1.0, 2.0, 2.0), (None, 50.2, 50.2, 50.3, 50.3), (3, 50.0, 50.0, 50.5, 50.5)]
    return rows, spark.createDataFrame(rows, BOXES)


@pytest.mark.parametrize("cut", [True, False])
def test_boxes_that_all_meet(spark, request, cut):
    if cut:
        request.getfixturevalue("fine")
    (p, a), (q, b) = boxes(spark, 250, 1), boxes(spark, 180, 2)
    got = spatial.boxes_touching(a, b, 10.0)
    want = Counter((s[0], t[0]) for s in p for t in q if None not in (s[1], t[1]) and s[1] <= t[3] and t[1] <= s[3] and s[2] <= t[4] and t[2] <= s[4])
    assert sum(want.values()) > 49_000
    assert Counter(tuple(r) for r in got.collect()) == want
    # each box is at most some cells, times the parts of the other side
    assert 0 < moved(got) < 12_000


@pytest.mark.parametrize("n,m", [(600, 200), (3, 400), (400, 3)])
def test_places_in_rings_that_all_meet(spark, fine, n, m):
    r = random.Random(n)
    p = [(i, r.uniform(0, 4), r.uniform(0, 4)) for i in range(n)] + [(9000, None, 1.0), (9001, -50.0, 1.0)]
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    q = [(j, square(-1.0 - j / 100, -1.0, 9.0)) for j in range(m)] + [(8000, None), (8001, square(2.0, 2.0, 1.0))]
    got = spatial.points_in_rings(spark.createDataFrame(p, "pid long, lon double, lat double"), spark.createDataFrame(q, RINGS), 1.0)
    want = {(i, j) for i in range(n) for j in range(m)} | {(i, 8001) for i, x, y in p[:n] if 2 <= x < 3 and 2 <= y < 3}
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert 0 < moved(got) < 30_000
    held = [x.n for x in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(held) > 1 and max(held) < 0.8 * len(rows)


def test_heavy_keys_are_cut_into_blocks(spark, fine):
    a = spark.range(900).selectExpr("struct(if(id < 500, 0, id) x, 'y' y) k", "id a")
    b = spark.range(700).selectExpr("struct(if(id < 300, 0, id) x, 'y' y) k", "id b").unionByName(spark.createDataFrame([((None, "y"), 1)], "k struct<x:long,y:string>, b long"))
    got = copies.met(a, b, "k").select("k.x", "a", "b")
    want = [(0, i, j) for i in range(500) for j in range(300)] + [(i, i, i) for i in range(500, 700)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert copies.met(a.limit(0), b, "k").count() == 0
