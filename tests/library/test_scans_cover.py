"""Scans over ranges, boxes in a hierarchy of cells, pointers and the writer of files, against plain Python and by their plans."""

import inspect
import random
import struct
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from orograph.operators import cover, links, meshes, spatial, stateful, terrain, tiletree
from orograph.shared import RANGE, Ranges
from orograph.sources import archives, files, texts


def events(spark, n=600, seed=1):
    """A third of all rows has one key, a third of these one time; keys and values may be null."""
    r = random.Random(seed)
    rows = [(r.choice([7, 7, 1, 2, 3, None]), float(r.choice([5, r.randint(0, 4000)])), i, r.choice([None, r.uniform(0, 20)]), r.random() < 0.05, r.choice([-1, 1])) for i in range(n)]
    return spark.createDataFrame(rows, "key int, ts double, seq long, v double, read boolean, step int"), rows


def by_key(rows):
    out = defaultdict(list)
    for row in sorted(rows, key=lambda q: (q[1], q[2])):
        out[row[0]].append(row)
    return out


def test_running_rules_equal_the_walk(spark):
    df, rows = events(spark)
    peaks = {r.seq: r.peak for r in stateful.running_peak(df, "v", reset="read").collect()}
    plain = {r.seq: r.peak for r in stateful.running_peak(df, "v").collect()}
    active = {r.seq: r.active for r in stateful.hysteresis(df, value="v").collect()}
    totals = {r.seq: (r.total, r.delta) for r in stateful.byte_counter(df.withColumn("bytes", F.col("seq") * 2)).collect()}
    flights = {(r.seq, r.loading) for r in stateful.in_flight(df).collect()}
    sessions = {r.seq: r.session for r in stateful.with_sessions(df, 60.0).collect()}
    want = set()
    for mine in by_key(rows).values():
        peak = top = None
        on, total, n, last, session = False, 0, 0, None, 0
        for _, ts, seq, v, read, step in mine:
            peak, top = (v if a is None else a if v is None else max(a, v) for a in (peak, top))
            assert (peaks[seq], plain[seq]) == (peak, top)
            if read:
                peak = None
            on = False if v is None or v < 8 else True if v >= 12 else on
            assert active[seq] == on
            total += seq * 2
            assert totals[seq] == (total, seq * 2)
            new = max(0, n + step)
            if (new > 0) != (n > 0):
                want.add((seq, new > 0))
            n = new
            session += last is not None and ts - last >= 60
            assert sessions[seq] == session
            last = ts
    assert flights == want


def test_a_hot_key_is_in_many_ranges(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("key"), F.lit(1.0).alias("ts"), F.col("id").alias("seq"))
    rows = Ranges(df, ["ts"], ["key"])
    sizes = Counter({r[RANGE]: r["count"] for r in rows.rows.where("key = -1").groupBy(RANGE).count().collect()})
    assert len(sizes) >= 3 and max(sizes.values()) < 2000
    numbers = sorted(r.k for r in rows.total(F.lit(1), "k").frame().where("key = -1").collect())
    assert numbers == list(range(1, len(numbers) + 1))
    # what remembers is not a window over a key
    source = inspect.getsource(stateful)
    assert source.count("Window.partitionBy(key)") == 1  # the last n events, which tasks cut before rows move


def test_scans_of_nothing(spark):
    df, _ = events(spark)
    none = df.limit(0)
    for found in (stateful.running_peak(none, "v", reset="read"), stateful.hysteresis(none, value="v"), stateful.in_flight(none), stateful.with_sessions(none, 1.0)):
        assert found.count() == 0
    assert Ranges(none, ["ts"]).total(F.lit(1), "k").frame().count() == 0


def test_pointers(spark):
    ways = {"line": {i: i + 1 for i in range(9)}, "ring": {i: (i + 1) % 5 for i in range(5)}, "rho": {**{i: i + 1 for i in range(12)}, 12: 6}, "end": {0: None}}
    rows = [(w, a, b) for w, m in ways.items() for a, b in m.items()]
    got = defaultdict(dict)
    starts = spark.createDataFrame([(w, 0) for w in ways], "way string, node int")
    for r in links.reached(spark.createDataFrame(rows, "way string, node int, next int"), starts, ["way"]).collect():
        got[r.way][r.node] = r.step
    assert got == {"line": {i: i for i in range(10)}, "ring": {i: i for i in range(5)}, "rho": {i: i for i in range(13)}, "end": {0: 0}}


def test_throttle_by_pointers_equals_the_walk(spark):
    df, _ = events(spark, 300, 4)
    walk = {r.seq for r in stateful.throttle(df, 150.0).collect()}
    placed = Ranges(df.select("key", "ts", "seq"), ["ts", "seq"], ["key"]).total(F.lit(1).cast("long"), "node").frame()
    kept = links.throttled(placed.select("key", "node", F.col("ts").alias("value")), 150.0)
    assert {r.seq for r in placed.join(kept, placed["key"].eqNullSafe(kept["key"]) & (placed["node"] == kept["node"])).select("seq").collect()} == walk


def test_boxes_of_all_sizes(spark):
    r = random.Random(3)

    def boxes(n):
        out = []
        for i in range(n):
            x, y, w, h = r.uniform(-500, 500), r.uniform(-500, 500), 2.0 ** r.randint(-8, 20), 2.0 ** r.randint(-8, 20)
            out.append((i, x, y, x + w, y + h))
        return [*out, (n, 0.0, 0.0, 0.0, 0.0), (n + 1, 0.0, 0.0, 1.0, 1.0), (n + 2, -1.0, -1.0, 0.0, 0.0)]

    a, b = boxes(60), boxes(50)
    schema = "id int, x0 double, y0 double, x1 double, y1 double"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    assert sorted((x.a_id, x.b_id) for x in spatial.boxes_touching(left, right, 1.0).collect()) == want
    sides = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    # a box a million cells wide is a few rows
    assert cover.with_box_cells(left, *sides, 1.0).groupBy("id").count().agg(F.max("count")).first()[0] <= 9
    ring = lambda q: [{"lon": q[1], "lat": q[2]}, {"lon": q[3], "lat": q[2]}, {"lon": q[3], "lat": q[4]}, {"lon": q[1], "lat": q[2]}]
    rings = spark.createDataFrame([(q[0], ring(q)) for q in a], "rid int, ring array<struct<lon:double,lat:double>>")
    points = [(i, r.uniform(-600, 600), r.uniform(-600, 600)) for i in range(200)]
    found = sorted((x.pid, x.rid) for x in spatial.points_in_rings(spark.createDataFrame(points, "pid int, lon double, lat double"), rings, 1.0).collect())
    inside = lambda x, y, q: q[2] <= y < q[4] and q[1] + (y - q[2]) / (q[4] - q[2]) * (q[3] - q[1]) <= x < q[3]
    assert found == sorted((i, q[0]) for i, x, y in points for q in a if inside(x, y, q))


def test_depth_first_order_of_large_orders(spark):
    orders = [999, 200000, 1000001, 1999999, 10]
    nodes = spark.createDataFrame([(0, None, 0, 0), *((i, 0, o, 1) for i, o in enumerate(orders, 1))], "node_id int, parent_id int, ord int, depth int")
    got = [r.ord for r in tiletree.dfs_order(nodes).where("depth = 1").orderBy("dfs").collect()]
    assert got == sorted(orders)


def test_users_in_parts(spark):
    rows = [("a", i) for i in range(25)] + [("b", 3), (None, 4)]
    got = {(r.texture, r.part): r.primitives for r in meshes.users_of_textures(spark.createDataFrame(rows, "texture string, primitive int"), 10).collect()}
    assert got == {("a", 0): list(range(10)), ("a", 1): list(range(10, 20)), ("a", 2): list(range(20, 25)), ("b", 0): [3], (None, 0): [4]}


def test_grid_in_tiles(spark):
    r = random.Random(9)
    width, rows = 13, 9
    values = [r.uniform(-9, 9) for _ in range(width * rows)]
    grid = spark.createDataFrame([(-74.0, 5.0, 0.1, width, values)], "west double, north double, step double, width int, values array<double>")
    points = [(r.uniform(-74.2, -72.6), r.uniform(3.9, 5.2)) for _ in range(200)] + [(-74.0, 5.0), (-73.6, 4.6)]
    got = {(x.lon, x.lat): x.geoid for x in terrain.sample_grid(spark.createDataFrame(points, "lon double, lat double"), grid, tile=4).collect()}
    for lon, lat in points:
        px, py = min(max((lon + 74.0) / 0.1, 0.0), width - 1.001), min(max((5.0 - lat) / 0.1, 0.0), rows - 1.001)
        c, w = int(px), int(py)
        u, v = px - c, py - w
        at = lambda i, j, w=w, c=c: values[(w + i) * width + c + j]
        assert got[lon, lat] == pytest.approx(at(0, 0) * (1 - u) * (1 - v) + at(0, 1) * u * (1 - v) + at(1, 0) * (1 - u) * v + at(1, 1) * u * v)
    assert terrain.sample_grid(spark.createDataFrame(points, "lon double, lat double"), grid.limit(0)).where("geoid is null").count() == len(points)


def test_files_appear_together(spark, tmp_path):
    target = f"file://{tmp_path}/tree"
    one = spark.createDataFrame([("a/x.bin", b"1"), ("b.bin", b"22")], "path string, content binary")
    files.write_files(one, target)
    read = lambda p: {str(f.relative_to(p)): f.read_bytes() for f in p.rglob("*") if f.is_file() and not f.name.startswith(".")}
    assert read(tmp_path / "tree") == {"a/x.bin": b"1", "b.bin": b"22"}
    files.write_files(one.limit(1), target)
    assert read(tmp_path / "tree") == {"a/x.bin": b"1"} and read(tmp_path / "tree.backup") == {"a/x.bin": b"1", "b.bin": b"22"}
    for bad in (one.withColumn("path", F.lit("../x")), one.withColumn("path", F.lit("same")), one.where(F.raise_error(F.lit("no")).isNull())):
        with pytest.raises(Exception):  # noqa: B017
            files.write_files(bad, target)
        assert read(tmp_path / "tree") == {"a/x.bin": b"1"}
    with pytest.raises(Exception, match="exists"):
        files.write_files(one, target, overwrite=False)
    assert not [p for p in tmp_path.iterdir() if "staging" in p.name]


def test_flat_doubles(spark, tmp_path):
    (tmp_path / "a.f64").write_bytes(b"".join(struct.pack("<3d", i, i / 2, -i) for i in range(1000)))
    files.register(spark)
    df = spark.read.format("float_triples").option("partitionbytes", "2400").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 10
    assert sorted((r.x, r.y, r.z) for r in df.collect()) == [(i, i / 2, -i) for i in map(float, range(1000))]
    (tmp_path / "b.f64").write_bytes(b"12345")
    with pytest.raises(Exception, match="whole triples"):
        spark.read.format("float_triples").load(str(tmp_path)).count()


def test_archive_filters_reach_the_directory(spark, tmp_path):
    rows = [(f"{a}.zip", f"{k}/{i}.txt", f"{a}{k}{i}".encode()) for a in "xy" for k in ("n", "g") for i in range(5)]
    archives.write_archives(spark.createDataFrame(rows, "archive string, name string, content binary"), f"file://{tmp_path}/z")
    archives.register(spark)
    df = spark.read.format("zip_entries").load(f"file://{tmp_path}/z")
    assert {(r.archive.rpartition("/")[2], r.name, bytes(r.content)) for r in df.collect()} == {tuple(r) for r in rows}
    some = df.where(F.col("name").startswith("g/") & (F.col("size") == 3))
    assert some.count() == 10
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith" not in plan.partition("Filter")[2].split("BatchScan")[0]


def test_one_large_text_file_is_many_tasks(spark, tmp_path):
    n = 20_000
    with open(tmp_path / "big.obj", "w") as f:
        for i in range(n):
            f.write(f"v {i} {i / 2} 1\n")
            if i % 1000 == 0:
                f.write(f"usemtl m{i}\n")
            f.write("f " + " ".join(str(i + k) for k in range(3 if i else 2500)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        lines = texts.read_lines(spark, str(tmp_path / "big.obj"))
        assert lines.rdd.getNumPartitions() > 5
        v = {r.vid: r.x for r in texts.obj_vertices(lines).collect()}
        assert v == {i + 1: float(i) for i in range(n)}
        f = {r.fid: (r.material, r.corners[0], len(r.corners)) for r in texts.obj_faces(lines).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert f == {i + 1: (f"m{i // 1000 * 1000}", i, 3 if i else 2500) for i in range(n)}


def test_labels_placed_in_rounds(spark):
    """Equal to marks that come one by one, on crowded views; a null view is a view of its own."""
    r = random.Random(5)
    rows = [(v, i, r.randrange(4), r.uniform(-20, 620), r.uniform(-20, 420), r.choice((0.0, 40.0, 130.0)), 600.0, 400.0) for v, n in (("a", 150), (None, 60), ("b", 12)) for i in range(n)]
    # many marks on one spot, and marks that just touch
    rows += [("c", i, 0, 300.0, 200.0, 50.0, 600.0, 400.0) for i in range(30)] + [("d", i, 0, 28.0 * i, 26.0 * (i % 3), 20.0, 600.0, 400.0) for i in range(20)]
    rows += [("e", 1, 0, None, 5.0, 10.0, 600.0, 400.0), ("e", 2, 0, 100.0, 5.0, None, 600.0, 400.0)]
    want = {}
    for view in {x[0] for x in rows}:
        standing = []
        for _, pid, _, x, y, px, w, h in sorted((x for x in rows if x[0] == view), key=lambda x: (x[2], x[1])):
            if x is None or not (0 <= x <= w and 0 <= y <= h):
                want[view, pid] = "outside"
                continue
            px = px or 0.0
            spots = [(side, a, b) for side, a, b in (("right", x + 15, x + 21 + px), ("left", x - 21 - px, x - 15)) if (b < w if side == "right" else a > 0)]
            side, *box = next((s for s in spots if not any(s[1] < b and s[2] > a and abs(y - c) < 26 for a, b, c in standing)), ("hidden",))
            standing += [(x - 13, x + 13, y)] + [(*box, y)] * bool(box)
            want[view, pid] = side
    df = spark.createDataFrame(rows, "view string, pid int, priority int, x double, y double, label_px double, view_width double, view_height double")
    got = {(m.view, m.pid): m.side for m in spatial.place_labels(df).collect()}
    assert got == want and set(want.values()) == {"right", "left", "hidden", "outside"}
    assert spatial.place_labels(df.limit(0)).count() == 0
