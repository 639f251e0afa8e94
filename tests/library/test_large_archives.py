"""What the driver and a task hold of archives and grids doesn't grow with them."""

import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import StringEndsWith

from orograph.operators import terrain
from orograph.sources import archives


@pytest.fixture
def many(tmp_path):
    for a in range(40):
        with zipfile.ZipFile(tmp_path / f"a{a:02}.zip", "w") as z:
            for i in range(30):
                z.writestr(f"e/{i}.{'txt' if i % 2 else 'bin'}", f"{a} {i}".encode())
            z.writestr("d/", b"")
    return tmp_path


def test_small_archives_are_read_together_and_not_by_the_driver(spark, many, monkeypatch):
    reader = archives.ZipReader({"path": str(many)})
    monkeypatch.setattr(archives, "opened", lambda path: pytest.fail("the driver opened an archive"))
    parts = reader.partitions()
    assert len(parts) <= 4 and sum(len(p.archives) for p in parts) == 40
    monkeypatch.undo()
    archives.register(spark)
    df = spark.read.format("zip_entries").load(str(many))
    assert {(r.archive[-7:], r.name, bytes(r.content)) for r in df.collect()} == {(f"a{a:02}.zip", f"e/{i}.{'txt' if i % 2 else 'bin'}", f"{a} {i}".encode()) for a in range(40) for i in range(30)}
    assert df.where(F.col("archive").endswith("a07.zip") & F.col("name").endswith(".txt")).count() == 15


def test_large_archives_are_cut_by_ranges_of_their_directory(many, monkeypatch):
    monkeypatch.setattr(archives, "BLOCK", 100)
    reader = archives.ZipReader({"path": str(many / "a03.zip"), "partitionbytes": "20", "prefix": "e/"})
    assert list(reader.pushFilters([StringEndsWith(("name",), ".txt")])) == []
    parts = reader.partitions()
    assert 2 < len(parts) <= 16 and not any(hasattr(p, "entries") for p in parts)
    got = [r[0] for p in parts for r in reader.read(p)]
    assert sorted(got) == sorted(f"e/{i}.txt" for i in range(1, 30, 2))
    assert archives.ZipReader({"path": str(many / "a03.zip"), "partitionbytes": "20", "prefix": "x"}).partitions()[0].archives == []


@pytest.mark.parametrize("width,n,tile", [(5, 33, 2), (4, 17, 4), (9, 81, 4), (1, 3, 2), (40, 450, 16), (3, 3, 8)])
def test_tiles_of_values_are_those_of_the_whole_grid(spark, width, n, tile):
    rows = n // width
    values = spark.range(n).select(F.col("id").alias("index"), F.when(F.col("id") % 7 != 3, F.col("id") * 1.5).alias("value"))
    got = {(r.tx, r.ty): r.heights for r in terrain.tiles_of_values(values, width, rows, tile).collect()}
    v = [None if i % 7 == 3 else i * 1.5 for i in range(rows * width)]
    grid = spark.createDataFrame([(0.0, 0.0, 1.0, width, v)], "west double, north double, step double, width int, values array<double>")
    assert got == {(r.tx, r.ty): r.heights for r in terrain.tiled_grid(grid, tile).collect()}


def test_a_grid_without_a_whole_row_gives_nulls(spark):
    points = spark.createDataFrame([(0.5, -0.5)], "lon double, lat double")
    values = spark.range(3).select(F.col("id").alias("index"), F.lit(1.0).alias("value"))
    assert terrain.sample_values(points, values, 0.0, 0.0, 1.0, 4).first().geoid is None


def test_vertices_of_small_buffers_leave_in_few_frames(monkeypatch):
    import numpy as np
    import pandas as pd

    from orograph.sources import binaries

    class Rows:
        def select(self, *names):
            return self

        def mapInPandas(self, run, schema):
            made = [binaries.geometry_of([[i, j, 0.0] for j in range(i % 3)], [[0.0, j] for j in range(i % 3)]) for i in range(300)]
            return list(run([pd.DataFrame({"name": [f"t{i}" for i in range(300)], "content": made})]))

    (one,) = binaries.vertices(Rows())
    assert list(one.columns) == ["tile", "vid", "x", "y", "z", "u", "v"]
    assert [tuple(r) for r in one[["tile", "vid", "x", "y", "v"]].itertuples(index=False)] == [(f"t{i}", j, float(i), float(j), float(j)) for i in range(300) for j in range(i % 3)]
    monkeypatch.setattr(binaries, "FRAME", 10)
    assert 25 < len(binaries.vertices(Rows())) < 35 and np.array_equal(pd.concat(binaries.vertices(Rows())).to_numpy(), one.to_numpy())
