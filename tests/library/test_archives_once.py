"""Contents of archives stand on the disk once: as archives."""

import os
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from orograph import shared
from orograph.sources import archives

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("late", [True, False])
def test_archives_are_written_without_a_copy(spark, tmp_path, monkeypatch, late):
    monkeypatch.setattr(shared, "settled", lambda df: pytest.fail("contents were written before"))
    monkeypatch.setattr(archives, "FRAME", 300)
    rows = spark.range(4000).select(F.concat(F.col("id") % 7, F.lit(".zip")).alias("archive"), F.concat(F.lit("e/"), "id").alias("name"), "id")
    content = F.repeat(F.col("id").cast("string"), 20).cast("binary")
    if late:
        archives.write_archives(rows.repartition(3, "archive"), str(tmp_path / "z"), content=content, dealt=True)
    else:
        archives.write_archives(rows.withColumn("content", content), str(tmp_path / "z"), packed=False)
    for a in range(7):
        with zipfile.ZipFile(tmp_path / "z" / f"{a}.zip") as z:
            assert z.testzip() is None and z.namelist() == sorted(f"e/{i}" for i in range(a, 4000, 7))
            assert all(z.read(f"e/{i}") == str(i).encode() * 20 for i in range(a, 4000, 7))
    archives.register(spark)
    assert spark.read.format("zip_entries").load(str(tmp_path / "z")).where(F.col("content") == F.repeat(F.substring("name", 3, 9), 20).cast("binary")).count() == 4000


def size(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(folder) for f in names)


@pytest.mark.parametrize("name,most", [("src13_glb_meshes", 600), ("src08_geometry", 250)])
def test_a_tile_takes_little_disk(spark, name, most):
    """And equals the SQL."""
    root = shared.shared_root(spark).removeprefix("file://")
    before = size(root)
    out = entry.queries()[name](spark, SMALL)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{SMALL}/lineitem.parquet')")
    found = con.execute(entry.oracle_sql()[name])
    at = [[c[0] for c in found.description].index(c) for c in out.columns]
    want = sorted(tuple(r[i] for i in at) for r in found.fetchall())
    assert sorted(tuple(r) for r in out.collect()) == want
    assert (size(root) - before) / len({r[0] for r in want}) < most
