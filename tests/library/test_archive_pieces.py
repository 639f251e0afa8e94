"""Archives and files are written a piece at a time."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from orograph.sources import archives, files


@pytest.mark.parametrize("packed", [True, False])
def test_archives_of_pieces(spark, tmp_path, monkeypatch, packed):
    monkeypatch.setattr(zipfile, "ZipFile", lambda *a, **k: pytest.fail("an archive was built whole"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(f"{a}.zip", f"e/{i}é.txt", f"{a} {i} ".encode() * (i % 50)) for a in ("x", "d/y") for i in range(300)] + [("z.zip", "n", None)]
        archives.write_archives(spark.createDataFrame(rows, "archive string, name string, content binary"), str(tmp_path / "out"), packed)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    monkeypatch.undo()
    for a in ("x", "d/y", "z"):
        with zipfile.ZipFile(tmp_path / "out" / f"{a}.zip") as z:
            assert z.testzip() is None
            want = {n: b or b"" for x, n, b in rows if x == f"{a}.zip"}
            assert {n: z.read(n) for n in z.namelist()} == want and z.namelist() == sorted(want) and len(z.infolist()) == len(want)


def test_ends_of_large_directories():
    piece, crc, small, size = archives.packed_entry("a", b"hello")
    far = archives.directory_entry("a", crc, small, size, 5 << 32, True)
    assert len(far) == 46 + 1 + 12
    ((found, _),) = archives.entries_of(io.BytesIO(far), 1, 0, len(far))
    assert found == ("a", 8, small, 5, 5 << 32)
    end = archives.directory_end(70_000, 0, 0)
    assert archives.directory_range(io.BytesIO(end)) == (70_000, 0, 0)
    body = piece + archives.directory_entry("a", crc, small, size, 0, True)
    with zipfile.ZipFile(io.BytesIO(body + archives.directory_end(1, len(body) - len(piece), len(piece)))) as z:
        assert z.read("a") == b"hello"


def test_files_are_sent_in_small_batches(spark, tmp_path, monkeypatch):
    before, seen, enter = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"), [], files.small_batches
    monkeypatch.setattr(files, "small_batches", lambda s: seen.append(1) or enter(s))
    rows = spark.range(30).select(F.concat(F.col("id").cast("string"), F.lit(".bin")).alias("path"), F.lit(b"abc").alias("content"))
    files.write_files(rows, str(tmp_path / "f"))
    assert seen and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before and len(list((tmp_path / "f").iterdir())) == 30
    with pytest.raises(Exception):
        files.write_files(rows.union(rows).coalesce(1), str(tmp_path / "g"))
