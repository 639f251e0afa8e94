"""Scratch tables in the folder that driver and executors share, and the size of what goes to Python at a time."""

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .words import trim

CHECKPOINTS = "spark.checkpoint.dir"
ARROW = "spark.sql.execution.arrow"
#: Narrow rows that one task writes.
TASK_ROWS = 50_000


def scratch_dir(spark: SparkSession, what: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Where that is unset, a local master gets a temp folder; a cluster gets an error, as no other
    folder is known to be shared."""
    root = spark.conf.get(CHECKPOINTS, None)
    if not root:
        master = spark.sparkContext.master
        alone = master.startswith("local") and not master.startswith("local-cluster")
        if not alone:
            raise RuntimeError(f"set {CHECKPOINTS} to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="orograph-")
        spark.conf.set(CHECKPOINTS, root)
    return f"{root}/{what}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20):
    """Texts are long: jobs within pass at most so many rows and about so many bytes at a time to Python. The session's own limits are
    back afterwards."""
    limits = {f"{ARROW}.maxRecordsPerBatch": rows, f"{ARROW}.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialise(df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage is cut, and a lost executor loses nothing. rows: about how many there are at most, where
    that is known; a small table then is a few files and tasks, of ``TASK_ROWS`` each, and not as many as shuffles have partitions."""
    spark = df.sparkSession
    path = scratch_dir(spark, what)
    if rows is not None and (tasks := max(1, -(-rows // TASK_ROWS))) < int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(tasks)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_names(columns: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that none of columns has, upper or lower case."""
    used = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def with_verdicts(rows: DataFrame, table: DataFrame, key: str, size: str) -> DataFrame:
    """rows with the columns of a table that has one row for each value of ``key`` and tells in ``size`` how many rows have that value.

    Values that more than a 1024th of all rows have are fewer than 1024, so these rows of the table are broadcast and a hot value's
    rows don't move; the others meet by a shuffle."""
    often = F.col(size) * 1024 > (table.agg(F.sum(size)).first()[0] or 0)
    hot = F.broadcast(table.where(often))
    rest = rows.join(hot.select(key), key, "left_anti").join(table.where(~often), key)
    return rows.join(hot, key).unionByName(rest)


def each(column: pa.Array, step: int = 256):
    """The values of a column, ``step`` at a time as Python objects: a batch of texts isn't held twice."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()
    trim()


@F.arrow_udf(BinaryType())
def packed(text: pa.Array) -> pa.Array:
    """Texts as zstd blocks behind their size in 8 bytes, about half as large on their way through a shuffle; null stays null."""
    codec = pa.Codec("zstd", 1)
    return pa.array([None if x is None else len(x).to_bytes(8, "little") + codec.compress(x, asbytes=True) for x in each(text.cast(pa.binary()))], pa.binary())


def size_of(value: bytes | None) -> int:
    return int.from_bytes(value[:8], "little") if value else 0


def unpacked(value: bytes | None) -> bytes:
    return pa.Codec("zstd").decompress(value[8:], size_of(value), asbytes=True) if value else b""
