"""Files as rows, in both directions.

``df.write.format("file_rows").mode("overwrite").save(folder)`` writes a file for each row (``path`` below the folder, ``content`` binary) in two
phases: tasks write below a folder of their own beside the target, a retried task writes over what it left, and only when all have succeeded does the
driver rename that folder to the target. So a tree's files appear together or not at all; what stood there before is kept as ``<folder>.backup``
(one, the last). If a task fails for good, the target stays as it was. Without overwrite the target must not exist. Reading is Spark's ``binaryFile``.

Rows of a path may also be the pieces of its file (option ``pieces``), in its order and one after the other in a partition.

``spark.read.format("float_triples").load(path)`` reads files of flat little-endian doubles, three to a row (``x, y, z``), in partitions of bounded size.

Paths are local ones or URIs that pyarrow's file systems open; executors open them themselves."""

import os
import uuid
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from orograph.shared import small_batches


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path on it."""
    if path.startswith("file:"):  # file:/a, file:///a
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    files: int


class FileRowsWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, pieces: bool = False):
        self.path, self.overwrite, self.pieces = path.rstrip("/"), overwrite, pieces
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"

    def write(self, iterator):
        from pyspark import TaskContext

        system, root = located(self.staging)
        attempt, n = TaskContext.get().taskAttemptId(), 0
        # rows of one path that follow each other are pieces of its file
        for name, pieces in groupby(iterator, key=lambda row: row["path"]):
            if name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"{name} is not a path below the folder")
            target = f"{root}/{name}"
            system.create_dir(target.rpartition("/")[0], recursive=True)
            # a file has its name only when it is whole
            with system.open_output_stream(f"{target}.{attempt}") as f:
                for k, row in enumerate(pieces):
                    if k and not self.pieces:
                        raise ValueError(f"two rows have the path {name}")
                    f.write(bytes(row["content"]))
            system.move(f"{target}.{attempt}", target)
            n += 1
        return Written(n)

    def commit(self, messages):
        system, root = located(self.staging)
        target = located(self.path)[1]
        system.create_dir(root, recursive=True)
        made = sum(i.type == fs.FileType.File for i in system.get_file_info(fs.FileSelector(root, recursive=True)))
        if made != sum(m.files for m in messages if m):
            self.abort(messages)
            raise ValueError("two rows have the same path")
        if system.get_file_info(target).type != fs.FileType.NotFound:
            if not self.overwrite:
                self.abort(messages)
                raise ValueError(f"{self.path} exists")
            backup = f"{target}.backup"
            if system.get_file_info(backup).type != fs.FileType.NotFound:
                system.delete_dir(backup)
            system.move(target, backup)
        system.move(root, target)

    def abort(self, messages):
        system, root = located(self.staging)
        if system.get_file_info(root).type != fs.FileType.NotFound:
            system.delete_dir(root)


class FileRows(DataSource):
    @classmethod
    def name(cls):
        return "file_rows"

    def schema(self):
        return "path string, content binary"

    def writer(self, schema, overwrite):
        return FileRowsWriter(self.options["path"], overwrite, self.options.get("pieces", "false").lower() == "true")


@dataclass
class Part(InputPartition):
    path: str
    start: int
    stop: int


class TriplesReader(DataSourceReader):
    #: Bytes of a row.
    WIDTH = 24

    def __init__(self, options):
        self.path = options["path"]
        self.step = max(1, int(options.get("partitionbytes", 64 << 20)) // self.WIDTH) * self.WIDTH

    def partitions(self):
        system, root = located(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        parts = []
        for f in sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path):
            if f.size % self.WIDTH:
                raise ValueError(f"{f.path} has {f.size} bytes, which aren't whole triples")
            parts += [Part(f.path, at, min(f.size, at + self.step)) for at in range(0, f.size, self.step)]
        return parts

    def read(self, partition):
        system = located(self.path)[0]
        with system.open_input_file(partition.path) as f:
            f.seek(partition.start)
            left = partition.stop - partition.start
            while left > 0:
                data = f.read(min(left, self.WIDTH << 15))
                left -= len(data)
                values = np.frombuffer(data, "<f8").reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(values)), *(pa.array(np.ascontiguousarray(c)) for c in values.T)], ["file", "x", "y", "z"])


class FloatTriples(DataSource):
    @classmethod
    def name(cls):
        return "float_triples"

    def schema(self):
        return "file string, x double, y double, z double"

    def reader(self, schema):
        return TriplesReader(self.options)


def register(spark) -> None:
    for source in (FileRows, FloatTriples):
        spark.dataSource.register(source)


def write_files(rows, folder: str, overwrite: bool = True, pieces: bool = False) -> None:
    """Writes rows (path, content) below a folder, all or none. pieces: rows of a path are in one partition and follow each other; together they are its file, of which a
    task holds a batch at a time."""
    register(rows.sparkSession)
    with small_batches(rows.sparkSession):
        rows.select("path", "content").write.format("file_rows").option("pieces", str(pieces).lower()).mode("overwrite" if overwrite else "append").save(folder)
