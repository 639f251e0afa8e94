"""ZIP and ZIP64 archives as a Spark data source: ``spark.read.format("zip_entries").load(path)`` gives ``name, method, size, content, archive`` of the
entries of an archive, or of all archives (``*.zip``) below a folder. ``write_archives`` is the way back.

The driver lists archives and opens only those that are larger than a partition, to cut their directory into ranges; it keeps no entry. Each partition
reads the directories (or the range of one) of its own archives, small ones together. Stored and deflated entries are
supported; ``.gz`` members are opened too unless ``gunzip`` is false. Entries whose name doesn't begin with the option ``prefix`` are not read, and a filter on
the name or the archive goes to the directory. The path is a local one or a URI that pyarrow's file systems open for reading by
offsets (``file:``, ``hdfs:``, ``s3:``, ``gs:``, ``abfs:``); executors open it themselves."""

import gzip
import io
import struct
import tempfile
import zlib
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringEndsWith, StringStartsWith

from orograph.sources.files import located, write_files

SCHEMA = "name string, method int, size bigint, content binary, archive string"
#: Fixed values of the format.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
TAIL = 65_557
#: Bytes of a directory that are read at once.
BLOCK = 4 << 20
#: Partitions, at least, that many small archives are dealt to.
SPREAD = 200


def opened(path: str):
    """A file that can be read at any offset."""
    system, inner = located(path)
    return system.open_input_file(inner)


def directory_range(f) -> tuple[int, int, int]:
    """Number of entries, offset and size of the directory of an open file."""
    f.seek(0, 2)
    length = f.tell()
    f.seek(max(0, length - TAIL - 20))
    tail = f.read()
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end of a ZIP directory found")
    count, size, offset = struct.unpack_from("<HII", tail, at + 10)
    if 0xFFFFFFFF in (size, offset) or count == 0xFFFF:
        loc = tail.rfind(LOCATOR64, 0, at)
        if loc < 0:
            raise ValueError("no ZIP64 locator found")
        f.seek(struct.unpack_from("<Q", tail, loc + 8)[0])
        head = f.read(56)
        if head[:4] != END64:
            raise ValueError("no ZIP64 end of directory found")
        count, size, offset = struct.unpack_from("<QQQ", head, 32)
    return count, offset, size


def entries_of(f, count: int, offset: int, size: int):
    """((name, method, packed size, size, offset of the local header), offset of what follows in the directory) of entries of a range of the directory, read
    a block at a time."""
    data, at, base, end = b"", 0, offset, offset + size
    f.seek(offset)
    for _ in range(count):
        # an entry is 46 bytes and three texts of 65535 at most
        if len(data) - at < 46 + 3 * 0xFFFF and base + len(data) < end:
            base, data, at = base + at, data[at:], 0
            data += f.read(min(BLOCK, end - base - len(data)))
        if data[at : at + 4] != ENTRY:
            raise ValueError("a broken entry in the ZIP directory")
        method, _, _, _, packed, real, n, m, k = struct.unpack_from("<HHHIIIHHH", data, at + 10)
        start = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n].decode("utf-8", "replace")
        extra, p = data[at + 46 + n : at + 46 + n + m], 0
        while p + 4 <= len(extra):
            kind, length_ = struct.unpack_from("<HH", extra, p)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{length_ // 8}Q", extra, p + 4))
                real = wide.pop(0) if real == 0xFFFFFFFF else real
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                start = wide.pop(0) if start == 0xFFFFFFFF else start
            p += 4 + length_
        at += 46 + n + m + k
        yield (name, method, packed, real, start), base + at


def directory(f) -> list[tuple[str, int, int, int, int]]:
    """(name, method, packed size, size, offset of the local header) of every entry of an open file."""
    return [e for e, _ in entries_of(f, *directory_range(f))]


def content(f, entry, gunzip: bool = True) -> bytes:
    name, method, packed, _, start = entry
    f.seek(start)
    head = f.read(30)
    if head[:4] != LOCAL:
        raise ValueError(f"no local header for {name}")
    n, m = struct.unpack_from("<HH", head, 26)
    f.seek(start + 30 + n + m)
    data = f.read(packed)
    if method == 8:
        data = zlib.decompress(data, -15)
    elif method != 0:
        raise ValueError(f"{name}: method {method} is not supported")
    return gzip.decompress(data) if gunzip and name.endswith(".gz") else data


class Entries(InputPartition):
    """Archives, each with a range of its directory (count, offset, size), or null for all of it."""

    def __init__(self, archives):
        super().__init__(0)
        self.archives = archives


#: Filters on text columns that the directory can answer.
TESTS = {EqualTo: lambda v, w: v == w, StringStartsWith: lambda v, w: v.startswith(w), StringEndsWith: lambda v, w: v.endswith(w), In: lambda v, w: v in w}


class ZipReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.gunzip = options["path"], options.get("gunzip", "true").lower() == "true"
        self.prefix, self.bytes = options.get("prefix", ""), int(options.get("partitionbytes", 64 << 20))
        self.tests = []

    def pushFilters(self, filters):
        for f in filters:
            column, test = getattr(f, "attribute", ()), TESTS.get(type(f))
            if test and column in (("name",), ("archive",)):
                self.tests.append((column[0], test, f.value))
            else:
                yield f

    def archives(self):
        """(path, bytes) in order of paths."""
        system, root = located(self.path)
        info = system.get_file_info(root)
        if info.type != fs.FileType.Directory:
            return [(self.path, info.size or 0)]
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        # paths on the same file system; a URI keeps what stands before its path
        before = self.path[: len(self.path.rstrip("/")) - len(root)] if self.path.rstrip("/").endswith(root) else ""
        return sorted((before + f.path, f.size or 0) for f in found if f.type == fs.FileType.File and f.path.endswith(".zip"))

    def wanted(self, archive, name=None):
        """By archive alone, or by an entry's name, too."""
        own = {"archive": archive, "name": name}
        return (name is None or (not name.endswith("/") and name.startswith(self.prefix))) and all(test(own[c], v) for c, test, v in self.tests if own[c] is not None)

    def cut(self, archive):
        """Ranges of a large archive's directory with wanted entries of about a partition's bytes each."""
        with opened(archive) as f:
            count, at, size_ = directory_range(f)
            n = size = some = 0
            start = at
            for e, after in entries_of(f, count, at, size_):
                packed = e[2] if self.wanted(archive, e[0]) else None
                if packed is not None and some and size + packed > self.bytes:
                    yield n, start, at - start
                    n, size, some, start = 0, 0, 0, at
                n, at = n + 1, after
                if packed is not None:
                    size, some = size + packed, some + 1
            if some:
                yield n, start, at - start

    def partitions(self):
        parts, group, size = [], [], 0
        found = [x for x in self.archives() if self.wanted(x[0])]
        # small archives share a partition, but not so that few tasks have all
        most = min(self.bytes, max(sum(b for _, b in found) // SPREAD, 1 << 16))
        for archive, bytes_ in found:
            if bytes_ > self.bytes:
                parts += [Entries([(archive, r)]) for r in self.cut(archive)]
                continue
            if group and size + bytes_ > most:
                parts.append(Entries(group))
                group, size = [], 0
            group.append((archive, None))
            size += bytes_
        return parts + [Entries(group)] if group or not parts else parts

    def read(self, partition):
        for archive, range_ in partition.archives:
            with opened(archive) as f:
                # a small archive is read at once
                source = f if range_ else io.BytesIO(f.read())
                found = [e for e, _ in entries_of(source, *(range_ or directory_range(source))) if self.wanted(archive, e[0])]
                for e in sorted(found, key=lambda e: e[4]):
                    data = content(source, e, self.gunzip)
                    yield e[0], e[1], len(data), data, archive


class ZipEntries(DataSource):
    @classmethod
    def name(cls):
        return "zip_entries"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ZipReader(self.options)


def register(spark) -> None:
    # a reader with pushFilters needs Spark's consent
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipEntries)


#: Bytes of contents that are packed at once, about.
FRAME = 4 << 20
#: Values of a field that is in the ZIP64 part instead.
WIDE, WIDE_COUNT = 0xFFFFFFFF, 0xFFFF
#: Fixed values of an entry's head: the first day that the format knows, a name in UTF-8.
DAY, UTF8 = 33, 0x800


def packed_entry(name: str, data: bytes, packed: bool = True) -> tuple[bytes, int, int, int]:
    """An entry as it stands in an archive, with its local header, and what the directory must know: checksum, packed size and size."""
    if len(data) >= WIDE:
        raise ValueError(f"{name}: an entry of 4 GB or more is not supported")
    crc, body = zlib.crc32(data), data
    if packed:
        deflate = zlib.compressobj(-1, zlib.DEFLATED, -15)
        body = deflate.compress(data) + deflate.flush()
    raw = name.encode()
    head = struct.pack("<HHHHHIIIHH", 20, UTF8, 8 if packed else 0, 0, DAY, crc, len(body), len(data), len(raw), 0)
    return LOCAL + head + raw + body, crc, len(body), len(data)


def directory_entry(name: str, crc: int, packed: int, size: int, start: int, deflated: bool) -> bytes:
    """An entry's record in the directory; places beyond 4 GB are in its ZIP64 part."""
    raw, extra = name.encode(), b"" if start < WIDE else struct.pack("<HHQ", 1, 8, start)
    fields = struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if extra else 20, UTF8, 8 if deflated else 0, 0, DAY, crc, packed, size, len(raw), len(extra), 0, 0, 0, 0x1800000, min(start, WIDE))
    return ENTRY + fields + raw + extra


def directory_end(count: int, size: int, start: int) -> bytes:
    """What stands behind a directory of so many entries and bytes."""
    last = END + struct.pack("<HHHHIIH", 0, 0, min(count, WIDE_COUNT), min(count, WIDE_COUNT), min(size, WIDE), min(start, WIDE), 0)
    if count < WIDE_COUNT and size < WIDE and start < WIDE:
        return last
    return END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, size, start) + LOCATOR64 + struct.pack("<IQI", 0, start + size, 1) + last


def write_archives(entries, folder: str, packed: bool = True, content=None, dealt: bool = False) -> None:
    """Writes entries (archive, name, content) as one ZIP each archive (a path below the folder), entries in the order of names.

    Entries are packed where they are. Only the joining of pieces to a file is one task's work; it holds a batch of them at a time, and spools the directory, which
    follows them. content: a column that makes the contents of the entries' other columns, only where an archive is joined, so that these move in their stead; for
    archives that are many. dealt: the entries of an archive are in one partition already."""

    def pack(batches):
        for batch in batches:
            archive, name, data = (batch.column(c) for c in range(3))
            at = 0
            while at < len(batch):
                found, end, size = [], at, 0
                while end < len(batch) and (end == at or size < FRAME):
                    value = data[end].as_py() or b""
                    found.append(packed_entry(name[end].as_py(), value, packed))
                    end, size = end + 1, size + len(value)
                piece, crc, small, real = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([archive.slice(at, end - at), name.slice(at, end - at), pa.array(piece, pa.binary()), *(pa.array(c, pa.int64()) for c in (crc, small, real))], ["archive", "name", "piece", "crc", "packed", "size"])
                at = end

    def sent(path, data):
        return pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([data], pa.binary())], ["path", "content"])

    def ended(path, listed, count, start):
        size = listed.tell()
        listed.seek(0)
        while data := listed.read(FRAME):
            yield sent(path, data)
        listed.close()
        yield sent(path, directory_end(count, size, start))

    def joined(batches):
        # the small pieces of a batch are one
        own = listed = None
        count = at = 0
        for batch in batches:
            for path, rows in groupby(zip(*(c.to_pylist() for c in batch.columns), strict=True), key=lambda row: row[0]):
                if listed is None or path != own:
                    if listed is not None:
                        yield from ended(own, listed, count, at)
                    own, listed, count, at = path, tempfile.SpooledTemporaryFile(FRAME), 0, 0
                pieces = []
                for _, name, piece, *known in rows:
                    listed.write(directory_entry(name, *known, at, packed))
                    pieces.append(piece)
                    count, at = count + 1, at + len(piece)
                yield sent(path, b"".join(pieces))
        if listed is not None:
            yield from ended(own, listed, count, at)

    if content is None:
        entries = entries.select("archive", "name", F.col("content").cast("binary").alias("content")).mapInArrow(pack, "archive string, name string, piece binary, crc long, packed long, size long")
    rows = (entries if dealt else entries.repartition("archive")).sortWithinPartitions("archive", "name")
    made = rows if content is None else rows.select("archive", "name", content.cast("binary").alias("content"))
    write_files(made.mapInArrow(joined if content is None else lambda batches: joined(pack(batches)), "path string, content binary"), folder, pieces=True)
