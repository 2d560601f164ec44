"""Lines of zip archives as a Spark data source: archives are read by members and parts of members, and none is held whole.

    spark.dataSource.register(ZippedLines)
    spark.read.format("zipped_lines").option("part", 64 << 20).load(path)

gives (path, member, part, line_no, line).  A stored member is cut into parts of `part` bytes, each read by a task of its own, which seeks
to it; line_no counts from the part's beginning.  A deflated member can only be inflated from its beginning, so it is one
part, streamed.  `members` is a pattern that members' names must fit ("*" by default).
"""

from __future__ import annotations

import fnmatch
import io
import struct
import zipfile
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparkwell import ship

ship(__name__)

PART = 64 << 20
STEP = 1 << 20


def opened(path: str):
    """A file of any store that the workers know, as a seekable file."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        store, name = fs.FileSystem.from_uri(path)
    else:
        store, name = fs.LocalFileSystem(), path
    return store.open_input_file(name)


def listed(path: str) -> list[str]:
    """The path itself, or the zip files of a folder."""
    from pyarrow import fs

    uri = "://" in path or path.startswith("file:")
    store, name = fs.FileSystem.from_uri(path) if uri else (fs.LocalFileSystem(), path)
    info = store.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    return sorted(f"{path.rstrip('/')}/{x.base_name}" for x in store.get_file_info(fs.FileSelector(name)) if x.base_name.endswith(".zip"))


@dataclass
class Piece(InputPartition):
    """Bytes [begin, end) of a member whose content starts at `data` of the file."""

    path: str
    member: str
    part: int
    data: int
    packed: bool
    begin: int
    end: int
    size: int


def pieces(path: str, members: str, part: int) -> list[Piece]:
    """What the tasks read: only the archive's directory and the members' headers are looked at."""
    out = []
    with opened(path) as f, zipfile.ZipFile(f) as z:
        for info in z.infolist():
            if info.is_dir() or not fnmatch.fnmatchcase(info.filename, members):
                continue
            if info.flag_bits & 1:
                raise ValueError(f"{path}: {info.filename} is encrypted")
            packed = info.compress_type != zipfile.ZIP_STORED
            f.seek(info.header_offset)
            name, extra = struct.unpack("<HH", f.read(30)[26:30])
            data = info.header_offset + 30 + name + extra
            step = info.file_size if packed else part
            for n, at in enumerate(range(0, max(info.file_size, 1), max(step, 1))):
                out.append(Piece(path, info.filename, n, data, packed, at, min(at + step, info.file_size) if not packed else info.file_size, info.file_size))
    return out


class Slice(io.RawIOBase):
    """Bytes [begin, end) of a file."""

    def __init__(self, file, begin: int, end: int):
        self.file, self.left = file, end - begin
        file.seek(begin)

    def readable(self):
        return True

    def readinto(self, into):
        got = self.file.read(min(len(into), self.left))
        into[: len(got)] = got
        self.left -= len(got)
        return len(got)


def lines(piece: Piece):
    """The lines that begin in a piece, the last of which may end beyond it."""
    with opened(piece.path) as f:
        if piece.packed:
            with zipfile.ZipFile(f) as z, z.open(piece.member) as m:
                yield from (line.rstrip(b"\n") for line in m)
            return
        # one byte before, to see whether a line begins here
        begin = max(piece.begin - 1, 0)
        stream = io.BufferedReader(Slice(f, piece.data + begin, piece.data + piece.size), STEP)
        at = begin
        if piece.begin:
            at += len(stream.readline())
        while at < piece.end:
            line = stream.readline()
            if not line:
                return
            at += len(line)
            yield line.rstrip(b"\n")


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.members, self.part = options["path"], options.get("members", "*"), int(options.get("part", PART))

    def partitions(self):
        return [p for path in listed(self.path) for p in pieces(path, self.members, self.part)]

    def read(self, partition):
        import pyarrow as pa

        def batch(held, first):
            n = len(held)
            named = [pa.array([x] * n, pa.string()) for x in (partition.path, partition.member)]
            text = pa.array([x.decode("utf-8", "replace").removesuffix("\r") for x in held], pa.string())
            return pa.RecordBatch.from_arrays([*named, pa.array([partition.part] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()), text], ["path", "member", "part", "line_no", "line"])

        held, size, first = [], 0, 1
        for line in lines(partition):
            held.append(line)
            size += len(line)
            if len(held) == 5000 or size > 8 * STEP:
                yield batch(held, first)
                held, size, first = [], 0, first + len(held)
        if held:
            yield batch(held, first)


class ZippedLines(DataSource):
    @classmethod
    def name(cls):
        return "zipped_lines"

    def schema(self):
        return "path string, member string, part int, line_no long, line string"

    def reader(self, schema):
        return Reader(dict(self.options))
