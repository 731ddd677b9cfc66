"""A data source for gzip tables of several members: ``spark.read.format("gene_table")``.

Gzip streams may follow each other in one file. A split of the file's bytes reads the members that start in it, so a
file of many members is read by many tasks; as for plain text, the first line of a split belongs to the split before it, which reads one
line beyond its end. Options: path (files, comma-separated), columns (comma-separated; else the first line names them, with ``#``
before the first name), arity (rows with another number of fields go), numbered (adds file and row, which grows with the
place in the file), splitBytes, firstSplits (only so many splits, in the order of files and places, are read). Lines that start with ``#`` are comments. There is no quoting. Filters for equality with texts, and for lists of them, are applied while reading.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

MAGIC, SPLIT, PIECE, TRIAL = b"\x1f\x8b\x08", 64 << 20, 1 << 18, 1 << 14
#: Rows of a batch that goes to Spark.
ROWS = 10_000


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def _files(paths: str) -> list[tuple[str, int]]:
    """(path, size) of the files, and of those in folders whose names do not start with a dot or an underscore."""
    from pyarrow import fs

    out = []
    for path in paths.split(","):
        system, place = _opened(path)
        info = system.get_file_info(place)
        if info.type == fs.FileType.Directory:
            found = [x for x in system.get_file_info(fs.FileSelector(place)) if x.type == fs.FileType.File and x.base_name[0] not in "._"]
            out += sorted((f"{path.rstrip('/')}/{x.base_name}", x.size) for x in found)
        else:
            out.append((path, info.size))
    return out


def _is_member(data: bytes) -> bool:
    """Whether a gzip member starts here: its header is sound and some of it can be unpacked."""
    if data[:3] != MAGIC or len(data) < 10 or data[3] & 0xE0:
        return False
    try:
        return bool(zlib.decompressobj(31).decompress(data, 64)) or len(data) < 64
    except zlib.error:
        return False


def member_from(read, start: int, size: int) -> int:
    """The first place at or after start where a member starts; size if there is none. read(at, n) gives bytes of the file."""
    at = start
    while at < size:
        data = read(at, PIECE + TRIAL)
        k = data.find(MAGIC)
        while 0 <= k < PIECE:
            if _is_member(data[k : k + TRIAL]):
                return at + k
            k = data.find(MAGIC, k + 1)
        at += PIECE
    return size


def members(read, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place of the member, some of its text), from the member that starts at ``start`` to the end of the file."""
    at = start
    while at < size:
        box, place, used = zlib.decompressobj(31), at, 0
        while not box.eof and place + used < size:
            data = read(place + used, PIECE)
            used += len(data)
            yield at, box.decompress(data)
        at = place + used - len(box.unused_data)
        if at < size and read(at, 3) != MAGIC:  # padding ends the file
            return


class _Part(InputPartition):
    def __init__(self, path: str, start: int, end: int, size: int, number: int = 0):
        self.path, self.start, self.end, self.size, self.number = path, start, end, size, number


def lines_of(read, part: _Part) -> Iterator[bytes]:
    """The lines that belong to a split: those behind the first line break of its first member, up to the one that crosses its end."""
    first = 0 if part.start == 0 else member_from(read, part.start, part.size)
    if first >= part.end:
        return
    rest, whole, last = b"", first == 0, False
    for at, text in members(read, first, part.size):
        if at >= part.end and not last:
            last = True  # one more line is this split's
            if not whole:
                return
        rest += text
        *found, rest = rest.split(b"\n")
        for line in found:
            if whole:
                yield line
                if last:
                    return
            whole = True
    if whole and rest:
        yield rest


class GeneTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gene_table"

    def schema(self) -> StructType:
        columns = self.options.get("columns")
        if columns is None:
            system, place = _opened(_files(self.options["path"])[0][0])
            with system.open_input_file(place) as f:
                read = lambda at, n: f.read_at(n, at)
                line = next(lines_of(read, _Part("", 0, f.size(), f.size())), b"")
            columns = line.decode().rstrip("\r").lstrip("#").replace("\t", ",")
        place = [StructField("file", StringType()), StructField("row", LongType())] if "numbered" in self.options else []
        return StructType([*(StructField(c, StringType()) for c in columns.split(",")), *place])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.options, self.wanted = schema.names, options, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in self.names:
                values = set(f.value) if isinstance(f, In) else {f.value}
                at = self.names.index(f.attribute[0])
                self.wanted[at] = self.wanted.get(at, values) & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        split = int(self.options.get("splitbytes", self.options.get("splitBytes", SPLIT)))
        parts = [_Part(path, at, min(at + split, size), size, at // split) for path, size in _files(self.options["path"]) for at in range(0, size, split)]
        first = self.options.get("firstsplits", self.options.get("firstSplits"))
        return parts if first is None else parts[: int(first)] or parts

    def read(self, partition: _Part) -> Iterator:
        import pyarrow as pa

        numbered, given = "numbered" in self.options, "columns" in self.options
        width = len(self.names) - 2 * numbered
        arity = int(self.options.get("arity", width))
        system, place = _opened(partition.path)

        def batch(rows: list[list[str]], first: int):
            columns = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)][:width]
            if numbered:
                columns += [pa.array([partition.path] * len(rows), pa.string()), pa.array([(partition.number << 33) + first + i for i in range(len(rows))], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, self.names)

        with system.open_input_file(place) as f:
            header, rows, sent = partition.start == 0 and not given, [], 0
            for line in lines_of(lambda at, n: f.read_at(n, at), partition):
                if header or line.startswith(b"#") or not line:
                    header = False
                    continue
                fields = line.decode(errors="replace").rstrip("\r").split("\t")
                if len(fields) == arity and all(fields[at] in values for at, values in self.wanted.items()):
                    rows.append(fields)
                    if len(rows) == ROWS:
                        yield batch(rows, sent)
                        sent, rows = sent + ROWS, []
            if rows:
                yield batch(rows, sent)


def split_count(paths: str, split_bytes: int | None = None) -> int:
    return sum(-(-size // (split_bytes or SPLIT)) for _, size in _files(paths))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeneTable)
