"""S1 for Arrow IPC dataset folders: a Python data source that splits shards by record batch.

Datasets saved by Arrow-based tools are folders of ``*.arrow`` files, IPC streams or
IPC files.  Planning lists the folder and reads only message headers (streams) or
footers (files), by range; a partition is a run of record batches of one shard of
about ``split_bytes``, and its task reads those bytes alone.  Paths are plain or any
URI the Arrow file systems know (``file://``, ``hdfs://``, ``s3://``, ``gs://``), opened where
the work is: nothing has to be mounted.

``spark.read.format("arrow_shards").load(uri)`` takes the schema from the first shard;
with ``.schema(...)`` only those columns are kept, cast to the types asked for; columns a
shard doesn't have are null.  Shards whose batches need dictionaries are read whole.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_schema
from pyspark.sql.types import StructField, StructType

SPLIT_BYTES = 64 << 20
_MAGIC = b"ARROW1"


@dataclass
class Batches(InputPartition):
    """Record batches of one shard: ``places`` are (offset, length) in a stream, numbers in a file; none: the whole shard."""

    path: str
    kind: str
    places: tuple


def _open(uri: str):
    """A file system and the path in it."""
    return arrow_fs.FileSystem.from_uri(uri) if "://" in uri else (arrow_fs.LocalFileSystem(), uri)


def shards_of(uri: str) -> list[str]:
    """The ``*.arrow`` files of a folder, or the file itself, as URIs of the same kind."""
    files, path = _open(uri)
    found = files.get_file_info(path)
    if found.type == arrow_fs.FileType.File:
        return [uri]
    inside = files.get_file_info(arrow_fs.FileSelector(path))
    names = sorted(f.base_name for f in inside if f.is_file and f.extension == "arrow")
    return [f"{uri.rstrip('/')}/{name}" for name in names]


def _body_length(message: bytes) -> tuple[int, int]:
    """Header type and body length of a message: fields 1 and 3 of its root table."""
    table = struct.unpack_from("<I", message)[0]
    fields = table - struct.unpack_from("<i", message, table)[0]
    size = struct.unpack_from("<H", message, fields)[0]

    def field(number: int, kind: str) -> int:
        slot = 4 + 2 * number
        at = struct.unpack_from("<H", message, fields + slot)[0] if slot < size else 0
        return struct.unpack_from(kind, message, table + at)[0] if at else 0

    return field(1, "<B"), field(3, "<q")


def stream_batches(source) -> tuple[list[tuple[int, int]], bool]:
    """Places of a stream's record batches, and whether dictionaries come between; reads headers alone."""
    places, dictionaries, at, end = [], False, 0, source.size()
    while at + 8 <= end:
        source.seek(at)
        head, size = struct.unpack("<iI", source.read(8))
        start = 8
        if head != -1:  # before the continuation mark was introduced
            size, start = head, 4
        if size == 0:
            break
        source.seek(at + start)
        kind, body = _body_length(source.read(size))
        length = start + size + body
        dictionaries |= kind == 2
        if kind == 3:
            places.append((at, length))
        at += length
    return places, dictionaries


def partitions_of(path: str, split_bytes: int) -> list[Batches]:
    files, inside = _open(path)
    with files.open_input_file(inside) as source:
        magic = source.read(len(_MAGIC))
        source.seek(0)
        if magic == _MAGIC:
            n = pa.ipc.open_file(source).num_record_batches
            share = max(1, -(-n * split_bytes // max(1, source.size()))) if n else 1
            return [Batches(path, "file", tuple(range(a, min(a + share, n)))) for a in range(0, n, share)]
        places, dictionaries = stream_batches(source)
    if dictionaries:
        return [Batches(path, "stream", ())]
    out, run, size = [], [], 0
    for place in places:
        if run and size + place[1] > split_bytes:
            out.append(Batches(path, "stream", tuple(run)))
            run, size = [], 0
        run.append(place)
        size += place[1]
    return out + ([Batches(path, "stream", tuple(run))] if run else [])


def schema_of(path: str) -> pa.Schema:
    files, inside = _open(path)
    with files.open_input_file(inside) as source:
        magic = source.read(len(_MAGIC))
        source.seek(0)
        return pa.ipc.open_file(source).schema if magic == _MAGIC else pa.ipc.open_stream(source).schema


def _plain(kind: pa.DataType) -> pa.DataType:
    return kind.value_type if pa.types.is_dictionary(kind) else kind


class ArrowShardReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes
        self.target = to_arrow_schema(schema)

    def partitions(self):
        return [part for shard in shards_of(self.path) for part in partitions_of(shard, self.split_bytes)]

    def read(self, partition):
        files, inside = _open(partition.path)
        with files.open_input_file(inside) as source:
            for batch in self._batches(source, partition):
                yield self._fitted(batch)

    def _batches(self, source, partition):
        if partition.kind == "file":
            reader = pa.ipc.open_file(source)
            for i in partition.places:
                yield reader.get_batch(i)
        elif not partition.places:
            yield from pa.ipc.open_stream(source)
        else:
            schema = pa.ipc.open_stream(source).schema
            for offset, length in partition.places:
                source.seek(offset)
                yield pa.ipc.read_record_batch(pa.ipc.read_message(source.read(length)), schema)

    def _fitted(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The columns asked for, in their order and types."""
        columns = []
        for field in self.target:
            at = batch.schema.get_field_index(field.name)
            columns.append(batch.column(at).cast(field.type) if at >= 0 else pa.nulls(batch.num_rows, field.type))
        return pa.RecordBatch.from_arrays(columns, schema=self.target)


class ArrowShardSource(DataSource):
    """``spark.read.format("arrow_shards")``; options: ``path``, ``split_bytes``."""

    @classmethod
    def name(cls):
        return "arrow_shards"

    def schema(self):
        shards = shards_of(self.options["path"])
        if not shards:
            raise ValueError(f"no *.arrow files in {self.options['path']}")
        return StructType([StructField(f.name, from_arrow_type(_plain(f.type))) for f in schema_of(shards[0])])

    def reader(self, schema):
        return ArrowShardReader(self.options["path"], schema, int(self.options.get("split_bytes", SPLIT_BYTES)))


def register(spark) -> None:
    spark.dataSource.register(ArrowShardSource)
