"""A binary write-ahead log: framing with checksums, replay, and a Spark data source.

A frame is 0xFF, the body's length and CRC-32 (both 32-bit, little-endian) and the body:
opcode, id, clock, the vector's length and values, and metadata as length-prefixed UTF-8.
Replay ends at the first frame that is cut short or fails its checksum.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

INSERT, DELETE = 3, 4
SCHEMA = "clock long, op string, id long, vector array<double>, metadata map<string,string>"


@dataclass(frozen=True)
class Entry:
    clock: int
    op: str
    id: int
    vector: tuple[float, ...] = ()
    metadata: dict[str, str] = field(default_factory=dict)


def encode(e: Entry) -> bytes:
    body = struct.pack("<BIQI", INSERT if e.op == "insert" else DELETE, e.id, e.clock, len(e.vector)) + struct.pack(f"<{len(e.vector)}d", *e.vector)
    body += struct.pack("<I", len(e.metadata))
    for k, v in sorted(e.metadata.items()):
        for s in (k.encode(), v.encode()):
            body += struct.pack("<I", len(s)) + s
    return struct.pack("<BII", 0xFF, len(body), zlib.crc32(body)) + body


def replay(data: bytes) -> Iterator[Entry]:
    return replay_stream(io.BytesIO(data).read)


def replay_stream(read: Callable[[int], bytes]) -> Iterator[Entry]:
    """Entries of a stream, frame by frame; ``read(n)`` gives n bytes, or fewer at the end."""
    while len(head := read(9)) == 9:
        mark, size, crc = struct.unpack("<BII", head)
        if mark != 0xFF:
            return
        body = read(size)
        if len(body) != size or zlib.crc32(body) != crc:
            return
        opcode, id_, clock, n = struct.unpack_from("<BIQI", body, 0)
        p = 17
        vector = struct.unpack_from(f"<{n}d", body, p)
        p += 8 * n
        (pairs,) = struct.unpack_from("<I", body, p)
        p += 4
        strings = []
        for _ in range(2 * pairs):
            (length,) = struct.unpack_from("<I", body, p)
            strings.append(body[p + 4 : p + 4 + length].decode())
            p += 4 + length
        yield Entry(clock, "insert" if opcode == INSERT else "delete", id_, vector, dict(zip(strings[::2], strings[1::2], strict=True)))


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow.fs import FileSystem

        fs, path = FileSystem.from_uri(partition.value)
        with fs.open_input_stream(path) as stream:
            for e in replay_stream(stream.read):
                yield e.clock, e.op, e.id, list(e.vector), e.metadata


class WalSource(DataSource):
    """``spark.read.format("lumenspar_wal").option("paths", "uri,uri")``: one task a segment."""

    @classmethod
    def name(cls) -> str:
        return "lumenspar_wal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader([p for p in self.options["paths"].split(",") if p])


def write_segments(rows: DataFrame, folder: str) -> list[str]:
    """Writes rows(clock, op, id, vector, metadata) as one segment a task; the URIs of the segments.

    A task that runs again writes a file of another name, and only the names that
    successful tasks report are segments of the log.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, path = FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name, n = f"{uuid.uuid4().hex}.wal", 0
        with fs.open_output_stream(f"{path}/{name}") as out:
            for batch in batches:
                for r in batch.to_pylist():
                    out.write(encode(Entry(r["clock"], r["op"], r["id"], tuple(r["vector"] or ()), dict(r["metadata"] or ()))))
                    n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["uri"])

    return sorted(r.uri for r in rows.select("clock", "op", "id", "vector", "metadata").mapInArrow(run, "uri string").collect())


def read(spark: SparkSession, segments: list[str]) -> DataFrame:
    """The entries of some segments, each read by one task."""
    spark.dataSource.register(WalSource)
    return spark.read.format("lumenspar_wal").option("paths", ",".join(segments)).load()
