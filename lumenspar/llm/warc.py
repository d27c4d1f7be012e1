"""WARC archives: a writer task by task and a sequential reader.

An archive holds one gzip member per record. The reader feeds bytes to zlib as they
come, ends a member where zlib does, frames the record by its Content-Length and checks
payload and block digests. Archives live in a folder that driver and executors share;
files are reached with ``pyarrow.fs`` by the folder's own scheme.

Defined results: a null payload is an empty one; of equal payloads the record with the
smallest id is a response, also where rows repeat that id, and the others are revisits;
null ids rank last, and if all are null all are responses; a null url leaves out the
target; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspar.work import materialize, work_path

#: An archive closes at the first record end beyond so many compressed bytes.
ARCHIVE_BYTES = 1_000_000_000
CHUNK = 1 << 18
DATE = "1970-01-01T00:00:00Z"
_ID = "<urn:x-row:{}>"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compression of the members: 4 takes half the time of 6 for a few per cent more bytes.
LEVEL = 4


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    """A header value without control characters or line ends."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def member(record_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool, date: str = DATE) -> bytes:
    """A record as a gzip member. A revisit carries the HTTP header and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _ID.format("" if record_id is None else record_id)),
        ("WARC-Date", date),
        *([("WARC-Target-URI", _clean(url))] if url is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("WARC-Block-Digest", "sha1:" + digest(block)),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", _ID.format("" if refers_to is None else refers_to))] if revisit else []),
        ("Content-Length", str(len(block))),
    ]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    parts = [z.compress(("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()), z.compress(block), z.compress(b"\r\n\r\n"), z.flush()]
    return b"".join(parts)


def members(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The uncompressed members of a stream, one at a time, read in chunks."""
    data = read(CHUNK)
    while data:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not data:
                raise ValueError("the archive ends within a record")
            parts.append(z.decompress(data))
            data = z.unused_data if z.eof else read(CHUNK)
        yield b"".join(parts)
        data = data or read(CHUNK)


def parse(record: bytes) -> dict[str, Any]:
    """Fields of a record by lower-case name, its block and payload; checks framing and digests."""
    end = record.find(b"\r\n\r\n")
    lines = record[: max(end, 0)].decode("utf-8", "replace").split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    block = record[end + 4 : end + 4 + size]
    if len(block) != size or record[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError("the record is not as long as its Content-Length says")
    head, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    stated = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    n = int(stated["content-length"]) if "content-length" in stated else len(payload)
    ok = fields.get("warc-block-digest", "sha1:" + digest(block)) == "sha1:" + digest(block)
    if not revisit:
        ok = ok and n == len(payload) and fields.get("warc-payload-digest", "sha1:" + digest(payload)) == "sha1:" + digest(payload)
    return {"fields": fields, "payload": None if revisit else payload, "payload_bytes": n, "ok": ok}


def _filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


def _write(folder: str, archive_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        out, name, n, size, serial = None, "", 0, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["archive", "records", "bytes"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("record_id", "url", "payload", "refers_to", "revisit")), strict=True):
                if out is None:
                    # a name of its own for every attempt: only files in the manifest are read
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{serial}.warc.gz"
                    out, n, size, serial = fs.open_output_stream(f"{base}/{name}", compression=None), 0, 0, serial + 1
                data = member(row[0], row[1], row[2], row[3], row[4])
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write_warc(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``records(record_id, url, payload, refers_to, revisit)``; returns the manifest.

    Each task writes its own archives. The manifest is a table in the same folder and
    lists what finished tasks wrote, so files of lost or repeated attempts are not read.
    """
    wanted = records.select("record_id", "url", "payload", "refers_to", "revisit")
    manifest = wanted.mapInArrow(_write(folder, archive_bytes), "archive string, records long, bytes long")
    manifest.write.parquet(f"{folder}/manifest")
    return records.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")


RECORD = "record_id string, record_type string, url string, date string, payload_bytes long, payload_digest string, refers_to string, digest_ok boolean, archive string"


def _read(folder: str, with_payload: bool) -> Callable:
    def name(value: str | None) -> str | None:
        return (value[len("<urn:x-row:") : -1] or None) if value else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                rows: list[tuple] = []
                held = 0
                with fs.open_input_stream(f"{base}/{archive}", compression=None) as stream:
                    for record in map(parse, members(stream.read)):
                        f = record["fields"]
                        rows.append((
                            name(f.get("warc-record-id")), f["warc-type"], f.get("warc-target-uri"), f.get("warc-date"), record["payload_bytes"],
                            f.get("warc-payload-digest", "").removeprefix("sha1:"), name(f.get("warc-refers-to")), record["ok"], archive,
                            *([record["payload"]] if with_payload else []),
                        ))
                        held += len(record["payload"] or b"") if with_payload else 100
                        if held > 8_000_000:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        s, n = pa.string(), pa.int64()
        types = [s, s, s, s, n, s, s, pa.bool_(), s, *([pa.binary()] if with_payload else [])]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
            names=[x.split()[0] for x in RECORD.split(", ")] + ["payload"] * with_payload,
        )

    return run


def read_warc(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives that the manifest lists; a broken archive is an error.

    An archive is read by one task from front to end, as its gzip members ask for;
    archives are bounded in size, and there are as many as the writer had tasks.
    """
    dealt = manifest.select("archive").repartition(max(1, min(manifest.count(), 100_000)), "archive")
    return dealt.mapInArrow(_read(folder, with_payload), RECORD + ", payload binary" * with_payload)


def with_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """The records to write: equal payloads after the first become revisits.

    Payloads are read twice: a first pass brings (digest, id) to one row a digest, and only
    digests met more than once are joined back, by broadcast if their table's size on disk
    allows it. Beyond that size the payloads are shuffled by digest, once, in a join in
    which a hot digest is split.
    """
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "utf-8")
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("key", F.sha1("payload"))
    twice = base.where(F.length("payload") >= min_bytes).groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = materialize(twice.select("key", "first"), "warc-copies")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")) & (F.length("payload") >= min_bytes)
    return base.join(twice, "key", "left").select(
        F.col("id").cast("string").alias("record_id"), "url", "payload", F.when(revisit, F.col("first").cast("string")).alias("refers_to"), revisit.alias("revisit")
    )


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records read with payloads, with those of revisits taken from their responses."""
    full = records.where("record_type = 'response'").groupBy("record_id").agg(F.first("payload").alias("of_payload"))
    joined = records.join(full.withColumnRenamed("record_id", "of"), F.col("refers_to") == F.col("of"), "left")
    return joined.withColumn("payload", F.coalesce("payload", "of_payload")).drop("of", "of_payload")


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back."""
    folder = work_path(pages.sparkSession, "warc")
    manifest = write_warc(with_revisits(pages, id_col, url_col, payload_col, min_bytes), folder)
    return read_warc(manifest, folder)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    bad = F.raise_error(F.concat(F.lit("a record does not match its digest: "), F.coalesce("record_id", F.lit("null"))))
    return records.select(
        F.col("record_id").cast("long").alias("page_id"),
        "payload_bytes",
        F.when(F.col("digest_ok"), F.col("payload_digest")).otherwise(bad.cast("string")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = " || ".join(
    f"substr('{_B32}', (((('0x' || substr(h, {1 + 5 * g}, 5))::BIGINT >> {15 - 5 * i}) & 31) + 1)::INT, 1)" for g in range(8) for i in range(4)
)
SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, {_DIGITS} AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
