"""WARC archives as chunked record tables.

``write_archives`` turns a table of records into WARC/1.1 files in the shared
folder, one per task, and ``read_chunks`` streams such files back as rows of
(record, chunk number, bytes, digest so far). Neither holds more than one chunk
of an archive's payload beyond what the source row itself holds, whatever the
size of a record. Files get their final name only when complete, so a task that
is run again leaves the earlier file unlisted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_path

CHUNK = 1 << 18
VERSION = b"WARC/1.1"
#: Headers of our own that carry what WARC has no field for.
LENGTH_HEADER, KEY_HEADER = "X-Payload-Length", "X-Record-Key"

INDEX_SCHEMA = "archive string, record_key string, record_type string, offset long, length long"
CHUNK_SCHEMA = "archive string, record_no long, headers string, chunk_no long, chunk binary, chunk_bytes long, bytes_so_far long, digest_so_far string, last boolean"


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder given as URI or plain path. A scheme that pyarrow doesn't know is an error, never a local folder."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", uri):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def roles(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add payload_bytes, payload_sha1 (hex), record_type and refers_to to rows of (page_id, url, html).

    Of records whose payloads are equal and at least ``least_bytes`` long, that
    with the largest page_id is the response and the others revisit it. Of rows
    that repeat page_id and payload, all are responses. A null page_id never
    becomes the response of a group that has an id; a group of null ids only is
    all responses. A null payload is empty.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    sized = records.withColumns({"payload_bytes": F.octet_length(payload).cast("long"), "payload_sha1": F.sha1(F.encode(payload, "UTF-8"))})
    #: The group's key also holds the length; hot groups meet as one row per task.
    top = sized.groupBy("payload_sha1", "payload_bytes").agg(F.max("page_id").alias("top_id")).withColumnsRenamed({"payload_sha1": "top_sha1", "payload_bytes": "top_bytes"})
    joined = sized.join(top, (F.col("payload_sha1") == F.col("top_sha1")) & (F.col("payload_bytes") == F.col("top_bytes")), "left")
    revisit = (F.col("payload_bytes") >= least_bytes) & F.col("top_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top_id"))
    return joined.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("top_id"))}).drop("top_sha1", "top_bytes", "top_id")


def _header(fields: list[tuple[str, str]]) -> bytes:
    clean = lambda v: " ".join(v.split())  # noqa: E731  header values stay on one line
    return VERSION + b"\r\n" + b"".join(f"{k}: {clean(v)}\r\n".encode("utf-8", "surrogatepass") for k, v in fields) + b"\r\n"


def write_record(out, fields: list[tuple[str, str]], payload: str, compress: bool, chunk: int = CHUNK) -> None:
    """One record as its own gzip member (or plain); the payload is encoded and passed on piece by piece."""
    sink = gzip.GzipFile(fileobj=out, mode="wb", compresslevel=1, mtime=0) if compress else out
    sink.write(_header(fields))
    for at in range(0, len(payload), chunk):
        sink.write(payload[at : at + chunk].encode("utf-8"))
    sink.write(b"\r\n\r\n")
    if compress:
        sink.close()


def write_archives(records: DataFrame, folder: str | None = None, compress: bool = True, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write records (page_id, url, html and what ``roles`` adds) as WARC files; returns the index of what was written.

    The index is itself a table in the shared folder and lists only files of
    tasks that succeeded.
    """
    spark = records.sparkSession
    folder = folder or fresh_path(spark, "warc")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * compress
        out, index, place = None, [], 0
        for batch in batches:
            if out is None:
                out = store.open_output_stream(f"{path}/{name}.tmp", compression=None, buffer_size=1 << 20)
            at = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                row = {c: v[i].as_py() for c, v in at.items()}
                payload = row["html"] or ""
                revisit = row["record_type"] == "revisit"
                key = "" if row["page_id"] is None else str(row["page_id"])
                fields = [
                    ("WARC-Type", row["record_type"]),
                    ("WARC-Record-ID", f"<urn:page:{key or 'none'}>"),
                    ("WARC-Date", date),
                    ("WARC-Target-URI", row["url"] or ""),
                    ("WARC-Payload-Digest", "sha1:" + base32_sha1(bytes.fromhex(row["payload_sha1"]))),
                    (LENGTH_HEADER, str(row["payload_bytes"])),
                    (KEY_HEADER, key),
                ]
                if revisit:
                    fields += [("WARC-Refers-To", f"<urn:page:{row['refers_to']}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", "0" if revisit else str(row["payload_bytes"]))]
                write_record(out, fields, "" if revisit else payload, compress)
                index.append((name, key, row["record_type"], place, out.tell() - place))
                place = out.tell()
                if len(index) >= 10_000:
                    yield _index_batch(index)
                    index = []
        if out is not None:
            out.close()
            store.move(f"{path}/{name}.tmp", f"{path}/{name}")
        if index:
            yield _index_batch(index)

    columns = ["page_id", "url", "html", "payload_bytes", "payload_sha1", "record_type", "refers_to"]
    written = cut(records.select(*columns).mapInArrow(task, INDEX_SCHEMA), "warc-index")
    return written.withColumn("archive", F.concat(F.lit(folder + "/"), F.col("archive")))


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["archive", "record_key", "record_type", "offset", "length"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _line(stream: io.BufferedReader) -> bytes:
    """The next line, whatever its length, without its CRLF; empty at the end of a header."""
    return stream.readline().rstrip(b"\r\n")


def parse(stream: io.BufferedReader, chunk: int = CHUNK) -> Iterator[tuple[int, dict[str, str], int, bytes, int, str, bool]]:
    """(record number, headers, chunk number, bytes, bytes so far, digest so far, last) of each chunk of a WARC stream."""
    number = 0
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"record {number} does not begin with a WARC version")
        headers: dict[str, str] = {}
        while text := _line(stream):
            name, _, value = text.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        left, digest, seen, k = int(headers.get("content-length", "0")), hashlib.sha1(), 0, 0
        while True:
            piece = stream.read(min(chunk, left)) if left else b""
            if left and not piece:
                raise ValueError(f"record {number} is cut short")
            left -= len(piece)
            seen += len(piece)
            digest.update(piece)
            yield number, headers, k, piece, seen, base32_sha1(digest.digest()), not left
            k += 1
            if not left:
                break
        number += 1


def read_chunks(archives: DataFrame, chunk: int = CHUNK, with_bytes: bool = True) -> DataFrame:
    """Chunk rows of the files named in column ``archive``; without ``with_bytes`` the bytes are digested and dropped."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = CHUNK_SCHEMA.replace(" string", "").replace(" long", "").replace(" binary", "").replace(" boolean", "").split(", ")
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = open_store(uri)
                with store.open_input_stream(path, compression=None, buffer_size=1 << 20) as raw:
                    source = gzip.GzipFile(fileobj=io.BufferedReader(raw), mode="rb") if path.endswith(".gz") else raw
                    stream, rows, held = io.BufferedReader(source, 1 << 20), [], 0
                    for number, headers, k, piece, seen, digest, last in parse(stream, chunk):
                        rows.append((uri, number, json.dumps(headers) if last or not k else None, k, piece if with_bytes else None, len(piece), seen, digest, last))
                        held += len(piece) * with_bytes + 500
                        if held >= 4 * chunk:
                            yield pack(rows)
                            rows, held = [], 0
                    if rows:
                        yield pack(rows)

    return archives.select("archive").mapInArrow(task, CHUNK_SCHEMA)
