"""WARC records: composing and parsing them, and reading the records that an index names by byte range.

Files lie in a folder that all tasks reach, by any URI that pyarrow knows (file, hdfs, s3, gs); they
are gzipped member by member, one record a member, or plain. Readers hold one record at a time.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes read at a time.
CHUNK = 1 << 20
#: Bytes of records in a batch that goes on to Spark.
BATCH = 4_000_000
#: Bytes of a file whose records one task reads.
STRETCH = 64_000_000
_END = b"\r\n\r\n"


class Record(NamedTuple):
    """Headers of a record by lower-case name, and its block."""

    headers: dict[str, str]
    block: bytes


def compose(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record; Content-Length is added."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + _END


def parse(record: bytes) -> Record | None:
    """The record that begins these bytes; None if there is none, or not all of it."""
    head, found, rest = record.partition(_END)
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        return None
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = headers.get("content-length", "")
    if not size.isdigit() or len(rest) < int(size):
        return None
    return Record(headers, rest[: int(size)])


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name (the status line's as status) and body of an HTTP message."""
    head, _, body = block.partition(_END)
    lines = head.decode("latin-1").split("\r\n")
    status = lines[0].split(" ")[1:2]
    return {"status": status[0] if status else ""} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, body


def body_text(block: bytes) -> str:
    """Body of an HTTP message by its charset, else UTF-8."""
    headers, body = http_parts(block)
    charset = re.search(r"(?i)charset=[\"']?([\w-]+)", headers.get("content-type", ""))
    try:
        return body.decode(charset[1] if charset else "utf-8", "replace").strip()
    except LookupError:
        return body.decode("utf-8", "replace").strip()


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path there."""
    return fs.FileSystem.from_uri(uri)


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of a stream, gzipped member by member or plain."""
    held, at = stream.read(CHUNK), 0
    zipped = held[:2] == b"\x1f\x8b"
    while held:
        if zipped:
            one, out, used = zlib.decompressobj(31), [], 0
            while not one.eof and held:
                out.append(one.decompress(held))
                used += len(held) - len(one.unused_data)
                held = one.unused_data if one.eof else stream.read(CHUNK)
            if not one.eof:
                return  # cut off
            record = b"".join(out)
        else:
            while _END not in held and (more := stream.read(CHUNK)):
                held += more
            head, _, _ = held.partition(_END)
            size = re.search(rb"(?im)^Content-Length:\s*(\d+)", head)
            used = len(head) + 4 + int(size[1] if size else 0) + 4
            while len(held) < used and (more := stream.read(max(CHUNK, used - len(held)))):
                held += more
            record, held = held[:used], held[used:]
        yield at, used, record
        at += used
        if not held:
            held = stream.read(CHUNK)


def records(uri: str) -> Iterator[tuple[int, int, Record]]:
    """(offset, length, record) of a whole file; what isn't a record is passed over."""
    system, path = place(uri)
    with system.open_input_stream(path, compression=None) as stream:
        for at, size, raw in members(stream):
            if record := parse(raw):
                yield at, size, record


def read_ranges(index: DataFrame, parallel: int | None = None, stretch: int = STRETCH) -> DataFrame:
    """(path, offset, url, body) of the responses that an index (path, offset, length) names.

    Only the named ranges are read. The index is dealt by file and stretch of STRETCH bytes, so the records of
    one file are read by several tasks, each of which opens the file once. Ranges that hold no whole
    response, and rows without a path or a length, give no row; a file that can't be opened fails.
    """
    own = index.where("path IS NOT NULL AND offset >= 0 AND length > 0").select("path", F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length"))
    own = own.repartition(*([parallel] if parallel else []), "path", F.floor(F.col("offset") / stretch)).sortWithinPartitions("path", "offset")

    def run(batches):
        name, stream = None, None
        for b in batches:
            out, size = [], 0
            for path, offset, length in zip(*(b.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                if path != name:
                    if stream:
                        stream.close()
                    system, where = place(path)
                    name, stream = path, system.open_input_file(where)
                stream.seek(offset)
                raw = stream.read(length)
                try:
                    record = parse(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
                except (OSError, EOFError, zlib.error):
                    record = None  # not a whole member
                if record and record.headers.get("warc-type") == "response":
                    out.append((path, offset, record.headers.get("warc-target-uri", "").strip("<>"), body_text(record.block)))
                    size += len(raw)
                if size > BATCH:
                    yield _rows(out)
                    out, size = [], 0
            yield _rows(out)
        if stream:
            stream.close()

    return own.mapInArrow(run, "path string, offset long, url string, body string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    made = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["path", "offset", "url", "body"])


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write captured pages (file, url, body) as gzipped WARC files, one for each name in file, and return their
    index (path, offset, length, url). A file is written by one task under a temporary name and renamed, so one
    that is written again is the same."""
    own = rows.select("file", "url", "body").repartition("file").sortWithinPartitions("file", "url", "body")

    def run(batches):
        name, stream, at = None, None, 0
        system, root = place(folder)
        system.create_dir(root, recursive=True)

        def close():
            stream.close()
            system.move(f"{root}/{name}.tmp", f"{root}/{name}")

        for b in batches:
            out = []
            for file, url, body in zip(*(b.column(c).to_pylist() for c in ("file", "url", "body")), strict=True):
                if file != name:
                    if stream:
                        close()
                    name, at = file, 0
                    stream = system.open_output_stream(f"{root}/{name}.tmp", compression=None)
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (body or "").encode()
                raw = gzip.compress(compose([("WARC-Type", "response"), ("WARC-Target-URI", url or "")], block), mtime=0)
                stream.write(raw)
                out.append((f"{folder}/{file}", at, url, len(raw)))
                at += len(raw)
            made = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["path", "offset", "url", "length"])
        if stream:
            close()

    return own.mapInArrow(run, "path string, offset long, url string, length long")
