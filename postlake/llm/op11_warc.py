"""Deterministic sharded WARC writer, and its reader.

Pages become records: of pages with equal payloads of least bytes or more, those with the largest id keep
theirs (response), the others refer to it (revisit). Records are sorted by id, url and digest over ranges;
the bounds of the ranges come from the records whose hashes are small, SAMPLE for each range, and the
number of ranges follows the bytes (it and their size grow alike), so neither depends on a cluster. The
shuffle deals a range to the partition of its number. A task regenerates headers, ids and digests of
its records, gzips each as a member of its own and rolls files by compressed size, under temporary names.
When all tasks have ended, the driver gives the files of one attempt a task their names and writes
the manifest, which readers go by: an archive without one doesn't exist, and what attempts left
is deleted. So a lost executor costs its tasks, and the same pages give the same bytes.

Links between equal payloads: payloads that occur once leave at an aggregate by digest; rows of hot
digests stay where they are (op06_near.hot_join), so no group of copies meets in one task.

Edge cases: null html is the empty payload, null urls and ids have no header of their own and come
back as null; repeated rows are records of their own, all of the largest id of a payload are responses;
rows that are equal throughout are dealt by their number in the partition of pages, so pages should be a
written table. An empty table gives a manifest without files. Ids must be integers. Other columns of
pages are not written.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from postlake.llm.common import checkpoint_dir, give_back, slices, stored, table
from postlake.llm.op06_near import hot_join
from postlake.sources.warc import compose, http_parts, place, records

#: Fewer bytes are never a revisit.
LEAST = 0
#: Compressed bytes after which a file ends.
ROLL = 1_000_000_000
#: A range has as many times UNIT bytes as there are ranges.
UNIT = 16_384
#: Sampled records for each range.
SAMPLE = 16
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "manifest.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
_NAMES = uuid.UUID(int=0)


def base32(sha1: str) -> str:
    """Bare base32 of a digest in hex."""
    return base64.b32encode(bytes.fromhex(sha1)).decode()


def record_id(*parts: object) -> str:
    """An id that follows from what it names."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, json.dumps(parts))}>"


def uri(url: str | None) -> list[tuple[str, str]]:
    """The header of a target; what would break a line is percent-encoded, and so is the percent sign, so that reading can undo it."""
    return [] if url is None else [("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~"))]


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: tuple[int, str | None] | None, number: int, date: str = DATE) -> bytes:
    """The record of a page, ungzipped; number counts the records of one page and payload."""
    kind, digest = "response" if refers_to is None else "revisit", base32(sha1)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, page_id, url, digest, number)), ("WARC-Date", date), *uri(url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).hexdigest())}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        other, target = refers_to
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id("response", other, target, digest, 0)), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-Id", str(other))]
        headers += [("WARC-Refers-To-Target-URI", uri(target)[0][1])] if target is not None else []
    return compose(headers, block)


def named(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, number, sha1) of pages."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), F.monotonically_increasing_id().alias("number"))
    return own.withColumn("sha1", F.sha1(F.encode("html", "utf-8")))


def decided(own: DataFrame, total: int, least: int = LEAST) -> DataFrame:
    """own (of named, total rows) with to: (page_id, url) of the response that a revisit refers to, null for responses."""
    # of responses with one id that with the smallest url is referred to
    first = F.min_by("url", F.struct(-F.coalesce("page_id", F.lit(-(2**63) + 1)), F.coalesce("url", F.lit(""))))
    able = own.where(F.octet_length("html") >= least).select("page_id", "url", "sha1")
    many = stored(able.groupBy("sha1").agg(F.count("*").alias("n"), F.max("page_id").alias("__id"), first.alias("__url")).where("n > 1 AND __id IS NOT NULL"))
    joined = hot_join(own, "sha1", many, total, "left")
    refers = F.col("__id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__id")) & (F.octet_length("html") >= least)
    return joined.select("page_id", "url", "html", "sha1", "number", F.when(refers, F.struct(F.col("__id").alias("page_id"), F.col("__url").alias("url"))).alias("to"))


def _tie() -> Column:
    return F.xxhash64("url", "sha1", "number")


def bounds(own: DataFrame, n: int, total: int) -> list[tuple[int, int]]:
    """First (id, tie) of all of n ranges but the first, of own (of named, total rows).

    Ids are sampled by a hash of their rows, so that the sample follows from the pages alone. An id with more
    than half a range of a second sample, which also hashes the rows' numbers, is hot: it is split by the
    ties of its rows there, other ids lie in one range as a whole. SAMPLE * n rows each are expected.
    """
    page, most = F.coalesce("page_id", F.lit(-(2**63))).alias("id"), min(2**63 - 1, int(2**64 * SAMPLE * n / max(total, 1)) - 2**63)
    ids = own.where(F.xxhash64("page_id", "url", "sha1") <= F.lit(most)).select(page).distinct().toArrow().column("id").to_numpy()
    rows = own.where(F.xxhash64("number", "page_id") <= F.lit(most)).select(page, _tie().alias("tie")).toArrow()
    own_ids, ties = rows.column("id").to_numpy(), rows.column("tie").to_numpy()
    each, inverse, count = np.unique(own_ids, return_inverse=True, return_counts=True)
    hot = count > SAMPLE // 2
    some = ids[~np.isin(ids, each[hot])]
    at = np.concatenate([some, own_ids[hot[inverse]]])
    tie = np.concatenate([np.full(len(some), -(2**63)), ties[hot[inverse]]])
    order = np.lexsort((tie, at))
    cut = order[np.unique(len(at) * np.arange(1, n) // n)] if len(at) else order
    return sorted(set(zip(at[cut].tolist(), tie[cut].tolist(), strict=True)))


def ranged(rows: DataFrame, at: list[tuple[int, int]], n: int) -> DataFrame:
    """rows with part, the number of their range, dealt to the partition of that number and sorted there."""

    @F.pandas_udf("int")
    def part(ids: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(at, x) for x in zip(ids.tolist(), ties.tolist(), strict=True)], dtype="int32")

    dealt = rows.withColumn("part", part(F.coalesce("page_id", F.lit(-(2**63))), _tie())).repartitionById(n, F.col("part"))
    return dealt.sortWithinPartitions("part", F.col("page_id").asc_nulls_first(), F.col("url").asc_nulls_first(), "sha1", "number")


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: (temporary name, name, bytes, records, sha256, first id, last id)."""

    files: list[tuple]


class _Files:
    """Rolled files of one task."""

    def __init__(self, folder: str, roll: int) -> None:
        self.system, self.root = place(folder)
        self.roll, self.own = roll, f"_temporary-{uuid.uuid4().hex}"
        self.done: list[tuple] = []
        self.part, self.k, self.stream = -1, 0, None

    def add(self, part: int, page_id: int | None, raw: bytes) -> None:
        if part != self.part:
            self.close()
            self.part, self.k = part, 0
        elif self.stream and self.size + len(raw) > self.roll:
            self.close()
            self.k += 1
        if not self.stream:
            self.system.create_dir(f"{self.root}/{self.own}", recursive=True)
            self.name = f"shard-{part:06d}-{self.k:04d}.warc.gz"
            self.stream = self.system.open_output_stream(f"{self.root}/{self.own}/{self.name}", compression=None)
            self.size, self.n, self.sha, self.first = 0, 0, hashlib.sha256(), page_id
            self.put(gzip.compress(compose([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", self.name)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"), mtime=0))
        self.put(raw)
        self.n += 1
        self.last = page_id

    def put(self, raw: bytes) -> None:
        self.stream.write(raw)
        self.size += len(raw)
        self.sha.update(raw)

    def close(self) -> None:
        if self.stream:
            self.stream.close()
            self.done.append((f"{self.own}/{self.name}", self.name, self.size, self.n, self.sha.hexdigest(), self.first, self.last))
            self.stream = None


class Archive(DataSourceArrowWriter):
    """Writes rows of ranged(); commits by names and a manifest."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.folder, self.roll, self.overwrite = options["path"].rstrip("/"), int(options.get("roll", ROLL)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, before, number = _Files(self.folder, self.roll), None, 0
        for b in iterator:
            for i, j in slices(b.column("html")):
                for row in b.slice(i, j - i).to_pylist():
                    key = (row["part"], row["page_id"], row["url"], row["sha1"])
                    number = number + 1 if key == before else 0
                    before = key
                    to = row["to"] and (row["to"]["page_id"], row["to"]["url"])
                    raw = record(row["page_id"], row["url"], row["html"].encode("utf-8", "surrogatepass"), row["sha1"], to, number)
                    files.add(row["part"], row["page_id"], gzip.compress(raw, 6, mtime=0))
            give_back()
        files.close()
        return Written(files.done)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = place(self.folder)
        system.create_dir(root, recursive=True)
        there = [f.base_name for f in system.get_file_info(_children(root))]
        if MANIFEST in there:
            if not self.overwrite:
                self.abort(messages)
                raise ValueError(f"{self.folder} holds an archive")
            system.delete_file(f"{root}/{MANIFEST}")
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f[1])
        for f in files:
            system.move(f"{root}/{f[0]}", f"{root}/{f[1]}")
        for name in set(there) - {f[1] for f in files} - {MANIFEST}:  # an older archive, and attempts that failed
            (system.delete_dir if name.startswith("_temporary-") else system.delete_file)(f"{root}/{name}")
        self.abort(messages)
        made = [dict(zip(("name", "bytes", "records", "sha256", "first", "last"), f[1:], strict=True)) for f in files]
        with system.open_output_stream(f"{root}/_{MANIFEST}", compression=None) as out:
            out.write(json.dumps({"files": made}, indent=1).encode())
        system.move(f"{root}/_{MANIFEST}", f"{root}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = place(self.folder)
        for name in {f[0].split("/")[0] for m in messages if m for f in m.files}:
            if system.get_file_info(f"{root}/{name}").is_file is False and system.get_file_info(f"{root}/{name}").type.name == "Directory":
                system.delete_dir(f"{root}/{name}")


def _children(root: str):
    from pyarrow import fs

    return fs.FileSelector(root)


class WarcSource(DataSource):
    """Sink "postlake_warc": options path, roll."""

    @classmethod
    def name(cls) -> str:
        return "postlake_warc"

    def schema(self) -> str:
        return "page_id long, url string, html string, sha1 string, number long, to struct<page_id:long,url:string>, part int"

    def writer(self, schema, overwrite: bool) -> Archive:
        return Archive(dict(self.options), overwrite)


def write(pages: DataFrame, folder: str, least: int = LEAST, roll: int = ROLL, unit: int = UNIT) -> list[dict]:
    """Write pages (page_id, url, html) as an archive in folder, and return its files by the manifest."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    own = named(pages)
    sizes = own.agg(F.count("*").alias("n"), F.sum(F.octet_length("html") + F.lit(500)).alias("b")).collect()[0]  # one row
    n = max(1, math.ceil(math.sqrt((sizes["b"] or 0) / unit)))
    rows = ranged(decided(own, sizes["n"], least), bounds(own, n, sizes["n"]), n)
    rows.write.format("postlake_warc").option("path", folder).option("roll", roll).mode("overwrite").save()
    return manifest(folder)


def manifest(folder: str) -> list[dict]:
    """The files of an archive; an error where there is none."""
    system, root = place(folder)
    with system.open_input_stream(f"{root}/{MANIFEST}", compression=None) as f:
        return json.loads(f.read())["files"]


def _row(headers: dict, block: bytes, payload: bool) -> tuple:
    from urllib.parse import unquote

    http, body = http_parts(block)
    url, to, page = headers.get("warc-target-uri"), headers.get("x-refers-to-page-id"), headers.get("x-page-id")
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "response" and base32(hashlib.sha1(body).hexdigest()) != digest:
        raise ValueError(f"{headers['warc-record-id']}: the payload isn't that of its digest")
    return None if page is None else int(page), None if url is None else unquote(url), int(http["content-length"]), digest, headers["warc-type"], None if to is None else int(to), body.decode("utf-8", "surrogatepass") if payload and headers["warc-type"] == "response" else None


def read(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """The records of an archive (SCHEMA; payload null unless asked for, and for revisits); payloads are held against
    their digests. Each file is read as a stream by one task, whose size the writer bounds."""
    names = [(f"{folder.rstrip('/')}/{f['name']}",) for f in manifest(folder)]
    if not names:
        return spark.createDataFrame([], SCHEMA)
    files = spark.createDataFrame(names, "path string").repartition(min(len(names), 10_000), "path")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])

    def run(batches):
        rows, size = [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for b in batches:
            for path in b.column("path").to_pylist():
                for _, _, r in records(path):
                    if r.headers["warc-type"] in ("response", "revisit"):
                        rows.append(_row(r.headers, r.block, payload))
                        size += 200 + payload * len(r.block)
                    if size > 4_000_000:
                        yield made()
                        rows, size = [], 0
        if rows:
            yield made()

    return files.mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH own AS (SELECT page_id, coalesce(html, '') AS html FROM pages), sized AS (SELECT page_id, html, octet_length(encode(html)) AS b, unhex(sha1(html)) AS d FROM own),
five AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top, list_transform(range(20), lambda i: ('0x' || substr(hex(d), 2 * i + 1, 2))::INT) AS bytes FROM sized)
SELECT page_id, b::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((((bytes[i * 5 // 8 + 1] << 8) | coalesce(bytes[i * 5 // 8 + 2], 0)) >> (11 - i * 5 % 8)) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN b >= {LEAST} AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN b >= {LEAST} AND page_id < top THEN top END AS refers_to
FROM five
"""
