"""Registry exports as a stream: gzipped JSON files, read record by record from a cursor.

A folder holds full exports (init-DATE/*.gz) and daily ones (daily-DATE.gz, or daily-DATE/*.gz). The latest full export is
read, then the daily ones from its date on, as far as days follow one another. The offset of the stream is export, file and
place, so it may stop between any two records; Spark's checkpoint of offsets gives each record once. A batch has MOST records at
most; the driver counts them in the one or two files that it ends in, and tasks read a file's share each, as gzip
can't be split. What has been committed is also written to cursor, from where a new reader goes on.

A file is {"...", "results": [records]} or a sequence of records; what follows a broken record is left out.
"""

from __future__ import annotations

import datetime as dt
import gzip
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from postlake.sources.warc import place

MOST = 100_000
CHUNK = 1 << 16
_HEAD = re.compile(r'\s*\{[^\[\]]*?"results"\s*:\s*\[')
_BETWEEN = re.compile(r"[\s,]*")


def records(stream: io.TextIOBase) -> Iterator[str]:
    """The records of a file as texts, one at a time."""
    held, decoder = stream.read(CHUNK), json.JSONDecoder()
    at = m.end() if (m := _HEAD.match(held)) else 0
    while True:
        at = _BETWEEN.match(held, at).end()
        if at < len(held) and held[at] == "]":
            return
        try:
            if held[at : at + 1] != "{":
                raise ValueError
            end = decoder.raw_decode(held, at)[1]
        except ValueError:
            more = stream.read(max(CHUNK, len(held) - at))
            if not more:
                return
            held, at = held[at:] + more, 0
            continue
        yield held[at:end]
        at = end


def opened(path: str) -> Iterator[str]:
    system, where = place(path)
    with system.open_input_stream(where, compression=None) as raw, io.TextIOWrapper(gzip.GzipFile(fileobj=raw), encoding="utf-8", errors="replace") as text:
        yield from records(text)


def files(folder: str) -> list[tuple[str, str]]:
    """(export, path) in the order they are read."""
    system, root = place(folder)
    found = [x for x in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if x.is_file and x.path.endswith(".gz")]
    by: dict[str, list[str]] = {}
    for x in found:
        if m := re.search(r"/((?:init|daily)-\d{4}-\d\d-\d\d)(?:\.[^/]*gz|/[^/_.][^/]*gz)$", x.path):
            by.setdefault(m[1], []).append(x.path)
    full = max((e for e in by if e.startswith("init-")), default=None)
    if full is None:
        return []
    out, day = [full], dt.date.fromisoformat(full[5:])
    while f"daily-{day}" in by:
        out.append(f"daily-{day}")
        day += dt.timedelta(1)
    prefix = folder.split("://")[0] + "://" if "://" in folder else ""
    return [(e, prefix + p) for e in out for p in sorted(by[e])]


@dataclass
class Share(InputPartition):
    """Records begin to end (None: all that follow) of a file."""

    export: str
    path: str
    begin: int
    end: int | None


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.most, self.cursor = options["path"], int(options.get("most", MOST)), options.get("cursor")
        self.at = self._committed() or self.initialOffset()

    def _committed(self) -> dict | None:
        if not self.cursor:
            return None
        system, where = place(self.cursor)
        if system.get_file_info(where).type == fs.FileType.NotFound:
            return None
        with system.open_input_stream(where, compression=None) as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"export": "", "file": "", "place": 0}

    def _left(self, at: dict) -> list[tuple[str, str, int]]:
        """(export, path, place) of the file the offset is in, and of those behind it; all, where the export is no longer there."""
        every = files(self.folder)
        here = next((k for k, (_, p) in enumerate(every) if p == at["file"]), None)
        if here is None:
            return [(e, p, 0) for e, p in every]
        return [(*every[here], at["place"]), *((e, p, 0) for e, p in every[here + 1 :])]

    def latestOffset(self) -> dict:
        room = self.most
        for export, path, begin in self._left(self.at):
            n = 0
            for n, _ in enumerate(opened(path), 1):
                if n >= begin + room:
                    break
            if n > begin:
                self.at = {"export": export, "file": path, "place": n}
                room -= n - begin
            if room <= 0:
                break
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Share]:
        out = []
        for export, path, begin in self._left(start):
            last = path == end["file"]
            out.append(Share(export, path, begin, end["place"] if last else None))
            if last:
                break
        self.at = end
        return out

    def read(self, partition: Share) -> Iterator[tuple]:
        for k, record in enumerate(opened(partition.path)):
            if partition.end is not None and k >= partition.end:
                return
            if k >= partition.begin:
                yield partition.export, partition.path.rsplit("/", 1)[-1], k, record

    def commit(self, end: dict) -> None:
        if self.cursor:
            system, where = place(self.cursor)
            system.create_dir(where.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(where + ".new", compression=None) as f:
                f.write(json.dumps(end).encode())
            system.move(where + ".new", where)


class Exports(DataSource):
    """Stream "registry_exports": options path, most (records a batch), cursor (a file)."""

    @classmethod
    def name(cls) -> str:
        return "registry_exports"

    def schema(self) -> str:
        return "export string, file string, place long, record string"

    def streamReader(self, schema) -> Reader:
        return Reader(dict(self.options))
