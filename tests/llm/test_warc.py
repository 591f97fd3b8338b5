"""The WARC writer and its reader against brute force: records, files, commit and edge cases."""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import random
import re

import pytest

from postlake.llm import op11_warc as w
from postlake.sources import warc

PAGES = "page_id long, url string, html string"


def brute(rows: list, least: int) -> list:
    out = []
    for page, url, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        top = max(same) if same and len(raw) >= least else page
        out.append((page, url, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if top == page else "revisit", None if top == page else top))
    return sorted(out, key=repr)


def seen(df) -> list:
    return sorted((tuple(r)[:6] for r in df.collect()), key=repr)


def rows(n: int = 200) -> list:
    own = random.Random(1)
    out = [(i, own.choice([f"http://h/{i}?q=a b&č=%41", None, "http://x/\r\nX: y", "http://h/%"]), own.choice([None, "", "same", "<p>é</p>" * 50, f"page {i} " * own.randrange(40)])) for i in range(n)]
    return [*out, (3, "u", "same"), (n - 1, "v", "same"), (n - 1, "v", "same"), (None, None, "same"), (None, None, None), (None, "n", "lonely"), (-5, "n", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n")]


@pytest.mark.parametrize("least", [0, 5, 10_000])
def test_read_back(spark, tmp_path, least):
    made = w.write(spark.createDataFrame(rows(), PAGES).repartition(3), f"file://{tmp_path}", least, roll=2000, unit=500)
    assert seen(w.read(spark, f"file://{tmp_path}")) == brute(rows(), least)
    kept = {(r["page_id"], r["url"]): r["payload"] for r in w.read(spark, f"file://{tmp_path}", payload=True).collect() if r["record_type"] == "response"}
    want = {(p, u): h or "" for p, u, h in rows()}
    assert all(want[k] == v for k, v in kept.items() if k != (None, None))
    # files: rolled by compressed size, sorted, as the manifest says, each member a gzip stream of its own
    assert len(made) > 5 and sum(f["records"] for f in made) == len(rows())
    assert sorted(os.listdir(tmp_path)) == sorted([*(f["name"] for f in made), w.MANIFEST]) or {x for x in os.listdir(tmp_path) if not x.startswith(".")} == {*(f["name"] for f in made), w.MANIFEST}
    ids = []
    for f in made:
        raw = (tmp_path / f["name"]).read_bytes()
        assert len(raw) == f["bytes"] and hashlib.sha256(raw).hexdigest() == f["sha256"]
        read = list(warc.records(f"file://{tmp_path}/{f['name']}"))
        assert b"".join(gzip.decompress(raw[a : a + n]) for a, n, _ in read) == gzip.decompress(raw)
        own = [r.headers.get("x-page-id") for _, _, r in read[1:]]
        ids += [-(2**63) if x is None else int(x) for x in own]
        last = max(n for _, n, _ in read)
        assert len(raw) <= 2000 + last or len(read) == 2
    assert ids == sorted(ids)


def test_headers(spark, tmp_path):
    w.write(spark.createDataFrame(rows(), PAGES), f"file://{tmp_path}", unit=500)
    names, to = {}, []
    for f in w.manifest(f"file://{tmp_path}"):
        for _, _, r in warc.records(f"file://{tmp_path}/{f['name']}"):
            assert r.headers["warc-record-id"] not in names and re.fullmatch("<urn:uuid:[0-9a-f-]{36}>", r.headers["warc-record-id"])
            names[r.headers["warc-record-id"]] = r.headers
            if "warc-block-digest" in r.headers:
                assert r.headers["warc-block-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(r.block).digest()).decode()
            to += [r.headers] if r.headers["warc-type"] == "revisit" else []
    assert to and all(names[h["warc-refers-to"]]["warc-type"] == "response" and names[h["warc-refers-to"]]["warc-payload-digest"] == h["warc-payload-digest"] and names[h["warc-refers-to"]].get("warc-target-uri") == h.get("warc-refers-to-target-uri") and h["warc-profile"] == w.PROFILE for h in to)


def test_same_bytes(spark, tmp_path):
    """The layout of the table doesn't matter, nor how many partitions the session has."""
    own = spark.createDataFrame([r for r in rows() if r[0] is not None and (r[0], r[1]) != (199, "v")], PAGES)
    a = w.write(own.repartition(7), f"file://{tmp_path}/a", roll=3000, unit=500)
    b = w.write(own.coalesce(1), f"file://{tmp_path}/b", roll=3000, unit=500)
    assert a == b and len(a) > 3


def test_commit(spark, tmp_path):
    """What attempts left doesn't count; an archive is replaced as a whole; without a manifest there is none."""
    folder = f"file://{tmp_path}"
    with pytest.raises(FileNotFoundError):
        w.read(spark, folder)
    w.write(spark.createDataFrame(rows(), PAGES), folder, unit=300)
    (tmp_path / "_temporary-lost").mkdir()
    (tmp_path / "_temporary-lost" / "shard-000000-0000.warc.gz").write_bytes(b"half")
    w.write(spark.createDataFrame([(1, "u", "x")], PAGES), folder)
    assert seen(w.read(spark, folder)) == brute([(1, "u", "x")], 0) and {x for x in os.listdir(tmp_path) if x[0] != "."} == {"shard-000000-0000.warc.gz", w.MANIFEST}
    kept = w.Archive({"path": folder}, overwrite=False)
    with pytest.raises(ValueError, match="holds an archive"):
        kept.commit([])


def test_lost_attempt(tmp_path):
    """Two attempts of one task write under names of their own; only the one that is committed counts."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"page_id": 1, "url": "u", "html": "x", "sha1": hashlib.sha1(b"x").hexdigest(), "number": 0, "to": None, "part": 0}])
    own = w.Archive({"path": f"file://{tmp_path}"}, overwrite=True)
    own.write(iter([batch]))
    own.commit([own.write(iter([batch])), None])
    assert {x for x in os.listdir(tmp_path) if x[0] != "."} == {"shard-000000-0000.warc.gz", w.MANIFEST} and len(w.manifest(f"file://{tmp_path}")) == 1


def test_empty(spark, tmp_path):
    assert w.write(spark.createDataFrame([], PAGES + ", part string"), f"file://{tmp_path}") == [] and w.read(spark, f"file://{tmp_path}").count() == 0


def test_ranges_share_the_work(spark, tmp_path):
    """Rows that are equal throughout, a third of all, are dealt to several ranges; so is one id."""
    same = [(1, "u", "x" * 100)] * 300 + [(i, "u", f"y{i}" * 40) for i in range(600)]
    made = w.write(spark.createDataFrame(same, PAGES), f"file://{tmp_path}", unit=1000)
    assert len(made) > 8 and max(f["records"] for f in made) < 5 * len(same) / len(made)
    assert seen(w.read(spark, f"file://{tmp_path}")) == brute(same, 0)
