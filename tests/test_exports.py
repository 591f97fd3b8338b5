"""Registry exports as a stream that stops and goes on between any two records."""

from __future__ import annotations

import gzip
import io
import json

import pytest

from postlake.sources import exports


def put(folder, name, rows, array=True):
    at = folder / name
    at.parent.mkdir(parents=True, exist_ok=True)
    text = json.dumps({"date": "x", "results": rows}) if array else "\n".join(map(json.dumps, rows))
    at.write_bytes(gzip.compress(text.encode()))


@pytest.fixture
def folder(tmp_path):
    own = tmp_path / "exports"
    row = lambda k: {"id": k, "names": [{"value": "a ] } \" " * (k % 3)}]}
    put(own, "init-2024-01-01/old.json.gz", [row(900)])
    put(own, "init-2024-02-01/b.json.gz", [row(k) for k in range(4, 9)], array=False)
    put(own, "init-2024-02-01/a.json.gz", [row(k) for k in range(4)])
    put(own, "daily-2024-02-01.json.gz", [row(9)])
    put(own, "daily-2024-02-02.json.gz", [])
    put(own, "daily-2024-02-03.json.gz", [row(10), row(11)])
    put(own, "daily-2024-02-05.json.gz", [row(901)])  # a day is missing before it
    return own


def test_records():
    rows = [{"a": "[{" * k, "b": [1, {"c": None}]} for k in range(3)]
    for text, n in ((json.dumps({"n": 1, "results": rows}), 3), ("\n".join(map(json.dumps, rows)), 3), (json.dumps({"results": rows})[:-9], 2)):
        assert [json.loads(x) for x in exports.records(io.StringIO(text))] == rows[:n]
    assert list(exports.records(io.StringIO(""))) == [] and list(exports.records(io.StringIO('{"results": []}'))) == []
    long = [{"x": "y" * 200_000}, {"x": 2}]
    assert [json.loads(x) for x in exports.records(io.StringIO(json.dumps({"results": long})))] == long


@pytest.mark.parametrize("most", [1, 3, 5, 100])
def test_every_stop_gives_each_record_once(folder, most):
    """Readers that are made anew from any committed offset go on behind it."""
    options = {"path": f"file://{folder}", "most": str(most)}
    got, at = [], exports.Reader(options).initialOffset()
    for _ in range(40):
        reader = exports.Reader(options)
        reader.at = at
        end = reader.latestOffset()
        if end == at:
            break
        batch = [json.loads(r[3])["id"] for p in reader.partitions(at, end) for r in reader.read(p)]
        assert 0 < len(batch) <= most
        again = [json.loads(r[3])["id"] for p in exports.Reader(options).partitions(at, end) for r in exports.Reader(options).read(p)]
        assert batch == again  # a batch that is taken again is the same
        got += batch
        at = end
    assert got == list(range(12))


def test_stream(spark, folder, tmp_path):
    spark.dataSource.register(exports.Exports)

    def run():
        seen = []
        stream = spark.readStream.format("registry_exports").option("path", f"file://{folder}").option("most", "2").option("cursor", f"file://{tmp_path}/cursor/at").load()
        own = stream.writeStream.foreachBatch(lambda df, k: seen.append([json.loads(r["record"])["id"] for r in df.collect()])).option("checkpointLocation", f"file://{tmp_path}/checkpoint").start()
        try:
            own.processAllAvailable()
        finally:
            own.stop()
        return [x for x in seen if x]

    first = run()
    assert sorted(sum(first, [])) == list(range(12)) and max(map(len, first)) == 2
    put(folder, "daily-2024-02-04.json.gz", [{"id": 12}])
    assert sorted(sum(run(), [])) == [12, 901]
