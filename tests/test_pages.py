"""Further sources, schemas and their checks."""

from __future__ import annotations

import gzip
import json

from pyspark.sql import functions as F

from postlake import schemas
from postlake.sources import pages


def bodies(spark, *texts):
    return spark.createDataFrame([("acme.com", t) for t in texts], "board string, body string")


def test_successfactors(spark):
    x = """<table><tr class="data-row"><td><a href="/job/1?x=1" class="jobTitle-link">Dev</a></td><td><span class="jobLocation">Nitra, SK</span></td></tr>
    <tr class="data-row"><td><a class="jobTitle-link" href="/job/2">Ops</a></td><td><span class="jobLocation">Wien, AT</span></td></tr></table>
    <li class="job-tile"><a class="jobTitle-link" href="/job/3">QA</a></li>"""
    assert sorted(r["external_id"] for r in pages.successfactors(bodies(spark, x)).collect()) == ["/job/1", "/job/2", "/job/3"]
    assert sorted(r["external_id"] for r in pages.successfactors(bodies(spark, x), "SK", "slovakia").collect()) == ["/job/1", "/job/3"]


def test_portal_pages(spark):
    x = '<dl><dt>Dátum vytvorenia:</dt><dd>5.1.2026</dd><dt>Zamestnanie</dt><dd>5120001 Kuchár</dd></dl><a class="btn employer-link" href="https://x.sk/job">go</a>'
    r = pages.portal_offer(spark.createDataFrame([("1", x), ("2", "")], "external_id string, body string")).orderBy("external_id").collect()
    assert (str(r[0]["posted"]), r[0]["isco"], r[0]["employer_url"]) == ("2026-01-05", "5120", "https://x.sk/job") and tuple(r[1])[1:] == (None, None, None)
    p = '<a href="https://www.profesia.sk/x">p</a><a href="https://acme.sk">Web</a><a href="https://acme.sk/kariera">Kariéra</a><a href="/in">in</a>'
    assert [tuple(x) for x in pages.company_page_link(spark.createDataFrame([("acme", p), ("none", None)], "slug string, body string")).collect()] == [("acme", "https://acme.sk/kariera")]
    e = '<a href="/zamestnavatel/12/acme">ACME</a><a href="/zamestnavatel/12/acme"><b>ACME</b></a><a href="/other">x</a>'
    assert [(r["number"], r["name"]) for r in pages.employer_list(bodies(spark, e)).collect()] == [("12", "ACME")]


def test_registry_answers(spark, tmp_path):
    b = {"results": {"bindings": [{"number": {"value": "123 456"}, "site": {"value": "https://x.sk"}}, {"number": {"value": "1"}, "site": {"value": "bad"}}]}}
    assert [tuple(r) for r in pages.wikidata_sites(bodies(spark, json.dumps(b), "{}")).collect()] == [("00123456", "https://x.sk")]
    got = spark.createDataFrame([("06",), ("00",), ("zz",), (None,)], "c string").select(pages.least_employees(F.col("c")).alias("n")).collect()
    assert [r["n"] for r in got] == [10, None, None, None]
    (tmp_path / "b.csv").write_text("rank,name,registration_number,country,employees\n1,A,12,SK,5\nx,B,1,SK,6\n")
    rows = pages.benchmark_list(spark, str(tmp_path / "b.csv")).cache()
    assert [r["name"] for r in rows.where("broken IS NULL").collect()] == ["A"] and rows.where("broken IS NOT NULL").count() == 1


def test_warc(spark, tmp_path):
    record = lambda url, body, kind="response": f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\n\r\nHTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n{body}\r\n\r\n".encode()
    (tmp_path / "a.warc").write_bytes(record("https://x.sk/", "<p>é</p>") + record("https://x.sk/q", "", "request"))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record("https://y.sk/", "two")))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert sorted(tuple(r) for r in pages.warc_pages(files).collect()) == [("https://x.sk/", "<p>é</p>"), ("https://y.sk/", "two")]


def test_outcomes(spark):
    rows = [(200, None), (403, None), (404, None), (429, None), (503, None), (302, None), (None, "ROBOTS"), (None, "TIMEOUT"), (200, "TOO_LARGE")]
    got = spark.createDataFrame(rows, "s int, e string").select(pages.http_outcome(F.col("s"), F.col("e")).alias("o")).collect()
    want = [None, ("ACCESS_DENIED", False), ("NOT_FOUND", False), ("RATE_LIMITED", True), ("SERVER_ERROR", True), ("UNEXPECTED_STATUS", False), ("USE_FORBIDDEN", False), ("NETWORK", True), ("TOO_LARGE", False)]
    assert [tuple(r["o"]) if r["o"] else None for r in got] == want


def test_schemas(spark):
    for name in schemas.DDL:
        assert len(schemas.schema(name)) > 1
    bad = spark.createDataFrame([(1, 1, "BOSS"), (1, 1, "GROUP"), (None, 2, "AGENCY")], "company_id long, source_id long, role string")
    assert {r["rule"]: r["n"] for r in schemas.violations("company_source", bad).collect()} == {"unique company_id, source_id": 1, "not null company_id, source_id": 1, "role allowed": 1}
    runs = spark.createDataFrame([(1, "COMPLETE", None), (2, "PARTIAL", None), (3, "COMPLETE", "X")], "id long, state string, reason string")
    assert [r["n"] for r in schemas.violations("crawl_run", runs).collect()] == [2]
    assert schemas.violations("position", spark.createDataFrame([], schemas.schema("position"))).count() == 0
