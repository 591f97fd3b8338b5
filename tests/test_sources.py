"""Parsers on small payloads of the feeds' shapes."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from postlake.sources import parsers, registries


def bodies(spark, *texts):
    return spark.createDataFrame([("acme", t) for t in texts], "board string, body string")


def got(df):
    return [(r["external_id"], r["title"], r["location"], str(r["posted"]) if r["posted"] else None) for r in df.orderBy("external_id").collect()]


def test_greenhouse(spark):
    x = {"jobs": [{"id": 12, "title": " Dev ", "absolute_url": "u", "location": {"name": "Nitra"}, "first_published": "2026-01-05T10:00:00Z", "content": "&lt;p&gt;"}, {"id": 13}]}
    assert got(parsers.greenhouse(bodies(spark, json.dumps(x), "not json", "{}"))) == [("12", "Dev", "Nitra", "2026-01-05")]


def test_personio(spark):
    x = "<a><position><id>7</id><office>Brno</office><name><![CDATA[Ops & co]]></name><createdAt>2026-02-01T00:00:00</createdAt><jobDescriptions><jobDescription><name>T</name><value><![CDATA[one]]></value></jobDescription><jobDescription><value>two</value></jobDescription></jobDescriptions></position><position><id>8</id></position></a>"
    df = parsers.personio(bodies(spark, x))
    assert got(df) == [("7", "Ops & co", "Brno", "2026-02-01")] and df.collect()[0]["content"] == "one\ntwo"


def test_lists(spark):
    assert got(parsers.nalgoo(bodies(spark, json.dumps([{"id": "5", "title": "A", "location": "L", "publishedOn": "2026-01-01"}, {"id": "x", "title": "B"}])))) == [("5", "A", "L", "2026-01-01")]
    o = {"items": [{"requisitionList": [{"Id": "1", "Title": "A", "PrimaryLocation": "P", "PrimaryLocationCountry": "SK", "PostedDate": "2026-01-02"}, {"Id": "2", "Title": "B", "PrimaryLocationCountry": "DE", "secondaryLocations": [{"CountryCode": "SK"}]}, {"Id": "3", "Title": "C", "PrimaryLocationCountry": "DE"}]}]}
    assert [r[0] for r in got(parsers.oracle_cloud(bodies(spark, json.dumps(o)), "SK"))] == ["1", "2"]
    w = {"jobPostings": [{"externalPath": "/job/1", "title": "A", "locationsText": "2 Locations", "postedOn": "Posted 3 Days Ago"}, {"externalPath": "/job/2", "title": "B", "locationsText": "Brno", "postedOn": "Posted Today"}]}
    assert got(parsers.workday(bodies(spark, json.dumps(w)), F.lit("2026-03-02").cast("date"))) == [("/job/1", "A", None, "2026-02-27"), ("/job/2", "B", "Brno", "2026-03-02")]
    t = {"requisitionList": [{"contestNo": "9", "column": ["T", '["Brno","Praha"]']}]}
    assert got(parsers.taleo(bodies(spark, json.dumps(t)))) == [("9", "T", "Brno; Praha", None)]
    assert spark.range(1).select(parsers.taleo_blocks(F.lit("a%20b!*!100%!*!a%20b!*!")).alias("x")).collect()[0]["x"] == ["a b", "100%"]
    p = [{"uuid": "u1", "nazovPracovnehoMiesta": "Kuchár", "miestoVykonuPrace": "Nitra", "url": "x", "datumVytvorenia": "3.1.2026"}, {"uuid": "", "nazovPracovnehoMiesta": "B", "url": "https://www.profesia.sk/praca/x/O123456"}]
    assert [r[0] for r in got(parsers.state_portal(bodies(spark, json.dumps(p))))] == ["profesia:123456", "u1"]


def test_pages(spark):
    s = '<section class="openings-section opening"><h3>Brno</h3><ul><li><a href="https://jobs.x/Acme/743-dev"><h4 class="details-title job-title">Dev</h4></a></li></ul></section>'
    assert got(parsers.smartrecruiters(bodies(spark, s))) == [("743", "Dev", "Brno", None)]
    h = 'x phApp.ddo = {"eagerLoadRefineSearch":{"data":{"jobs":[{"jobId":"J1","title":"Dev {x}","location":"L","postedDate":"2026-01-09"}]}}}; other = {'
    assert got(parsers.phenom(bodies(spark, h, "nothing", "phApp.ddo = {broken"))) == [("J1", "Dev {x}", "L", "2026-01-09")]
    c = "".join(f'<a href="https://x.sk/kariera/{i}"><b>Job {i}</b></a>' for i in range(3)) + '<a href="https://x.sk/o-nas/1">About</a><a href="https://x.sk/jobs/z">One</a>'
    assert got(parsers.career_page(bodies(spark, c))) == [(f"x.sk/kariera/{i}", f"Job {i}", None, None) for i in range(3)]
    ld = lambda x: f'<script type="application/ld+json">{json.dumps(x)}</script>'
    job = {"@type": ["JobPosting"], "title": "Dev", "datePosted": "2026-01-01", "jobLocation": {"address": {"addressLocality": "Nitra", "addressCountry": {"name": "SK"}}}}
    pages = spark.createDataFrame([("u1", ld({"@graph": [{"@type": "Org"}, job]})), ("u2", ld([{"@type": "WebPage"}])), ("u3", '<script type="application/ld+json">{bad</script>' + ld(job)), ("u4", None)], "url string, body string")
    assert got(parsers.json_ld(pages)) == [("u1", "Dev", "Nitra, SK", "2026-01-01"), ("u3", "Dev", "Nitra, SK", "2026-01-01")]
    m = "".join(f"<loc>https://p.sk/praca/{e}/O{n}</loc>" for e, n in (("acme-s-r-o", 20), ("acme-s-r-o", 9), ("two", 5), ("two-a-s", 6)))
    assert [(r["employer"], r["ad_number"]) for r in parsers.sitemap(bodies(spark, m)).collect()] == [("acme", "9")]
    ad = spark.createDataFrame([("1", '<title>Dev, Acme | portal</title><h1>Dev</h1><span itemprop="address">Nitra</span><meta itemprop="datePosted" content="2026-01-01">'), ("2", "<title>captcha</title>")], "num string, body string")
    assert [(r["num"], r["title"], r["employer"], r["location"], str(r["posted"])) for r in parsers.offer_page(ad).collect()] == [("1", "Dev", "Acme", "Nitra", "2026-01-01")]


def test_accumulate(spark):
    pages = spark.createDataFrame([("a", "1", "x", 1), ("a", "1", "y", 2), ("a", "2", "z", 2), ("b", "1", "x", 1), ("d", "1", "x", 1)], "board string, external_id string, title string, page_no int")
    out = spark.createDataFrame([("a", 1, True, 2, 1, 9), ("a", 2, True, 2, 2, 9), ("b", 1, True, 5, 1, 9), ("b", 2, False, 5, 0, 9), ("c", 1, False, None, 0, 9), ("d", 1, True, 5, 1, 1)], "board string, page_no int, ok boolean, total int, rows int, budget int")
    first, reads = parsers.accumulate(pages, out)
    assert {r["board"]: r["state"] for r in reads.collect()} == {"a": "COMPLETE", "b": "PARTIAL:PAGE_FAILED", "c": "UNAVAILABLE", "d": "PARTIAL:PAGE_LIMIT"}
    assert first.where("board = 'a' AND external_id = '1'").collect()[0]["title"] == "x"


def test_registries(spark, tmp_path):
    records = [
        {"id": "1", "identifiers": [{"value": "123456"}], "fullNames": [{"value": "Old", "validTo": "2020"}, {"value": "New"}], "statisticalCodes": {"mainActivity": {"code": "78200"}}},
        {"id": "2", "identifiers": [{"value": "7"}], "fullNames": [{"value": "Ján", "validTo": "2020"}], "legalForms": [{"value": {"code": "101"}}]},
    ]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, records)))
    got_ = [tuple(r) for r in registries.companies(spark.read.schema(registries.RECORD).json(str(tmp_path / "r.json"))).collect()]
    assert got_ == [("SK", "00123456", "New", True, None)]
    geo = [("1", "Košice", "Kosice", "Kassa,KE", "SK", 229_000), ("2", "Kassa", "Kassa", "", "TZ", 10), ("3", "Hyderabad", "Hyderabad", "Haidarabad,HYD", "IN", 6_000_000), ("4", "Tiny", "Tiny", "Other name", "IN", 5)]
    df = spark.createDataFrame([(i, n, a, alt, c, p) for i, n, a, alt, c, p in geo], "geonameid string, name string, asciiname string, alternatenames string, country string, population long")
    assert {r["name"]: r["country"] for r in registries.cities(df).collect()} == {"kosice": "SK", "kassa": "SK", "ke": "SK", "hyderabad": "IN", "haidarabad": "IN", "tiny": "IN"}
    index = spark.createDataFrame([("f", k) for k in ("sk,a)/", "sk,acme)/b", "sk,acme)/x", "sk,z)/")], "file string, surt string")
    assert [r["surt"] for r in registries.index_blocks(index, "sk,acme)/").orderBy("surt").collect()] == ["sk,a)/", "sk,acme)/b", "sk,acme)/x"]
    web = spark.createDataFrame([("https://x.sk/", "<p>IČO: 11111111</p>"), ("https://x.sk/kontakt", "<p>IČO: 22222222</p>"), ("https://y.sk", "IČO 1234567 IČO 2234567 IČO 3234567 IČO 4234567")], "url string, body string")
    assert [tuple(r) for r in registries.numbers_on_pages(web).collect()] == [("x.sk", "22222222")]


@pytest.mark.parametrize(
    ("path", "want"),
    [("/", True), ("/a", False), ("/a/b", True), ("/a/x.pdf", False), ("/c?x=1", False), ("/exact", False), ("/exact/more", True)],
)
def test_robots(spark, path, want):
    rules = "User-agent: *\nDisallow: /a # all\nAllow: /a/b\nDisallow: /*.pdf$\nDisallow: /c?\nDisallow: /exact$\nUser-agent: bot\nDisallow: /"
    assert registries.allowed(rules, path) is want and registries.allowed(rules, path, "bot") is False and registries.allowed(None, path)


def test_robots_rows(spark):
    df = spark.createDataFrame([("User-agent: *\nDisallow: /a", "/a"), (None, None)], "rules string, path string")
    assert [r["allowed"] for r in registries.robots(df).collect()] == [False, True]
