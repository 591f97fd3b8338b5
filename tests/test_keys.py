"""Keys and places on golden values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from postlake.functions import keys, places, scalars


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize("title", ["Skladník", "SKLADNÍK (m/ž)", "Skladník muž/žena", "Skladník 1 500 €", "Skladník od 1200 EUR/mes. brutto", "Skladník (TOBI TEAN s.r.o.)", "skladník - 900,- €"])
def test_title_key(spark, title):
    text = title.replace("(m/ž)", "m/ž")
    assert one(spark, keys.title_key(F.lit(text))) == "skladnik"
    assert one(spark, keys.same_title(F.lit(title))) == "skladnik"


def test_parentheses_stay_in_identity(spark):
    assert one(spark, keys.title_key(F.lit("Predavač (Popradská)"))) == "predavac popradska"
    assert one(spark, keys.same_title(F.lit("Predavač (Popradská)"))) == "predavac"
    assert one(spark, keys.title_key(F.lit(None).cast("string"))) == ""
    assert one(spark, keys.same_title(F.lit(None).cast("string"))) is None


def test_heads(spark):
    assert one(spark, keys.title_head(F.lit("Kuchár/ka (muž/žena)"))) == "kuchar"
    assert one(spark, keys.title_head(F.lit("Vodič  sk. B - Nitra"))) == "vodic sk. b"


@pytest.mark.parametrize(
    ("location", "want"),
    [
        ("Topoľčany - Topoľčany", ["c:topolcany"]),
        ("okres Topolčany", ["c:topolcany"]),
        ("Hlavná 19, 949 01 Nitra", ["c:nitra"]),
        ("Bratislava-Petržalka; Košice IV", ["c:bratislava", "c:kosice"]),
        ("Žilinský kraj", ["r:zilinsky kraj"]),
        ("Slovensko", []),
        ("Remote", []),
        ("", []),
        (None, []),
    ],
)
def test_places(spark, location, want):
    assert one(spark, places.places(F.lit(location).cast("string"))) == want


def test_relation(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    rel = lambda x, y: one(spark, places.relation(x, y))
    assert rel(a("c:x"), a("c:x", "c:y")) == "same" and rel(a("c:x"), a("c:y")) == "different"
    assert rel(a("r:x"), a("r:x")) == "same" and rel(a("c:x"), a("r:x")) == "loose" and rel(F.lit(None).cast("array<string>"), a()) == "loose"


def test_addresses(spark):
    assert one(spark, keys.clean_address(F.lit("https://www.X.sk/a/?utm_source=b&id=5&source=c#top"))) == "x.sk/a/?id=5"
    assert one(spark, keys.clean_address(F.lit("http://x.sk/a/?search_id=1"))) == "x.sk/a"
    assert one(spark, keys.link_key(F.lit("https://x.sk/sk-SK/job/?job=12#a"))) == "x.sk/job/?job=12"
    for ext, url in (("profesia:1234567", None), (None, "https://www.profesia.sk/praca/firma/O1234567"), ("x", "https://kaufland.profesia.sk/O1234567?a")):
        assert one(spark, keys.offer_number(F.lit(ext).cast("string"), F.lit(url).cast("string"))) == "1234567"
    assert one(spark, keys.name_slug(F.lit("Ťažký & syn, spol. s r. o."))) == "tazky-syn"
    assert one(spark, keys.registrable(F.lit("a.b.co.uk"))) == "b.co.uk" and one(spark, keys.registrable(F.lit("jobs.x.sk"))) == "x.sk"
    b = one(spark, keys.board(F.lit("https://acme.wd3.myworkdayjobs.com/en-US/Careers/job/1")))
    assert (b["provider"], b["board"]) == ("WORKDAY", "acme.wd3/careers")
    assert one(spark, keys.percent_decoded(F.lit("100%"))) == "100%" and one(spark, keys.percent_decoded(F.lit("a%20b"))) == "a b"


def test_scalars(spark):
    assert str(one(spark, scalars.portal_date(F.lit("od 3.11.2026")))) == "2026-11-03" and one(spark, scalars.portal_date(F.lit("31.2.2026"))) is None
    assert one(spark, scalars.split_list(F.lit(""))) == [] and one(spark, scalars.split_list(F.lit("a,b"))) == ["a", "b"]
    assert one(spark, scalars.html_text(F.lit("&lt;p&gt;a&amp;amp;b&lt;/p&gt;"))) == "a&b"
    assert one(spark, scalars.backoff(5, 60, F.lit(10))) == 60.0
    lo, hi = scalars.day_bounds(F.lit("2024-03-31").cast("date"), "Europe/Bratislava")
    assert (one(spark, hi) - one(spark, lo)).total_seconds() == 23 * 3600


def test_boards_in_pages(spark):
    rows = [
        (None, None), ("https://jobs.zf.com/x", "<link href='//rmkcdn.successfactors.com/y'>"), (None, "<link href='//rmkcdn.successfactors.com/y'>"),
        ("https://k.sk", '"https://ats.nalgoo.com/api", "organization" : "Foxconn"'), ("https://k.sk", '"organization" : "foxconn"'),
        ("https://k.sk", 'https:\\/\\/mol.taleo.net\\/careersection\\/external\\/jobsearch.ftl https://mol.taleo.net/careersection/External/jobdetail.ftl xmol.taleo.net/careersection/1/else.ftl'),
        ("https://k.sk", 'cdn.phenompeople.com "baseUrl":"https://careers.dhl.com/eu/sk/" <a href="https://boards.greenhouse.io/acme">'),
    ]
    got = spark.createDataFrame(rows, "page string, html string").select(keys.boards_in_page(F.col("page"), F.col("html")).alias("b")).collect()
    assert [sorted((x["provider"], x["board"]) for x in r["b"]) for r in got] == [[], [("SUCCESSFACTORS", "jobs.zf.com")], [], [("NALGOO", "foxconn")], [], [("TALEO", "mol.taleo.net/external")], [("GREENHOUSE", "acme"), ("PHENOM", "careers.dhl.com/eu/sk")]]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://x.sk/a?search_id=1", "https://x.sk/a"),
        ("https://x.sk/a?search_id=1&id=2", "https://x.sk/a?id=2"),
        ("https://x.sk/a?id=2&utm_source=b&utm_term=#top", "https://x.sk/a?id=2#top"),
        ("https://x.sk/a?utm_source=b&search_id=3&id=2", "https://x.sk/a?&id=2"),
        ("https://x.sk/a?filter=tpp#list?x", "https://x.sk/a#list?x"),
        ("https://x.sk/a?id=filter&myfilter=1", "https://x.sk/a?id=filter&myfilter=1"),
        ("", ""),
        (None, None),
    ],
)
def test_without_session(spark, url, want):
    assert one(spark, keys.without_session(F.lit(url).cast("string"))) == want
