"""Brands of companies, site checks, sinks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from postlake import sinks
from postlake.matching import brands


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("ACME, s.r.o.", ["acme"]),
        ("Tatra banka, a.s.", ["tatra", "tatrabanka"]),
        ("Ing. Ján Novák", ["ingjan"]),
        ("Dr.Max a.s.", ["drmax"]),
        ("J.S.B. Stav", []),
        ("I B M Slovensko", ["ibm"]),
        ("firma.com, spol. s r.o.", ["firma"]),
        ("Spojená škola", []),
        ("", []),
        (None, []),
    ],
)
def test_brand_keys(name, want):
    assert brands.keys(name) == want


def test_addresses():
    got = brands.addresses("Marks & Spencer Slovakia")
    assert {"www.marks.sk/", "www.marks-spencer.sk/", "www.marksandspencer.com/", "kariera.marks.sk/", "www.marks.com/sk/"} <= set(got) and len(got) == len(set(got)) <= 38
    assert "www.alza.sk/" in brands.addresses("Alza.sk s.r.o.")


def test_confirmed():
    text = "Acme je firma na Slovensku. " + "slovo " * 40
    assert brands.confirmed("ACME s.r.o.", "www.acme.sk", "Acme", text, "<p>")
    assert not brands.confirmed("ACME s.r.o.", "www.acme.sk", "Acme", "Acme", "<p>")
    assert not brands.confirmed("ACME s.r.o.", "www.acme.sk", "Acme", text, "this domain is for sale")
    assert not brands.confirmed("ACME s.r.o.", "www.other.sk", "Acme", text, "<p>")
    assert not brands.confirmed("ACME Lodge s.r.o.", "www.acme.sk", "Acme", text, "<p>")
    assert brands.confirmed("IBM s.r.o.", "www.ibm.com", "IBM", "ibm slovakia " + text, "") and not brands.confirmed("IBM s.r.o.", "www.ibm.com", "x", "ibm slovakia " + text, "")


def test_mail_hosts():
    assert brands.mail_names_company("tatrabanka.sk", "Tatra banka, a.s.") and not brands.mail_names_company("gmail.com", "Gmail s.r.o.")
    assert brands.mail_names_company("abcd.sk", "Alfa Beta Cenkov Dom") and not brands.mail_names_company(None, None)


def test_days_and_tables(spark, tmp_path):
    path = f"{tmp_path}/metrics"
    rows = lambda: sorted((r["day"], r["value"]) for r in spark.read.schema("value int, day string").parquet(path).collect())
    make = lambda *x: spark.createDataFrame(list(x), "day string, value int")
    sinks.overwrite_days(make(("d1", 1), ("d2", 2)), path)
    sinks.overwrite_days(make(("d2", 3), ("d2", 4)), path)
    assert rows() == [("d1", 1), ("d2", 3), ("d2", 4)]
    table = f"{tmp_path}/table"
    for n in (3, 1):
        sinks.replace_table(spark.range(n), table)
        assert spark.read.parquet(table).count() == n
    assert sorted(p.name for p in tmp_path.iterdir()) == ["metrics", "table"]


def test_snapshots_and_digest(spark, tmp_path):
    path = f"{tmp_path}/snapshots"
    bodies = spark.createDataFrame([(1, "2026-01-01", "a"), (1, "2026-01-01", "a"), (2, "2026-01-01", "a"), (1, "2026-02-01", "a")], "source_id int, day string, body string")
    sinks.put_snapshots(bodies, path)
    assert spark.read.parquet(path).count() == 3
    assert sinks.purge_snapshots(spark, path, "2026-01-15") == ["day=2026-01-01"] and spark.read.parquet(path).count() == 1
    lines = spark.createDataFrame([(1, i, f"t{i}", "u", i % 3) for i in range(5)], "user_id int, vacancy_id int, title string, url string, opened int")
    r = sinks.digest_texts(lines, most=2).collect()[0]
    assert (r["total"], r["body"]) == (5, "- t2 <u>\n- t1 <u>")
    assert spark.range(1).select(F.length(sinks.snapshot_key(F.lit(3), F.lit("x"))).alias("n")).collect()[0]["n"] == 66


def test_next_pages(spark):
    from postlake.matching.career_pages import next_pages

    rows = [("https://x.sk/k", 0, "https://x.sk/k", "1", None), ("https://x.sk/k", 1, "https://x.sk/k?strana=2", "2", None), ("https://x.sk/k", 2, "https://x.sk/k?strana=3", "Ďalej »", None), ("https://y.sk/k?page=2", 0, "https://y.sk/k?page=3", "3", None), ("https://z.sk", 0, "https://z.sk/2", "weiter", "NEXT"), ("https://w.sk", 0, "https://w.sk/a", "a", None)]
    got = {r["page"]: r["url"] for r in next_pages(spark.createDataFrame(rows, "page string, at int, url string, text string, rel string")).collect()}
    assert got == {"https://x.sk/k": "https://x.sk/k?strana=3", "https://y.sk/k?page=2": "https://y.sk/k?page=3", "https://z.sk": "https://z.sk/2"}


def test_pages_confirmed(spark):
    text = "acme slovensko " * 20
    rows = [(1, "ACME s.r.o.", "WWW.acme.sk", "Acme", text, None), (2, None, "www.acme.sk", "Acme", text, ""), (3, "ACME s.r.o.", None, None, text, ""), (4, "ACME s.r.o.", "www.acme.sk", None, None, None), (5, "ACME s.r.o.", "www.acme.com", None, text * 2000, "")]
    df = spark.createDataFrame(rows, "id int, name string, host string, title string, text string, html string")
    got = {r["id"]: r["ok"] for r in df.select("id", brands.page_confirmed(F.col("name"), F.col("host"), F.col("title"), F.col("text"), F.col("html")).alias("ok")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: True}


def test_employers_by_hand(spark):
    from postlake.sources import employers

    names = employers.parsed('{"employers": [{"provider": "w", "board": "b", "name": " Old "}, {"provider": "w", "board": "b", "name": "New"}, {"provider": "w", "board": "none", "name": "X"}]}')
    rows = [(1, "w", "b", "System"), (2, "w", "c", "Kept"), (3, "w", None, None), (4, None, "b", "Kept")]
    df = spark.createDataFrame(rows, "id int, provider string, board string, employer_name string")
    assert {r["id"]: r["employer_name"] for r in employers.named(df, names).collect()} == {1: "New", 2: "Kept", 3: None, 4: "Kept"}
    assert employers.named(df, ()).count() == 4
    with pytest.raises(ValueError, match="without"):
        employers.parsed('{"employers": [{"provider": "w", "board": " ", "name": "X"}]}')


def test_work_queues(spark):
    import datetime as dt

    from postlake.plans import market

    at, old, new = dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 9)
    companies = spark.createDataFrame([(1, "A", "SK", "123", None, 0, old), (2, "B", "SK", "00000456", None, 5, None), (3, "C", "SK", "789", "2024-01-01", 9, None), (4, "D", "CZ", "123", None, 9, None), (5, "E", "SK", None, None, 0, new)], "id int, name string, country string, registration_number string, terminated_on string, priority int, employees_checked_at timestamp_ntz")
    on, off = (spark.createDataFrame([("SK", x)], "country string, active boolean") for x in (True, False))
    assert [r["id"] for r in market.sizes_to_check(companies, on, "SK", at, 9).collect()] == [2, 1]
    assert market.sizes_to_check(companies, off, "SK", at, 9).count() == 0
    portal = spark.createDataFrame([("00000123", None, old), ("00000456", new, None), ("00000789", None, None), (None, None, None)], "registration_number string, site_checked_at timestamp_ntz, profesia_checked_at timestamp_ntz")
    assert [tuple(r) for r in market.employers_for_sites(portal, companies, on, "SK", at, 9).collect()] == [("00000123", 1, "A")]
    sources = spark.createDataFrame([(7, "p", "00000123"), (8, "p", "00000456"), (9, "q", "00000123")], "id int, provider string, board string")
    offers = [(7, "profesia:1", "u1", None, old), (7, "profesia:2", "u2", None, new), (7, "x:3", "u0", None, new), (8, "profesia:4", "u4", new, new), (9, "profesia:5", "u5", None, new), (7, "profesia:6", "u9", None, new)]
    postings = spark.createDataFrame(offers, "source_id int, external_id string, url string, closed_at timestamp_ntz, last_confirmed_at timestamp_ntz")
    assert [tuple(r) for r in market.employers_for_offers(portal, companies, on, sources, postings, "p", "SK", at, 9).collect()] == [("00000123", 1, "u2")]
