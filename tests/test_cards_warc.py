"""Cards of career pages by their tree, and crawl records by byte ranges."""

from __future__ import annotations

import gzip

from postlake.sources import cards, warc

PAGE = "https://www.e.sk/kariera"


def seen(html):
    return [(c["url"].rsplit("/", 1)[-1], c["title"], c["place"]) for c in cards.cards(html, PAGE)]


def test_titles_and_places():
    assert seen("<ul><li><a href=/kariera/1><h3>Nurse</h3>Penta Hospitals</a> Senec<li><a href=/kariera/2>Driver</a><p>Martin</ul>") == [("1", "Nurse", "Senec"), ("2", "Driver", "Martin")]
    assert seen("<div><h3>Nurse</h3><p>Senec</p><a href=/kariera/1>Viac informácií</a></div><div><h3>Driver</h3><a href=/kariera/2>Detail</a></div>") == [("1", "Nurse", "Senec"), ("2", "Driver", None)]
    assert seen("<li><a href=/kariera/1>10 Poradca</a></li><li><a href=/kariera/2>3 x Poradca</a></li>") == [("1", "Poradca", None), ("2", "3 x Poradca", None)]
    assert seen("<li><span class=job-title>Nurse</span><a href=/kariera/1>Apply now</a>") == [("1", "Nurse", "Nurse")]  # of the title only headings are no place
    # two buttons of one list: there is no card around both, so the text of the button stays, and a menu's word is no opening
    assert seen("<div><h2>Openings</h2><a href=/kariera/1>TPP</a><a href=/kariera/2>TPP</a><a href=/kariera/3>Viac</a><a href=/kariera/4>Viac</a></div>") == [("1", "TPP", None), ("2", "TPP", None)]


def test_what_is_no_opening():
    assert seen("<nav><a href=/a>One two</a></nav><header><a href=/b>One two</a></header><footer><a href=/c>One two</a></footer><a href=/d.pdf>One two</a><a href=https://other.sk/e>One two</a><a href='mailto:x@e.sk'>One two</a><a href=#f>One two</a><a href='http://[x'>One two</a>" + f"<a href=/g>{'word ' * 16}</a>") == []
    assert seen("<article><header><a href=https://jobs.e.sk/kariera/1>In an article</a></header></article>") == [("1", "In an article", None)]
    assert cards.cards(None) == cards.cards("") == [] and seen("<a href=/kariera/1>Unclosed <b>title") == [("1", "Unclosed title", None)]


def test_largest_list(spark):
    rows = [("a", PAGE, "<ul><li><a href=/kariera/1>One job</a> Senec<li><a href=/kariera/2>Two job</a><li><a href=/kariera/2>Two again</a><li><a href=/kariera/3>Three job</a></ul><div><p><a href=/kariera/x>Story one</a><p><a href=/kariera/y>Story two</a></div><ul><li><a href=/x/1>A b</a><li><a href=/x/2>C d</a><li><a href=/x/3>E f</a><li><a href=/x/4>G h</a></ul>"), ("b", PAGE, None), ("c", PAGE, "<a href=/x>No career path</a>")]
    got = cards.career_cards(spark.createDataFrame(rows, "board string, page string, body string")).orderBy("url").collect()
    assert [(r["board"], r["external_id"], r["title"], r["place_keys"]) for r in got] == [("a", "e.sk/kariera/1", "One job", ["c:senec"]), ("a", "e.sk/kariera/2", "Two job", []), ("a", "e.sk/kariera/3", "Three job", [])]


def test_ranges_of_one_file(spark, tmp_path):
    """Ten records of one file are read by several tasks, and nothing else is read."""
    rows = [("one.warc.gz", f"http://h/{i}", f"<p>číslo {i}" * 50) for i in range(100)]
    index = warc.write_files(spark.createDataFrame(rows, "file string, url string, body string"), f"file://{tmp_path}").collect()
    raw = bytearray((tmp_path / "one.warc.gz").read_bytes())
    wanted = [r for r in index if int(r["url"].rsplit("/", 1)[1]) % 10 == 3]
    for r in index:
        if r not in wanted:
            raw[r["offset"] : r["offset"] + r["length"]] = bytes(r["length"])  # what isn't named can't be read
    (tmp_path / "one.warc.gz").write_bytes(raw)
    broken = [(wanted[0]["path"], wanted[0]["offset"] + 5, "x", wanted[0]["length"]), (wanted[0]["path"], wanted[0]["offset"], "x", 20), (None, 0, "x", 5), (wanted[0]["path"], 0, "x", 0)]
    read = warc.read_ranges(spark.createDataFrame([*wanted, *broken], "path string, offset long, url string, length long"), parallel=8, stretch=1500)
    got = read.select("url", "body", warc.F.spark_partition_id().alias("task")).collect()
    assert {(r["url"], r["body"]) for r in got} == {(u, b) for _, u, b in rows if int(u.rsplit("/", 1)[1]) % 10 == 3} and len(got) == 10 and len({r["task"] for r in got}) > 2


def test_records_of_a_stream(tmp_path):
    one, two = (warc.compose([("WARC-Type", "response"), ("WARC-Target-URI", f"http://h/{i}")], b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n\xe9" * i) for i in (1, 2))
    for name, raw in (("zipped", gzip.compress(one) + gzip.compress(two)), ("plain", one + two), ("cut", gzip.compress(one) + gzip.compress(two)[:-9]), ("none", b"")):
        (tmp_path / name).write_bytes(raw)
    read = {name: [(a, n, warc.body_text(r.block)) for a, n, r in warc.records(f"file://{tmp_path}/{name}")] for name in ("zipped", "plain", "cut", "none")}
    assert len(read["zipped"]) == len(read["plain"]) == 2 and len(read["cut"]) == 1 and read["none"] == [] and read["plain"][0] == (0, len(one), "é")
    assert read["zipped"][1][:2] == (len(gzip.compress(one)), len(gzip.compress(two)))
