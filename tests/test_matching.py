"""Positions, places, languages, neighbours."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.matching import languages, locations, neighbours, positions

D = positions.Dictionary(
    (
        positions.Position("JAVA", titles=("java developer",), roles=("developer", "engineer"), keywords=("java", "spring"), exclude=("javascript",)),
        positions.Position("CPP", titles=("c++ developer",), roles=("developer",), keywords=("c++", ".net")),
    ),
    content_hits=2,
    other=("ruby",),
)


@pytest.mark.parametrize(
    ("title", "text", "want"),
    [
        ("Senior Java Developer", "", [("JAVA", "title: java developer")]),
        ("Developer – Spring", "", [("JAVA", "title: developer + spring")]),
        ("Developer", "We use Java. Java only.", [("JAVA", "title: developer; text: java x2")]),
        ("Developer", "We use Java.", []),
        ("Ruby developer", "java java java", []),
        ("JavaScript developer", "java java", []),
        ("C++ Developer", "", [("CPP", "title: c++ developer")]),
        ("Developer (.NET)", "", [("CPP", "title: developer + .net")]),
        ("Vývojár", "java java", []),
        (None, None, []),
    ],
)
def test_positions(spark, title, text, want):
    df = spark.createDataFrame([(title, text)], "t string, x string")
    got = df.select(positions.matches(D, positions.normal(F.col("t")), positions.normal(F.col("x"))).alias("m")).collect()[0]["m"]
    assert [(m["code"], m["explanation"]) for m in got] == want


@pytest.mark.parametrize(
    ("where", "want"),
    [
        (["Bratislava, Slovakia"], ["SK"]),
        (["SVK.Bratislava"], ["SK"]),
        (["IND - Telangana - Hyderabad (Raheja)"], ["IN"]),
        (["Remote - EU"], sorted(locations.EU)),
        (["Vienna or Bratislava", None], ["SK"]),
        (["Bratislava old town"], ["SK"]),
        (["Worldwide"], ["*"]),
        (["2 Locations", ""], []),
    ],
)
def test_places(where, want):
    assert locations.Places({"bratislava": "SK", "hyderabad": "IN"}).countries_of(where) == want


def test_countries_fall_back(spark):
    f = locations.countries({"bratislava": "SK"}, {"kosice": "SK", "banska bystrica": "SK"})
    df = spark.createDataFrame([(["?"], "Tester Banská Bystrica", None), (["?"], "x", "CZ"), (None, None, None), (["Bratislava"], "x", "CZ")], "w array<string>, t string, p string")
    assert [r["c"] for r in df.select(f("w", "t", "p").alias("c")).collect()] == [["SK"], ["CZ"], [], ["SK"]]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("Fluent English required. German is a plus.", [("de", False), ("en", True)]),
        ("<ul><li>anglický jazyk – pokročilý (B2)</li><li>nemecký jazyk výhodou</li></ul>", [("de", False), ("en", True)]),
        ("&lt;p&gt;Deutsch fließend&lt;/p&gt;", [("de", True)]),
        ("angol nyelvtudás", [("en", True)]),
        ("znalosť českého jazyka", [("cs", True)]),
        ("English breakfast", []),
        ("English is a plus. English required.", [("en", True)]),
        ("", []),
        (None, []),
    ],
)
def test_languages(html, want):
    assert [(r["language"], r["required"]) for r in languages.requirements(html)] == want


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    unit = lambda n: (x := rng.normal(size=(n, 8))) / np.linalg.norm(x, axis=1, keepdims=True)
    q, e, codes = unit(40), unit(200), rng.integers(0, 5, 200)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "id long, vector array<double>")
    examples = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(codes, e, strict=True))], "example long, code long, vector array<double>")
    a = {r["id"]: r["code"] for r in neighbours.vote(queries, examples, least=0.7).collect()}
    neighbours.NATIVE_ROWS, kept = 10, neighbours.NATIVE_ROWS
    c = {r["id"]: r["code"] for r in neighbours.vote(queries, examples, least=0.7).collect()}
    neighbours.NATIVE_ROWS = kept
    assert a == c and 0 < len(a) <= 40


def test_neighbours_in_many_blocks(spark, monkeypatch):
    """No number of examples is refused; equal vectors tie by example; a query's own vector may be left out."""
    for name, value in (("NATIVE_ROWS", 10), ("BLOCK_ROWS", 16)):
        monkeypatch.setattr(neighbours, name, value)
    monkeypatch.setattr(neighbours, "MOST_ROWS", 50, raising=False)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(120, 8))
    v[40:70] = v[5]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    codes = rng.integers(0, 5, 120)

    def brute(i, own):
        s = np.round(v @ v[i], 12)
        near = [j for j in np.lexsort((np.arange(120), -s)) if own or j != i][: neighbours.K]
        total = {}
        for j in near:
            total[codes[j]] = total.get(codes[j], 0.0) + s[j]
        return max(total, key=lambda c: round(total[c], 9)) if s[near[0]] >= 0.3 else None

    rows = spark.createDataFrame([(i, int(c), x.tolist()) for i, (c, x) in enumerate(zip(codes, v, strict=True))], "example long, code long, vector array<double>")
    queries = rows.where("example % 3 = 0").selectExpr("example AS id", "vector")
    for own, made in ((True, neighbours.vote(queries, rows, least=0.3)), (False, neighbours.vote_all(queries, rows, least=0.3, own=False))):
        got = {r["id"]: r["code"] for r in made.collect()}
        assert got == {i: c for i in range(0, 120, 3) if (c := brute(i, own)) is not None}
