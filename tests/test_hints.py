"""Hints and kept-up examples by hand."""

from __future__ import annotations

import datetime as dt
import itertools

from postlake.matching import examples, hints

NONE = dt.datetime(2024, 1, 1)


def hits(spark, name, *terms):
    titles = spark.createDataFrame([("s", name), ("other", None), ("other", "")], "slug string, name string")
    rows = [(i, "TITLE", t) for i, t in enumerate(terms)]
    return {terms[r["position_id"]] for r in hints.term_hits(titles, spark.createDataFrame(rows, "position_id int, kind string, term string")).collect()}


def test_terms_are_whole_words(spark):
    assert hits(spark, "IT Architect", "architect", "IT", "arch", "it architect", "architect it") == {"architect", "IT", "it architect"}
    assert hits(spark, "Senior C++/.NET dev", "c++", "c", ".net", "net", "dev", "c+++") == {"c++", "c", ".net", "net", "dev"}
    assert hits(spark, "Žena – šéf\nkuchár", "šéf\nkuchár", "kuchár", "ef", "žena") == {"šéf\nkuchár", "kuchár", "žena"}
    assert hits(spark, "a \\E+ b ??", "\\e+", "+", "?", "??", " ", "", None) == {"\\e+", "?", "??"}  # + stands behind a letter
    assert hits(spark, "(x) y", "x", "(x)", "x)", "[x]") == {"x", "(x)", "x)"}


def test_long_titles_and_repeats(spark):
    long = "word " * 100_000 + "last"
    titles = spark.createDataFrame([("s", long), ("s", long)], "slug string, name string")
    terms = spark.createDataFrame([(1, "TITLE", "word last"), (1, "TITLE", "Word Last"), (2, "TITLE", "last word")], "position_id int, kind string, term string")
    assert [tuple(r) for r in hints.term_hits(titles, terms).collect()] == [("s", 1, "TITLE")]


GROUPS = [("G1", "One"), ("G1", "One"), ("G2", "Two"), ("G3", "Three"), (None, "None")]


def test_dictionary_hints(spark):
    groups = spark.createDataFrame(GROUPS, "code string, name string")
    positions = spark.createDataFrame([(1, "Architect", True, "G1"), (2, "Developer", True, "G2"), (3, "Tester", False, "G3"), (4, "Analyst", True, None), (5, "Agile", True, "G1"), (6, "Cook", True, "G9"), (7, "Nobody", True, "G3")], "id int, name string, active boolean, occupation_code string")
    terms = spark.createDataFrame([(2, "ROLE", "programmer"), (2, "KEYWORD", "python"), (1, "EXCLUDE", "landscape"), (5, "TITLE", "architect"), (7, None, "python")], "position_id int, kind string, term string")

    def of(name):
        got = hints.dictionary_hints(spark.createDataFrame([("s", name)], "slug string, name string"), positions, terms, groups).collect()
        return {(r["code"], r["group_name"], r["hint"]) for r in got}

    assert of("IT architect") == {("G1", "One", "dictionary: Agile")}
    assert of("Landscape architect") == {("G1", "One", "dictionary: Agile")} and of("Landscape") == set()
    assert of("Python Programmer") == {("G2", "Two", "dictionary: Developer")}
    assert of("Programmer") == of("Python") == of("Tester") == of("Analyst") == of("Cook") == set()


def test_votes_and_unseen(spark):
    ads = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, "a"), (4, "a"), (5, "c"), (None, "a")], "num long, slug string")
    rows = [(10, "profesia:1", None, None, None), (10, "x", None, "G1", "G2"), (11, "profesia:2", None, "G2", None), (12, "profesia:3", None, None, None), (13, "profesia:4", NONE, "G3", None), (14, "profesia:5", None, None, None), (None, "profesia:5", None, "G3", None), (15, None, None, "G3", None)]
    postings = spark.createDataFrame(rows, "vacancy_id long, external_id string, closed_at timestamp, occupation_code string, title_occupation_code string")
    positions = spark.createDataFrame([("a", "A", None), ("a", "A", None), ("b", "B", "G1"), ("c", "C", None), ("d", "D", None)], "slug string, name string, code string")
    dictionary = spark.createDataFrame([(1, "P", True, "G3"), (2, "Q", True, None)], "id int, name string, active boolean, occupation_code string")
    matches = spark.createDataFrame([(12, 1), (12, 1), (14, 2), (None, 1)], "vacancy_id long, position_id int")
    groups = spark.createDataFrame(GROUPS, "code string, name string")
    links = hints.ad_vacancies(ads, postings)
    assert {tuple(r) for r in links.collect()} == {("a", 10), ("a", 11), ("a", 12), ("b", 10), ("c", 14)}
    codes = hints.known_codes(positions, links, postings, matches, dictionary)
    got = [(r["code"], r["rank"], r["hint"]) for r in hints.neighbour_hints(links, codes, groups).where("slug = 'a'").orderBy("rank").collect()]
    assert got == [("G2", 1, "2 of 3 ads"), ("G1", 2, "1 of 3 ads"), ("G3", 3, "1 of 3 ads")]
    assert hints.neighbour_hints(links, codes, groups, 1).where("slug = 'a'").count() == 1
    assert {tuple(r) for r in hints.unmapped(positions, links, postings, matches).collect()} == {("a", "A", 3, 0), ("c", "C", 1, 0)}
    assert {tuple(r) for r in hints.unmapped(positions, links, postings.where("vacancy_id = 12"), matches.limit(0)).collect()} == {("a", "A", 3, 2), ("c", "C", 1, 1)}
    for empty in (hints.unmapped(positions, links.limit(0), postings, matches), hints.neighbour_hints(links, codes.limit(0), groups)):
        assert empty.count() == 0


POSTINGS = "vacancy_id long, title string, occupation_code string, title_occupation_code string, closed_at timestamp"


def test_increments_equal_one_computation(spark):
    rows = [(i, f"{'Cook' if i % 3 else 'COOK'} {i % 7}{' (m/ž)' if i % 2 else ''}", f"G{i % 7 + (i == 41)}" if i % 5 else None, None, None) for i in range(60)]
    rows += [(99, None, "G1", None, None), (99, "(x)", "G1", None, None), (99, "", "G1", None, None), (99, "y" * 301, "G1", None, None), (99, "y" * 300, "G1", None, None)]
    full = spark.createDataFrame(rows, POSTINGS)
    whole = {tuple(r) for r in examples.title_states(full).collect()}
    for order in itertools.permutations(range(3)):
        states = examples.title_states(full.limit(0))
        for i in order:
            states = examples.merged_states(states, examples.title_states(spark.createDataFrame(rows[i::3], POSTINGS)))
        assert {tuple(r) for r in states.collect()} == whole
    labels = spark.createDataFrame([("Kuchár", "sk", "G1"), ("Koch", "de", "G1"), ("Kuchár", "sk", "G1")], "label string, language string, code string")
    got = {(r["source"], r["example"], r["code"]) for r in examples.examples(examples.title_states(full), labels).collect()}
    assert got == {("PORTAL", f"cook {k}", f"G{k}") for k in range(7) if k != 6} | {("PORTAL", "y" * 300, "G1"), ("ESCO", "Kuchár", "G1")}


def test_cap_counts_known_ones(spark):
    wanted = spark.createDataFrame([(s, f"{s}{i}", "t", "G1") for s in ("PORTAL", "ESCO") for i in range(4)], "source string, example string, text string, code string")
    known = spark.createDataFrame([("PORTAL", "PORTAL0", "G1", "new"), ("PORTAL", "PORTAL1", "G1", "old")], "source string, example string, code string, model string")
    names = lambda **how: [r["example"] for r in examples.pending(wanted, known, "new", **how).collect()]
    assert sorted(names(per_code=3)) == ["PORTAL1", "PORTAL2"]
    assert sorted(names(per_code=5)) == ["ESCO0", "PORTAL1", "PORTAL2", "PORTAL3"]
    assert names(most=2) == ["PORTAL1", "PORTAL2"] and len(names()) == 7 and names(per_code=1) == []
    saved = examples.save_examples(known.selectExpr("source", "example", "code", "'t' AS text", "model"), wanted, "new")
    assert saved.count() == 8 and examples.pending(wanted, saved, "new").count() == 0


def test_answers(spark):
    rows = [(1, "Cook", None, None, None), (2, "COOK (m/ž)", None, None, None), (3, "cook", "G1", None, None), (4, "Cook", None, "G4", None), (5, "Cook", None, None, NONE), (6, None, None, None, None), (7, "(x)", None, None, None), (8, "Baker", None, None, None), (9, "Driver", None, None, None)]
    postings = spark.createDataFrame(rows, POSTINGS)
    answers = spark.createDataFrame([("baker", "G8", "old")], "title_key string, code string, model string")
    matches = spark.createDataFrame([(9,), (9,)], "vacancy_id long")
    assert [tuple(r) for r in examples.uncoded(postings, matches, answers).collect()] == [("cook", "COOK (m/ž)", 2)]
    batch = spark.createDataFrame([("Cook", "G2"), ("COOK", "G3"), ("Baker", "G9"), ("Driver", ""), (None, "G1"), ("(x)", "G1")], "title string, code string")
    cache = examples.save_answers(answers, batch, "new")
    assert {tuple(r) for r in cache.collect()} == {("baker", "G8", "old"), ("cook", "G3", "new"), ("driver", None, "new")}
    assert {tuple(r) for r in examples.save_answers(cache, batch, "newer").collect()} == {tuple(r) for r in cache.collect()}
    got = {r["vacancy_id"]: r["title_occupation_code"] for r in examples.propagated(postings, cache).collect()}
    assert got == {1: "G3", 2: "G3", 3: None, 4: "G4", 5: None, 6: None, 7: None, 8: "G8", 9: None}
    again = examples.propagated(examples.propagated(postings, cache), cache)
    assert again.columns == postings.columns and {r["vacancy_id"]: r["title_occupation_code"] for r in again.collect()} == got
