"""Small cases of reviewers' findings; each failed before the finding was settled."""

from __future__ import annotations

import datetime as dt
import os
import random
import time

from pyspark.sql import functions as F

from postlake import tables
from postlake.functions import keys
from postlake.llm import op04_bpe
from postlake.llm.op02_tokens import load
from postlake.matching import hints, positions
from postlake.operators import identity, joins, merging, resolve
from postlake.plans import demo, market
from postlake.sources import parsers


def test_a_word_ends_with_marks_but_not_with_hash_or_full_stops(spark):
    texts = {"the": 1, "The, (the)": 2, "the.": 1, "the.***": 1, "the.###": 0, "the...": 0, "the's": 0, "x–the": 0, "–the –": 1, "ṫhe": 1, "the\tTHE\nthe": 3, "the the": 0, "": 0, None: None}
    rows = spark.createDataFrame(list(texts.items()), "text string, n int")
    got = rows.select("text", positions.word_count(positions.unmarked(F.col("text")), "the").alias("n")).collect()
    assert {r["text"]: r["n"] for r in got} == texts


def shuffled(spark, run) -> int:
    """Rows that all shuffles of an action wrote."""
    gateway = spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList()

    def total() -> int:
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_new_postings_of_a_title_are_not_paired_with_all_its_vacancies(spark):
    n = 600
    known = spark.range(n).select(F.lit(1).alias("source_id"), F.lit(None).cast("string").alias("external_id"), F.col("id").alias("vacancy_id"), F.lit("cook").alias("title_key"), F.array(F.concat(F.lit("c:t"), F.col("id") % 300)).alias("place_keys"))
    new = spark.range(n).select(F.col("id").alias("k"), F.lit(1).alias("source_id"), F.lit("cook").alias("title_key"), F.array(F.concat(F.lit("c:t"), F.col("id"))).alias("place_keys"))
    employers = spark.createDataFrame([(7, 1, None), (8, 1, None)], "company_id int, source_id int, external_id string")
    got = []
    rows = shuffled(spark, lambda: got.extend(identity.title_and_place(new, known, employers).collect()))
    assert {r["k"]: r["vacancy_id"] for r in got} == {k: k if k < 300 else None for k in range(n)}
    assert rows < 20 * n


def test_pairs_are_computed_once_for_a_batch(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for batch in rows:
            seen.add(len(batch))
            yield batch

    pairs = spark.createDataFrame([(2, 1, 3), (3, 2, 1), (5, 4, 2), (4, 6, 1)], "a long, b long, rank int").mapInPandas(count, "a long, b long, rank int")
    got = {tuple(r) for r in resolve.keepers(pairs, spark.createDataFrame([(4, 5)], "a long, b long")).select("merged", "kept", "rank").collect()}
    assert got == {(3, 2, 1), (6, 4, 1)}  # 2 goes to 1 later, as it keeps 3 in this batch
    assert seen.value == 4


def test_keys_of_several_parts_keep_them_apart(spark):
    rows = spark.createDataFrame([("a", "b"), ("a,b", ""), ("", "a,b"), ("a1:", "b"), ("a", "1:b"), (None, "a")], "x string, y string")
    got = [r["k"] for r in rows.select(identity._key(F.col("x"), F.col("y")).alias("k")).collect()]
    assert got[-1] is None and len(set(got)) == 6


def test_sitemap_query_lists_an_ad_once(spark, monkeypatch):
    counts, own = [], parsers.sitemap
    monkeypatch.setattr(parsers, "sitemap", lambda bodies: counts.append(bodies.count()) or own(bodies))
    demo.QUERIES["s14_sitemap"](spark, "/root/testdata/sf0.001").count()
    assert counts == [spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()]


def test_short_rows_of_one_file_are_spread(spark):
    rows = spark.range(12_000).coalesce(1)
    assert tables.spread(rows, 5_000).rdd.getNumPartitions() == 3 and tables.spread(rows, 12_000).rdd.getNumPartitions() == 1
    assert tables.spread(rows, 5_000).distinct().count() == 12_000 and tables.spread(rows.limit(0)).count() == 0


def test_pairs_of_a_key_are_dealt_in_blocks_and_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK_ROWS", 50)
    monkeypatch.setattr(joins, "TASK_PAIRS", 5_000)
    data = [(i, i % 3 if i % 7 else None) for i in range(300)]
    own = lambda rows: {(a, b) for a, k in rows for b, m in rows if k is not None and k == m and a < b}
    for rows in (data, data + [(5, 0), (5, 2), (8, 2), (9, 1), (9, 1)]):  # ids of several rows and keys
        df, got = spark.createDataFrame(rows, "id long, k long"), []
        moved = shuffled(spark, lambda df=df, got=got: got.extend(tuple(r) for r in joins.ordered_pairs(df, ["k"], "id").collect()))
        assert len(got) == len(set(got)) and set(got) == own(rows)
        assert rows is not data or moved < len(got) / 2
    near = joins.ordered_pairs(spark.createDataFrame(data, "id long, k long"), ["k"], "id", lambda x, y: F.col(f"{y}.id") - F.col(f"{x}.id") < 9)
    assert {tuple(r) for r in near.collect()} == {(a, b) for a, b in own(data) if b - a < 9}


def test_pairs_of_a_common_key_join_other_paths_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(joins, "TASK_PAIRS", 2_000)
    left, right = [(i, i % 2) for i in range(80)] + [(3, 0), (None, 1), (90, None)], [(i, i % 2) for i in range(80)] + [(4, 1), (4, 1), (91, None)]
    paths = [(1, 1), (1, 2), (1, 2), (None, 3), (None, None), (90, 91)]
    frame = lambda rows, b, c="c": spark.createDataFrame(rows, f"{c} long, {b} long")
    got = []
    moved = shuffled(spark, lambda: got.extend(tuple(r) for r in joins.matched_by_key(frame(paths, "k"), frame(left, "key"), frame(right, "key", "k"), "key").collect()))
    assert len(got) == len(set(got)) and set(got) == set(paths) | {(c, k) for c, x in left for k, y in right if x is not None and x == y}
    assert moved < len(got) / 2


def test_encoder_remembers_few_words_of_one_text_and_sends_no_text_back(spark, monkeypatch):
    path = op04_bpe.vocabulary_path(op04_bpe.VOCABULARY)
    text = " ".join(f"w{i % 700}x{i}" for i in range(3_000)) + " the w1x1 the" * 5
    want = op04_bpe.Bpe(path).encode_text(text)
    monkeypatch.setattr(op04_bpe, "MEMORY", 40)
    monkeypatch.setattr(op04_bpe, "PAIRS", 50)
    bpe = op04_bpe.Bpe(path)
    assert bpe.encode_text(text) == want and want[0] == len(want[1].split(","))
    assert len(bpe._known) + len(bpe._older) <= 40 and len(bpe._fits) <= 50
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = op04_bpe.digests(docs, keep_text=False)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and sorted(got.collect()) == sorted(op04_bpe.digests(docs).drop("text").collect())


def test_titles_are_dealt_by_slug_and_their_hits_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(hints, "TASK_TITLES", 100)
    titles = spark.range(600).selectExpr("'s' || id AS slug", "'a b c d e f g h i j' AS name").coalesce(1)
    terms = spark.createDataFrame([(i, "ROLE", w) for i, w in enumerate("abcdefghij")], "position_id int, kind string, term string")
    got = []
    moved = shuffled(spark, lambda: got.append(hints.term_hits(titles, terms).groupBy("slug").count().selectExpr("count(*) AS n", "sum(count) AS hits").collect()[0]))
    assert tuple(got[0]) == (600, 6_000) and moved < 1_000
    assert hints.term_hits(titles, terms).rdd.getNumPartitions() > 4
    assert hints.term_hits(titles.limit(0), terms).count() == 0


def test_matches_are_distinct_before_conditions_multiply_them(spark, monkeypatch):
    monkeypatch.setattr(market, "TASK_POSTINGS", 100)
    n, conditions = 400, 30
    frame = spark.createDataFrame
    t = {
        "condition_occupation": frame([(c, "G1") for c in range(conditions)] + [(0, None), (0, "G1"), (0, "P9")], "condition_id int, code string"),
        "condition_position": frame([(1, 9), (1, 9), (2, 8)], "condition_id int, position_id int"),
        "position": frame([(9, "P9", "G1"), (8, None, None)], "id int, code string, occupation_code string"),
        "vacancy_position_match": frame([(7, 9), (7, 8), (None, 9)], "vacancy_id long, position_id int"),
        "offer_position": frame([(5, "G1"), (6, "G7"), (5, None)], "num int, code string"),
        "job_posting": spark.range(2 * n).selectExpr("id div 2 AS vacancy_id", "if(id = 20, 'profesia:5', 'profesia:6') AS external_id", "if(id > 200, 'G1', NULL) AS occupation_code", "if(id > 300, 'G1', 'P9') AS title_occupation_code"),
        "vacancy": spark.range(n + 50).selectExpr("id", "CAST(NULL AS TIMESTAMP_NTZ) AS posted_at").where("id <> 150"),
    }
    want = {(c, "G1", v) for c in range(conditions) for v in [7, 10, *range(100, n)]} | {(0, "P9", v) for v in range(151)} | {(1, "P9", 7), (2, None, 7)}
    got = []
    moved = shuffled(spark, lambda: got.extend(tuple(r) for r in market.search_matches(t, dt.datetime(2024, 2, 1)).collect()))
    assert len(got) == len(set(got)) and set(got) == {x for x in want if x[2] != 150}
    assert moved < len(got) / 2


def test_dealt_join_cuts_hot_keys_and_bounds_its_tasks(spark, monkeypatch):
    left, right = [(i % 5, i) for i in range(60)] + [(None, 1), (8, 2)], [(i % 3 if i % 4 else 0, i) for i in range(200)] + [(None, 1), (9, 2)]
    want = sorted((k, x, y) for k, x in left for m, y in right if k is not None and k == m)
    for most in (10**6, 1_300, 100):  # no key is hot, some are, all are
        monkeypatch.setattr(joins, "DEALT_PAIRS", most)
        out, tasks, by = joins.dealt_join(spark.createDataFrame(left, "k int, x int"), spark.createDataFrame(right, "k int, y int"), "k", "y")
        assert sorted(tuple(r) for r in out.select("k", "x", "y").collect()) == want
        assert tasks == len(want) // most + 1 and by[0] == "k"
        pieces = out.groupBy(*by).count().collect()
        assert most > 1_000 or max(r["count"] for r in pieces) < 3 * most


def test_coverage_counts_equal_titles_and_vacancies_once_over_pieces(spark, monkeypatch):
    plain = sorted(map(str, demo.QUERIES["q08_coverage"](spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(joins, "DEALT_PAIRS", 50)
    df = demo.QUERIES["q08_coverage"](spark, "/root/testdata/sf0.001")
    assert sorted(map(str, df.collect())) == plain and plain


def test_documents_of_one_file_are_dealt_for_title_keys(spark):
    for name in ("x03_same_title", "x05_title_key"):
        rows = demo.QUERIES[name](spark, "/root/testdata/sf0.1").select("doc_id").groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in rows) == 10_000 and max(r["count"] for r in rows) < 4_000


def test_patterns_of_titles_that_are_not_looked_for_change_nothing(spark):
    texts = ["Cook od 1 200 - 1 500 EUR/mes. brutto", "od 5", "€ 100 m/ž", "1 €", "EUR 20 neto", "euro 5", "Ž/M/d x/y", "m/", "(m/w) a", "5 eur od 7 €", "od od 7 eur", "мужЕУР 5", "щука 7 еур", "", None, "eur", "/", "zena/muz/f€"]
    plain = lambda x: F.trim(chain(x))

    def chain(x):
        for p in (keys.SALARY, keys.EURO_FIRST, keys.GENDER, "[^a-z0-9]+"):
            x = F.regexp_replace(x, p, " ")
        return x

    t = F.col("t")
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(
        keys.same_title(t).alias("a"), plain(F.regexp_replace(F.lower(F.translate(t, keys.TITLE_FROM, keys.TITLE_TO)), r"\([^)]*\)", " ")).alias("b"),
        keys.title_key(t).alias("c"), plain(F.regexp_replace(keys.plain_text(t), keys.LEGAL_PAREN, " ")).alias("d"),
    ).collect()
    assert len(rows) == len(texts) and all(r["a"] == r["b"] and r["c"] == r["d"] for r in rows)


def test_bpe_remembers_common_words(monkeypatch):
    """op4_bpe at 1,108 CPU seconds a GB: rare words drove the common ones out of the memory; ids were read one by one."""
    monkeypatch.setattr(op04_bpe, "MEMORY", 40)
    path = op04_bpe.vocabulary_path(op04_bpe.VOCABULARY)
    bpe = op04_bpe.Bpe(path)
    library = load(path)
    common = [f" word{x}" for x in "abcdefghij"]
    rare = [f" {chr(97 + i % 26)}q{chr(97 + i // 26)}x" for i in range(200)]
    for text in ("".join(common), "".join(common), "".join(rare)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode_text(text) == (len(ids), ",".join(map(str, ids)))
    assert all(w in bpe._known for w in common) and len(bpe._known) + len(bpe._newer) + len(bpe._older) <= 40


def test_bpe_short_words_equal_the_whole_table(monkeypatch):
    monkeypatch.setattr(op04_bpe, "PREFIXES", 30)
    bpe = op04_bpe.Bpe(op04_bpe.vocabulary_path(op04_bpe.VOCABULARY))
    rng = random.Random(8)
    tokens = [x for x in bpe.bytes_of.values() if len(x) < 9]
    for _ in range(3000):
        data = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 7)))
        assert bpe._begun(data.decode("latin-1"))[1] == ",".join(map(str, bpe.encode_word(data)))
    for data in (b"a" * 63, b" " * 64, b"ab" * 32, b"=-" * 30, b"0" * 61, "é".encode() * 32):
        assert bpe._begun(data.decode("latin-1"))[1] == ",".join(map(str, bpe.encode_word(data)))
    assert len(bpe._prefixes) <= 30 and len(bpe._passing) <= op04_bpe.PASSING
    rows = [[rng.randrange(50_257) for _ in range(rng.choice([0, 1, 40]))] for _ in range(300)] + [[]]
    assert bpe.decode_joined([",".join(map(str, x)) for x in rows]) == [bpe.decode(x) for x in rows]
    assert bpe.decode_joined([""]) == [""] and bpe.decode_joined([]) == []
    texts = ["one two " * 50, None, "", "three", "vier " * 30]
    run = op04_bpe.encoder(op04_bpe.vocabulary_path(op04_bpe.VOCABULARY))()
    whole = run(texts)
    monkeypatch.setattr(op04_bpe, "JOINED", 10)
    assert run(texts) == whole and [len(x) for x in whole] == [5, 5, 5]


def files_of_shuffles(spark) -> int:
    return spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()


def test_a_written_step_leaves_no_shuffle_on_disk(spark):
    before = files_of_shuffles(spark)
    got = resolve.written(spark.range(4_000).repartition(7, "id").groupBy(F.col("id") % 100).count())
    assert got.count() == 100 and spark.conf.get(resolve.CLEANED) == "false"
    until = time.time() + 20
    while files_of_shuffles(spark) > before + 8 and time.time() < until:  # they are removed in the background; the count itself shuffles
        time.sleep(0.2)
    assert files_of_shuffles(spark) <= before + 8


def links_of(spark, n: int):
    """Links of n vacancies of one company, each with an address and an id of its own, but the last with the first one's address."""
    rows = spark.range(n, numPartitions=4).select(
        F.col("id").alias("vacancy_id"), F.lit(1).alias("source_id"), F.lit("x").alias("provider"), F.concat(F.lit("e"), "id").alias("external_id"), F.concat(F.lit("https://h.sk/job/"), F.col("id") % (n - 1)).alias("url"),
        F.lit(None).cast("string").alias("employer_url"), F.concat(F.lit("Cook "), F.col("id")).alias("title"), F.lit("Senec").alias("location"),
    )
    p = resolve.written(identity.keyed(rows))
    return identity.merge_pairs(p, p.select("vacancy_id", F.lit(1).alias("company_id"), "title_key"))


def test_keys_of_one_vacancy_are_shuffled_as_hashes_alone(spark):
    n, got = 3_000, []
    rows = shuffled(spark, lambda: got.extend(links_of(spark, n).collect()))
    assert [tuple(r) for r in got] == [(n - 1, 0, identity.ADDRESS)]
    assert rows < 8 * n, rows


def test_steps_of_signals_are_removed(spark):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = len(os.listdir(folder))
    links_of(spark, 50)
    assert len(os.listdir(folder)) == before + 4  # postings, and links of three kinds


def columns_left(spark, name: str) -> list[set[str]]:
    """Columns of the tables that a query has written by the time its result is read."""
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    demo.QUERIES[name](spark, "/root/testdata/sf0.001")
    return [set(spark.read.parquet(f"{folder}/{step}").columns) for step in set(os.listdir(folder)) - before if step.startswith("step-")]


def test_keyed_postings_are_removed_when_moves_are_written(spark):
    assert not any("button_key" in c for c in columns_left(spark, "q18_merged_postings"))


def test_tables_of_a_batch_are_removed_when_they_are_rolled_back(spark):
    left = columns_left(spark, "b07_unmerge_from_journal")
    assert not any(c & {"button_key", "employer_url", "pass_id", "last_confirmed_at"} for c in left) and {"id", "vacancy_id", "title"} in left


def test_unmerging_writes_what_its_result_is_made_of(spark):
    assert not any(c & {"button_key", "employer_url", "mailed_at", "changed_at", "posting_id"} for c in columns_left(spark, "q24_unmerge"))


def test_main_postings_bring_only_what_is_read(spark):
    rows = resolve.written(spark.createDataFrame([(10, 1, "a", "p10", "u10", None), (20, 2, "b", "p20", "u20", None)], "id long, vacancy_id long, external_id string, title string, url string, closed_at date"))
    own = resolve.written(spark.createDataFrame([(k, "ACTIVE", f"t{k}", f"u{k}", None, None, None, "v1") for k in (1, 2)], "id long, state string, title string, url string, posted_at date, first_seen_at date, last_confirmed_at date, match_version string"))
    moves = spark.createDataFrame([(2, 1)], "merged long, kept long")
    after = merging.apply_batch({"vacancy": own, "job_posting": rows}, moves)["vacancy"]
    assert [tuple(r) for r in after.select("id", "title", "url").collect()] == [(1, "p10", "u10")]
    assert "url" not in after.select("id", "title")._jdf.queryExecution().executedPlan().toString()
