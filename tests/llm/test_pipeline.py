"""The pipeline against its stages' brute-force versions, and the registered queries."""

from __future__ import annotations

import hashlib
import random

import duckdb

import corpus_pipeline
from postlake.llm import op01_quality, op04_bpe, op07_secrets, queries
from postlake.llm.op02_tokens import load
from tests.llm.test_groups import brute_classes, brute_scan, words
from tests.llm.test_texts import brute_spans

ITEM = "the quick brown fox jumps over the lazy dog and runs away"


def documents() -> list[tuple]:
    rng = random.Random(7)
    base = words(rng, 120)
    rows = [(i, " ".join(words(rng, rng.randint(60, 200)))) for i in range(30)]
    rows += [(100 + i, " ".join(base[:60] + (words(rng, 1) if i else []) + base[60:])) for i in range(4)]
    rows += [(200, " ".join(words(rng, 70)) + " " + ITEM.upper()), (201, "junk " * 80), (202, None), (203, ""), (204, "too short"), (205, rows[3][1]), (3, rows[3][1])]
    rows += [(300, " ".join(words(rng, 60)) + ' password="hunter2hunter2" ' + "ab12" * 10), (301, " ".join(words(rng, 60)) + " <|endoftext|> é🙂"), (None, " ".join(words(rng, 60)))]
    return rows


def redacted(text: str) -> str:
    out, pos = "", 0
    for a, b in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in brute_spans(text).split(",") if x):
        if a >= pos:
            out += text[pos:a] + op07_secrets.MASK
        pos = max(pos, b)
    return out + text[pos:]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = documents()
    spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", [(k, t) for k, (_, t) in enumerate(rows)])
    kept = dict(duck.execute(f"SELECT doc_id, kept FROM ({op01_quality.SQL})").fetchall())
    good = [row for k, row in enumerate(rows) if kept[k]]
    assert {202, 203, 204, 201}.isdisjoint(i for i, _ in good) and len(good) > 30
    named = brute_classes(good)
    one = {(i, t) for i, t in good if named[i, t] == i}
    clean = [(i, t) for i, t in one if not brute_scan([(i, t)], [(1, ITEM)])[i][1]]
    tokens = load(op04_bpe.vocabulary_path(op04_bpe.VOCABULARY))
    want = set()
    for i, t in clean:
        ids = tokens.encode(redacted(t), add_special_tokens=False).ids
        text = tokens.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert all(r["n_chars"] == len(r["text"]) for r in corpus_pipeline.secrets(spark, docs.where("text IS NOT NULL"), str(tmp_path)).collect())


def test_every_operator_has_one_query():
    names = [k.split("_")[0] for k in queries.QUERIES]
    assert sorted(names, key=lambda x: int(x[2:])) == [f"op{n}" for n in range(1, 14)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
