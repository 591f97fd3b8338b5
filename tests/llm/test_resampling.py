"""Importance resampling and tokenizer alignment against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postlake.llm import op12_importance as imp
from postlake.llm import op13_alignment as al
from tests.llm.test_texts import edge, empty

# importance resampling


def brute_draw(docs: list, target: list, percent: int, least: int, runs: tuple[int, int] = (1, 1), buckets: int = imp.BUCKETS) -> list:
    def own(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return w, [" ".join(w[i : i + k]) for k in range(runs[0], runs[1] + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in own(x)[1]), Counter(bucket(f) for x in target for f in own(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for doc, x in docs:
        w, f = own(x)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(y)) for y in f)
        rows.append([doc, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], -(2**63) if r[0] is None else r[0]))
    for i, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = i + 1
    return rows


def seen(df) -> list:
    return [tuple(r) for r in df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()]


def order(rows) -> list:
    return sorted(map(tuple, rows), key=repr)


def test_draw_equals_brute_force(spark):
    own = random.Random(5)
    docs = [(own.choice([None, i, i, i]), " ".join(own.choice(["Apple", "bear", "Čaj", "dog", "ÉTÉ", "x1"]) for _ in range(own.randrange(12)))) for i in range(300)]
    docs += [(7, "apple bear dog x1 apple")] * 60  # ties of scores, ids and rows
    target = ["apple dog", "Čaj čaj", None]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    for runs, percent, least in (((1, 1), 30, 4), ((1, 2), 50, 0), ((1, 1), 100, 3), ((1, 1), 0, 3), ((1, 1), 3, 5)):
        got = imp.draw(imp.weighted(rows, goal, runs=runs, buckets=50), percent, least)
        assert order(seen(got)) == order(brute_draw(docs, target, percent, least, runs, 50)), (runs, percent, least)


@given(st.lists(st.integers(-5, 5), min_size=1, max_size=40), st.data())
@settings(max_examples=5, deadline=None)
def test_bisection(spark, values, data):
    k = data.draw(st.integers(1, len(values)))
    scale = data.draw(st.sampled_from([1, 10**6, 2**59]))
    values = [v * scale for v in values]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    want = sorted(values, reverse=True)[k - 1]
    assert imp.kth(rows, "v", k, min(values), max(values)) == (want, sum(v > want for v in values))


def test_draw_edges(spark):
    goal = spark.createDataFrame([("ab one",)], "text string")
    rows = imp.draw(imp.weighted(edge(spark).withColumn("rank", F.col("doc_id")), goal), 100, 1).collect()
    assert len(rows) == 7 and sorted(r["rank"] for r in rows if r["rank"]) == [1, 2, 3, 4] and {r["kept"] for r in rows} == {"x", "y", "z", None}
    assert imp.draw(imp.weighted(empty(spark), goal)).count() == 0
    assert imp.draw(imp.weighted(edge(spark), goal.where("false"))).count() == 7


def test_one_hot_score(spark):
    """Documents of one id and text are drawn by number; ranks are those of the sorted list."""
    rows = spark.range(3000).selectExpr("id % 3 as doc_id", "repeat('same words ', 20) as text")
    got = seen(imp.draw(imp.weighted(rows, rows.limit(1).select("text")), 10))
    drawn = sorted(r[5] for r in got if r[5])
    assert drawn == list(range(1, 301)) and len({r[0] for r in got if r[5]}) == 1


# tokenizer alignment

LETTERS = ["a", "be", "the ", " ", "  ", "\n", "\t", "'s", "'ll", "1", "2024", ".", ",", "é", "日本", "▁", "<|endoftext|>", "<s>", " ", " ", "\x1c", "🙂", "word", "Ünder", " -- ", "http://x.y/z?", "\0"]


def whole(text: str | None, a, b, pair) -> tuple[list[int], list[int]]:
    """Ids by the libraries, of the whole text; none where the bytes differ."""
    if not text:
        return [], []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw = (" " + text).encode()
    same = b"".join(pair.a_bytes[i] for i in ids_a) == raw == b"".join(pair.b_bytes[i] for i in ids_b)
    return (ids_a, ids_b) if same else ([], [])


def brute_align(docs: list) -> list:
    pair = al._pair(al.vocabulary_path(al.A), al.vocabulary_path(al.B))
    rows, holds = [], defaultdict(int)
    for text in docs:
        ids_a, ids_b = whole(text, pair.a, pair.b, pair)
        spans = lambda ids, table: [(sum(len(table[i]) for i in ids[:k]), sum(len(table[i]) for i in ids[: k + 1])) for k in range(len(ids))]
        at_a, at_b = spans(ids_a, pair.a_bytes), spans(ids_b, pair.b_bytes)
        links = [(x, y) for x, (p, q) in zip(ids_a, at_a, strict=True) for y, (r, s) in zip(ids_b, at_b, strict=True) if max(p, r) < min(q, s)]
        both = sorted({q for _, q in at_a} & {q for _, q in at_b})
        parts = []
        for low, high in zip([0, *both], both, strict=False):
            parts.append(",".join(str(i) for i, (_, q) in zip(ids_a, at_a, strict=True) if low < q <= high) + "|" + ",".join(str(i) for i, (_, q) in zip(ids_b, at_b, strict=True) if low < q <= high))
        for x in set(links):
            holds[x] += 1
        rows.append((len(ids_a), len(ids_b), len(both), links, hashlib.sha256(";".join(parts).encode()).hexdigest() if ids_a else ""))
    top = defaultdict(int)
    for (x, _), n in holds.items():
        top[x] = max(top[x], n)
    return [(a, b, g, len(ls), sum(holds[x] == top[x[0]] for x in ls), sum(holds[x] for x in ls), d) for a, b, g, ls, d in rows]


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@given(st.lists(st.integers(1, 60), max_size=40, unique=True), st.lists(st.integers(1, 60), max_size=40, unique=True), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_merge_path(a, b, size):
    end = 61
    a, b = np.array(sorted([*a, end])), np.array(sorted([*b, end]))
    link_a, link_b, cut = al.merged(a, b, size)
    want = [(int(np.searchsorted(a, e)), int(np.searchsorted(b, e)), e in a and e in b) for e in sorted({*a.tolist(), *b.tolist()})]
    assert list(zip(link_a.tolist(), link_b.tolist(), cut.tolist(), strict=True)) == want


@given(st.lists(st.sampled_from(LETTERS), max_size=25))
@settings(max_examples=400, deadline=None)
def test_segments_give_the_libraries_tokens(parts):
    text = "".join(parts)
    pair = al._pair(al.vocabulary_path(al.A), al.vocabulary_path(al.B))
    want = whole(text, pair.a, pair.b, pair)
    number = pair.numbers([al.segments(text) if text else []])
    assert "".join(al.segments(text)) == " " + text
    right = all(pair.right[i] for i in number)
    got = (pair.of_a.take(number)[0].tolist(), pair.of_b.take(number)[0].tolist()) if right else ([], [])
    assert got == want


def test_alignment_equals_brute_force(spark):
    own = random.Random(3)
    docs = [None, "", "▁", "x", "x", *("".join(own.choice(LETTERS) for _ in range(own.randrange(30))) for _ in range(120)), "word" * 300, " ".join(["the same words"] * 200)]
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    want = [(i, *r) for i, r in enumerate(brute_align(docs))]
    for size, head in ((al.PIECE, al.HEAD), (7, 20), (3, 0)):
        got = al.alignment(rows, size=size, head=head)
        assert sorted(tuple(r) for r in got.select("doc_id", *NAMES).collect()) == want, (size, head)


def test_forgetting_segments(spark, monkeypatch):
    pair = al.Pair(al.vocabulary_path(al.A), al.vocabulary_path(al.B))
    monkeypatch.setattr(al, "MEMORY", 3)
    for text in ("a b c d e f", "b c d", "x" * 100, "x" * 100, "a b"):
        number = pair.numbers([al.segments(text)])
        assert pair.of_a.take(number)[0].tolist() == pair.a.encode(" " + text, add_special_tokens=False).ids
        assert all(len(s) <= al.LONGEST for s in pair.known)


def test_alignment_edges(spark):
    got = al.alignment(edge(spark).withColumn("n_best", F.col("doc_id"))).collect()
    assert len(got) == 7 and {r["kept"] for r in got} == {"x", "y", "z", None}
    by = {(r["doc_id"]): r for r in got}
    assert tuple(by[1][c] for c in NAMES) == tuple(by[2][c] for c in NAMES) == (0, 0, 0, 0, 0, 0, "") and by[4]["n_a"] > 10_000
    assert al.alignment(empty(spark)).count() == 0 and set(al.alignment(empty(spark)).columns) == {"doc_id", "kept", "n_tokens", *NAMES}
    shown = al.groups(edge(spark)).where("doc_id = 5").first()["groups"]
    assert len(shown) >= 1 and all(re.fullmatch(r"\d+(,\d+)*\|\d+(,\d+)*", g) for g in shown)
