"""Operators across texts against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np

from postlake.llm import op05_substrings as sub
from postlake.llm import op06_near as near
from postlake.llm import op08_decontaminate as dec
from postlake.llm import op09_chat as chat
from postlake.llm.components import components


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


# components


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 180), (None, 3)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 150: 150, 180: 150, 200: 150}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# near-duplicates


def shingle_weights(text: str) -> Counter:
    w = text.lower().split()
    return Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []))


def probability_jaccard(a: Counter, b: Counter) -> float:
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a | b) for d in a if d in b)


def test_similarity():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (Counter({i: rng.randint(1, 4) for i in rng.sample(range(12), 6)}) for _ in range(2))
        f = lambda x: (np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)]))
        assert abs(near.similarity(f(a), f(b)) - probability_jaccard(a, b)) < 1e-9
    a = {i: rng.randint(1, 4) for i in range(100)}
    b = {i: a[i] if i < 80 else rng.randint(1, 4) for i in range(4, 104) if i in a}
    keys = near.mix(np.array([*a, *b], np.uint64))
    sig = near.signatures(np.repeat([0, 1], [len(a), len(b)]), keys, np.array([*a.values(), *b.values()]), 2, 8192)
    assert abs((sig[0] == sig[1]).mean() - probability_jaccard(Counter(a), Counter(b))) < 0.02


def brute_classes(rows: list[tuple]) -> dict:
    texts = sorted({t for _, t in rows if t is not None})
    sets = {t: shingle_weights(t) for t in texts}
    up = {t: t for t in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(texts, 2):
        if sets[a].keys() & sets[b].keys() and probability_jaccard(sets[a], sets[b]) >= 0.8:
            up[find(a)] = find(b)
    name = defaultdict(list)
    for i, t in rows:
        if t is not None:
            name[find(t)].append(i)
    return {(i, t): i if t is None else min((x for x in name[find(t)] if x is not None), default=None) for i, t in rows}


def near_rows() -> list[tuple]:
    rng = random.Random(2)
    base = words(rng, 150)
    rows = [(10, " ".join(base))]
    for i in range(60):  # copies with up to six changed words; many miss the base but not one another
        w = list(base)
        for k in rng.sample(range(len(w)), rng.randint(0, 6)):
            w[k] = rng.choice(["the", "of", *words(rng, 1)])
        rows.append((100 + i, " ".join(w)))
    passage = words(rng, 40)
    rows += [(300 + i, " ".join(words(rng, 60) + passage + words(rng, 60))) for i in range(15)]
    rows += [(400 + i, " ".join(words(rng, 30) * 3)) for i in range(3)] + [(410, "a b c d e a b c d e a b c d e"), (411, "a b c d e a b c d e")]
    rows += [(500, None), (501, None), (502, ""), (503, ""), (504, "tiny"), (505, "Tiny"), (506, "tiny"), (None, rows[0][1]), (10, rows[0][1]), (11, " ".join(words(rng, 20_000)))]
    return rows


def test_classes_equal_brute_force(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, digest string")
    got = near.classes(docs).select("doc", "class_id").collect()
    want = brute_classes(rows)
    assert Counter((r["doc"], r["class_id"]) for r in got) == Counter((i, want[i, t]) for i, t in rows)
    kept = near.one_each(docs)
    assert kept.columns == docs.columns
    first = {(c if c is not None else None) for (i, t), c in want.items() if t is not None}
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter([*first, *(i for i, t in rows if t is None)])
    assert near.classes(docs.limit(0)).count() == 0 and near.one_each(docs.limit(0)).count() == 0


# repeated passages


def test_units_and_shifts():
    rng = random.Random(3)
    missed = 0
    for _ in range(200):
        p = words(rng, 60)
        texts = [" ".join(words(rng, rng.randint(0, 60)) + p + words(rng, 40)) for _ in range(2)]
        u = sub.units(texts)
        for k, t in enumerate(texts):
            w = t.split()
            assert u[4][k][0] == 0 and u[5][k][-1] == len(w)
            assert all(t[a:b].split() == w[x:y] for a, b, x, y in zip(u[2][k], u[3][k], u[4][k], u[5][k], strict=True))
        mine = set(zip(u[0][0], u[1][0], strict=True))
        hit = [(x, y) for a, b, x, y in zip(u[0][1], u[1][1], u[4][1], u[5][1], strict=True) if (a, b) in mine]
        missed += not hit or hit[-1][1] - hit[0][0] < sub.LEAST
    assert missed <= 2


def brute_repeats(texts: list[str]) -> list[list[tuple[int, int]]]:
    """(begin, end) in words of the maximal stretches of each text whose windows of MIN_WORDS words occur twice or more."""
    n = sub.MIN_WORDS
    split = [t.split() for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    out = []
    for w in split:
        own: list[tuple[int, int]] = []
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                own = [*own[:-1], (own[-1][0], i + n)] if own and i <= own[-1][1] else [*own, (i, i + n)]
        out.append(own)
    return out


def test_recall_against_brute_force(spark):
    """Of the repeated stretches of MIN_WORDS words and more, nine in ten at least are found, and nothing else is reported."""
    rng = random.Random(12)
    passages = [words(rng, n) for n in range(sub.MIN_WORDS, sub.MIN_WORDS + 24) for _ in range(4)]
    texts = []
    for k, p in enumerate(passages):
        for _ in range(2 + k % 2):
            texts.append(" ".join(words(rng, rng.randint(0, 90)) + p + words(rng, rng.randint(0, 90))))
    got = defaultdict(list)
    for r in sub.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got[r["doc_id"]].append((len(texts[r["doc_id"]][: r["start"]].split()), r["n_words"]))
    want = brute_repeats(texts)
    found = [any(a <= x and x + n <= b for x, n in got[i]) for i, own in enumerate(want) for a, b in own]
    assert len(found) == len(texts) and sum(found) >= 0.95 * len(found)
    assert all(any(a <= x and x + n <= b for a, b in want[i]) for i, own in got.items() for x, n in own)


def test_repeated_spans(spark):
    rng = random.Random(4)
    passage = " ".join(words(rng, 80))
    rows = [(i, " ".join(words(rng, 50)) + ("\n" + passage + "\n" if i < 5 else "\n") + " ".join(words(rng, 50))) for i in range(12)]
    rows += [(20, None), (21, ""), (22, "tiny"), (23, "tiny"), (None, " ".join(words(rng, 60))), (30, rows[11][1]), (11, rows[11][1]), (40, "é🙂 " * 30_000)]
    docs = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, unit string")
    got = sub.spans(docs).collect()
    assert {r["doc_id"] for r in got} == {*range(5), 11, 30, 40}
    texts = {i: t for i, t in rows if t} | {11: rows[11][1]}
    for r in got:
        assert len(texts[r["doc_id"]][r["start"] : r["end"]].split()) == r["n_words"] >= sub.LEAST
    cut = {r["doc_id"]: r["text"] for r in sub.without_repeats(docs).collect() if r["doc_id"] != 11}
    assert cut[0] == texts[0] and cut[6] == texts[6] and cut[20] is None and cut[22] == "tiny"
    assert all(len(cut[i].split()) < len(texts[i].split()) - 40 for i in range(1, 5)) and cut[30].strip() == ""
    assert sub.spans(docs.limit(0)).count() == 0 and sub.without_repeats(docs).columns == docs.columns


# decontamination


def brute_scan(docs: list, items: list) -> dict:
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for item, x in items:
            v = split(x)
            n = min(len(v), dec.WINDOW)
            win = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in win:
                    hit |= set(range(k, k + n))
                    found.add(str(item))
        out[i] = (len(w), len(hit), len(found), ",".join(sorted(found)))
    return out


def test_decontamination(spark):
    rng = random.Random(5)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([3, 9, 10, 11, 40, 1])] + [(7, None), (8, "?!"), (9, "Größe ÄÖ 1-2"), (9, "Größe ÄÖ 1-2"), (10, "it's o'clock \\ x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(0, None), (1, ""), (2, " ".join(words(rng, 5000)))]
    for i in range(40):
        item = rng.choice(items)[1] or ""
        w = item.split()
        a = rng.randint(0, max(0, len(w) - 10))
        docs.append((10 + i, " ".join(words(rng, 20)) + rng.choice([" ", "; "]) + " ".join(w[a : a + rng.randint(8, 20)]).upper() + " - " + " ".join(words(rng, 20))))
    docs += [(60, "grÖße äö"), (61, "GRÖßE ÄÖ, 1/2")]
    frame = spark.createDataFrame([(i, t, "own") for i, t in docs], "doc_id long, text string, items string")
    want = brute_scan(docs, items)
    for most, block in ((dec.MAX_SET, 1), (3, dec.MAX_HASHES), (3, 20)):  # in the plan, as a broadcast table, in blocks of one
        rows = dec.scan(frame, bench, max_set=most, max_hashes=block).collect()
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"])) for r in rows}
        assert got == want and len(rows) == len(docs)
        kept = dec.clean(frame, bench, max_set=most, max_hashes=block)
        assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {i for i, x in want.items() if not x[1]}
    assert any(x[1] for x in want.values()) and not all(x[1] for x in want.values())
    assert dec.scan(frame.limit(0), bench).count() == 0
    assert {r["n_hit"] for r in dec.scan(frame, bench.limit(0)).collect()} == {0} and dec.clean(frame, bench.limit(0)).count() == len(docs)
    twice = dec.scan(frame.union(frame), bench).count()
    assert twice == len(docs)  # repeated rows count once


# chat


def test_fold(spark):
    log = [
        (1, 0, 0, "message", "system", "be"), (1, 1, 2, "delta", "assistant", "lo"), (1, 1, 1, "message", "assistant", "hel"),
        (1, 2, 0, "message", "user", "first"), (1, 2, 1, "edit", None, "second"), (1, 3, 0, "message", "assistant", "bad"),
        (1, 3, 1, "regenerate", None, None), (1, 3, 2, "delta", None, "good"), (1, 3, 3, "delta", None, "!"), (1, 4, 0, "message", "user", "gone"),
        (1, 4, 1, "delete", None, None), (2, 0, 0, "delta", "assistant", "x"), (None, None, 0, "message", None, None), (3, 0, 0, "message", "user", "a"), (3, 0, 0, "message", "user", "a"),
    ]
    got = chat.fold(spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string")).collect()
    key = lambda r: (-1 if r[0] is None else r[0], -1 if r[1] is None else r[1], r[2])
    assert sorted((tuple(r) for r in got), key=key) == [
        (None, None, 0, "", ""), (1, 0, 0, "system", "be"), (1, 1, 0, "assistant", "hello"), (1, 2, 0, "user", "second"), (1, 3, 0, "assistant", "good!"),
        (2, 0, 0, "assistant", "x"), (3, 0, 0, "user", "a"), (3, 0, 1, "user", "a"),
    ]


def test_logs_need_the_fold(spark):
    """Finished turns become logs of every kind of event, and taking any kind away changes the result."""
    rows = [(c, t, "assistant" if t % 2 else "user", f"{c} {t} " + "word " * 200 if t < 4 else "") for c in range(20) for t in range(5)]
    log = chat.events_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    folded = lambda x: sorted((r["conv_id"], r["turn"], r["text"]) for r in chat.fold(x).collect())
    assert folded(log) == sorted((c, t, x) for c, t, _, x in rows)
    for kind in chat.KINDS:
        assert folded(log.where(log["kind"] != kind)) != folded(log), kind


def test_ids_of_any_type(spark):
    rows = [(1, 2, "user", "a"), (1, 3, "assistant", "b" * 900), (None, None, None, None), (2, 1, "assistant", "x"), (2, 1, "assistant", "x")]
    seen = []
    for kind in ("int", "long", "short", "string", "double"):
        table = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").selectExpr(f"cast(conv_id AS {kind}) AS conv_id", f"cast(turn AS {kind}) AS turn", "role", "text")
        out = chat.digests(chat.fold(chat.events_of(table)))
        assert out.schema["conv_id"].dataType == table.schema["conv_id"].dataType
        seen.append({(None if r["conv_id"] is None else float(r["conv_id"]), *tuple(r)[1:]) for r in out.collect()})
    assert all(s == seen[0] for s in seen) and len(seen[0]) == 3


def test_render_and_read_back(spark):
    rng = random.Random(6)
    parts = [*chat.CONTROL, chat.ESC, "<", "[", "\n", "s>", "é", "", "n", "INST]", "|im_end|>"]
    text = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
    rows = [(c, t, rng.choice(["user", "assistant", "a\nb", "[INST]", None]), None if rng.random() < 0.1 else text()) for c in range(30) for t in range(5)]
    rows += [(0, 0, "user", "again"), (99, 0, "assistant", "long " * 60_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    rendered = chat.render(chat.fold(chat.events_of(table)))
    for r in rendered.collect():
        body = r["formatted"][len(chat.OPEN) : -len(chat.CLOSE) - 1]
        assert not any(c in body for c in chat.CONTROL) and chat.read_back(r["formatted"])[:2] == (r["role"], r["text"])
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted(((t, role or "", x or "") for k, t, role, x in rows if k == c))
        said = [x for _, role, x in own if role == "assistant"]
        want[c] = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest(), sum(map(len, said)), hashlib.sha256("".join(said).encode()).hexdigest())
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(rendered).collect()}
    assert got == want
    assert chat.digests(chat.render(chat.fold(chat.events_of(table.limit(0))))).count() == 0


# findings of the first review


def test_pairs_at_the_threshold(spark):
    from fractions import Fraction

    rng = random.Random(7)
    exact = lambda a, b: sum(Fraction(1) / sum(max(Fraction(a[e], a[d]), Fraction(b[e], b[d])) for e in a | b) for d in a if d in b)
    rows, want = [], {}
    for k, (common, union) in enumerate([(12, 15), (48, 60), (52, 65), (60, 75), (80, 100), (47, 60), (79, 100)]):
        w = words(rng, union + 4)
        x, y = " ".join(w), " ".join(w[: common + 4])
        same = exact(shingle_weights(x), shingle_weights(y)) >= Fraction(4, 5)
        assert same == (5 * common >= 4 * union)
        rows += [(10 * k, x), (10 * k + 1, y)]
        want |= {10 * k: 10 * k, 10 * k + 1: 10 * k + (not same)}
    got = near.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc"]: r["class_id"] for r in got} == want


def test_spans_name_a_document_that_has_them(spark):
    rng = random.Random(8)
    licence, a, b, body = (words(rng, 90) for _ in range(4))
    rows = {1: words(rng, 40) + licence, 3: words(rng, 40) + b, 5: a + words(rng, 40), 7: words(rng, 30) + a + b + words(rng, 30), 20: body + licence, 21: body + licence}
    texts = {i: " ".join(w) for i, w in rows.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sources = defaultdict(set)
    for r in sub.spans(docs).collect():
        covered = set()
        for x in r["sources"]:
            assert texts[r["doc_id"]][x["start"] : x["end"]] in texts[x["first_doc"]]
            covered |= set(range(x["start"], x["end"]))
            sources[r["doc_id"]].add(x["first_doc"])
        assert {k for k in range(r["start"], r["end"]) if not texts[r["doc_id"]][k].isspace()} == {k for k in covered if not texts[r["doc_id"]][k].isspace()}
    assert sources[7] == {3, 5} and sources[20] == sources[21] == {1, 20}
