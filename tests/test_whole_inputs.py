"""Queries over whole tables: every row reaches the operator, and small fixtures by brute force."""

from __future__ import annotations

import re

import pyarrow.parquet as pq

from postlake.plans import demo

FOLDER = "/root/testdata/sf0.001"


def plain_html(html: str) -> str:
    for _ in range(2):
        html = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", html)
        html = re.sub(r"(?s)<[a-zA-Z/!][^>]*>", " ", html)
        for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            html = html.replace(a, b)
    return re.sub(r"\s+", " ", html).strip(" ")


def test_html_text_of_every_page(spark):
    pages = pq.read_table(f"{FOLDER}/pages.parquet").to_pylist()
    got = {r["page_id"]: r["text"] for r in demo.QUERIES["p16_html_text"](spark, FOLDER).collect()}
    assert got == {p["page_id"]: plain_html(p["html"]) for p in pages} and len(got) == len(pages) > 0
    assert all("&copy" in p["html"] for p in pages)


def test_resolution_of_all_documents(spark):
    docs = pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()
    first, pairs = {}, set()
    for d in sorted((d for d in docs if d["text"] is not None), key=lambda d: d["doc_id"]):
        for key in (("t", d["text"]), ("k", d["text"].split("\n")[0].lower())):
            if first.setdefault(key, d["doc_id"]) != d["doc_id"]:
                pairs.add((first[key], d["doc_id"]))
    label = {x: x for p in pairs for x in p}
    while any(label[a] != label[b] for a, b in pairs):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert max(label) > max(d["doc_id"] for d in docs) * 0.9
    assert {r["node"]: r["label"] for r in demo.QUERIES["j21_min_label_components"](spark, FOLDER).collect()} == label
    assert {r["merged"]: r["kept"] for r in demo.QUERIES["q18_resolve_all"](spark, FOLDER).collect()} == {k: v for k, v in label.items() if k != v}
    best = {b: min(a for a, x in pairs if x == b) for _, b in pairs}
    want = {(b, a, 1 + (a + b) % 6) for b, a in best.items() if b not in best.values()}
    assert {(r["merged"], r["kept"], r["rank"]) for r in demo.QUERIES["q18_merge_batch"](spark, FOLDER).collect()} == want


def test_counts_of_whole_tables(spark):
    count = lambda name: pq.read_metadata(f"{FOLDER}/{name}.parquet").num_rows
    run = lambda name: demo.QUERIES[name](spark, FOLDER)
    assert sum(r["n"] for r in run("q03_responses_by_group").collect()) == count("orders")
    ids = lambda table, column: set(pq.read_table(f"{FOLDER}/{table}.parquet", columns=[column])[column].to_pylist())
    assert {r["vec_id"] for r in run("v03_pending_examples").collect()} == ids("embeddings", "vec_id") - ids("labels", "doc_id")
    for name, key, step in (("j17_employers_of_posting", "id", 7), ("b10_title_and_place", "k", 11), ("b09_strong_signal", "k", 10)):
        assert {r["m"] for r in run(name).selectExpr(f"{key} % {step} AS m").distinct().collect()} == set(range(step)), name
