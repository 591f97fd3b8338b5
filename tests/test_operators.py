"""Merges, lifecycle, resolution and joins on small tables."""

from __future__ import annotations

from itertools import product

import pytest
from pyspark.sql import functions as F

from postlake.operators import filters, joins, lifecycle, merges, resolve


def test_country_and_format_rules(spark):
    sets = [["SK"], ["CZ"], [], ["*"], ["SK", "*"], ["CZ", "*"], None]
    formats = [None, "OFFICE", "HYBRID", "REMOTE", "CONFLICT"]
    rows = [(i, s, f, c) for i, (s, f, c) in enumerate(product(sets, formats, [None, "OFFICE", "REMOTE"]))]
    df = spark.createDataFrame(rows, "id int, s array<string>, f string, c string")
    got = {r["id"] for r in df.where(filters.country_rule(F.array(F.lit("SK")), F.col("s")) & filters.format_rule(F.col("c"), F.col("f"))).collect()}
    want = {i for i, s, f, c in rows if s is not None and ("SK" in s or not s) and (c is None or f is None or f in ("CONFLICT", "HYBRID", c))}
    assert got == want


@pytest.mark.parametrize(("other", "want"), [([1, 2], [3]), ([1, None], []), ([], [1, 3, None])])
def test_not_in(spark, other, want):
    df = spark.createDataFrame([(1,), (3,), (None,)], "k int")
    got = [r["k"] for r in joins.not_in(df, "k", spark.createDataFrame([(x,) for x in other], "o int"), "o").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def known(spark, rows):
    return spark.createDataFrame(rows, "source_id int, external_id string, title string, url string, location string, content string, confirmed boolean, missing int, closed_at string")


def test_posting_merge(spark):
    k = known(spark, [
        (1, "a", "A", "https://x/a", "L", "C", True, 0, None), (1, "b", "B", "https://x/b", None, None, True, 2, None), (1, "c", "C", "https://x/c", None, None, False, 3, "t0"),
        (1, "d", "D", "https://x/d", None, None, True, 1, None), (1, "e", "E", "https://x/e", None, None, True, 2, None), (2, "a", "A", "https://x/a", None, None, True, 4, None),
        (3, "a", "A", "https://x/a", None, None, True, 4, None), (4, "a", "A", "https://x/a", None, None, True, 1, None),
    ])
    fetched = spark.createDataFrame([(1, "a", "A2", "https://x/a", None, None), (1, "c", "C", "https://x/c", None, None), (1, "new", "N", "https://x/n", None, None), (1, "bad", "N", "ftp://x", None, None), (1, "e", "E", "mailto:x", None, None), (4, "a", "A3", "https://x/a", None, None)], "source_id int, external_id string, title string, url string, location string, content string")
    run = spark.createDataFrame([(1, True, False, "t1"), (2, False, False, "t1"), (3, False, True, "t1"), (4, False, False, "t1")], "source_id int, complete boolean, unrecognised boolean, read_at string")
    skip = spark.createDataFrame([(1, "d")], "source_id int, external_id string")
    got = {(r["source_id"], r["external_id"]): (r["event"], r["missing"], r["confirmed"], r["closed_at"], r["title"], r["location"]) for r in lifecycle.posting_merge(k, fetched, run, skip).collect()}
    assert got == {
        (1, "a"): ("CONFIRMED", 0, True, None, "A2", "L"), (1, "b"): ("CLOSED", 3, False, "t1", "B", None), (1, "c"): ("REOPENED", 0, True, None, "C", None),
        (1, "d"): ("UNTOUCHED", 1, True, None, "D", None), (1, "e"): ("UNCONFIRMED", 2, False, None, "E", None), (1, "new"): ("INSERTED", 0, True, None, "N", None),
        (2, "a"): ("UNCONFIRMED", 4, False, None, "A", None), (3, "a"): ("CLOSED", 5, False, "t1", "A", None), (4, "a"): ("UNCONFIRMED", 1, False, None, "A", None),
    }


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "c", None)], "k int, a string, b string")
    new = spark.createDataFrame([(2, "n", None), (3, None, "z"), (4, "d", "w")], "k int, a string, b string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(merges.upsert(old, new, ["k"])) == [(1, "a", "x"), (2, "n", "y"), (3, "c", "z"), (4, "d", "w")]
    assert rows(merges.insert_absent(old, new, ["k"])) == [(1, "a", "x"), (2, None, "y"), (3, "c", None), (4, "d", "w")]
    state, lost = merges.checked_update(old, spark.createDataFrame([(1, "A", "x"), (2, "B", "old")], "k int, a string, b string"), ["k"], "b", ["a"])
    assert rows(state) == [(1, "A", "x"), (2, None, "y"), (3, "c", None)] and [r["k"] for r in lost.collect()] == [2]
    done = spark.createDataFrame([(1,)], "k int")
    batch = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    first = merges.append_new(done, batch, ["k"])
    assert rows(first) == [(2,)] and rows(merges.append_new(done.union(first), batch, ["k"])) == []


def test_resolve(spark):
    pairs = spark.createDataFrame([(5, 3, 2), (3, 1, 1), (9, 5, 6), (20, 21, 1), (30, 31, 1)], "a int, b int, rank int")
    batch = {(r["merged"], r["kept"], r["rank"]) for r in resolve.keepers(pairs).collect()}
    assert batch == {(9, 5, 6), (21, 20, 1), (31, 30, 1)}
    blocked = spark.createDataFrame([(30, 31)], "a int, b int")
    assert {(r["merged"], r["kept"]) for r in resolve.resolve_all(pairs, blocked).collect()} == {(9, 1), (5, 1), (3, 1), (21, 20)}
    got = {r["node"]: r["label"] for r in resolve.components(spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (None, 2)], "a int, b int")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 40: 40, 50: 40}


def test_claims_by_hand(spark):
    import datetime as dt

    from postlake.operators import queues

    now = dt.datetime(2024, 1, 1, 12)
    t = lambda hour: dt.datetime(2024, 1, 1, hour)
    rows = [
        (1, "a", "WAITING", None, queues.BUSY, t(11), 4, 0),  # waits for group x and is alive: 2 must not overtake it
        (2, "a", "QUEUED", None, None, t(10), 0, 0),
        (3, "b", "RUNNING", t(13), None, t(10), 1, 0),  # group y runs
        (4, "b", "QUEUED", None, None, t(10), 0, 0),
        (5, "c", "RUNNING", t(11), None, t(10), 7, 2),  # group z: its lease is over
        (6, "c", "QUEUED", None, None, t(10), 2, 0),
        (7, "c", "QUEUED", None, None, t(10), 0, 0),
        (8, "free", "QUEUED", None, None, t(10), 0, 0),
        (9, "free", "QUEUED", None, None, t(10), 5, 0),
    ]
    tasks = spark.createDataFrame(rows, "id long, type string, state string, lease_until timestamp_ntz, last_error string, updated_at timestamp_ntz, claim_seq int, attempts int")
    groups = {"a": "x", "b": "y", "c": "z"}
    got = queues.claims(tasks, now, 60, groups, 7200).collect()
    assert {(r["id"], r["claim_seq"], r["state"]) for r in got} == {(6, 3, "RUNNING"), (8, 1, "RUNNING"), (9, 6, "RUNNING")}
    assert {r["lease_until"] for r in got} == {dt.datetime(2024, 1, 1, 12, 1)}
    # a task that has waited without a change for too long is lost and holds nobody up
    assert {r["id"] for r in queues.claims(tasks, now, 60, groups, 60).collect()} == {2, 6, 8, 9}
    late = queues.expired(tasks, now, 3).collect()
    assert [(r["id"], r["state"], r["attempts"], r["last_error"]) for r in late] == [(5, "FAILED", 3, queues.EXPIRED)]
    reports = spark.createDataFrame([(3, 1, "DONE"), (5, 6, "DONE"), (8, 0, "DONE")], "id long, claim_seq int, outcome string")
    assert [tuple(r) for r in queues.finished(tasks, reports).collect()] == [(3, "DONE")]
