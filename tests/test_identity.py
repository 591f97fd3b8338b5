"""Identity of vacancies by hand: the six signals, blocks, merges of children, journal, un-merge, lookups."""

from __future__ import annotations

import datetime as dt
import itertools
import random

from postlake.operators import identity, merging
from postlake.operators.resolve import keepers, written

RAW = "id long, vacancy_id long, source_id long, provider string, external_id string, url string, employer_url string, title string, location string, closed_at date"


def posting(i, source, provider, external, url, title, location, employer_url=None, vacancy=None):
    return i, vacancy or i, source, provider, external, url, employer_url, title, location, None


def moves(spark, rows, employers=(), blocked=None):
    p = identity.keyed(spark.createDataFrame(rows, RAW))
    links = spark.createDataFrame(list(employers), "company_id long, source_id long")
    e = p.join(links, "source_id").select("vacancy_id", "company_id", "title_key")
    stop = spark.createDataFrame(blocked, "a long, b long") if blocked else None
    return {(r["merged"], r["kept"], r["rank"]) for r in keepers(identity.merge_pairs(p, e, stop), stop).collect()}


def test_number_title_and_veto(spark):
    rows = [
        posting(1, 1, "careerpage", "w1", "https://q.test/k/w1", "Skladník (m/ž)", "Senec"), posting(2, 2, "portal", "w2", "https://q.test/p/w2", "Skladník (muž/žena)", "Senec - Senec"),
        posting(3, 2, "portal", "w3", "https://q.test/p/w3", "Skladník (muž/žena)", "Senec - Senec"), posting(4, 1, "careerpage", "d1", "https://q.test/k/d1", "Vodič", "Martin"),
        posting(5, 2, "portal", "d2", "https://q.test/p/d2", "Vodič", "Žilina - Žilina"), posting(6, 2, "portal", "profesia:9268100", "https://www.profesia.sk/O9268100", "Operátor", "Senec"),
        posting(7, 3, "profesia", "profesia:9268100", "https://www.profesia.sk/praca/q/O9268100", "Operátor", None), posting(8, 1, "careerpage", "q1", "https://q.test/k/q1", "Veduci kvality", "Levice"),
        posting(9, 1, "careerpage", "q2", "https://q.test/k/q2", "Veduci procesnej kvality", "Levice"), posting(10, 2, "portal", "profesia:9268101", "https://www.profesia.sk/O9268101", "Veduci kvality (muž/žena)", "Levice", "https://q.test/k/q2"),
    ]
    want = {(2, 1, identity.TITLE_PLACE), (3, 1, identity.TITLE_PLACE), (7, 6, identity.NUMBER)}
    assert moves(spark, rows, [(1, 1), (1, 2)]) == want
    assert moves(spark, rows) == {(7, 6, identity.NUMBER)}  # without the company
    assert moves(spark, rows, [(1, 1), (1, 2)], [(1, 3), (6, 7)]) == {(3, 2, identity.TITLE_PLACE)}  # 2 is kept in this batch, and goes to 1 in the next


def test_buttons(spark):
    """An ad joins its target, also if it is the older one; links of two postings, and other titles, are no target."""
    ad, own = posting(1, 1, "portal", "profesia:1", "https://www.profesia.sk/O7770001", "Driver", None, "https://e.sk/job/1/"), posting(2, 2, "careerpage", "j1", "https://www.e.sk/job/1", "Driver", "Senec")
    assert moves(spark, [ad, own]) == {(2, 1, identity.BUTTON)}
    assert moves(spark, [ad, own, posting(3, 2, "careerpage", "j2", "https://www.e.sk/job/1#x", "Driver", "Martin")]) == {(3, 2, identity.ADDRESS)}
    assert moves(spark, [ad, (*own[:7], "Baker", *own[8:])]) == set()
    two = [posting(k, 1, "portal", f"profesia:{k}", f"https://www.profesia.sk/O777000{k}", "Driver", place, "https://e.sk/all") for k, place in ((1, "Senec"), (2, "Martin"), (3, "Remote"), (4, "Senec, Martin"), (5, None))]
    assert moves(spark, two[:2]) == set() and moves(spark, two) == {(3, 1, 5), (4, 1, 5), (5, 1, 5)}


def test_board_copies(spark):
    rows = [posting(1, 1, "workday", "R1", "https://h.sk/a/R1", "Driver", None), posting(2, 2, "workday", "R1-2", "https://h.sk/b/R1-2", "Driver", None), posting(3, 2, "workday", "R1-3", "https://h.sk/b/R1-3", "Baker", None), posting(4, 3, "personio", "R1-2", "https://h.sk/c/4", "Driver", None), posting(5, 3, "personio", "R1-2", "https://h.sk/c/5", "Else", None)]
    assert moves(spark, rows) == {(2, 1, identity.BOARD_ID), (5, 4, identity.BOARD_ID)}


def test_loose_places_need_a_pair(spark):
    rows = [posting(k, 1, "portal", f"x{k}", f"https://e.sk/{k}", "Driver", place) for k, place in ((1, "Senec"), (2, "Remote"), (3, "Remote"))]
    assert moves(spark, rows[:2], [(1, 1)]) == {(2, 1, identity.TITLE_PLACE)} and moves(spark, rows, [(1, 1)]) == set()


def test_random_pairs_against_brute_force(spark):
    """Keys give the moves that all pairs give, with blocked pairs too."""
    own = random.Random(4)
    rows = [posting(k, 1, "portal", f"x{k}", f"https://e.sk/{own.choice('abc')}{own.randrange(12)}", own.choice(["Driver", "Baker", "!"]), own.choice(["Senec", "Martin", "Senec, Martin", "Remote", None, "Trnavský kraj", "Nitriansky kraj"]), own.choice([None, "https://e.sk/b1", "https://e.sk/zz"]), vacancy=1 + k // 2) for k in range(60)]
    p = identity.keyed(spark.createDataFrame(rows, RAW)).collect()
    kind = lambda x, c: {y for y in x if y.startswith(c)}

    def fits(a, b):
        ca, cb, ra, rb = kind(a, "c:"), kind(b, "c:"), kind(a, "r:"), kind(b, "r:")
        if ca and cb:
            return bool(ca & cb)
        return bool(ra & rb) if not ca and not cb and ra and rb else True

    links = {k: [r for r in p if r["link_key"] == k] for k in {r["link_key"] for r in p}}
    pairs = set()
    for a, b in itertools.permutations(p, 2):
        found = [2] if a["address_key"] == b["address_key"] else []
        if a["title_key"] and a["title_key"] == b["title_key"]:
            found += [4] if len(links.get(a["button_key"], [])) == 1 and b["link_key"] == a["button_key"] else []
            found += [5] if a["button_key"] and a["button_key"] == b["button_key"] and fits(a["place_keys"], b["place_keys"]) else []
        pairs |= {(max(a["vacancy_id"], b["vacancy_id"]), min(a["vacancy_id"], b["vacancy_id"]), s) for s in found if a["vacancy_id"] != b["vacancy_id"]}
    for blocked in ([], sorted({(b, a) for a, b, _ in pairs})[::3]):
        best = {}
        for a, b, s in pairs:
            if (b, a) not in blocked:
                best[a] = min(best.get(a, (b, s)), (b, s))
        kept = {b for b, _ in best.values()}
        assert moves(spark, rows, blocked=blocked) == {(a, b, s) for a, (b, s) in best.items() if a not in kept}


def day(n):
    return dt.date(2024, 1, n)


def stand(spark):
    """Four vacancies with children of every kind."""
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "vacancy": make([(k, "CLOSED" if k == 1 else "ACTIVE", f"t{k}", f"u{k}", None if k == 2 else day(9 - k), day(9 - k), day(k), "v1", "more") for k in (1, 2, 3, 4)], "id long, state string, title string, url string, posted_at date, first_seen_at date, last_confirmed_at date, match_version string, extra string"),
        "job_posting": make([(10, 1, "profesia:1", "p10", "u10", None), (20, 2, "b", "p20", "u20", None), (21, 2, "c", "p21", "u21", day(1)), (30, 3, "d", "p30", "u30", None), (40, 4, "e", "p40", "u40", None)], "id long, vacancy_id long, external_id string, title string, url string, closed_at date"),
        "vacancy_revision": make([(1, 20, 2), (2, 30, 3)], "id long, posting_id long, vacancy_id long"),
        "status_history": make([(1, 2, "VIEWED"), (2, 3, "APPLIED"), (3, 4, "VIEWED")], "id long, vacancy_id long, status string"),
        "delivered": make([(1, 1, 7, day(5)), (1, 2, 6, day(4)), (1, 3, 5, day(6)), (2, 3, 4, day(3)), (2, 4, 9, day(2)), (3, 4, None, None)], "condition_id long, vacancy_id long, pass_id long, delivered_at date"),
        "digest": make([(1, 1, day(9)), (1, 2, day(1)), (2, 3, day(2)), (2, 4, day(3))], "user_id long, vacancy_id long, mailed_at date"),
        "user_status": make([(1, 1, "VIEWED", day(9)), (1, 2, "APPLIED", day(1)), (1, 3, "APPLIED", day(2)), (2, 4, "REJECTED", day(1))], "user_id long, vacancy_id long, status string, changed_at date"),
        "position_match": make([(1, 5), (2, 5), (3, 6)], "vacancy_id long, position_id long"),
    }


def seen(tables):
    return {k: sorted(map(tuple, v.collect()), key=repr) for k, v in tables.items()}


def test_children_follow(spark):
    m = spark.createDataFrame([(2, 1), (3, 1)], "merged long, kept long")
    got = seen(merging.apply_batch(stand(spark), m))
    assert got["vacancy"] == [(1, "ACTIVE", "p20", "u20", day(6), day(6), day(3), None, "more"), (4, "ACTIVE", "t4", "u4", day(5), day(5), day(4), "v1", "more")]
    assert [r[1] for r in got["job_posting"]] == [1, 1, 1, 1, 4] and [r[2] for r in got["vacancy_revision"]] == [1, 1] and [r[1] for r in got["status_history"]] == [1, 1, 4]
    assert got["delivered"] == [(1, 1, 5, day(4)), (2, 1, 4, day(3)), (2, 4, 9, day(2)), (3, 4, None, None)]
    assert got["digest"] == [(1, 1, day(9)), (2, 1, day(2)), (2, 4, day(3))]
    assert got["user_status"] == [(1, 1, "APPLIED", day(2)), (2, 4, "REJECTED", day(1))] and got["position_match"] == [(1, 5)]


def test_a_chain_of_three_batches_and_back(spark):
    now = first = {k: written(v) for k, v in stand(spark).items()}
    kept, states = [], [seen(first)]
    for merged, to in ((4, 3), (3, 2), (2, 1)):
        m = written(spark.createDataFrame([(merged, to)], "merged long, kept long"))
        kept.append({k: written(v) for k, v in merging.journal(now, m).items()})
        now = {k: written(v) for k, v in merging.apply_batch(now, m).items()}
        states.append(seen(now))
    assert [r[0] for r in states[-1]["vacancy"]] == [1] and {r[1] for r in states[-1]["job_posting"]} == {1}
    # un-merged by the journal of the first batch: 4 gets its own back from wherever it is, 1 keeps what it took over
    back, blocked = merging.unmerge(now, kept[0], spark.createDataFrame([(4,), (99,)], "merged long"))
    got = seen(back)
    assert [tuple(r) for r in blocked.collect()] == [(3, 4)] and [r[:4] for r in got["vacancy"]] == [(1, "ACTIVE", "p20", "u20"), (4, "ACTIVE", "p40", "u40")]
    assert {r[0]: r[1] for r in got["job_posting"]}[40] == 4 and {r[0]: r[1] for r in got["status_history"]}[3] == 4
    assert (2, 4, 9, day(2)) in got["delivered"] and (2, 4, day(3)) in got["digest"] and (2, 4, "REJECTED", day(1)) in got["user_status"] and (2, 1, "REJECTED", day(1)) in got["user_status"]
    for own, state in zip(reversed(kept), reversed(states[:-1]), strict=True):
        now = {k: written(v) for k, v in merging.roll_back(now, own).items()}
        assert seen(now) == state


def test_no_moves(spark):
    m = spark.createDataFrame([], "merged long, kept long")
    assert seen(merging.apply_batch(stand(spark), m)) == seen(stand(spark))


def test_lookups(spark):
    known = identity.keyed(spark.createDataFrame([posting(11, 1, "workday", "R1", "https://h.sk/a/R1", "Driver", "Senec", vacancy=5), posting(12, 2, "portal", "profesia:8880001", "https://p.sk/x", "Driver", "Martin", vacancy=4), posting(13, 1, "careerpage", "c", "https://h.sk/c?id=1", "Baker", "Remote", vacancy=3)], RAW))
    rows = [posting(1, 1, "workday", "R1-2", "https://h.sk/zz", "Driver", "Senec"), posting(2, 9, "x", "y", "https://www.profesia.sk/O8880001", "Any", None), posting(3, 9, "x", "y", "http://h.sk/c?id=1#top", "Any", None), posting(4, 9, "workday", "R1-2", "https://h.sk/zz", "Baker", "Senec"), posting(5, 2, "portal", "z", None, "Driver", "Trnava"), posting(6, 1, "portal", None, None, "Baker", "Senec"), posting(7, 1, "portal", None, None, "!", "Senec")]
    new = identity.keyed(spark.createDataFrame(rows, RAW).withColumnRenamed("id", "k").drop("vacancy_id"))
    got = {r["k"]: (r["vacancy_id"], r["signal"]) for r in identity.strong_match(new, known).collect()}
    assert got == {1: (5, 3), 2: (4, 1), 3: (3, 2), 4: (None, None), 5: (None, None), 6: (None, None), 7: (None, None)}
    employers = spark.createDataFrame([(1, 1, None), (1, None, "profesia:8880001"), (1, 2, None)], "company_id long, source_id long, external_id string")
    got = {r["k"]: r["vacancy_id"] for r in identity.title_and_place(new, known, employers).collect()}
    assert got == {1: 5, 2: None, 3: None, 4: None, 5: None, 6: 3, 7: None}
