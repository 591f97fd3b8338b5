"""Status history by hand."""

from __future__ import annotations

import datetime as dt

from postlake.operators import history

SCHEMA = "id long, user_id long, vacancy_id long, status string, set_at timestamp, local_day date"


def lines(spark, *asked):
    """(status, current) of the lines of requests (day, status), one user and vacancy."""
    rows = [(i, 1, 1, status, dt.datetime(2024, 1, day, 1, i), dt.date(2024, 1, day)) for i, (day, status) in enumerate(asked)]
    got = history.status_history(spark.createDataFrame(rows, SCHEMA)).orderBy("line").collect()
    assert [r["line"] for r in got] == list(range(1, len(got) + 1))
    return [(r["status"], r["current"]) for r in got]


def test_fold(spark):
    v, a, i, n, r = ((x, x) for x in ("VIEWED", "APPLIED", "INTERVIEW", "NOT_INTERESTED", "REJECTED"))
    assert lines(spark, (1, "VIEWED"), (1, "VIEWED"), (1, "APPLIED"), (1, "VIEWED")) == [v, a]
    assert lines(spark, (1, "VIEWED"), (1, "APPLIED"), (1, "INTERVIEW"), (1, "REJECTED")) == [v, r]
    assert lines(spark, (1, "APPLIED"), (2, "INTERVIEW"), (2, "INTERVIEW"), (3, "INTERVIEW")) == [a, i]
    assert lines(spark, (1, "VIEWED"), (1, "APPLIED"), (2, "NOT_INTERESTED"), (2, "RETURNED")) == [v, a, n, ("RETURNED", "APPLIED")]
    assert lines(spark, (1, "APPLIED"), (1, "NOT_INTERESTED"), (1, "APPLIED")) == [a, n, a]
    assert lines(spark, (1, "INTERVIEW"), (1, "NOT_INTERESTED"), (1, "RETURNED"), (2, "NOT_INTERESTED"), (2, "RETURNED")) == [i, n, ("RETURNED", "INTERVIEW"), n, ("RETURNED", "INTERVIEW")]
    assert lines(spark, (1, "NOT_INTERESTED"), (2, "RETURNED"), (2, "NOT_INTERESTED")) == [n, ("RETURNED", "VIEWED"), n]
    assert lines(spark, (1, "APPLIED"), (1, "RETURNED"), (1, "RETURNED")) == [a, ("RETURNED", "VIEWED")]
    assert lines(spark, (1, "INTERVIEW"), (1, "RETURNED")) == [i] and lines(spark, (1, "RETURNED")) == []


def test_edges(spark):
    rows = [(1, None, 5, "APPLIED", None, None), (2, None, 5, "INTERVIEW", None, None), (3, 1, None, None, None, None), (4, 1, 5, "OTHER", dt.datetime(2024, 1, 1), None), (4, 1, 5, "OTHER", dt.datetime(2024, 1, 1), None)]
    got = history.current_status(history.status_history(spark.createDataFrame(rows, SCHEMA).repartition(3))).collect()
    assert {(r["user_id"], r["vacancy_id"], r["status"]) for r in got} == {(None, 5, "INTERVIEW"), (1, 5, "OTHER")}
    assert history.status_history(spark.createDataFrame([], SCHEMA)).count() == 0
