"""Task queues, guards and cursors as set operations on tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUSY, EXPIRED = "Group is busy", "Lease expired"


def _at(time: dt.datetime) -> Column:
    return F.lit(time.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def claims(tasks: DataFrame, now: dt.datetime, lease_seconds: int, groups: dict[str, str], alive_seconds: int) -> DataFrame:
    """The queued tasks (id, type, state, lease_until, last_error, updated_at, claim_seq) that are claimed
    now, as running ones with a lease and the next fencing number.

    groups names the exclusive group of some types: a group claims one task at a time, its smallest id,
    only if none of its tasks runs under a live lease, and only if no older task that waits because the
    group was busy, and has changed within alive_seconds, stands before it. Other tasks are all claimed.
    """
    group = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])[F.col("type")] if groups else F.lit(None).cast("string")
    own = tasks.withColumn("grp", group)
    waits = F.col("state").isin("QUEUED", "WAITING") & (F.col("last_error") == BUSY) & (F.col("updated_at") > _at(now - dt.timedelta(seconds=alive_seconds)))
    # one small row a group: whether it runs, its oldest task in the queue, the oldest one that waits for it
    per = own.where("grp IS NOT NULL").groupBy("grp").agg(
        F.coalesce(F.bool_or((F.col("state") == "RUNNING") & (F.col("lease_until") > _at(now))), F.lit(False)).alias("runs"),
        F.min(F.when(F.col("state") == "QUEUED", F.col("id"))).alias("first"),
        F.min(F.when(waits, F.col("id"))).alias("waiting"),
    )
    free = per.where(~F.col("runs") & F.col("first").isNotNull() & (F.col("waiting").isNull() | (F.col("first") <= F.col("waiting")))).select(F.col("first").alias("id"))
    queued = own.where("state = 'QUEUED'").drop("grp")
    taken = queued.join(free, "id", "left_semi").unionByName(own.where("state = 'QUEUED' AND grp IS NULL").drop("grp"))
    return taken.withColumns({"state": F.lit("RUNNING"), "lease_until": _at(now + dt.timedelta(seconds=lease_seconds)), "claim_seq": F.col("claim_seq") + 1, "updated_at": _at(now)}).select(*tasks.columns)


def expired(tasks: DataFrame, now: dt.datetime, most: int) -> DataFrame:
    """The running tasks whose lease is over, as failed attempts: queued again, or failed after so many."""
    late = tasks.where((F.col("state") == "RUNNING") & (F.col("lease_until") <= _at(now)))
    tries = F.col("attempts") + 1
    return late.withColumns({"state": F.when(tries >= most, "FAILED").otherwise("QUEUED"), "attempts": tries, "lease_until": F.lit(None).cast("timestamp_ntz"), "last_error": F.lit(EXPIRED), "updated_at": _at(now)}).select(*tasks.columns)


def finished(tasks: DataFrame, reports: DataFrame) -> DataFrame:
    """(id, state) of the running tasks whose report (id, claim_seq, outcome) has their fencing number;
    what an earlier claimant reports is ignored."""
    r = reports.select(F.col("id").alias("rid"), F.col("claim_seq").alias("seq"), "outcome")
    return tasks.where("state = 'RUNNING'").join(r, (F.col("id") == F.col("rid")) & (F.col("claim_seq") == F.col("seq"))).select("id", F.col("outcome").alias("state"))


def timeouts(vacancies: DataFrame, now: dt.datetime, days: int = 30) -> DataFrame:
    """vacancies (last_confirmed_at) with hidden: not confirmed for so many days."""
    return vacancies.withColumn("hidden", F.col("last_confirmed_at") < _at(now - dt.timedelta(days=days)))


def earlier(known: DataFrame, read: DataFrame, key: str, date: str) -> DataFrame:
    """(key, date): dates only move to earlier ones; what was not read keeps its own."""
    return known.select(key, date).unionByName(read.select(key, date)).groupBy(key).agg(F.min(date).alias(date))


def after(rows: DataFrame, cursor: dict[str, object]) -> DataFrame:
    """Rows beyond a cursor in the order of its keys: those a resumed reader has yet to see."""
    beyond, same = F.lit(False), F.lit(True)
    for column, value in cursor.items():
        at = _at(value) if isinstance(value, dt.datetime) else F.lit(value)
        beyond = beyond | (same & (F.col(column) > at))
        same = same & (F.col(column) == at)
    return rows.where(beyond)


def unless_shrunk(fresh: DataFrame, before: DataFrame) -> DataFrame:
    """fresh, or nothing of it if it has fewer than half as many rows as before."""
    n = fresh.agg(F.count("*").alias("n")).crossJoin(before.agg(F.count("*").alias("m")))  # one row
    return fresh.crossJoin(F.broadcast(n.where("n * 2 >= m").select())) if fresh.columns else fresh


def if_fresh(rows: DataFrame, reads: DataFrame, time: str, now: dt.datetime, days: int = 2) -> DataFrame:
    """rows if the feed that reads tell of was read within so many days, else none of them."""
    last = reads.agg(F.max(time).alias("last")).where(F.col("last") >= _at(now - dt.timedelta(days=days)))
    return rows.crossJoin(F.broadcast(last.select()))


def days_without(rows: DataFrame, time: str, first: dt.date, last: dt.date) -> DataFrame:
    """(day) of the days from first to last that no row has, to be computed again."""
    spark = rows.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return days.join(rows.select(F.col(time).cast("date").alias("day")).distinct(), "day", "left_anti")


def outbox_batch(outbox: DataFrame, most: int) -> DataFrame:
    """The next messages (id, sent_at, ...) to publish: those not sent, oldest first."""
    return outbox.where("sent_at IS NULL").orderBy("id").limit(most)


def outbox_sent(outbox: DataFrame, answers: DataFrame, now: dt.datetime) -> DataFrame:
    """outbox (id, sent_at, attempts) after a batch was published; answers (id, answer) has the broker's:
    CONFIRMED messages are sent; RETURNED ones, which nobody takes, stay with one attempt more. If any
    message of the batch has no answer (null), the whole batch stays as it was and is published again,
    so every message arrives at least once, in order."""
    if not answers.where("answer IS NULL").isEmpty():
        return outbox
    said = answers.select(F.col("id").alias("of"), "answer")
    own = outbox.join(said, F.col("id") == F.col("of"), "left")
    open_ = F.col("sent_at").isNull()
    sent = F.when(open_ & (F.col("answer") == "CONFIRMED"), _at(now)).otherwise(F.col("sent_at"))
    tries = F.when(open_ & (F.col("answer") == "RETURNED"), F.col("attempts") + 1).otherwise(F.col("attempts"))
    return own.withColumns({"sent_at": sent, "attempts": tries}).drop("of", "answer")
