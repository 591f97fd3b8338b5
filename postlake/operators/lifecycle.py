"""Lifecycle of postings and vacancies, as one join per read of a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.keys import is_web_url

#: Complete reads, and reads of an unrecognised list, after which a missing posting is closed.
CLOSE_AFTER, CLOSE_UNRECOGNISED = 3, 5


def posting_merge(known: DataFrame, fetched: DataFrame, run: DataFrame, not_read: DataFrame | None = None) -> DataFrame:
    """New state of postings after reads of their sources.

    known: source_id, external_id, title, url, location, content, confirmed, missing, closed_at.
    fetched: source_id, external_id, title, url, location, content. run: source_id, complete,
    unrecognised, read_at (one row per source). not_read: source_id, external_id that the read
    left out. The column event says INSERTED, CONFIRMED, REOPENED, UNCONFIRMED, MISSING, CLOSED
    or UNTOUCHED. A fetched row without a web address counts as not verified: it is not recorded,
    and its posting can't be closed. Repeated fetched ids count once (smallest title).
    """
    keys = ["source_id", "external_id"]
    f = fetched.groupBy(*keys).agg(F.min(F.struct("title", "url", "location", "content")).alias("f")).select(*keys, "f", is_web_url(F.col("f.url")).alias("valid"))
    skip = (not_read.select(*keys).distinct() if not_read is not None else f.select(*keys).limit(0)).withColumn("skipped", F.lit(True))
    both = known.withColumn("old", F.lit(True)).join(f, keys, "full").join(skip, keys, "left").join(run, "source_id")
    old, seen = F.col("old").isNotNull(), F.coalesce(F.col("valid"), F.lit(False))
    unseen = old & ~seen & F.col("skipped").isNull()
    verified = F.col("valid").isNull()  # fetched without a web address: not verified
    counts = unseen & verified & (F.col("complete") | F.col("unrecognised"))
    limit = F.when(F.col("complete"), CLOSE_AFTER).otherwise(CLOSE_UNRECOGNISED)
    missing = F.when(seen & F.col("complete"), 0).when(counts, F.coalesce("missing", F.lit(0)) + 1).otherwise(F.coalesce("missing", F.lit(0)))
    closing = counts & (F.coalesce("missing", F.lit(0)) + 1 >= limit) & F.col("closed_at").isNull()
    event = (
        F.when(~old, "INSERTED")
        .when(seen & F.col("complete") & F.col("closed_at").isNotNull(), "REOPENED")
        .when(seen & F.col("complete"), "CONFIRMED")
        .when(F.col("skipped").isNotNull() & ~seen, "UNTOUCHED")
        .when(closing, "CLOSED")
        .when(counts, "MISSING")
        .otherwise("UNCONFIRMED")
    )
    fresh = seen & (F.col("complete") | ~old)
    take = lambda c: F.when(fresh, F.coalesce(F.col(f"f.{c}"), F.col(c))).otherwise(F.col(c)).alias(c)
    out = both.where(old | seen).select(
        *keys,
        *[take(c) for c in ("title", "url", "location", "content")],
        F.when(event.isin("INSERTED", "REOPENED", "CONFIRMED"), True).when(event == "UNTOUCHED", F.col("confirmed")).otherwise(False).alias("confirmed"),
        missing.alias("missing"),
        F.when(closing, F.col("read_at")).when(fresh, F.lit(None)).otherwise(F.col("closed_at")).alias("closed_at"),
        event.alias("event"),
    )
    return out


def vacancy_state(postings: DataFrame, vacancy: str = "vacancy_id") -> DataFrame:
    """CLOSED if all postings are closed, else ACTIVE if an open one is confirmed, else NEEDS_RECHECK."""
    open_ = F.col("closed_at").isNull()
    return postings.groupBy(vacancy).agg(
        F.when(~F.bool_or(open_), "CLOSED").when(F.bool_or(open_ & F.col("confirmed")), "ACTIVE").otherwise("NEEDS_RECHECK").alias("state")
    )


def availability(failure: Column, failing_days: Column, after_days: int = 7) -> Column:
    """OK, TEMP_FAILING or UNAVAILABLE: a lasting failure counts at once, a passing one after some days."""
    return F.when(failure.isNull(), "OK").when((failure == "TEMPORARY") & (failing_days < after_days), "TEMP_FAILING").otherwise("UNAVAILABLE")


def response_group(status: Column, closed: Column, days: Column, silent: int = 21, finished: int = 42) -> Column:
    """FINISHED, SILENT or ACTIVE for a reader's answer to a vacancy."""
    return F.when((status == "REJECTED") | closed | ((status == "APPLIED") & (days >= finished)), "FINISHED").when((status == "APPLIED") & (days >= silent), "SILENT").otherwise("ACTIVE")


def dropped(open_postings: Column, listed: Column, least: int = 5) -> Column:
    """Whether a read lists suspiciously few: fewer than half of at least so many open postings."""
    return (open_postings >= least) & (listed * 2 < open_postings)


def posting_check(checks: DataFrame) -> DataFrame:
    """What single pages say of postings that a list with a country filter no longer has: checks
    (external_id, status, error, title, ...) with result. A page that is there (a success with a title)
    is PRESENT: its details are taken and no absence counts; one that the source says is gone (404, 410)
    is ABSENT: an absence counts; anything else is UNKNOWN: nothing counts, and the next read checks again."""
    from postlake.sources.pages import http_outcome

    kind = http_outcome(F.col("status"), F.col("error"))["kind"]
    there = kind.isNull() & F.col("status").isNotNull() & (F.coalesce(F.trim("title"), F.lit("")) != "")
    return checks.withColumn("result", F.when(there, "PRESENT").when(kind == "NOT_FOUND", "ABSENT").otherwise("UNKNOWN"))


def after_checks(unlisted: DataFrame, checks: DataFrame) -> DataFrame:
    """unlisted postings (external_id, missing, title) after their check: missing 0 and the page's title if
    present, one more if absent, unchanged if unknown or not checked."""
    c = posting_check(checks).select(F.col("external_id").alias("of"), "result", F.col("title").alias("now"))
    own = unlisted.join(c, F.col("external_id") == F.col("of"), "left")
    missing = F.when(F.col("result") == "PRESENT", 0).when(F.col("result") == "ABSENT", F.col("missing") + 1).otherwise(F.col("missing"))
    return own.withColumns({"missing": missing, "title": F.when(F.col("result") == "PRESENT", F.col("now")).otherwise(F.col("title"))}).drop("of", "now", "result")
