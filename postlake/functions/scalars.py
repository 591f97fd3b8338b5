"""Dates, arrays, JSON, digests and small formulas as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s ]+"


def iso_date(text: Column) -> Column:
    """Date of an ISO prefix (2026-01-31...), null if it is none."""
    return F.try_to_date(F.regexp_extract(text, r"^\s*(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")


def portal_date(text: Column) -> Column:
    """Date of d.M.yyyy, null if it is none."""
    return F.try_to_date(F.nullif(F.regexp_extract(text, r"(\d{1,2}\.\d{1,2}\.\d{4})", 1), F.lit("")), "d.M.yyyy")


def relative_date(text: Column, today: Column) -> Column:
    """Date of "Posted Today", "Posted Yesterday", "Posted N Days Ago"; null for "30+" and others."""
    n = F.regexp_extract(text, r"(?i)posted (\d+) days? ago", 1)
    return (
        F.when(text.rlike("(?i)posted today"), today)
        .when(text.rlike("(?i)posted yesterday"), F.date_sub(today, 1))
        .when(n != "", F.date_sub(today, n.try_cast("int")))
    )


def local_time(ts: Column, zone: Column) -> Column:
    """UTC time as wall time of a zone."""
    return F.from_utc_timestamp(ts, zone)


def day_bounds(day: Column, zone: str) -> tuple[Column, Column]:
    """Half-open UTC bounds of a local day, right on days of 23 and 25 hours."""
    begin = F.to_utc_timestamp(day.cast("timestamp"), zone)
    return begin, F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)


def backoff(initial: float, most: float, attempts: Column) -> Column:
    """Seconds before the next attempt: initial doubled for each attempt, at most so many."""
    return F.least(F.lit(float(most)), F.lit(float(initial)) * F.pow(F.lit(2.0), attempts))


def rotation(day_number: Column, per_day: int, n: Column) -> Column:
    """Where today's window of a rotating list begins."""
    return F.when(n > 0, F.pmod(day_number * per_day, n))


def split_list(text: Column, by: str = ",") -> Column:
    """Array of a joined list; the empty string is the empty array, null stays null."""
    return F.filter(F.split(text, by), lambda x: x != "")


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays, as double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(a: Column) -> Column:
    """Vector of length 1; a null vector stays."""
    size = F.sqrt(dot(a, a))
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


def every_word(text: Column, words: list[str], fold) -> Column:
    """Whether a text has every word, folded."""
    folded = fold(text)
    return reduce(lambda a, w: a & F.contains(folded, fold(F.lit(w))), words, F.lit(True))


def html_text(html: Column) -> Column:
    """Text of HTML by native expressions: scripts, styles, comments and tags go, the five basic
    character references and numeric blanks are decoded, white space collapses. Entity-encoded
    markup is stripped in a second turn."""
    out = html
    for _ in range(2):
        out = F.regexp_replace(out, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
        out = F.regexp_replace(out, r"(?s)<[a-zA-Z/!][^>]*>", " ")
        for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, SPACE, " "))
