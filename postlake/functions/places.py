"""Place keys of postings and how two sets of them relate, without user functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.functions.keys import plain_text

# Places that say nothing about the city.
GENERAL = (
    "slovensko", "slovakia", "slovenska republika", "slovak republic", "cesko", "czechia", "ceska republika",
    "czech republic", "madarsko", "hungary", "polsko", "poland", "rakusko", "austria", "nemecko", "germany", "europe",
    "world wide", "worldwide", "remote", "remote work", "home office", "praca z domu", "prace z domu", "hybrid",
)
SPACES = " \t\n\r"


def places(location: Column) -> Column:
    """Sorted distinct 'c:city' and 'r:region' of a location; empty for general places and null."""
    bare = F.regexp_replace(plain_text(location), r"\([^)]*\)", " ")
    segments = F.flatten(F.transform(F.split(bare, ";"), lambda p: F.split(F.split_part(p, F.lit(" - "), F.lit(1)), ",")))
    segments = F.filter(F.transform(segments, F.trim), lambda s: ~s.rlike(r"\d\S*$"))
    words = F.transform(segments, lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"\S*\d\S*", " "), "[^a-z]+", " ")))
    words = F.transform(words, lambda s: F.regexp_replace(s, r"^(okres|slovakia|slovensko)\s+", ""))
    words = F.filter(words, lambda s: (F.length(s) >= 3) & ~s.isin(*GENERAL))
    named = F.transform(
        words,
        lambda s: F.when(s.rlike("^(bratislava|kosice)( |$)"), F.concat(F.lit("c:"), F.split_part(s, F.lit(" "), F.lit(1))))
        .when(s.rlike(r"\bkraj\b"), F.concat(F.lit("r:"), s))
        .otherwise(F.concat(F.lit("c:"), s)),
    )
    return F.array_sort(F.array_distinct(named))


def relation(first: Column, second: Column) -> Column:
    """'same', 'different' or 'loose': cities decide if both have some, regions if neither has a city."""
    none = F.array().cast("array<string>")
    kind = lambda a, k: F.filter(F.coalesce(a, none), lambda x: F.startswith(x, F.lit(k)))
    c1, c2, r1, r2 = kind(first, "c:"), kind(second, "c:"), kind(first, "r:"), kind(second, "r:")
    verdict = lambda a, b: F.when(F.arrays_overlap(a, b), "same").otherwise("different")
    return (
        F.when((F.size(c1) > 0) & (F.size(c2) > 0), verdict(c1, c2))
        .when((F.size(c1) == 0) & (F.size(c2) == 0) & (F.size(r1) > 0) & (F.size(r2) > 0), verdict(r1, r2))
        .otherwise("loose")
    )
