"""Predicates of delivery and search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANYWHERE = "*"
#: Formats that fit every wish.
LOOSE_FORMATS = ("CONFLICT", "HYBRID")


def country_rule(wanted: Column, countries: Column) -> Column:
    """Whether work countries fit: an overlap, or no wish. Null countries (not yet recognised) and a
    list of only '*' fit no named wish; null in, null or false out, so where() drops them."""
    return (F.cardinality(wanted) == 0) | F.arrays_overlap(wanted, countries) | (F.cardinality(countries) == 0)


def format_rule(wanted: Column, offered: Column) -> Column:
    """Whether a work format fits: no wish, nothing said, a loose one, or the same."""
    return wanted.isNull() | offered.isNull() | offered.isin(*LOOSE_FORMATS) | (offered == wanted)


def fresh(posted: Column, now: Column, months: int = 4) -> Column:
    """Posted less than so many calendar months ago, or at an unknown time."""
    return posted.isNull() | (posted > F.add_months(now, -months))


def ranked(column: Column, order: list[str]) -> Column:
    """Rank of a status in a list, the length for any other; for min() and back by unranked()."""
    out = F.lit(len(order))
    for i in reversed(range(len(order))):
        out = F.when(column == order[i], i).otherwise(out)
    return out


def unranked(rank: Column, order: list[str], other: str = "NONE") -> Column:
    """The status of a rank."""
    out = F.lit(other)
    for i in reversed(range(len(order))):
        out = F.when(rank == i, order[i]).otherwise(out)
    return out


def optional(column: Column, value: object) -> Column:
    """A filter that a search may leave out: true for all rows without a value."""
    return F.lit(True) if value is None else column == F.lit(value)
