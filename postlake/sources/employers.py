"""Employers of sources whose hiring system doesn't name them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Provider, board and employer of sources that are named by hand.
BY_HAND = (
    ("workday", "cat.wd5.myworkdayjobs.com/caterpillarcareers", "Caterpillar"),
    ("workday", "hpe.wd5.myworkdayjobs.com/jobsathpe", "Hewlett Packard Enterprise"),
    ("workday", "hpe.wd5.myworkdayjobs.com/acjobsite", "Hewlett Packard Enterprise"),
    ("workday", "hpe.wd5.myworkdayjobs.com/wfmathpe", "Hewlett Packard Enterprise"),
    ("personio", "personio.jobs.personio.de", "Personio"),
)


def parsed(text: str) -> tuple[tuple[str, str, str], ...]:
    """The entries of a list in JSON: {"employers": [{"provider", "board", "name"}]}. One that lacks any of them is an error."""
    out = tuple((e.get("provider") or "", e.get("board") or "", (e.get("name") or "").strip()) for e in json.loads(text).get("employers", []))
    for entry in out:
        if not all(x.strip() for x in entry):
            raise ValueError(f"an employer without provider, board or name: {entry}")
    return out


def named(sources: DataFrame, names: tuple[tuple[str, str, str], ...] = BY_HAND) -> DataFrame:
    """sources (provider, board, employer_name, ...) with the names of the list in place of those of the hiring systems;
    entries without a source are left out, of entries for one board the last holds.

    The list is a file that people keep, so it is a map literal of the plan: no join, no shuffle."""
    last = {f"{provider}\n{board}": name for provider, board, name in names}
    if not last:
        return sources
    table = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])
    key = F.concat(F.col("provider"), F.lit("\n"), F.col("board"))
    return sources.withColumn("employer_name", F.coalesce(F.try_element_at(table, key), F.col("employer_name")))
