"""Mutations as rewrites: each returns the new state of a table from the old one and a batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pair(old: DataFrame, new: DataFrame, keys: list[str], how: str) -> DataFrame:
    on = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    return old.withColumn("__old", F.lit(True)).alias("o").join(new.withColumn("__new", F.lit(True)).alias("n"), on, how)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new whose keys it lacks."""
    on = reduce(lambda a, b: a & b, [old[k].eqNullSafe(new[k]) for k in keys])
    return old.unionByName(new.join(old, on, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], when: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both by key. Of a row in both, non-null values of new win, except in the columns keep
    and where the condition on o.* and n.* doesn't hold."""
    both = _pair(old, new, keys, "full")
    change = F.col("n.__new").isNotNull() & (F.lit(True) if when is None else F.col("o.__old").isNull() | when)
    take = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keys or c in keep else F.when(change, F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))).otherwise(F.col(f"o.{c}"))
    return both.select(*[take(c).alias(c) for c in old.columns])


def update_from(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """old with columns set from the rows of new that have its keys (unique there)."""
    both = _pair(old, new, keys, "left")
    return both.select(*[(F.when(F.col("n.__new").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in columns else F.col(f"o.{c}")).alias(c) for c in old.columns])


def checked_update(old: DataFrame, new: DataFrame, keys: list[str], version: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new state, conflicts): rows of new apply only where their version is still that of old."""
    both = _pair(old, new, keys, "left")
    ok = F.col(f"n.{version}").eqNullSafe(F.col(f"o.{version}")) & F.col("n.__new").isNotNull()
    state = both.select(*[(F.when(ok, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in columns else F.col(f"o.{c}")).alias(c) for c in old.columns])
    lost = _pair(new, old, keys, "left").where(~F.col(f"o.{version}").eqNullSafe(F.col(f"n.{version}"))).select("o.*").drop("__old")
    return state, lost


def collapse(rows: DataFrame, moves: DataFrame, owner: str, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Children moved to the kept owner (moves: merged, kept); of rows that then share keys the first in order stays."""
    moved = rows.join(moves, rows[owner] == moves["merged"], "left").withColumn(owner, F.coalesce("kept", owner)).drop("merged", "kept")
    top = F.min(F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], *columns)).alias("__t")
    return moved.groupBy(owner, *keys).agg(top).select(owner, *keys, *[F.col(f"__t.{c}").alias(c) for c in columns])


def append_new(done: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """What of a batch is not done yet, each key once: running it twice appends nothing."""
    on = reduce(lambda a, b: a & b, [batch[k] == done[k] for k in keys])
    return batch.join(done, on, "left_anti").dropDuplicates(keys)


def replace_children(old: DataFrame, new: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """old without the children of the given parents, and the new ones."""
    return old.join(parents.select(key).distinct(), key, "left_anti").unionByName(new)


def visit(seen: Column, boundary: Column, now: Column, gap_seconds: int = 1800) -> Column:
    """Start of the current visit: the last time seen if that is longer ago than the gap, else as it was."""
    return F.when(seen < now - F.make_dt_interval(secs=F.lit(gap_seconds)), seen).otherwise(boundary)


def dedupe(rows: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """(keys, kept, n): the smallest id of rows that are one by their keys, and their number."""
    return rows.groupBy(*keys).agg(F.min(id_).alias("kept"), F.count("*").alias("n"))
