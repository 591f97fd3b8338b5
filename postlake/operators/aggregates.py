"""Aggregation patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_total(df: DataFrame, key: str, part: str, value, alias: str = "value", total: str = "") -> DataFrame:
    """value per key and per (key, part), the row of a key marked by part = total; null parts say 'NONE'."""
    grouped = df.groupingSets([[key], [key, part]], key, part).agg(value.alias(alias), F.grouping(part).alias("__g"))
    return grouped.select(key, F.when(F.col("__g") == 1, total).otherwise(F.coalesce(part, F.lit("NONE"))).alias(part), alias)


def majority(df: DataFrame, key: str, value: str, share: float = 0.7, least: int = 2) -> DataFrame:
    """(key, value, n, total): the value that has at least that share of a key's rows, of least at least.
    Rows are counted per (key, value) before the window, so a hot key is small by then."""
    counts = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    totals = counts.withColumn("total", F.sum("n").over(Window.partitionBy(key)))
    top = totals.where((F.col("n") >= share * F.col("total")) & (F.col("total") >= least))
    return top.groupBy(key).agg(F.max_by(F.struct(value, "n", "total"), F.struct("n", value)).alias("t")).select(key, "t.*")


def unambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of keys with one distinct value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("__n"), F.min(value).alias(value)).where("__n = 1").drop("__n")


def facets(names: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows per name, 0 for names without any."""
    n = rows.groupBy(key).agg(F.count("*").alias("total"))
    return names.join(n, key, "left").withColumn("total", F.coalesce("total", F.lit(0)))


def first_values(df: DataFrame, key: str, value: str, order: str, n: int) -> DataFrame:
    """Up to n values of each key in order; only n rows of a key are gathered."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order, value))
    few = df.withColumn("__r", rank).where(F.col("__r") <= n)
    return few.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__r", value))).alias("__v")).select(key, F.transform("__v", lambda s: s[value]).alias(value))


def votes(hints: DataFrame, key: str, voter: str, choice: str) -> DataFrame:
    """(key, choice, n, total): each voter counts once per key and choice; total is the key's voters."""
    one = hints.select(key, voter, choice).distinct()
    total = one.groupBy(key).agg(F.count_distinct(voter).alias("total"))
    return one.groupBy(key, choice).agg(F.count("*").alias("n")).join(total, key)


def mostly_not(df: DataFrame, key: str, test) -> DataFrame:
    """Keys of which fewer than half the rows pass a test."""
    return df.groupBy(key).agg(F.count_if(test).alias("hits"), F.count("*").alias("n")).where("2 * hits < n")
