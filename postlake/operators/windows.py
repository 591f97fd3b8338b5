"""Ranking patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order; Spark keeps one row per key and task before the shuffle."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def fair_queue(df: DataFrame, group: str, order: list[Column], column: str = "turn") -> DataFrame:
    """df with each row's turn within its group; sorted by turn, groups alternate."""
    return df.withColumn(column, F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def with_size(df: DataFrame, key: str, column: str = "size") -> DataFrame:
    """df with the number of rows of its key; counted first and joined, so a hot key is no one task's."""
    n = df.groupBy(key).agg(F.count("*").alias(column)).withColumnRenamed(key, "__k")
    return df.join(n, df[key].eqNullSafe(n["__k"])).drop("__k")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def versions(df: DataFrame, owner: str, order: str) -> DataFrame:
    """df with version, the number of a row among its owner's, and active, which marks the last one."""
    own = Window.partitionBy(owner).orderBy(order)
    last = df.groupBy(F.col(owner).alias("__o")).agg(F.max(order).alias("__last"))
    out = df.withColumn("version", F.row_number().over(own).cast("long")).join(last, F.col(owner).eqNullSafe(F.col("__o")), "left")
    return out.withColumn("active", F.col(order).eqNullSafe(F.col("__last"))).drop("__o", "__last")
