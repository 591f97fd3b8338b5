"""Reading tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; columns and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, rows: int = 5_000, *keys: str) -> DataFrame:
    """df over tasks of at most so many rows or so, for costly work a row: a small file that is read in one task holds very many short rows.

    With keys the rows of a key stay together, whatever the number of tasks."""
    parts = -(-df.count() // rows)
    if keys:
        return df.repartition(max(parts, 1), *keys)
    return df.repartition(parts) if parts > df.rdd.getNumPartitions() else df
