"""Writing results: by day, as a whole, once per key, snapshots, mail texts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def overwrite_days(df: DataFrame, path: str, day: str = "day") -> None:
    """Replace the days that df has, and no other, in one commit: running a day again is harmless."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a whole table: written beside it, then renamed, so readers see the old or the new one."""
    spark = df.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    fs, target = _fs(spark, path)
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if fs.exists(target):
        fs.rename(target, make(old))
    fs.rename(make(new), target)
    fs.delete(make(old), True)


def snapshot_key(source: Column, body: Column) -> Column:
    """<source>/<sha256> of a captured body."""
    return F.concat_ws("/", source.cast("string"), F.sha2(body, 256))


def put_snapshots(bodies: DataFrame, path: str) -> None:
    """Append captured bodies (source_id, day, body), those of one source and content once per day."""
    own = bodies.withColumn("object_key", snapshot_key(F.col("source_id"), F.col("body")))
    own.dropDuplicates(["object_key", "day"]).write.mode("append").partitionBy("day").parquet(path)


def purge_snapshots(spark: SparkSession, path: str, before: str) -> list[str]:
    """Delete the day folders before a day; returns their names."""
    fs, root = _fs(spark, path)
    gone = []
    for s in fs.listStatus(root) if fs.exists(root) else []:
        name = s.getPath().getName()
        if name.startswith("day=") and name[4:] < before:
            fs.delete(s.getPath(), True)
            gone.append(name)
    return sorted(gone)


def digest_texts(lines: DataFrame, most: int = 20) -> DataFrame:
    """(user_id, total, body): up to so many lines of each user in order of opened and id; the lines
    beyond are counted, not gathered."""
    from pyspark.sql import Window

    total = lines.groupBy("user_id").agg(F.count("*").alias("total"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("opened"), "vacancy_id"))
    few = lines.withColumn("r", rank).where(F.col("r") <= most)
    text = F.concat_ws(" ", F.lit("-"), "title", F.concat(F.lit("<"), "url", F.lit(">")))
    body = few.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", text.alias("t")))), lambda s: s["t"]), "\n").alias("body"))
    return total.join(body, "user_id")
