"""Entity resolution: candidate pairs by rank, keepers, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a temporary folder in local mode (tests), else an error, as
    executors don't see each other's folders."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    at = tempfile.mkdtemp(prefix="postlake-")
    spark.sparkContext.setCheckpointDir(at)
    return at


#: Where it is set, Spark removes the shuffles of an execution when it ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, steps: list[str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: later reads need none of its lineage, and its shuffles are removed at once.

    The folder is added to steps, if given, for `removed`."""
    spark = df.sparkSession
    at = f"{shared_folder(spark).rstrip('/')}/step-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANED, "false")
    spark.conf.set(CLEANED, "true")
    try:
        df.write.option("compression", "zstd").parquet(at)
    finally:
        spark.conf.set(CLEANED, before)
    if steps is not None:
        steps.append(at)
    return spark.read.schema(df.schema).parquet(at)


def removed(spark: SparkSession, steps: list[str]) -> None:
    """Removes written tables that nothing reads any more, as what was made of them is written."""
    for at in steps:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    steps.clear()


def keepers(pairs: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """One batch of merges (merged, kept, rank) from ranked pairs (a, b, rank), either way round.

    Each vacancy goes to the smallest other one it is paired with, if that is smaller, by the
    smallest rank; a vacancy that is somebody's keeper is not merged in the same batch.
    """
    both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "rank").where("b < a")
    if blocked is not None:
        stop = blocked.select(F.col("a").alias("x"), F.col("b").alias("y"))
        both = both.join(stop, (F.col("b") == F.col("x")) & (F.col("a") == F.col("y")), "left_anti")
    best = written(both.groupBy(F.col("a").alias("merged")).agg(F.min(F.struct("b", "rank")).alias("t")).select("merged", F.col("t.b").alias("kept"), F.col("t.rank").alias("rank")))  # read twice
    return best.join(best.select(F.col("kept").alias("k")).distinct(), F.col("merged") == F.col("k"), "left_anti")


def resolve_all(pairs: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """(merged, kept) of repeated batches until nothing is left to merge; kept is the final one.

    Each batch is written to the shared folder. Batches end, as each shortens every chain.
    """
    left = written(pairs.select("a", "b", "rank"))
    blocked = written(blocked) if blocked is not None else None
    moves = None
    while True:
        batch = written(keepers(left, blocked))
        if batch.isEmpty():
            break
        to = batch.select(F.col("merged").alias("m"), F.col("kept").alias("k"))
        if moves is None:
            moves = batch.select("merged", "kept")
        else:
            moves = moves.join(to, moves["kept"] == to["m"], "left").select("merged", F.coalesce("k", "kept").alias("kept")).union(batch.select("merged", "kept"))
        moves = written(moves)
        for side in ("a", "b"):
            left = left.join(to, left[side] == to["m"], "left").withColumn(side, F.coalesce("k", side)).drop("m", "k")
        if blocked is not None:  # a block follows the vacancies it names
            for side in ("a", "b"):
                blocked = blocked.join(to, blocked[side] == to["m"], "left").withColumn(side, F.coalesce("k", side)).drop("m", "k")
            blocked = written(blocked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        left = written(left.where("a <> b").select("a", "b", "rank").distinct())
    return moves if moves is not None else left.select(F.col("a").alias("merged"), F.col("b").alias("kept")).limit(0)


def components(pairs: DataFrame) -> DataFrame:
    """(node, label): the smallest node that pairs (a, b) connect a node with.

    Labels spread along the pairs and jump to their own label's label, so the number of steps grows
    with the logarithm of the longest path; each is written to the shared folder.
    """
    edges = written(pairs.select("a", "b").union(pairs.select("b", "a")).where("a IS NOT NULL AND b IS NOT NULL").distinct())
    label = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        near = edges.join(label, edges["b"] == label["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near, label["node"] == near["a"]).select("node", F.least("label", "near").alias("label"), F.col("label").alias("before"))
        own = step.select(F.col("node").alias("x"), F.col("label").alias("up"))
        step = written(step.join(own, step["label"] == own["x"]).select("node", F.least("label", "up").alias("label"), "before"))
        if step.where("label <> before").isEmpty():
            return step.select("node", "label")
        label = step.select("node", "label")
