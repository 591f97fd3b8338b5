"""Streams over event files. Windows are emitted once the watermark has passed them (append mode)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postlake.streaming.twins import CLOSE_AFTER, GAP

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, lateness: str = "1 hour", files_per_batch: int = 1) -> DataFrame:
    """Events of Parquet files as they arrive; later ones than lateness are dropped by windows."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder).withWatermark("ts", lateness)


def hour_windows(events: DataFrame) -> DataFrame:
    """Tumbling hours."""
    return events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("begin"), "event_type", "n", "total")


def sessions(events: DataFrame) -> DataFrame:
    """Visits with a gap."""
    return events.groupBy("user_id", F.session_window("ts", GAP)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("begin"), "n")


def once(events: DataFrame) -> DataFrame:
    """Each event id once, while the watermark remembers it."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


def absences(reads: DataFrame, close_after: int = CLOSE_AFTER) -> DataFrame:
    """Keyed counter of misses in a row; a row each time it reaches close_after. The state is one
    number per key; the order within a micro-batch is that of ts and event_id."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        missing = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        closed = []
        for event, seen in zip(rows["event_id"], rows["seen"], strict=True):
            missing = 0 if seen else missing + 1
            if missing == close_after:
                closed.append(event)
        state.update((missing,))
        yield pd.DataFrame({"user_id": [key[0]] * len(closed), "event_id": closed})

    own = reads.select("user_id", "event_id", "ts", "seen")
    return own.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long", "missing int", "append", GroupStateTimeout.NoTimeout)


def append_once(stream: DataFrame, out: str, checkpoint: str, keys: list[str], watermark: tuple[str, str] | None = None):
    """A running query that writes each key once to a Parquet table.

    Repeated keys are dropped by the stream's own state, within the watermark (column, delay) if there
    is one. Every micro-batch is written to a folder by its number, over what a failed attempt left
    there; so nothing that was written is read again, and the folder out belongs to one checkpoint.
    """
    own = stream.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys) if watermark else stream.dropDuplicates(keys)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return own.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
