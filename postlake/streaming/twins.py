"""Batch twins: what the streams of this folder give once all their input has been seen."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP = "30 minutes"
CLOSE_AFTER = 3


def hour_windows(events: DataFrame) -> DataFrame:
    """(begin, event_type, n, total) of each hour."""
    return events.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("begin"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sessions(events: DataFrame) -> DataFrame:
    """(user_id, begin, n) of visits: a longer pause than the gap ends one."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.col("ts") <= F.lag("ts").over(own) + F.expr(f"INTERVAL {GAP}"), 0).otherwise(1)
    k = F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("fresh", fresh).withColumn("k", k).groupBy("user_id", "k").agg(F.min("ts").alias("begin"), F.count("*").alias("n")).drop("k")


def absences(reads: DataFrame, close_after: int = CLOSE_AFTER) -> DataFrame:
    """(user_id, closings): how often close_after reads in a row missed a key; reads: user_id, event_id, ts, seen."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    run = F.sum(F.col("seen").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    nth = F.row_number().over(Window.partitionBy("user_id", "run").orderBy("ts", "event_id")) - F.when(F.col("run") > 0, 1).otherwise(0)
    return reads.withColumn("run", run).withColumn("missing", nth).groupBy("user_id").agg(F.count_if(~F.col("seen") & (F.col("missing") == close_after)).alias("closings"))


def rate_limited(asks: DataFrame, interval: int, most: int) -> DataFrame:
    """asks (host, event_id, at in microseconds) with granted and wait: a host is used once per
    interval; an ask that would wait longer than most is refused. One pass over each host's asks in
    order, which holds one number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, free = None, 0
        for b in batches:
            granted, wait = [], []
            for h, at in zip(b["host"], b["at"], strict=True):
                if h != host:
                    host, free = h, at
                w = max(free - at, 0)
                granted.append(w <= most)
                wait.append(w if w <= most else None)
                if w <= most:
                    free = at + w + interval
            yield pd.DataFrame({"host": b["host"], "event_id": b["event_id"], "granted": granted, "wait": pd.array(wait, dtype="Int64")})

    return asks.repartition("host").sortWithinPartitions("host", "at", "event_id").select("host", "event_id", "at").mapInPandas(run, "host long, event_id long, granted boolean, wait long")
