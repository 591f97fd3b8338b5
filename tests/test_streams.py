"""Streams against their batch twins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from postlake.streaming import streams, twins

EVENTS = "/root/testdata/sf0.001/events.parquet"


def files(spark, tmp_path):
    """Events in time order in three files, and a late sentinel that closes all windows."""
    e = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts", "event_id")
    rows = e.collect()
    for i in range(3):
        spark.createDataFrame(rows[i * len(rows) // 3 : (i + 1) * len(rows) // 3], e.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = dt.datetime(2030, 1, 1)
    spark.createDataFrame([(-1, last, -1, "end", 0.0, None)], streams.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), spark.read.parquet(EVENTS)


def run(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return df.sparkSession.table(name)


def test_windows_and_sessions(spark, tmp_path):
    folder, events = files(spark, tmp_path)
    got = run(streams.hour_windows(streams.read_events(spark, folder)), "hours", tmp_path).where("event_type <> 'end'")
    want = twins.hour_windows(events)
    rows = lambda df: sorted((str(r["begin"])[:19], r["event_type"], r["n"]) for r in df.collect())
    assert rows(got) == rows(want)
    got = run(streams.sessions(streams.read_events(spark, folder)), "visits", tmp_path).where("user_id >= 0")
    rows = lambda df: sorted((r["user_id"], str(r["begin"])[:19], r["n"]) for r in df.collect())
    assert rows(got) == rows(twins.sessions(events))


def test_absences(spark, tmp_path):
    folder, events = files(spark, tmp_path)
    reads = streams.read_events(spark, folder).withColumn("seen", F.col("event_type") == "click")
    got = run(streams.absences(reads), "absences", tmp_path).where("user_id >= 0").groupBy("user_id").count()
    want = twins.absences(events.select("user_id", "event_id", "ts", (F.col("event_type") == "click").alias("seen"))).where("closings > 0")
    assert {r["user_id"]: r["count"] for r in got.collect()} == {r["user_id"]: r["closings"] for r in want.collect()}


def test_append_once(spark, tmp_path):
    folder, events = files(spark, tmp_path)
    out = str(tmp_path / "out")
    for k in range(2):  # a second run from a fresh checkpoint sees the same input again
        streams.append_once(streams.read_events(spark, folder).select("event_id", "user_id"), out, str(tmp_path / f"c{k}"), ["event_id"]).awaitTermination(300)
    assert spark.read.parquet(out).count() == events.count() + 1


def test_rate_limiter(spark):
    asks = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (1, 3, 0), (1, 4, 100), (2, 5, 7)], "host long, event_id long, at long")
    got = {r["event_id"]: (r["granted"], r["wait"]) for r in twins.rate_limited(asks, interval=10, most=15).collect()}
    assert got == {1: (True, 0), 2: (True, 10), 3: (False, None), 4: (True, 0), 5: (True, 0)}
