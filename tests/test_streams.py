"""Streams over several batches: a repeated batch counts once, timers, closed sessions."""

import datetime as dt
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pkgloom.streaming import feed

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture
def log(spark, tmp_path):
    """Three files, read one a batch: user 1 goes quiet after the first, user 2 comes back, user 3 stays."""
    times = [[(1, 0), (2, 0), (3, 0), (1, 2)], [(3, 30), (3, 60)], [(2, 61), (3, 90), (3, 91)]]
    n = 0
    for i, batch in enumerate(times):
        rows = []
        for user, hour in batch:
            rows.append((n, DAY + dt.timedelta(hours=hour), user, "view" if user % 2 else "click", 1.0))
            n += 1
        frame = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value"])
        frame["ts"] = frame["ts"].astype("datetime64[us]")
        (tmp_path / "events.parquet").mkdir(exist_ok=True)
        path = tmp_path / "events.parquet" / f"{i}.parquet"
        frame.to_parquet(path)


        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken by age
    return str(tmp_path)


def stream(spark, log):
    schema = spark.read.parquet(f"{log}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{log}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def test_a_repeated_batch_counts_once(spark, log, tmp_path):
    out, seen = str(tmp_path / "out"), []
    keep = feed.keeper(out, ["event_type"])

    def twice(batch, number):
        seen.append(number)
        keep(batch, number)
        keep(batch, number)

    feed.consume(stream(spark, log), twice, str(tmp_path / "a"))
    assert len(seen) == 3
    again = str(tmp_path / "b")  # a subscriber without memory replays everything under the same numbers
    feed.dispatch(stream(spark, log), out, again)
    got = {r.event_type: r.n for r in spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n")).collect()}
    assert got == {"view": 7, "click": 2}
    feed.dispatch(stream(spark, log), out, again)  # and one with memory reads nothing anew
    assert spark.read.parquet(out).count() == 9


def test_spells_and_state(spark, log, tmp_path):
    out = str(tmp_path / "quiet")
    feed.consume(feed.activity_spells(stream(spark, log), dt.timedelta(hours=24)), feed.keeper(out), str(tmp_path / "c"))
    got = sorted((r.user_id, (r.last_ms - int(DAY.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)) // 3_600_000, r.n) for r in spark.read.parquet(out).collect())
    assert got == [(1, 2, 2), (2, 0, 1), (2, 61, 1), (3, 0, 1), (3, 30, 1), (3, 60, 1)]
    state = str(tmp_path / "state")
    feed.consume(feed.last_state(stream(spark, log)), feed.keeper(state), str(tmp_path / "d"), "update")
    assert {(r.user_id, r.event_id, r.n) for r in feed.latest(spark, state, ["user_id"]).collect()} == {(1, 3, 2), (2, 6, 2), (3, 8, 5)}


def test_sessions_come_once_when_closed(spark, log, tmp_path):
    out = str(tmp_path / "sessions")
    feed.consume(feed.sessions(stream(spark, log)), feed.keeper(out), str(tmp_path / "e"))
    got = sorted((r.user_id, int((r.start - DAY).total_seconds() // 3600), r.n) for r in spark.read.parquet(out).withColumn("start", F.col("start").cast("timestamp_ntz")).collect())
    assert got == [(1, 0, 2), (2, 0, 1), (2, 61, 1), (3, 0, 1), (3, 30, 1), (3, 60, 1)]
