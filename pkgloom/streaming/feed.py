"""The event log as Structured Streaming.

A subscriber is a checkpoint folder: it resumes after the last batch it
finished, and a batch that failed comes again (at least once). Results are kept
in one folder per batch number that a repeated batch overwrites, so it counts
once. Event times come without zone and are read as UTC timestamps.
"""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KINDS = ("view", "click", "purchase", "signup", "error")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the session's shared place."""
    where = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="pkgloom-")
    return f"{where}/pkgloom-{name}-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str, files_per_batch: int = 64) -> DataFrame:
    """The log as a stream of (event_id, ts, user_id, event_type, value)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/events.parque[t]")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def consume(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a subscriber over all that is there; the offset advances after ``handle`` returned."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle).trigger(availableNow=True).start().awaitTermination()


def append_events(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append to the log, each batch exactly once."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def keeper(path: str, by: list[str] = ()) -> Callable[[DataFrame, int], None]:
    """A handler that keeps every batch in the folder of its number, however often it comes. Readers find the number as column ``batch``."""

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/batch={number}")

    return handle


def dispatch(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Every kind of event to its own folder of its batch."""
    consume(stream, keeper(path, ["event_type"]), checkpoint)


def incremental_totals(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Per batch the changed users with their new sums; the latest row of a user counts."""
    changed = stream.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    consume(changed, keeper(path), checkpoint, "update")


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The rows of the last batch that touched each key."""
    df = spark.read.parquet(path)
    values = [c for c in df.columns if c not in (*keys, "batch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def windowed_counts(stream: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and value per window and kind, late rows within the watermark included."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """A user's sessions, ended by a gap. In append mode a session comes once, when the watermark has passed its end, and its state goes."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def without_duplicates(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def last_state(stream: DataFrame, keep: dt.timedelta = dt.timedelta(days=365), late: str = "1 hour") -> DataFrame:
    """Per user the newest event and the number seen, kept as state that goes after ``keep`` of event time without an event.

    Timers run on event time: with timers on processing time a run over all that
    is there would not end, as every empty batch may be followed by another.
    """
    wait = int(keep.total_seconds() * 1000)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest, kind, n, last = state.get if state.exists else (-1, "", 0, 0)
        for frame in frames:
            n, last = n + len(frame), max(last, int(frame["ts_ms"].max()))
            top = frame.loc[frame["event_id"].idxmax()]
            if top["event_id"] > newest:
                newest, kind = int(top["event_id"]), str(top["event_type"])
        state.update((newest, kind, n, last))
        state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], newest, kind, n)], columns=["user_id", "event_id", "event_type", "n"])

    rows = stream.withWatermark("ts", late).select("user_id", "event_id", "event_type", "ts", F.unix_millis("ts").alias("ts_ms"))
    return rows.groupBy("user_id").applyInPandasWithState(update, "user_id long, event_id long, event_type string, n long", "event_id long, event_type string, n long, last long", "update", GroupStateTimeout.EventTimeTimeout)


def activity_spells(stream: DataFrame, idle: dt.timedelta, late: str = "1 hour") -> DataFrame:
    """A user's spells of activity, ended by ``idle`` of event time without an event: user_id, last_ms, n.

    State holds the open spell's last time and number of events. A later event
    at least ``idle`` after the last one gives the spell out and begins a new one;
    without one a timer does when the watermark has passed, and the user is
    forgotten. Within the watermark's delay, late events join the open spell.
    """
    wait = int(idle.total_seconds() * 1000)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], last, n)], columns=["user_id", "last_ms", "n"])
            return
        times = np.sort(np.concatenate([frame["ts_ms"].to_numpy() for frame in frames]))
        before = np.concatenate(([times[0] if last is None else last], times[:-1]))
        spells = np.split(times, np.flatnonzero(times - before >= wait))
        if len(spells[0]) == 0 or last is None:  # the open spell, if any, got no event
            done, spells = [] if last is None else [(last, n)], [s for s in spells if len(s)]
            spells = [(int(s[-1]), len(s)) for s in spells]
        else:
            done, spells = [], [(max(last, int(spells[0][-1])), n + len(spells[0])), *((int(s[-1]), len(s)) for s in spells[1:])]
        done += spells[:-1]
        state.update(spells[-1])
        # a timer lies after the watermark; one already due comes with the next batch
        state.setTimeoutTimestamp(max(spells[-1][0] + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *d) for d in done], columns=["user_id", "last_ms", "n"])

    rows = stream.withWatermark("ts", late).select("user_id", "ts", F.unix_millis("ts").alias("ts_ms"))
    return rows.groupBy("user_id").applyInPandasWithState(update, "user_id long, last_ms long, n long", "last_ms long, n long", "append", GroupStateTimeout.EventTimeTimeout)
