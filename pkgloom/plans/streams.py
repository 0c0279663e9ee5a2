"""The event log run to its end, against the same result in one batch."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..streaming import feed
from .registry import query
from .views import Views


@query("x1_append_events", "SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY event_type")
def _(v: Views):
    out = feed.folder(v.spark, "log")
    feed.append_events(feed.events(v.spark, v.sf_dir), out, feed.folder(v.spark, "subscriber"))
    return v.spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@query("x5_dispatch", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(v: Views):
    out = feed.folder(v.spark, "dispatched")
    feed.dispatch(feed.events(v.spark, v.sf_dir), out, feed.folder(v.spark, "subscriber"))
    return v.spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("x6_incremental_totals", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY user_id")
def _(v: Views):
    out = feed.folder(v.spark, "totals")
    feed.incremental_totals(feed.events(v.spark, v.sf_dir), out, feed.folder(v.spark, "subscriber"))
    return feed.latest(v.spark, out, ["user_id"])


@query("x7_windowed_counts", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def _(v: Views):
    out = feed.folder(v.spark, "windows")
    feed.consume(feed.windowed_counts(feed.events(v.spark, v.sf_dir)), feed.keeper(out), feed.folder(v.spark, "subscriber"), "update")
    return feed.latest(v.spark, out, ["start", "event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("x8_sessions", "WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session")
def _(v: Views):
    out = feed.folder(v.spark, "sessions")
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(out)
    feed.consume(feed.sessions(feed.events(v.spark, v.sf_dir)), keep, feed.folder(v.spark, "subscriber"), "complete")
    return v.spark.read.parquet(out).withColumn("start", F.col("start").cast("timestamp_ntz"))


SESSIONS = "WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e)"


@query("x8_closed_sessions", f"{SESSIONS} SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR")
def _(v: Views):
    out = feed.folder(v.spark, "closed")
    feed.consume(feed.sessions(feed.events(v.spark, v.sf_dir)), feed.keeper(out), feed.folder(v.spark, "subscriber"))
    return v.spark.read.parquet(out).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("x9_without_duplicates", "SELECT count(DISTINCT (user_id, event_type)) AS n FROM events")
def _(v: Views):
    out = feed.folder(v.spark, "unique")
    feed.append_events(feed.without_duplicates(feed.events(v.spark, v.sf_dir), ["user_id", "event_type"], "60 days"), out, feed.folder(v.spark, "subscriber"))
    return v.spark.read.parquet(out).agg(F.count("*").alias("n"))


@query("x10_last_state", "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type, count(*) AS n FROM events GROUP BY user_id")
def _(v: Views):
    out = feed.folder(v.spark, "state")
    feed.consume(feed.last_state(feed.events(v.spark, v.sf_dir)), feed.keeper(out), feed.folder(v.spark, "subscriber"), "update")
    return feed.latest(v.spark, out, ["user_id"])


@query("x10_activity_spells", """WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms FROM events), g AS (SELECT *, CASE WHEN ms - lag(ms) OVER w >= 24 * 3600 * 1000 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms) AS spell FROM g),
p AS (SELECT user_id, spell, max(ms) AS last_ms, count(*) AS n FROM s GROUP BY user_id, spell), q AS (SELECT *, max(spell) OVER (PARTITION BY user_id) AS newest FROM p)
SELECT user_id, last_ms, n FROM q WHERE spell < newest OR last_ms + 24 * 3600 * 1000 < (SELECT max(ms) FROM e) - 3600 * 1000""")
def _(v: Views):
    out = feed.folder(v.spark, "spells")
    feed.consume(feed.activity_spells(feed.events(v.spark, v.sf_dir), dt.timedelta(days=1)), feed.keeper(out), feed.folder(v.spark, "subscriber"))
    return v.spark.read.parquet(out).select("user_id", "last_ms", "n")
