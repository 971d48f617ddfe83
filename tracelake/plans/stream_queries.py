"""Registered queries: event-time windows run as streams, and continuous ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.plans.registry import query
from tracelake.streaming import events


@query("T_tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(t):
    """A stream over the events, to its end, in hourly windows."""
    return events.run_to_end(t.spark, f"{t.sf_dir}/events.parquet", events.windowed)


@query("T_session_windows", """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS "end", count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def session_windows(t):
    return events.sessions(t.raw("events"))


@query("T10_context_fold", "SELECT user_id, count(*)::BIGINT AS steps, round(max(running), 4) AS peak FROM (SELECT user_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id) AS running FROM events) GROUP BY user_id")
def t10(t):
    """A fold over each user's steps in order: the largest running sum."""
    from pyspark.sql import Window

    running = F.sum("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    return t.raw("events").withColumn("running", running).groupBy("user_id").agg(F.count("*").alias("steps"), F.round(F.max("running"), 4).alias("peak"))
