"""Registered queries: the streaming operators, drained over the table files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tableproof.plans.merge_queries import CHANGE_SQL, SESSIONS_SQL, change_feed
from tableproof.plans.registry import query
from tableproof.sources.tables import read_table
from tableproof.streaming import ops


def event_stream(spark, d) -> DataFrame:
    """The events files as a stream, with an event time that watermarks accept."""
    schema = read_table(spark, d, "events").schema
    raw = ops.stream_intake(spark, d, schema, pathGlobFilter="events.parquet")
    return raw.withColumn("ts", ops.event_time(F.col("ts")))


def _plain(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query("stream_intake", "SELECT * FROM events")
def stream_intake(spark, d):
    return _plain(ops.drain(event_stream(spark, d), "stream-intake"), "ts")


@query("stream_dedup", "SELECT event_id, ts, user_id, event_type FROM events")
def stream_dedup(spark, d):
    """Every event arrives twice; each is kept once."""
    cols = ["event_id", "ts", "user_id", "event_type"]
    twice = event_stream(spark, d).select(*cols).unionByName(event_stream(spark, d).select(*cols))
    return _plain(ops.drain(ops.stream_dedup(twice, ["event_id"], "ts", "1 hour"), "stream-dedup"), "ts")


@query("stream_sessions", f"WITH {SESSIONS_SQL} SELECT * FROM p")
def stream_sessions(spark, d):
    """All sessions: a closing row behind the last event lets the watermark pass the open ones."""
    stream, close = ops.closing_row(event_stream(spark, d), "ts")
    sessions = ops.stream_sessions(stream, "user_id", "ts", "30 minutes", "10 minutes")
    return _plain(ops.drain(sessions, "stream-sessions", close), "session_start", "session_end")


@query("stream_window_parity", """
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, count(*) AS src_rows,
       count(*) FILTER (NOT (event_type = 'error' AND value > 150)) AS build_rows,
       count(*) FILTER (event_type = 'error' AND value > 150) = 0 AS passed
FROM events GROUP BY 1, 2
""")
def stream_window_parity(spark, d):
    """Events against a feed that lost its largest errors, per day, the last one included."""
    cols = ["event_id", "ts", "user_id", "event_type", "value"]
    src, close = ops.closing_row(event_stream(spark, d), "ts")
    lossy = event_stream(spark, d).where("NOT (event_type = 'error' AND value > 150)")
    windows = ops.stream_window_parity(src, lossy, cols, "ts", "1 day", "1 hour")
    return _plain(ops.drain(windows, "stream-parity", close), "window_start", "window_end")


@query("stream_upsert", CHANGE_SQL)
def stream_upsert(spark, d):
    base = read_table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return ops.stream_upsert(change_feed(event_stream(spark, d)), base, ["c_custkey"], "op", "seq", "stream-upsert")
