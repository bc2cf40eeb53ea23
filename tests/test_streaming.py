"""Streams in several batches against the batch form of the same operator."""

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from tableproof.operators import merge
from tableproof.streaming import ops

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "id bigint, ts timestamp, u int, op string, v int"


def events(n=400, seed=4):
    rnd = random.Random(seed)
    at = sorted(rnd.randrange(60 * 24 * 3) for _ in range(n))
    return [(i, DAY + dt.timedelta(minutes=m), 1 if rnd.random() < 0.4 else rnd.randrange(6), rnd.choice("IUD"), rnd.randrange(99)) for i, m in enumerate(at)]


def feed(spark, path, batches):
    """One file per batch; files are read one at a time, oldest first."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
    return ops.stream_intake(spark, str(path), spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)


def far(spark_rows):
    """A row far ahead, which closes every window before it."""
    return [(10**9, DAY + dt.timedelta(days=400), -1, "I", 0)]


def thirds(rows):
    n = len(rows) // 3
    return [rows[:n], rows[n:2 * n], rows[2 * n:]]


def test_sessions_equal_batch(spark, tmp_path):
    rows = events()
    stream = feed(spark, tmp_path / "in", thirds(rows) + [far(rows)])
    got = ops.drain(ops.stream_sessions(stream, "u", "ts", "30 minutes", "10 minutes"), "s").where("u >= 0")
    batch = merge.sessionize(spark.createDataFrame(rows, SCHEMA), "u", "ts", 1800).select("u", "session_start", "session_end", "page_views")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, batch.collect()))


def test_dedup_drops_replays(spark, tmp_path):
    rows = events()
    parts = thirds(rows)
    stream = feed(spark, tmp_path / "in", [parts[0], parts[0][-20:] + parts[1], parts[2], parts[2][-5:]])
    got = ops.drain(ops.stream_dedup(stream, ["id"], "ts", "2 days"), "d")
    assert sorted(r["id"] for r in got.collect()) == [r[0] for r in rows]


def test_window_parity_turns_red_where_a_row_is_lost(spark, tmp_path):
    rows = events()
    lost = rows[200]
    src = feed(spark, tmp_path / "a", thirds(rows) + [far(rows)])
    build = feed(spark, tmp_path / "b", thirds([r for r in rows if r is not lost]) + [far(rows)])
    out = ops.drain(ops.stream_window_parity(src, build, ["id", "ts", "u", "v"], "ts", "1 day", "1 hour"), "p").collect()
    red = [r for r in out if not r["passed"]]
    assert len(out) == 3 and len(red) == 1
    assert red[0]["window_start"] <= lost[1] < red[0]["window_end"] and red[0]["src_rows"] == red[0]["build_rows"] + 1


def test_upsert_equals_one_batch(spark, tmp_path):
    rows = events()
    base = spark.createDataFrame([(k, -k) for k in range(10)], "u int, v int")
    stream = feed(spark, tmp_path / "in", thirds(rows))
    got = ops.stream_upsert(stream.select("u", "v", "op", F.col("id").alias("seq")), base, ["u"], "op", "seq", "u")
    changes = spark.createDataFrame(rows, SCHEMA).select("u", "v", "op", F.col("id").alias("seq"))
    want = merge.delta_apply(base, changes, ["u"], "op", "seq")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_intake_is_exactly_once(spark, tmp_path):
    rows = events(90)
    stream = feed(spark, tmp_path / "in", thirds(rows))
    assert sorted(r["id"] for r in ops.drain(stream, "i").collect()) == [r[0] for r in rows]
