"""Window tables against a brute-force line of points; backfills that are proven again."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from tableproof import Target
from tableproof.operators import windows

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "table_name string, lo timestamp_ntz, hi timestamp_ntz, load_id string, loaded_at timestamp_ntz"


def at(h):
    return DAY + dt.timedelta(hours=h)


def drawn(rnd, load, stamp, n=6):
    """Windows of a few tables that do not overlap, some of them touching."""
    out = []
    for table in "abc":
        edges = sorted(rnd.sample(range(80), 2 * n))
        for lo, hi in zip(edges[::2], edges[1::2]):
            out.append((table, at(lo), at(hi), f"{load}{rnd.randrange(2)}", stamp))
        if rnd.random() < 0.5:
            out.append((table, at(hi), at(hi + 3), out[-1][3], stamp))
    return out


def points(rows):
    return {(t, h): load for t, lo, hi, load, *_ in rows for h in range(200) if lo < at(h) <= hi}


@pytest.mark.parametrize("seed", range(4))
def test_overlay_is_the_later_load_at_every_point(spark, seed):
    rnd = random.Random(seed)
    old, new = drawn(rnd, "o", at(500)), drawn(rnd, "n", at(600), n=3)
    got = sorted(map(tuple, windows.overlay(spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA)).collect()))
    assert points(got) == points(old) | points(new)
    for a, b in zip(got, got[1:]):
        assert a[0] != b[0] or a[2] < b[1] or (a[2] == b[1] and a[3:] != b[3:])
    gaps = windows.gaps(spark.createDataFrame(got, SCHEMA), at(10), at(95)).collect()
    want = {(t, h) for t in "abc" for h in range(11, 96) if (t, h) not in points(got)}
    assert {(t, h) for t, lo, hi in gaps for h in range(200) if lo < at(h) <= hi} == want and all(r["lo"] < r["hi"] for r in gaps)


def test_empty_sides_and_windows_without_extent(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([("a", at(1), at(2), "x", at(9)), ("a", at(5), at(5), "x", at(9))], SCHEMA)
    assert windows.overlay(none, none).count() == 0
    for x, y in ((none, one), (one, none), (one, one)):
        assert [tuple(r) for r in windows.overlay(x, y).collect()] == [("a", at(1), at(2), "x", at(9))]


def test_stale_checks_touch_the_window_and_are_older(spark):
    checks = spark.createDataFrame(
        [("a", at(0), at(10), at(20), 1), ("a", at(10), at(20), at(20), 2), ("a", at(0), at(10), at(40), 3), ("b", at(0), at(10), at(20), 4)],
        "table_name string, lo timestamp_ntz, hi timestamp_ntz, ran_at timestamp_ntz, id int",
    )
    loads = spark.createDataFrame([("a", at(5), at(10), "x", at(30))], SCHEMA)
    assert [r["id"] for r in windows.stale(checks, loads).collect()] == [1]


@pytest.mark.parametrize("good", [True, False])
def test_backfill_is_proven_and_marks_what_it_touches(spark, good):
    source = spark.createDataFrame([(i, at(i)) for i in range(40)], "id int, at timestamp_ntz")
    t = Target("t", keys=("id",), watermark_col="at", watermark=at(20), prev_watermark=at(10))
    loads = spark.createDataFrame([("t", at(-1), at(40), "first", at(50))], SCHEMA)
    checks = spark.createDataFrame([("t", at(0), at(10), at(60)), ("t", at(0), at(11), at(60)), ("u", at(0), at(99), at(60))], "table_name string, lo timestamp_ntz, hi timestamp_ntz, ran_at timestamp_ntz")
    out = windows.verified_backfill(source.where("id <> 15 and id <> 30"), lambda df: df if good else df.where("id <> 12"), source, t, loads, checks, "again", at(70))
    assert out.verdict.first()["passed"] is good
    assert {r["id"] for r in out.table.collect()} == set(range(40)) - {30} - (set() if good else {12})
    assert sorted((r["lo"], r["hi"], r["load_id"]) for r in out.windows.collect()) == [(at(-1), at(10), "first"), (at(10), at(20), "again"), (at(20), at(40), "first")]
    assert [r["hi"] for r in out.stale.select(F.col("hi")).collect()] == [at(11)]
