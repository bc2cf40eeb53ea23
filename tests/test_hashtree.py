"""Hash trees: verdicts of the full comparison, reading only what differs."""

import datetime as dt
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from tableproof import Target
from tableproof.operators import hashtree, parity

START = dt.datetime(2024, 1, 1)
T = Target("t", keys=("id",), watermark_col="at", watermark=START + dt.timedelta(days=20), prev_watermark=START + dt.timedelta(days=10))
FIRST = replace(T, watermark=T.prev_watermark, prev_watermark=None)


@pytest.fixture(scope="module")
def base(spark):
    rows = spark.range(4000).select(
        "id", F.when(F.col("id") % 9 > 0, F.col("id") % 7).alias("v"), (F.lit(START) + F.make_dt_interval(hours=F.col("id") % 480)).cast("timestamp_ntz").alias("at")
    )
    return rows.unionAll(rows.where("id % 500 = 0")).coalesce(4)


def grown(spark, tmp_path, base, build):
    trees = hashtree.open_trees(spark, str(tmp_path), base, build, T)
    hashtree.checkpoint(base, build, FIRST, trees, "w0")
    first = hashtree.tree_checksum(trees, T).first()
    hashtree.checkpoint(base, build, T, trees, "w1")
    return trees, first


@pytest.mark.parametrize("defect", ["none", "changed", "doubled", "null", "before"])
def test_verdicts_of_the_full_checksum(spark, tmp_path, base, defect):
    late = F.col("at") > F.lit(T.prev_watermark)
    hit = (F.col("id") == 3101) | (F.col("id") == 1181)
    build = {
        "none": base,
        "changed": base.withColumn("v", F.when(hit, 99).otherwise(F.col("v"))),
        "doubled": base.unionAll(base.where(hit)),
        "null": base.withColumn("v", F.when(~hit, F.col("v"))),
        "before": base.withColumn("v", F.when(hit & ~late, 99).otherwise(F.col("v"))),
    }[defect]
    trees, first = grown(spark, tmp_path, base, build)
    assert first == parity.content_checksum(base, build, FIRST).first()
    assert hashtree.tree_checksum(trees, T).first() == parity.content_checksum(base, build, T).first()
    leaves = hashtree.differing_leaves(*trees)
    diff = hashtree.tree_differences(trees, base, build, T)
    x, y = (d.where(F.col("at") <= F.lit(T.watermark)) for d in (base, build))
    want = sorted([(*r, 1) for r in x.exceptAll(y).collect()] + [(*r, -1) for r in y.exceptAll(x).collect()], key=str)
    got = [(*r[:-1], 1 if r.net > 0 else -1) for r in diff.collect() for _ in range(abs(r.net))]
    assert sorted(got, key=str) == want and len(leaves) <= 2 and bool(leaves) == bool(want)


def test_only_differing_leaves_are_read(spark, tmp_path, base):
    build = base.withColumn("v", F.when(F.col("id") == 100, 99).otherwise(F.col("v")))
    trees, _ = grown(spark, tmp_path, base, build)
    (leaf,) = hashtree.differing_leaves(*trees)
    rows = trees[0].rows([leaf], base)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*__leaf", plan)
    folders = {f.rsplit("/", 2)[1] for f in (r[0] for r in rows.select(F.input_file_name()).distinct().collect())}
    assert folders == {f"__leaf={leaf}"} and rows.count() < base.count() / 50


def test_a_window_stored_again_replaces_itself(spark, tmp_path, base):
    trees, _ = grown(spark, tmp_path, base, base)
    before = sorted(trees[0].nodes().collect())
    hashtree.checkpoint(base, base, T, trees, "w1")
    assert sorted(trees[0].nodes().collect()) == before
    again = hashtree.HashTree(spark, trees[0].path, ["id"])
    assert sorted(again.nodes().collect()) == before


def test_empty_sides_and_tables_without_a_key(spark, tmp_path, base):
    none, t = base.where("false"), replace(T, keys=())
    trees = hashtree.open_trees(spark, str(tmp_path), base, none, t)
    hashtree.checkpoint(base, none, replace(t, prev_watermark=None), trees, "w")
    assert hashtree.tree_checksum(trees, t).first() == parity.content_checksum(base, none, replace(t, prev_watermark=None)).first()
    net = hashtree.tree_differences(trees, base, none, t).agg(F.sum("net")).first()[0]
    assert net == base.where(F.col("at") <= F.lit(T.watermark)).count()
