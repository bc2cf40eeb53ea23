"""The reachability index against brute force, hubs included."""

import random

import pytest
from pyspark.sql import functions as F
from tableproof.operators import lineage, reach


def closure(edges):
    out, step = {}, {}
    for a, b in edges:
        step.setdefault(a, set()).add(b)
    for a in {x for e in edges for x in e}:
        seen, todo = set(), list(step.get(a, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += step.get(x, ())
        out[a] = seen
    return out


@pytest.mark.parametrize("seed,nodes,n", [(1, 12, 14), (2, 25, 40), (3, 30, 25), (4, 5, 12)])
def test_random_graphs(spark, seed, nodes, n):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(nodes):02d}", f"n{rng.randrange(nodes):02d}") for _ in range(n)]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    targets = reach.numbered(lineage._ends(edges), F.when(F.col("node") > "n10", 1).otherwise(0))
    got = reach.reach_index(edges, targets)
    want = closure(pairs)
    assert {tuple(r) for r in reach.members(got, targets).collect()} == {(a, b) for a, bs in want.items() for b in bs}
    # Counts and first members without pairs.
    kind = reach.kind_of(F.col("bucket"))
    counts = {tuple(r) for r in got.groupBy("node", kind.alias("k")).agg(F.sum(reach.count_of())).collect()}
    parts = {(a, k, sum((b > "n10") == bool(k) for b in bs)) for a, bs in want.items() for k in (0, 1)}
    assert counts == {p for p in parts if p[2]}
    first = got.groupBy("node", kind.alias("k")).agg(F.min(F.struct("bucket", reach.first_bit().cast("bigint").alias("bit"))).alias("at"))
    names = targets.select(F.struct("bucket", "bit").alias("at"), F.col("node").alias("name"))
    assert {tuple(r) for r in first.join(names, "at").select("node", "k", "name").collect()} == {
        (a, k, min(b for b in bs if (b > "n10") == bool(k))) for a, bs in want.items() for k in (0, 1) if any((b > "n10") == bool(k) for b in bs)
    }


def test_hub_of_thousands_of_tables_makes_no_pairs(spark):
    """One hub reads 40,000 tables and feeds 3,000 pipelines: 120 million pairs, two bitmaps per pipeline."""
    tables = spark.range(40_000).select(F.lit("hub").alias("src"), F.format_string("t%05d", "id").alias("dst"))
    users = spark.range(3_000).select(F.format_string("p%04d", "id").alias("src"), F.lit("hub").alias("dst"))
    edges = tables.unionAll(users)
    targets = reach.numbered(tables.select(F.col("dst").alias("node")))
    labels = reach.reach_index(edges, targets)
    assert labels.count() == 3_001 * 2  # two buckets
    got = labels.where("node <> 'hub'")
    assert got.groupBy("node").agg(F.sum(reach.count_of()).alias("n")).agg(F.min("n"), F.max("n"), F.count("*")).first()[:] == (40_000, 40_000, 3_000)


def test_first_bit_of_every_place(spark):
    bits = spark.range(0, 1 << 15, 37).select("id", F.col("id").alias("bit"), F.lit(0).alias("bucket"))
    assert reach.bitmaps(bits.select(F.col("id").alias("k"), "bucket", "bit"), "k").where(reach.first_bit() != F.col("k")).isEmpty()


def test_dependents_without_pairs(spark):
    rng = random.Random(9)
    io = {(rng.choice(["READS_TABLE", "WRITES_TABLE"]), f"w{rng.randrange(6)}", f"T{rng.randrange(9)}") for _ in range(60)}
    edges = spark.createDataFrame([(s, k, t, t) for k, s, t in io], "src_key string, edge_type string, dst_key string, dst_name string")
    want = {}
    for k, s, t in io:
        for k2, s2, t2 in io:
            if k == "READS_TABLE" and k2 == "WRITES_TABLE" and s == s2 and t != t2:
                want.setdefault(t.lower(), set()).add(t2)
    assert {r.node: r.n for r in lineage.dependent_counts(edges).collect()} == {t: len(x) for t, x in want.items()}
    assert lineage.dependent_counts(edges.limit(0)).count() == 0
