"""Key and inclusion search against brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from tableproof.operators import inference


def brute_keys(rows, names, most):
    for size in range(1, most + 1):
        found = [
            s for s in combinations(range(len(names)), size)
            if all(r[i] is not None for r in rows for i in s) and len({tuple(r[i] for i in s) for r in rows}) == len(rows)
        ]
        if found:
            return {",".join(names[i] for i in s) for s in found}
    return set()


@pytest.mark.parametrize("seed", range(4))
def test_smallest_keys(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "d", "e"]
    rows = [tuple(rng.choice([None, *range(6)]) if j == 4 else rng.randrange(3 + 3 * j) for j in range(5)) for _ in range(25)]
    rows = list({r[:4]: r for r in rows}.values()) if seed % 2 else rows
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in names))
    assert {r.key_columns for r in inference.smallest_keys(df, 4).collect()} == brute_keys(rows, names, 4)


def test_keys_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (1, "y", 1.0), (2, "x", float("nan"))], "a int, b string, c double")
    assert [tuple(r) for r in inference.smallest_keys(df).collect()] == [("a,b", 2, 3), ("b,c", 2, 3)]
    assert inference.smallest_keys(df.unionAll(df)).count() == 0
    assert inference.smallest_keys(df, 1).count() == 0
    assert {r.key_columns for r in inference.smallest_keys(df.limit(0)).collect()} == {"a", "b", "c"}
    hot = spark.range(3000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id")).alias("x"), (F.col("id") % 1500).alias("y"), F.lit(None).cast("int").alias("z"))
    assert {r.key_columns for r in inference.smallest_keys(hot).collect()} == {"x,y"}


def test_inclusions_under_other_names(spark):
    tables = {
        "parent": spark.range(5000).select((F.col("id") * 7).alias("pk"), F.format_string("n%d", "id").alias("name")),
        "child": spark.range(9000).select((F.col("id") % 4000 * 7).cast("int").alias("ref"), F.when(F.col("id") % 3 == 0, F.lit("n17")).alias("one"), F.lit(None).cast("bigint").alias("none")),
        "near": spark.range(3000).select(F.when(F.col("id") == 2999, -1).otherwise(F.col("id") * 7).alias("almost"), F.col("id").cast("double").alias("real")),
        "nothing": spark.range(0).select(F.col("id").alias("empty")),
    }
    got = {tuple(r) for r in inference.inclusions(tables).collect()}
    assert got == {
        ("child", "ref", "parent", "pk", 9000, 4000, 5000), ("child", "one", "parent", "name", 3000, 1, 5000),
    }


def test_no_inclusion_is_ruled_out_by_signatures(spark):
    rng = random.Random(6)
    values = {f"c{i}": rng.sample(range(3000), rng.choice([1, 3, 200, 256, 257, 1500, 2900])) for i in range(8)}
    values |= {f"s{i}": rng.sample(v, max(1, len(v) // 5)) for i, v in enumerate(values.values())}
    tables = {n: spark.createDataFrame([(x,) for x in v], "v bigint") for n, v in values.items()}
    got = {(r.child_table, r.parent_table) for r in inference.inclusion_candidates(inference.signatures(tables)).collect()}
    truth = {(a, b) for a in values for b in values if a != b and set(values[a]) <= set(values[b])}
    assert truth <= got and len(got) < len(values) ** 2 / 2
