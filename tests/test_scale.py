"""Work per task, passes and bytes of queries that outgrew a limit; rows are the tests' own."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from tableproof.operators import diff, inference, lineage, reach, translate
from tableproof.plans import mart_queries
from tableproof.target import Target


def test_keyless_difference_takes_one_pass(spark, monkeypatch):
    written = []
    monkeypatch.setattr(diff, "materialize", lambda df, label: (written.append(label), df)[1])
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "z")], "a int, b string")
    b = spark.createDataFrame([(1, "x"), (2, None), (2, None), (4, "z")], "a int, b string")
    got = {(r.change, r.n_rows, *(r.src or r.build)) for r in diff.row_diff(a, b, Target("t")).collect()}
    assert got == {("missing_in_build", 1, 1, "x"), ("extra_in_build", 1, 2, None), ("missing_in_build", 1, 3, "z"), ("extra_in_build", 1, 4, "z")}
    assert written == ["differing-rows"]


def test_texts_of_one_file_are_rewritten_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(translate, "TEXTS_PER_TASK", 10)
    q = spark.range(200).coalesce(1).select("id", F.concat(F.lit("SELECT now(), a::int8 + "), F.col("id").cast("string")).alias("q"))
    out = translate.translate_queries(q, "q", "postgres")
    assert out.rdd.getNumPartitions() == 21
    assert {(r.id, r.translated) for r in out.collect()} == {(i, f"SELECT current_timestamp(), CAST(a AS BIGINT) + {i}") for i in range(200)}


def test_catalog_tasks_follow_the_lines(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(mart_queries, "_OFFERS_PER_TASK", 100)
    lines = spark.range(2000).select((F.col("id") % 50).alias("l_partkey"), (F.col("id") % 7).alias("l_suppkey"))
    lines.unionAll(spark.createDataFrame([(None, 1), (3, None)], lines.schema)).write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(k, f"n{k}", "t", 1.5) for k in range(40)] + [(3, "n3", "t", 1.5), (3, "other", None, 2.5), (None, "x", "t", 1.0)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_type string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    suppliers = [(0, "s0"), (1, "s1"), (2, "s1"), (3, None), (3, None)]
    spark.createDataFrame(suppliers, "s_suppkey bigint, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    got = mart_queries.product_catalog(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == 21
    met = {(i % 50, i % 7) for i in range(2000)}
    want = {(p, n, t, s, Decimal(str(c)).quantize(Decimal("0.01"))) for p, n, t, c in parts for k, s in suppliers if (p, k) in met}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_few_targets_make_small_bitmaps(spark):
    own = spark.createDataFrame([("t", 0, 3), ("u", 0, 700)], "node string, bucket int, bit bigint")
    edges = spark.createDataFrame([("p", "t"), ("p", "u"), ("q", "p")], "src string, dst string")
    got = {r.node: [w.word for w in r.bits] for r in reach.reach_index(edges, own).collect()}
    assert got == {"p": [0, 1], "q": [0, 1]}


@pytest.mark.parametrize("seed", range(3))
def test_dependencies_and_gate_against_pairs(spark, seed):
    rng = random.Random(seed)
    io = {(f"p{rng.randrange(9)}", rng.choice(["read", "write"]), f"t{rng.randrange(6)}") for _ in range(30)}
    runs = {(f"p{rng.randrange(11)}", f"p{rng.randrange(11)}") for _ in range(8)} | {("p1", "p1")}
    objects = spark.createDataFrame([(f"p{i}", "PIPELINE") for i in range(10)], "object_key string, type string")
    edges = spark.createDataFrame([(a, lineage.EXECUTES, b) for a, b in runs], "src_key string, edge_type string, dst_key string")
    pairs = {(a, c) for a, m, t in io for c, n, u in io if m == "write" and n == "read" and t == u and a != c}
    pairs |= {(b, a) for a, b in runs if "p10" not in (a, b)}
    frame = spark.createDataFrame(sorted(io), "pipeline string, mode string, table string")
    got = [tuple(r) for r in lineage.pipeline_dependencies(frame, edges, objects).collect()]
    assert sorted(got) == sorted(pairs)
    status = spark.createDataFrame([(f"p{i}", rng.choice(["CERTIFIED", "PROVISIONAL"])) for i in range(8)], "pipeline string, status string")
    want = lineage.predecessor_gate(spark.createDataFrame(sorted(pairs), "src string, dst string"), status)
    assert {*map(tuple, lineage.estate_predecessor_gate(frame, edges, objects, status).collect())} == {*map(tuple, want.collect())}


def test_unresolved_references_without_the_others(spark):
    io = spark.createDataFrame([("a", "read", "t1"), ("a", "read", "x"), ("b", "write", "t1"), ("b", "read", "y")], "pipeline string, mode string, table string")
    edges = spark.createDataFrame([("a", lineage.CONFIG, "c", "C")], "src_key string, edge_type string, dst_key string, dst_name string")
    objects = spark.createDataFrame(
        [("a", "a", "PIPELINE", None), ("b", "b", "PIPELINE", None), ("y", "Y", "TABLE", None)], "object_key string, name string, type string, external_system string"
    )
    got = {tuple(r) for r in lineage.unresolved_references(io, edges, objects).collect()}
    every = lineage.resolved_references(lineage.upstream_closure(io, edges, objects), io, objects).where("NOT resolved")
    assert got == {("a", "x"), ("a", "c")} == {tuple(r) for r in every.select("pipeline", "table").collect()}


def test_sets_with_a_repeated_value_are_ruled_out_without_a_count(spark, monkeypatch):
    rows = [(i, i // 2 % 40, i // 2, "x" if i % 2 else "y") for i in range(400)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d string").drop("a")
    counted = []
    exact = inference._identifies
    monkeypatch.setattr(inference, "_identifies", lambda df, s: (counted.append(s), exact(df, s))[1])
    assert [r.key_columns for r in inference.smallest_keys(df).collect()] == ["c,d"]
    assert counted == [("c", "d")]
    assert inference._repeated(df, [("b", "c"), ("c", "d"), ("b", "d")], 1) == {("b", "c"), ("b", "d")}


def near_key(spark):
    """x and y repeat in 8 of 4,008 rows; only c tells those apart."""
    rows = [(i % 1000, i // 1000, i % 40, i % 7, i % 2) for i in range(4000)] + [(i // 2, 50, i % 2, 0, 0) for i in range(8)]
    return spark.createDataFrame(rows, "x int, y int, c int, d int, e int")


def test_sets_of_a_near_key_are_counted_over_its_repeated_rows(spark, monkeypatch):
    counted = []
    exact = inference._identifies
    monkeypatch.setattr(inference, "_identifies", lambda df, s: (counted.append((s, df.count())), exact(df, s))[1])
    sets = [("x", "y", "c"), ("x", "y", "d"), ("x", "y", "e")]
    assert inference._keys(near_key(spark), sets, {("x", "y"): 0.01, ("x", "d"): 0.9}) == [("x", "y", "c")]
    assert counted == [(("x", "y", "c"), 8)]


def test_sets_share_slices_of_a_table_that_is_read_once(spark, monkeypatch):
    written = []
    real = inference.materialize
    monkeypatch.setattr(inference, "materialize", lambda df, label: (written.append((label, df.count())), real(df, label))[1])
    shares = {}
    names = {"x": 1000, "y": 5, "c": 40, "d": 7, "e": 2}
    sets = [("x", "y"), ("x", "c"), ("x", "e"), ("y", "c"), ("c", "d")]
    got = inference._repeated(near_key(spark), sets, 8, names, shares)
    assert {("x", "c"), ("x", "e"), ("y", "c"), ("c", "d")} - got == set() and shares.get(("x", "y"), 0) < inference.FEW < shares[("x", "c")]
    assert [label for label, _ in written] == ["slices", "slices"] and written[1][1] < written[0][1] < 4008
    monkeypatch.setattr(inference, "ROWS_PER_SLICE", 100)
    assert [tuple(r) for r in inference.smallest_keys(near_key(spark)).collect()] == [("x,y,c", 3, 4008)]


def test_dependencies_shuffle_no_words(spark, monkeypatch):
    rng = random.Random(7)
    io = sorted({(f"p{rng.randrange(700):03d}", rng.choice(["read", "write"]), f"t{rng.randrange(20)}") for _ in range(2500)})
    runs = {("m", "p001"), ("p002", "p002"), ("p003", "p004"), ("p999", "p001")}
    frame = spark.createDataFrame(io, "pipeline string, mode string, table string")
    objects = spark.createDataFrame([(p, "PIPELINE") for p in {p for p, _, _ in io} | {"m"}], "object_key string, type string")
    edges = spark.createDataFrame([(a, lineage.EXECUTES, b) for a, b in runs], "src_key string, edge_type string, dst_key string")
    status = spark.createDataFrame([(p, "CERTIFIED" if int(p[1:]) % 3 else "PROVISIONAL") for p in sorted({p for p, _, _ in io})], "pipeline string, status string")
    reads, writes = ([(p, t) for p, m, t in io if m == mode] for mode in ("read", "write"))
    pairs = {(a, c) for a, t in writes for c, u in reads if t == u and a != c}
    pairs |= {(b, a) for a, b in runs if a != "p999" and {a, b} <= {p for p, _, _ in io} | {"m"}}
    got = lineage.pipeline_dependencies(frame, edges, objects)
    assert "ENSURE_REQUIREMENTS" not in got._jdf.queryExecution().executedPlan().toString()
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted(pairs)
    gate = sorted(map(tuple, lineage.estate_predecessor_gate(frame, edges, objects, status).collect()))
    assert gate == sorted(map(tuple, lineage.predecessor_gate(got, status).collect()))
    # Words in parts, and names that are too many to send everywhere.
    monkeypatch.setattr(lineage, "WORDS_TO_ALL", 10)
    monkeypatch.setattr(reach, "NAMES_TO_ALL", 0)
    assert sorted(map(tuple, lineage.pipeline_dependencies(frame, edges, objects).collect())) == sorted(pairs)
    assert sorted(map(tuple, lineage.estate_predecessor_gate(frame, edges, objects, status).collect())) == gate
