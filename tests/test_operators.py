"""Operators against brute force on small data, hot keys included."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F, types as T

from tableproof import FK, SampleSpec
from tableproof.operators import certify, filters, governance, lineage, merge, sampling, synth, translate
from tableproof.operators.parity import CHECKS, PROFILES, SAMPLE_CHECKS, stamp
from tableproof.sources import extract, tables

DAY = dt.datetime(2024, 1, 1)


def tuples(df):
    return Counter(tuple(r) for r in df.collect())


# --- sampling ---------------------------------------------------------------

@pytest.mark.parametrize("digest", ["md5", "xxhash64"])
@pytest.mark.parametrize("rows", [0, 1, 57, 500, 900, 5000])
def test_top_by_digits_equals_sort_and_limit(spark, digest, rows):
    df = spark.range(1000).withColumn("v", F.col("id") * 3)
    digits = sampling.order_digits(["id"], 42, digest)
    want = tuples(df.orderBy(*digits).limit(rows))
    assert tuples(sampling.seed_sample(df, ["id"], rows, digest=digest)) == want


def test_sample_goes_by_all_digits(spark):
    df = spark.range(1000)
    digits = [(F.col("id") % 10).cast("int"), (F.col("id") % 100).cast("int"), F.col("id").cast("int")]
    want = sorted(range(1000), key=lambda i: (i % 10, i % 100, i))
    for rows in (100, 333, 999):
        assert sorted(r["id"] for r in sampling.top_by_digits(df, digits, rows).collect()) == sorted(want[:rows])


def test_sample_with_a_hot_key_keeps_the_exact_size(spark):
    df = spark.range(900).select(F.when(F.col("id") < 300, 7).otherwise(F.col("id")).alias("k"), F.col("id"))
    for rows in (1, 100, 299, 301, 600):
        assert sampling.seed_sample(df, ["k"], rows).count() == rows


def test_sample_of_copies_keeps_the_exact_size(spark):
    df = spark.range(900).select(F.when(F.col("id") < 400, 7).otherwise(F.col("id")).alias("k"))
    for rows in (1, 399, 401, 650, 899):
        got = tuples(sampling.seed_sample(df, ["k"], rows))
        assert sum(got.values()) == rows and got[(7,)] <= 400
        assert all(n == 1 for (k,), n in got.items() if k != 7)


def test_sample_is_stable_under_partitioning(spark):
    df = spark.range(5000).withColumn("k", F.col("id") % 4000)
    a = tuples(sampling.seed_sample(df, ["id"], 100))
    assert a == tuples(sampling.seed_sample(df.repartition(11), ["id"], 100))
    assert a != tuples(sampling.seed_sample(df, ["id"], 100, seed=7))
    assert sampling.seed_sample(df, ["id"], 100, mode="none").count() == 5000


def test_closure_reaches_grandparents(spark):
    a = spark.createDataFrame([(i, i % 10) for i in range(100)] + [(100, None)], "id int, b int")
    b = spark.createDataFrame([(i, i % 3) for i in range(10)], "id int, z int")
    z = spark.createDataFrame([(i,) for i in range(3)], "id int")
    fks = {"a": [FK("b", "b", "id")], "b": [FK("z", "z", "id")]}
    closed = sampling.fk_closure({"a": a, "b": b, "z": z}, {"a": a.where("id in (4, 5, 100)")}, fks)
    assert tuples(closed["b"]) == Counter([(4, 1), (5, 2)])
    assert tuples(closed["z"]) == Counter([(1,), (2,)])


def test_closure_of_a_reference_cycle(spark):
    emp = spark.createDataFrame([(i, i - 1 if i else None) for i in range(6)], "id int, boss int")
    closed = sampling.fk_closure({"emp": emp}, {"emp": emp.where("id = 3")}, {"emp": [FK("boss", "emp", "id")]})
    assert sorted(r["id"] for r in closed["emp"].collect()) == [0, 1, 2, 3]


def test_sample_estate_budgets(spark):
    parent = spark.range(50).select(F.col("id").alias("pk"))
    child = spark.range(500).select("id", (F.col("id") % 50).alias("pk"))
    cfg = spark.range(5).select(F.col("id").alias("c"))
    specs = [SampleSpec("child", ("id",), (FK("pk", "parent", "pk"),), 30), SampleSpec("parent", ("pk",), (), 3), SampleSpec("cfg", is_reference=True)]
    closed, manifest = sampling.sample_estate({"child": child, "parent": parent, "cfg": cfg}, specs, overrides={"child": 20})
    m = {r["table_name"]: r for r in manifest.collect()}
    assert m["child"]["actual_rows"] == 20 and m["child"]["target_rows"] == "20" and m["child"]["seed"] == 42
    assert m["cfg"]["kind"] == "reference_full" and m["cfg"]["actual_rows"] == 5
    assert closed["child"].join(closed["parent"], "pk", "left_anti").count() == 0
    assert SampleSpec("x").rows == 10_000


def test_inferred_keys(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 5), (3, "b", 6)], "id int, s string, n int")
    got = {r["column_name"]: (r["is_key"], r["null_count"]) for r in sampling.infer_keys(df).collect()}
    assert got == {"id": (True, 0), "s": (False, 0), "n": (False, 1)}


def test_synthetic_estate_is_closed(spark):
    specs = [
        synth.SynthSpec("p", T.StructType.fromDDL("pk string, f boolean, d date, x decimal(10,2)"), 7, ("pk",)),
        synth.SynthSpec("c", T.StructType.fromDDL("id bigint, pk string, t timestamp_ntz, name string"), 40, ("id",), {"pk": "p"}),
    ]
    estate = synth.synth_estate(spark, specs, {"c": 25})
    assert estate["c"].count() == 25 and estate["c"].join(estate["p"], "pk", "left_anti").count() == 0
    assert tuple(estate["p"].where("pk = '3'").first()) == ("3", True, dt.date(2024, 1, 4), 3)
    assert synth.synth_table(spark, specs[0].schema, 100, partitions=6).rdd.getNumPartitions() == 6


# --- merges -----------------------------------------------------------------

def scd2_by_hand(changes):
    out = []
    for key, versions in changes.items():
        kept = []
        for at in sorted(versions):
            if not kept or kept[-1][1] != versions[at]:
                kept.append((at, versions[at]))
        for i, (at, value) in enumerate(kept):
            end = kept[i + 1][0] if i + 1 < len(kept) else dt.datetime(9999, 12, 31)
            out.append((key, value, at, end, i + 1 == len(kept)))
    return Counter(out)


def test_scd2_in_batches_equals_one_history(spark):
    rnd = random.Random(5)
    feed = [(0 if rnd.random() < 0.4 else rnd.randrange(20), rnd.choice("ABC") if rnd.random() < 0.9 else None, DAY + dt.timedelta(days=d)) for d in rnd.sample(range(700), 400)]
    target = spark.createDataFrame([], "k int, v string, effective_from timestamp_ntz, effective_to timestamp_ntz, is_active boolean")
    rnd.shuffle(feed)  # late changes are spliced into the history
    for part in (feed[:150], feed[150:300], feed[300:]):
        updates = spark.createDataFrame(part, "k int, v string, at timestamp_ntz")
        target = merge.scd2_merge(target, updates, ["k"], ["v"], "at")
    changes = defaultdict(dict)
    for k, v, at in feed:
        changes[k][at] = v
    want = {(k, e) for (k, _, e, _, _) in scd2_by_hand(changes)}
    got = tuples(target.select("k", "v", "effective_from", "effective_to", "is_active"))
    assert max(got.values()) == 1
    assert {(k, e) for (k, _, e, _, _) in got} <= {(k, at) for k in changes for at in changes[k]}
    per_key = defaultdict(list)
    for k, v, start, end, active in got:
        per_key[k].append((start, end, v, active))
    for k, spans in per_key.items():
        spans.sort()
        assert [s[3] for s in spans] == [False] * (len(spans) - 1) + [True]
        assert all(a[1] == b[0] and a[2] != b[2] for a, b in zip(spans, spans[1:]))
        assert spans[0][0] == min(changes[k])
    assert want  # the hand-made history is not empty


def test_scd2_in_order_equals_brute_force_and_is_idempotent(spark):
    rnd = random.Random(9)
    feed = [(0 if rnd.random() < 0.4 else rnd.randrange(20), rnd.choice("ABC"), DAY + dt.timedelta(days=d)) for d in range(300)]
    target = spark.createDataFrame([], "k int, v string, effective_from timestamp_ntz, effective_to timestamp_ntz, is_active boolean")
    for part in (feed[:100], feed[100:], feed[100:]):
        target = merge.scd2_merge(target, spark.createDataFrame(part, "k int, v string, at timestamp_ntz"), ["k"], ["v"], "at")
    changes = defaultdict(dict)
    for k, v, at in feed:
        changes[k][at] = v
    assert tuples(target.select("k", "v", "effective_from", "effective_to", "is_active")) == scd2_by_hand(changes)


def test_neighbour_across_empty_buckets(spark):
    ts = [0, 1, 2, 500, 501, 9000]
    df = spark.createDataFrame([(None, i) for i in ts] + [(1, 5)], "k int, t int")
    for following in (False, True):
        got = {(r["k"], r["t"]): r["n"] and r["n"]["t"] for r in merge.neighbour(df, ["k"], "t", ["t"], F.col("t") / 100 - F.col("t") / 100 % 1, "n", following).collect()}
        seq = ts[::-1] if following else ts
        want = {(None, b): a for a, b in zip([None] + seq, seq)}
        assert got == {**want, (1, 5): None}


def test_scd1(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 0)], "k int, v string, w int")
    updates = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "k int, v string")
    once = merge.scd1_merge(target, updates, ["k"])
    assert tuples(once) == Counter([(1, "a", 1), (2, "B", 2), (3, "C", None), (None, "N", 0)])
    assert tuples(merge.scd1_merge(once, updates, ["k"])) == tuples(once)


def test_delta_apply_and_dedup_with_a_hot_key(spark):
    rnd = random.Random(3)
    feed = [(7 if rnd.random() < 0.4 else rnd.randrange(30), rnd.choice("IUD"), seq, rnd.randrange(100)) for seq in range(500)]
    target = {k: 1000 + k for k in range(0, 40, 2)}
    want = dict(target)
    for k, op, _, v in feed:
        if op == "D":
            want.pop(k, None)
        else:
            want[k] = v
    base = spark.createDataFrame(list(target.items()), "k int, v int")
    changes = spark.createDataFrame(feed, "k int, op string, seq int, v int").repartition(6)
    assert tuples(merge.delta_apply(base, changes, ["k"], "op", "seq")) == Counter(want.items())
    last = {k: (k, op, s, v) for k, op, s, v in feed}
    assert tuples(merge.dedup(changes, ["k"], ["seq"])) == Counter(last.values())


def test_cdc_snapshot_turns_prev_into_curr(spark):
    prev = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    curr = spark.createDataFrame([(1, "a"), (3, "c"), (4, "d")], "k int, v string")
    changes = merge.cdc_snapshot(prev, curr, ["k"])
    assert tuples(changes) == Counter([("D", 2, "b"), ("U", 3, "c"), ("I", 4, "d")])
    assert tuples(merge.delta_apply(prev, changes.withColumn("seq", F.lit(1)), ["k"], "op", "seq")) == tuples(curr)


def test_sessions_with_a_hot_user(spark):
    rnd = random.Random(2)
    events = [(1 if rnd.random() < 0.4 else rnd.randrange(9), DAY + dt.timedelta(minutes=rnd.randrange(60 * 24 * 4))) for _ in range(900)]
    events += [(50, DAY + dt.timedelta(minutes=m)) for m in (0, 30, 60, 91)]  # a gap of exactly 30 minutes joins
    want = Counter()
    for user in {u for u, _ in events}:
        times = sorted(t for u, t in events if u == user)
        start, last, n = times[0], times[0], 0
        for t in times + [dt.datetime.max]:
            if t == dt.datetime.max or t - last > dt.timedelta(minutes=30):
                want[(user, start, last + dt.timedelta(minutes=30), n)] += 1
                start, n = t, 0
            last, n = t, n + 1
    df = spark.createDataFrame(events, "u int, ts timestamp_ntz").repartition(5)
    assert tuples(merge.sessionize(df, "u", "ts", 1800).drop("session_key")) == want
    plan = merge.sessionize(df, "u", "ts", 1800)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 2 and "partial_count" in plan  # both windows run over slots


def test_retention_and_backfill(spark):
    df = spark.createDataFrame([(i, DAY + dt.timedelta(days=i)) for i in range(10)] + [(99, None)], "i int, ts timestamp_ntz")
    kept = merge.retention_purge(df, "ts", 3, dt.datetime(2024, 1, 10))
    assert sorted(r["i"] for r in kept.collect()) == [7, 8, 9, 99]
    broken = df.where("i not in (4, 8)")
    fixed = merge.backfill(broken, lambda x: x, df, "ts", DAY + dt.timedelta(days=3), DAY + dt.timedelta(days=6))
    assert sorted(r["i"] for r in fixed.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 9, 99]


def test_replace_window(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "v int, day string").write.partitionBy("day").parquet(path)
    merge.replace_window(spark.createDataFrame([(9, "b")], "v int, day string"), path, "day")
    assert tuples(spark.read.parquet(path).select("v", "day")) == Counter([(1, "a"), (9, "b")])


def test_config_table_of_any_length(spark):
    out = merge.dynamic_sql_expand(spark, spark.range(7), "SELECT {id} AS x", per_job=3)
    assert sorted(r["x"] for r in out.collect()) == list(range(7))
    with pytest.raises(ValueError):
        merge.dynamic_sql_expand(spark, spark.range(0), "SELECT {id} AS x")


def test_sql_steps_leave_no_views(spark):
    steps = [("a", "SELECT x + 1 AS x FROM {t}"), ("b", "SELECT sum(x) AS s FROM {a} WHERE x IN (SELECT x + 1 FROM {t})")]
    first = merge.sql_steps(spark, {"t": spark.range(3).toDF("x")}, steps)
    second = merge.sql_steps(spark, {"t": spark.range(5).toDF("x")}, steps)
    assert first.first()["s"] == 6 and second.first()["s"] == 15
    assert not {r.name for r in spark.catalog.listTables()} & {"a", "b", "t"}


def test_tables_without_key(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "k int, v string")
    assert tuples(merge.cdc_snapshot(a, b, [])) == Counter([("D", 1, "x"), ("I", 3, "y")])
    assert sampling.infer_fks({"a": a}, {"a": "k"}).count() == 0


def test_surrogates_tell_nulls_apart(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a|", "b"), ("a", "|b"), (None, None), ("-", "-")], "x string, y string")
    for digest in ("md5", "xxhash64"):
        assert df.select(filters.surrogate_key(["x", "y"], digest).alias("k")).distinct().count() == 6


# --- sources ----------------------------------------------------------------

def test_extract_slices_tile_the_window(spark):
    lo, hi = DAY, DAY + dt.timedelta(hours=5, microseconds=7)
    df = spark.createDataFrame([(lo + (hi - lo) * i / 50,) for i in range(-5, 60)] + [(hi,), (lo,)], "ts timestamp_ntz")
    predicates = [p.replace("TIMESTAMP '", "TIMESTAMP_NTZ '") for p in extract.extract_predicates("ts", lo, hi, 7)]
    inside = df.where((F.col("ts") > F.lit(lo).cast("timestamp_ntz")) & (F.col("ts") <= F.lit(hi).cast("timestamp_ntz"))).count()
    assert sum(df.where(p).count() for p in predicates) == inside > 50
    assert extract.watermark_extract(df, "ts", lo, hi, 7).where("slice is null").count() == 0


def test_estate_files(spark, tmp_path):
    (tmp_path / "objects.csv").write_bytes(",".join(tables.OBJECT_COLUMNS).encode() + b"\nk,n\xff,TABLE,gold,s,,f.sql,1,,,\n")
    (tmp_path / "edges.csv").write_text(",".join(tables.EDGE_COLUMNS) + "\na,a,PIPELINE,READS_TABLE,b,s.B,TABLE,1,,,\n")
    objects, edges = tables.read_estate(spark, str(tmp_path))
    assert objects.first()["object_key"] == "k" and objects.count() == 1
    assert tuples(lineage.table_edges(edges, lineage.READS)) == Counter([("a", "s.b")])


def test_report_objects(spark, tmp_path):
    path = tmp_path / "bi.json"
    path.write_text('[{"obj_id": "a", "system": "x", "target_tables": ["G.a", "g.b"], "ordered": true}, {"obj_id": "b", "system": "y", "target_tables": []}]')
    objs = tables.read_bi_objects(spark, str(path))
    assert objs.count() == 2 and tables.read_bi_objects(spark, str(path), "y").first()["obj_id"] == "b"
    done = spark.createDataFrame([("g.A",)], "table string")
    assert [r["obj_id"] for r in certify.ready_reports(objs, done).collect()] == ["b"]


def test_catalog_tables(spark, tmp_path):
    from tableproof.operators.parity import extra_tables

    spark.sql(f"CREATE DATABASE proof_db LOCATION '{tmp_path}'")
    try:
        tables.replace_table(spark.range(3), "proof_db.wanted")
        tables.replace_table(spark.range(2), "proof_db.wanted")
        tables.replace_table(spark.range(1), "proof_db.stray")
        assert spark.table("proof_db.wanted").count() == 2
        assert [r["table_name"] for r in extra_tables(spark, "proof_db", ["wanted"]).collect()] == ["stray"]
    finally:
        spark.sql("DROP DATABASE proof_db CASCADE")


def test_results_table(spark, tmp_path):
    rows = spark.createDataFrame([("t", "row_count", False, "1", "2")], "table_name string, check_name string, passed boolean, src_value string, build_value string")
    path = str(tmp_path / "results")
    for attempt in (1, 2):
        tables.write_results(stamp(rows, "u", "sit", "build", None, attempt, dt.datetime(2024, 1, 1), "TIMING"), path)
    back = spark.read.parquet(path)
    assert back.count() == 2 and back.first()["reason_code"] == "TIMING" and len(back.columns) == 12


# --- lineage ----------------------------------------------------------------

def reach(edges):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    changed = True
    while changed:
        changed = False
        for a in list(out):
            more = set().union(*[out.get(b, set()) for b in out[a]]) - out[a]
            if more:
                out[a] |= more
                changed = True
    return out


@pytest.mark.parametrize("seed,n,m", [(2, 25, 32), (4, 15, 0)])
def test_components_and_waves(spark, seed, n, m):
    rnd = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(n)]
    edges = {(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(m)}
    r = reach({(a, b) for a, b in edges if a != b})
    comp = {v: min([v] + [w for w in nodes if w in r[v] and v in r[w]]) for v in nodes}
    nd = spark.createDataFrame([(v,) for v in nodes], "node string")
    ed = spark.createDataFrame(list(edges), "src string, dst string")
    got = lineage.components(nd, ed)
    assert {x["node"]: x["component"] for x in got.collect()} == comp
    dag = {(comp[a], comp[b]) for a, b in edges if comp[a] != comp[b]}
    wave = {c: 0 for c in comp.values()}
    for _ in wave:
        for a, b in dag:
            wave[b] = max(wave[b], wave[a] + 1)
    plain = lineage.wave_layers(ed, got)
    assert {x["node"]: x["wave"] for x in plain.collect()} == {v: wave[comp[v]] for v in nodes}
    # The same through writers: each writer covers several edges; every pair it makes is an edge.
    jobs = [(f"job{i}", {rnd.choice(nodes) for _ in range(2)}, {rnd.choice(nodes) for _ in range(2)}) for i in range(m // 4)]
    pairs = {(a, b) for _, ins, outs in jobs for a in ins for b in outs if a != b}
    r = reach(pairs)
    comp = {v: min([v] + [w for w in nodes if w in r[v] and v in r[w]]) for v in nodes}
    dag = {(comp[a], comp[b]) for a, b in pairs if comp[a] != comp[b]}
    wave = {c: 0 for c in comp.values()}
    for _ in wave:
        for a, b in dag:
            wave[b] = max(wave[b], wave[a] + 1)
    log = [(j, "READS_TABLE", t) for j, ins, _ in jobs for t in ins] + [(j, "WRITES_TABLE", t) for j, _, outs in jobs for t in outs]
    edges = spark.createDataFrame(log, "src_key string, edge_type string, dst_name string")
    objects = spark.createDataFrame([(v, "TABLE") for v in nodes], "name string, type string")
    waves = lineage.table_waves(edges, objects)
    assert {x["node"]: (x["component"], x["wave"]) for x in waves.collect()} == {v: (comp[v], wave[comp[v]]) for v in nodes}
    on_cycles = {v for v in nodes if sum(c == comp[v] for c in comp.values()) > 1}
    assert {x["node"] for x in lineage.cycles(edges, objects).collect()} == on_cycles
    reads, writes = lineage.table_edges(edges, lineage.READS), lineage.table_edges(edges, lineage.WRITES)
    audit = lineage.order_audit(nd, reads, writes, waves).first()
    assert audit["passed"] and audit["components"] == len(set(comp.values()))
    if dag:
        broken = waves.withColumn("wave", F.when(F.col("wave") == 1, 5).otherwise(F.col("wave")))
        assert not lineage.order_audit(nd, reads, writes, broken).first()["passed"]
        assert lineage.order_audit(nd, reads, writes, waves.where("wave > 0")).first()["c1_missing"] > 0


def test_transitive(spark):
    edges = [(i, i + 1) for i in range(6)] + [(6, 2), (9, 9)]
    df = spark.createDataFrame(edges, "src int, dst int")
    got = tuples(lineage.transitive(df.select(F.col("src").alias("node"), F.col("dst").alias("reached")), df))
    want = reach(set(edges))
    assert got == Counter((a, b) for a in want for b in want[a])


def test_layers(spark):
    names = ["ods.a", "SRC.b", "ds.c", "az_x.d", "foo.stg_e", "mart.f", "metadata.g", "qlik.h", "stg"]
    got = spark.createDataFrame([(n,) for n in names], "t string").select(filters.layer_of(F.col("t")).alias("l"))
    assert [r["l"] for r in got.collect()] == ["bronze", "bronze", "silver", "bronze", "silver", "gold", "config", "serving", "silver"]


# --- governance -------------------------------------------------------------

def test_masks(spark):
    df = spark.createDataFrame([("Ann", "a@b.c", "555-1234", "s"), (None, None, None, None), ("", "nomail", "12", "t")], "n string, e string, p string, d string")
    rules = {"n": "name", "e": "email", "p": "phone", "d": "other"}
    got = [tuple(r) for r in governance.apply_masks(df, rules).collect()]
    assert got == [("A****", "***@b.c", "***-***-1234", "****"), (None, None, None, None), ("****", None, "***-***-12", "****")]
    assert [tuple(r) for r in governance.apply_masks(df, rules, True).collect()] == [tuple(r) for r in df.collect()]


def test_access_gate(spark):
    p = spark.createDataFrame([("Ann",)], "principal string")
    g = spark.createDataFrame([("ann", "S.T")], "principal string, object string")
    o = spark.createDataFrame([("s.t",)], "name string")
    s = spark.createDataFrame([("C",)], "connection string")
    c = spark.createDataFrame([("c", 1), ("idle", 0)], "connection string, n_pipelines int")
    k = spark.createDataFrame([("t", "x", "pii", "name")], "table string, column string, classification string, mask string")
    assert governance.access_gate(governance.access_audit(p, g, o, s, c, k)).first()["passed"]
    stranger = g.unionAll(spark.createDataFrame([("bob", "s.t")], g.schema))
    audit = {r["finding"]: r["first_item"] for r in governance.access_audit(p, stranger, o, s, c, k).where("not passed").collect()}
    assert audit == {"unknown_principal": "bob"}


def parses(spark, sql: str) -> bool:
    try:
        spark._jsparkSession.sessionState().sqlParser().parseQuery(sql)
        return True
    except Exception:  # noqa: BLE001 - any parse error
        return False


@pytest.mark.parametrize("dialect,text,want", [
    ("postgres", "(a+b)::int", "CAST((a+b) AS INT)"), ("postgres", "sum(x)::int", "CAST(sum(x) AS INT)"),
    ("postgres", "x::numeric(10,2)", "CAST(x AS DECIMAL(10,2))"), ("postgres", "c::varchar(10)", "left(CAST(c AS STRING), 10)"),
    ("postgres", "'call now() at noon'", "'call now() at noon'"), ("postgres", "now ( )::timestamptz", "CAST(current_timestamp() AS TIMESTAMP)"),
    ("postgres", "x::int::double precision", "CAST(CAST(x AS INT) AS DOUBLE)"), ("postgres", "a and (b)::bool", "a and CAST((b) AS BOOLEAN)"),
    ("postgres", "'it''s'::text -- x::int", "CAST('it''s' AS STRING) -- x::int"), ("postgres", "t.\"My Col\"::text", "CAST(t.`My Col` AS STRING)"),
    ("postgres", "f(g(x), ')')::date", "CAST(f(g(x), ')') AS DATE)"), ("postgres", "x RLIKE 'a\\d'", "x RLIKE 'a\\\\d'"),
    ("postgres", "b ILIKE 'c' AND string_agg(x, ',') = ''", "b ILIKE 'c' AND string_agg(x, ',') = ''"),
    ("tsql", "ISNULL([my col], '[x]')", "coalesce(`my col`, '[x]')"), ("tsql", "LEN(GETDATE())", "length(current_timestamp())"),
    ("tsql", "s.len + len_x", "s.len + len_x"),
])
def test_translation_of_code(spark, dialect, text, want):
    got, review = translate.translate_text(text, dialect)
    assert (got, review) == (want, "") and parses(spark, f"SELECT {got}")


@pytest.mark.parametrize("dialect,text,flags", [
    ("postgres", "a[1]", "ARRAY"), ("postgres", "x::int[]", "ARRAY;CAST int[]"), ("postgres", "x::uuid", "CAST uuid"),
    ("postgres", "nextval('s') + E'a'", "PREFIXED_LITERAL;NEXTVAL"), ("postgres", "$$a$$", "DOLLAR_QUOTE"),
    ("tsql", "SELECT TOP 5 x", "TOP"), ("tsql", "SELECT TOP (10) x", "TOP"), ("tsql", "CONVERT(int, x)", "CONVERT"),
    ("tsql", "DATEADD(day, 1, d)", "DATEADD"), ("tsql", "a[1]", "SUBSCRIPT"), ("tsql", "@v + #t", "VARIABLE;TEMP_TABLE"),
])
def test_translation_names_what_it_leaves(dialect, text, flags):
    got, review = translate.translate_text(text, dialect)
    assert got == text and review == flags


def test_translation_of_tables(spark):
    q = spark.createDataFrame([("SELECT x::int FROM dbo.Sales s JOIN dbo.SalesTax x JOIN xdbo.Sales WHERE c = 'dbo.sales' AND y.dbo.sales = 1",), (None,)], "q string")
    r = translate.translate_queries(q, "q", "postgres").collect()
    assert r[0]["translated"].startswith("SELECT CAST(x AS INT) FROM") and r[1]["translated"] is None and r[1]["needs_review"] == ""
    got = q.select(translate.repoint_tables(F.col("q"), {"dbo.sales": "gold.sales"}).alias("q")).collect()
    assert got[0]["q"] == "SELECT x::int FROM gold.sales s JOIN dbo.SalesTax x JOIN xdbo.Sales WHERE c = 'dbo.sales' AND y.dbo.sales = 1"
    assert got[1]["q"] is None


# --- certification ----------------------------------------------------------

def check_rows(unit, dev=True, sit=True, soak=("T+7", "T+14"), skip=(), soak_ok=True):
    rows = [(unit, "dev", "build", c, dev) for c in SAMPLE_CHECKS] + [(unit, "sit", "build", c, sit) for c in CHECKS if c not in skip]
    return rows + [(unit, "soak", w, c, soak_ok) for w in soak for c in PROFILES["soak"]]


def test_gates(spark):
    rows = (
        check_rows("done") + check_rows("half", soak=("T+7",)) + check_rows("fresh", soak=()) + check_rows("red", sit=False)
        + check_rows("gap", skip=("idempotency",)) + check_rows("drift", soak_ok=False) + check_rows("nodev", dev=False)
    )
    df = spark.createDataFrame(rows, "pipeline string, env string, checkpoint string, check_name string, passed boolean").select(
        "*", F.lit("t").alias("table_name"), F.lit(1).alias("attempt")
    )
    got = {r["pipeline"]: (r["status"], r["soak_state"]) for r in certify.pipeline_gate(df).collect()}
    assert got == {
        "done": ("CERTIFIED", "PASS"), "half": ("PROVISIONAL", "FAIL"), "fresh": ("PROVISIONAL", "PENDING"), "red": ("BLOCKED", "PENDING"),
        "gap": ("BLOCKED", "PENDING"), "drift": ("PROVISIONAL", "FAIL"), "nodev": ("BLOCKED", "PENDING"),
    }
    loose = {r["pipeline"]: r["status"] for r in certify.pipeline_gate(df, require_both=False, require_soak=False).collect()}
    assert loose["nodev"] == "CERTIFIED" and loose["fresh"] == "CERTIFIED" and loose["red"] == "BLOCKED"
    retry = df.unionAll(df.where("pipeline = 'red' AND env = 'sit'").withColumn("passed", F.lit(True)).withColumn("attempt", F.lit(2)))
    assert {r["pipeline"]: r["status"] for r in certify.pipeline_gate(retry).collect()}["red"] == "CERTIFIED"


def test_a_pipeline_is_as_green_as_its_least_table(spark):
    schema = "pipeline string, env string, checkpoint string, check_name string, passed boolean, table_name string, attempt int"
    full = [(*r, "a", 1) for r in check_rows("p")]

    def state(rows, contract=None):
        c = None if contract is None else spark.createDataFrame(contract, "pipeline string, table_name string")
        return {r["pipeline"]: r["status"] for r in certify.pipeline_gate(spark.createDataFrame(rows, schema), c).collect()}

    assert state(full) == {"p": "CERTIFIED"}
    assert state(full + [("p", "dev", "build", "schema_parity", True, "b", 1)]) == {"p": "BLOCKED"}
    assert state(full, [("p", "a"), ("p", "b")]) == {"p": "BLOCKED"}
    assert state(full, [("p", "a"), ("q", "a")]) == {"p": "CERTIFIED", "q": "BLOCKED"}
    for point in ("T+7", "T+14"):
        red = [(*r[:4], r[4] and not (r[2] == point and r[3] == "soak_delta_parity"), *r[5:]) for r in full]
        assert state(red) == {"p": "PROVISIONAL"}
        assert state([r for r in full if not (r[2] == point and r[3] == "soak_delta_parity")]) == {"p": "PROVISIONAL"}


def test_system_states(spark):
    def state(statuses, reports=None):
        g = spark.createDataFrame([(str(i), s) for i, s in enumerate(statuses)], "pipeline string, status string")
        r = None if reports is None else spark.createDataFrame([(str(i), d) for i, d in enumerate(reports)], "obj_id string, done boolean")
        return certify.system_state(g, r).first()["status"]

    assert state([]) == "MIGRATION_IN_PROGRESS"
    assert state(["CERTIFIED", "BLOCKED"]) == "MIGRATION_IN_PROGRESS"
    assert state(["CERTIFIED", "PROVISIONAL"]) == "SYSTEM_PROVISIONAL"
    assert state(["CERTIFIED"]) == "MIGRATION_COMPLETE"
    assert state(["CERTIFIED"], [True, False]) == "SYSTEM_PROVISIONAL"
    assert state(["CERTIFIED"], [True, True]) == "MIGRATION_COMPLETE"
    g = spark.createDataFrame([("a", "CERTIFIED"), ("b", "PROVISIONAL")], "pipeline string, status string")
    assert [r["pipeline"] for r in certify.blocking(g).collect()] == ["b"]
    assert certify.blocking(g.where("status = 'CERTIFIED'")).count() == 0
    reports = spark.createDataFrame([("x", True), ("y", False)], "obj_id string, done boolean")
    assert sorted(r["pipeline"] for r in certify.blocking(g, reports).collect()) == ["BI:1/2", "b"]
    blocked = g.unionAll(spark.createDataFrame([("c", "BLOCKED")], g.schema))
    assert [r["pipeline"] for r in certify.blocking(blocked, reports).collect()] == ["c"]
    assert certify.blocking(g.where("status = 'CERTIFIED'"), reports.where("done")).count() == 0


def test_shared_folder_must_be_named_on_a_cluster():
    from tableproof.session import shared_dir

    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default=None):
            return self.value or default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = Conf(None)

    with pytest.raises(RuntimeError):
        shared_dir(Session())
    Session.conf = Conf("hdfs://x/tmp/")
    assert shared_dir(Session()) == "hdfs://x/tmp"
