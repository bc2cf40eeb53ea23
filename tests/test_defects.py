"""Plant one defect at a time and see exactly the checks turn red that should."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tableproof import FK, Target
from tableproof.operators import diff, filters, parity, results
from tableproof.operators.parity import CHECKS, PROFILES, SAMPLE_CHECKS

SCHEMA = "id bigint, cust bigint, status string, price decimal(18,2), at timestamp_ntz"
T = Target("t", keys=("id",), watermark_col="at", watermark=dt.datetime(2024, 1, 20), prev_watermark=dt.datetime(2024, 1, 10))


def rows(n=200):
    return [
        (i, i % 7, "OFP"[i % 3] if i % 11 else None, Decimal(i) / 4, dt.datetime(2024, 1, 1) + dt.timedelta(hours=3 * i))
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame(rows(), SCHEMA).coalesce(2)


@pytest.fixture(scope="module")
def parent(spark):
    return spark.createDataFrame([(i,) for i in range(7)], "k bigint")


def verdicts(env, source, build, parent, t=T, **kw):
    kw.setdefault("rebuild", lambda: build)
    out = parity.run_profile(env, source, build, t, parents={"p": parent}, fks=[FK("cust", "p", "k")], **kw)
    return {r["check_name"]: r["passed"] for r in out.collect()}


def red(v):
    return {k for k, ok in v.items() if not ok}


def test_identical_tables_are_green(base, parent):
    for env in ("dev", "sit", "soak"):
        v = verdicts(env, base, base.repartition(5).orderBy(F.rand(1)), parent)
        assert set(v) == set(PROFILES[env]) and not red(v), env


def test_profile_without_a_rebuild_is_red_for_idempotency_only(base, parent):
    assert red(verdicts("sit", base, base, parent, rebuild=None)) == {"idempotency"}


def test_profile_sizes():
    assert len(SAMPLE_CHECKS) == 6 and len(CHECKS) == 10 and len(PROFILES["soak"]) == 11


def test_dropped_row(base, parent):
    v = verdicts("soak", base, base.where("id <> 100"), parent)  # 2024-01-13 12:00, inside the delta window
    assert {"row_count", "key_parity", "content_checksum", "row_level_sample", "soak_delta_parity"} <= red(v)
    assert v["referential_integrity"] and v["no_extra_output"] and v["idempotency"]


def test_dropped_row_before_the_window_keeps_the_delta_green(base, parent):
    v = verdicts("soak", base, base.where("id <> 5"), parent)
    assert v["soak_delta_parity"] and not v["row_count"]


def test_row_after_the_watermark_is_ignored(base, parent):
    assert not red(verdicts("sit", base, base.where("id <> 199"), parent))


def test_duplicated_row(base, parent):
    v = verdicts("sit", base, base.unionAll(base.where("id = 3")), parent)
    assert {"row_count", "key_parity", "content_checksum", "row_level_sample"} <= red(v)


def test_changed_value(base, parent):
    build = base.withColumn("status", F.when(F.col("id") == 8, "X").otherwise(F.col("status")))
    v = verdicts("sit", base, build, parent)
    assert v["row_count"] and v["key_parity"] and not v["content_checksum"] and not v["row_level_sample"]
    cells = [tuple(r) for r in diff.column_diff(base, build, T).collect()]
    assert cells == [(8, "changed", 1, "status", "P", "X")]


def test_swapped_values_keep_aggregates_but_not_content(base, parent):
    build = base.withColumn("price", F.when(F.col("id") == 4, Decimal("1.50")).when(F.col("id") == 6, Decimal("1.00")).otherwise(F.col("price")).cast("decimal(18,2)"))
    v = verdicts("sit", base, build, parent)
    assert v["column_aggregates"] and v["null_distribution"] and red(v) == {"content_checksum", "row_level_sample"}


def test_nulled_value(base, parent):
    build = base.withColumn("status", F.when(F.col("id") == 8, None).otherwise(F.col("status")))
    v = verdicts("sit", base, build, parent)
    assert {"null_distribution", "column_aggregates", "content_checksum", "row_level_sample"} <= red(v) and v["key_parity"]


def test_null_moved_between_columns_is_seen(spark):
    t = Target("t", keys=("id",))
    a = spark.createDataFrame([(1, None, "a"), (2, "b", None)], "id int, x string, y string")
    b = spark.createDataFrame([(1, "a", None), (2, None, "b")], "id int, x string, y string")
    assert not parity.content_checksum(a, b, t).first()["passed"]


def test_orphan(base, parent):
    build = base.withColumn("cust", F.when(F.col("id") == 9, 99).otherwise(F.col("cust")))
    v = verdicts("sit", base, build, parent)
    assert not v["referential_integrity"]
    assert [tuple(r) for r in parity.orphans(build, parent, FK("cust", "p", "k")).collect()] == [(99, 1)]


def test_null_foreign_key_is_no_orphan(base, parent):
    build = base.withColumn("cust", F.lit(None).cast("bigint"))
    assert parity.orphans(build, parent, FK("cust", "p", "k")).count() == 0


def test_extra_column_and_type(base, parent):
    build = base.withColumn("price", F.col("price").cast("string")).withColumn("note", F.lit("n"))
    v = verdicts("sit", base, build, parent)
    assert not v["schema_parity"] and not v["no_extra_output"]
    assert v["key_parity"] and v["row_level_sample"], "equal text compares equal"
    bad = {r["column_name"]: r["problem"] for r in parity.extra_output_rows(build, base.columns).collect()}
    assert bad == {"note": "extra"}


def test_column_order_is_schema_drift(base, parent):
    build = base.select("id", "status", "cust", "price", "at")
    assert not parity.schema_parity(base, build, T).first()["passed"]


def test_unstable_build(base, parent):
    runs = iter([base, base.where("id <> 1")])
    assert not verdicts("dev", base, base, parent, rebuild=lambda: next(runs))["idempotency"]


def test_empty_sides(base, parent):
    none = base.where("false")
    assert not red(verdicts("sit", none, none, parent))
    assert "row_count" in red(verdicts("sit", base, none, parent))


def test_checksum_ignores_order_and_partitioning(base):
    def h(df):
        return parity.content_checksum(df, base, T).first()["src_value"]

    assert h(base) == h(base.repartition(13)) == h(base.orderBy(F.desc("price")).coalesce(1))


def test_repeated_keys_are_not_paired(spark):
    t = Target("t", keys=("k",))
    a = spark.createDataFrame([(1, "x")] * 3 + [(1, "y"), (2, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x")] + [(1, "w"), (2, "q")], "k int, v string")
    got = {(r["k"], r["change"], r["n_rows"]) for r in diff.row_diff(a, b, t).collect()}
    assert got == {(1, "missing_in_build", 2), (1, "missing_in_build", 1), (1, "extra_in_build", 1), (2, "changed", 1)}


def test_null_keys_compare_equal(spark):
    t = Target("t", keys=("k",))
    a = spark.createDataFrame([(None, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(None, "z"), (1, "y")], "k int, v string")
    got = [(r["k"], r["change"], r["src"]["v"], r["build"]["v"]) for r in diff.row_diff(a, b, t).collect()]
    assert got == [(None, "changed", "x", "z")]


def test_double_zero_signs_and_nan(spark):
    t = Target("t", keys=("k",))
    a = spark.createDataFrame([(1, 0.0), (2, float("nan"))], "k int, v double")
    b = spark.createDataFrame([(1, -0.0), (2, float("nan"))], "k int, v double")
    assert parity.content_checksum(a, b, t).first()["passed"]
    assert diff.row_diff(a, b, t).count() == 0


def test_drift_reasons(spark, base):
    t = Target("t", keys=("id",), watermark=dt.datetime(2024, 1, 20), prev_watermark=dt.datetime(2024, 1, 10))
    cells = spark.createDataFrame([
        (1, "changed", "status", "o ", "O", dt.datetime(2024, 1, 1)),
        (2, "changed", "price", "1.001", "1.002", dt.datetime(2024, 1, 1)),
        (3, "missing_in_build", "*", None, None, dt.datetime(2024, 1, 5)),
        (4, "missing_in_build", "*", None, None, dt.datetime(2024, 1, 20)),
        (5, "changed", "status", "O", "F", dt.datetime(2024, 1, 12)),
        (6, "changed", "status", "O", "F", dt.datetime(2024, 1, 2)),
        (7, "changed", "qty", "1", "2", dt.datetime(2024, 1, 2)),
        (8, "changed", "status", "O", "F", dt.datetime(2024, 1, 2)),
    ], "id int, change string, column_name string, src_value string, build_value string, event_time timestamp_ntz")
    waived = spark.createDataFrame([(8, "status", "LEGACY-BUG"), (8, "status", "SOURCE-CHANGE")], "id int, column_name string, reason_code string")
    rest = ["LATE-DATA", "TIMING", "INCREMENTAL-LOGIC", "TRANSLATION", "SCHEMA", "LEGACY-BUG"]
    for scales, second in ((None, "TRANSLATION"), ({"price": 2}, "TYPE-NUANCE"), ({"price": 3}, "TRANSLATION"), ({"other": 1}, "TRANSLATION")):
        out = diff.drift_reason(cells, t, "event_time", mistyped=["qty"], waivers=waived, scales=scales)
        assert [r["reason_code"] for r in out.orderBy("id").collect()] == ["TYPE-NUANCE", second, *rest]
        assert {r["reason_code"] for r in out.collect()} <= set(diff.REASON_CODES)
    null_key = cells.where("id = 6").withColumn("id", F.lit(None).cast("int"))
    pardon = spark.createDataFrame([(None, "status", "LEGACY-BUG")], "id int, column_name string, reason_code string")
    assert diff.drift_reason(null_key, t, "event_time", waivers=pardon).first()["reason_code"] == "LEGACY-BUG"


def test_tolerance(spark):
    c = spark.createDataFrame([("a", 0, 10), ("b", 1, 10), ("c", 0, 0)], "g string, d bigint, n bigint")
    strict = {r["g"]: r["within"] for r in parity.within_tolerance(c, "d", "n").collect()}
    loose = {r["g"]: r["within"] for r in parity.within_tolerance(c, "d", "n", 0.1).collect()}
    assert strict == {"a": True, "b": False, "c": True} and all(loose.values())


def test_approximate_profile_is_close(base):
    exact = {r["column_name"]: r["distinct_count"] for r in parity.column_profile(base).collect()}
    approx = {r["column_name"]: r["distinct_count"] for r in parity.column_profile(base, approx=True).collect()}
    assert set(exact) == set(approx) and all(abs(exact[c] - approx[c]) <= 0.15 * exact[c] + 1 for c in exact)


def test_watermark_filter_reaches_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    df = filters.as_of(orders, "o_orderdate", dt.datetime(2000, 1, 1)).select("o_orderkey", "o_orderdate")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(o_orderdate" in plan.split("PushedFilters")[1]
    assert "o_totalprice" not in plan.split("ReadSchema")[1]


def test_result_parity(spark, base):
    order = [F.desc("price"), "id"]
    same = {r["check_name"]: r["passed"] for r in results.result_parity(base, base.repartition(3), order).collect()}
    assert len(same) == 5 and all(same.values())
    short = {r["check_name"]: r["passed"] for r in results.result_parity(base, base.where("id < 199"), order).collect()}
    assert short["result_schema"] and not any(ok for c, ok in short.items() if c != "result_schema")


def test_positions_are_gapless(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("v"))
    got = results.with_positions(df, ["v"]).collect()
    assert sorted((r["position"], r["v"]) for r in got) == [(i, i) for i in range(1000)]
    hot = df.select(F.when(F.col("v") < 400, 5).otherwise(F.col("v")).alias("v"))
    got = sorted(tuple(r) for r in results.with_positions(hot, ["v"]).select("position", "v").collect())
    assert [p for p, _ in got] == list(range(1000)) and [v for _, v in got] == sorted(v for _, v in got)
