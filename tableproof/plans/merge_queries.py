"""Registered queries: ingest, merges, history, maintenance and round trips."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tableproof.functions.money import dec
from tableproof.operators import merge
from tableproof.plans import mart_queries as marts
from tableproof.plans.pair import ORDERS, PAIR_SQL, PREV, WATERMARK, build, source
from tableproof.plans.registry import query
from tableproof.session import fresh_path, materialize
from tableproof.sources import extract, tables
from tableproof.sources.tables import read_table

_WM, _PREV = f"TIMESTAMP '{WATERMARK}'", f"TIMESTAMP '{PREV}'"


@query("dedup_latest", """
SELECT event_id, ts, user_id, event_type, value, props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
""")
def dedup_latest(spark, d):
    return merge.dedup(read_table(spark, d, "events"), ["user_id"], ["ts", "event_id"])


@query("scd1_merge", f"""
WITH u AS (SELECT o_custkey AS c_custkey, 'RECENT' AS c_mktsegment, CAST(max(o_totalprice) AS DECIMAL(12,2)) AS c_acctbal
           FROM orders WHERE o_orderdate > {_WM} GROUP BY o_custkey
           UNION ALL
           SELECT s_suppkey + 10000000, 'SUPPLIER', CAST(s_acctbal AS DECIMAL(12,2)) FROM supplier)
SELECT coalesce(u.c_custkey, c.c_custkey) AS c_custkey, c.c_name, c.c_nationkey,
       CASE WHEN u.c_custkey IS NULL THEN CAST(c.c_acctbal AS DECIMAL(12,2)) ELSE u.c_acctbal END AS c_acctbal,
       coalesce(u.c_mktsegment, c.c_mktsegment) AS c_mktsegment
FROM customer c FULL JOIN u ON u.c_custkey = c.c_custkey
""")
def scd1_merge(spark, d):
    target = read_table(spark, d, "customer").withColumn("c_acctbal", dec("c_acctbal"))
    recent = read_table(spark, d, "orders").where(f"o_orderdate > TIMESTAMP_NTZ '{WATERMARK}'").groupBy(
        F.col("o_custkey").alias("c_custkey")
    ).agg(F.lit("RECENT").alias("c_mktsegment"), F.max("o_totalprice").cast("decimal(12,2)").alias("c_acctbal"))
    new = read_table(spark, d, "supplier").select(
        (F.col("s_suppkey") + 10_000_000).alias("c_custkey"), F.lit("SUPPLIER").alias("c_mktsegment"), dec("s_acctbal").alias("c_acctbal")
    )
    return merge.scd1_merge(target, recent.unionByName(new), ["c_custkey"])


@query("scd2_merge", """
WITH v AS (SELECT c_custkey, TIMESTAMP '1994-01-01' AS effective_from, c_mktsegment AS grade FROM customer
           UNION ALL
           SELECT o_custkey, o_orderdate, max(o_orderpriority) FROM orders GROUP BY o_custkey, o_orderdate),
     c AS (SELECT *, lag(grade) OVER (PARTITION BY c_custkey ORDER BY effective_from) AS before,
                  row_number() OVER (PARTITION BY c_custkey ORDER BY effective_from) AS rn FROM v),
     k AS (SELECT * FROM c WHERE rn = 1 OR grade IS DISTINCT FROM before)
SELECT c_custkey, grade, effective_from,
       coalesce(lead(effective_from) OVER (PARTITION BY c_custkey ORDER BY effective_from), TIMESTAMP '9999-12-31') AS effective_to,
       lead(effective_from) OVER (PARTITION BY c_custkey ORDER BY effective_from) IS NULL AS is_active
FROM k
""")
def scd2_merge(spark, d):
    """Two merges, older changes first; together they must equal one history of all changes."""
    dim = read_table(spark, d, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("grade"),
        F.lit("1994-01-01").cast("timestamp_ntz").alias("effective_from"),
        F.lit(merge.OPEN_END).cast("timestamp_ntz").alias("effective_to"), F.lit(True).alias("is_active"),
    )
    changes = read_table(spark, d, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("grade"), F.col("o_orderdate").alias("changed_at")
    )
    half = F.col("changed_at") <= F.lit(str(PREV)).cast("timestamp_ntz")
    older = materialize(merge.scd2_merge(dim, changes.where(half), ["c_custkey"], ["grade"], "changed_at"), "dim")
    return merge.scd2_merge(older, changes.where(~half), ["c_custkey"], ["grade"], "changed_at")


def change_feed(events):
    """Events as a change feed on customer balances."""
    op = F.when(F.col("event_type") == "error", "D").when(F.col("event_type") == "signup", "I").otherwise("U")
    return events.select(
        F.col("user_id").alias("c_custkey"), F.col("value").alias("c_acctbal"), op.alias("op"), F.col("event_id").alias("seq")
    )


CHANGE_SQL = """
SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)
UNION ALL
SELECT user_id, value FROM (
  SELECT user_id, value, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1
) WHERE event_type <> 'error'
"""


@query("delta_apply", CHANGE_SQL)
def delta_apply(spark, d):
    balances = read_table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return merge.delta_apply(balances, change_feed(read_table(spark, d, "events")), ["c_custkey"], "op", "seq")


@query("cdc_snapshot", f"""
WITH {PAIR_SQL}
SELECT CASE WHEN s.o_orderkey IS NULL THEN 'I' WHEN b.o_orderkey IS NULL THEN 'D' ELSE 'U' END AS op,
       coalesce(b.o_orderkey, s.o_orderkey) AS o_orderkey, coalesce(b.o_custkey, s.o_custkey) AS o_custkey,
       coalesce(b.o_orderstatus, s.o_orderstatus) AS o_orderstatus, coalesce(b.o_totalprice, s.o_totalprice) AS o_totalprice,
       coalesce(b.o_orderdate, s.o_orderdate) AS o_orderdate, coalesce(b.o_orderpriority, s.o_orderpriority) AS o_orderpriority
FROM s FULL JOIN b ON s.o_orderkey = b.o_orderkey
WHERE s.o_orderkey IS NULL OR b.o_orderkey IS NULL OR s.o_orderstatus <> b.o_orderstatus OR s.o_totalprice <> b.o_totalprice
""")
def cdc_snapshot(spark, d):
    return merge.cdc_snapshot(source(spark, d), build(spark, d), list(ORDERS.keys))


@query("retention_purge", "SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-21' OR ts IS NULL")
def retention_purge(spark, d):
    return merge.retention_purge(read_table(spark, d, "events"), "ts", 10, dt.datetime(2024, 1, 31))


@query("copy_table", "SELECT * FROM lineitem WHERE l_returnflag = 'R'")
def copy_table(spark, d):
    return merge.copy_table(read_table(spark, d, "lineitem"), F.col("l_returnflag") == "R")


@query("backfill", f"""
WITH {PAIR_SQL}
SELECT * FROM b WHERE o_orderdate <= {_PREV} OR o_orderdate > {_WM}
UNION ALL SELECT * FROM s WHERE o_orderdate > {_PREV} AND o_orderdate <= {_WM}
""")
def backfill(spark, d):
    return merge.backfill(build(spark, d), lambda df: df, source(spark, d), "o_orderdate", PREV, WATERMARK)


@query("advance_watermark", """
WITH c AS (SELECT event_type AS table_name, 'ts' AS watermark_col, max(ts) AS watermark_value FROM events
           WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY event_type),
     l AS (SELECT event_type AS table_name, max(ts) AS new_wm FROM events
           WHERE ts > TIMESTAMP '2024-01-15' AND event_type <> 'error' GROUP BY event_type)
SELECT c.table_name, watermark_col, greatest(watermark_value, new_wm) AS watermark_value,
       CASE WHEN new_wm IS NULL THEN TIMESTAMP '2024-01-15' ELSE TIMESTAMP '2024-02-01' END AS last_run_ts,
       CASE WHEN new_wm IS NULL THEN 'PENDING' ELSE 'SUCCESS' END AS status
FROM c LEFT JOIN l ON c.table_name = l.table_name
""")
def advance_watermark(spark, d):
    ev = read_table(spark, d, "events")
    cut = F.col("ts") <= F.lit("2024-01-15").cast("timestamp_ntz")
    control = ev.where(cut).groupBy(F.col("event_type").alias("table_name")).agg(
        F.lit("ts").alias("watermark_col"), F.max("ts").alias("watermark_value"),
        F.lit("2024-01-15").cast("timestamp_ntz").alias("last_run_ts"), F.lit("PENDING").alias("status"),
    )
    loads = ev.where(~cut & (F.col("event_type") != "error")).select(F.col("event_type").alias("table_name"), F.col("ts").alias("wm"))
    return merge.advance_watermark(control, loads, dt.datetime(2024, 2, 1))


@query("sql_steps", """
SELECT o_orderpriority, count(*) AS n_orders, CAST(sum(units) AS BIGINT) AS units
FROM orders JOIN (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units FROM lineitem GROUP BY 1) u ON l_orderkey = o_orderkey
WHERE units > 50 GROUP BY 1
""")
def sql_steps(spark, d):
    inputs = {"step_orders": read_table(spark, d, "orders"), "step_lines": read_table(spark, d, "lineitem")}
    return merge.sql_steps(spark, inputs, [
        ("step_units", "SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS units FROM {step_lines} GROUP BY l_orderkey"),
        ("step_big", "SELECT o.o_orderpriority, u.units FROM {step_orders} o JOIN {step_units} u ON o.o_orderkey = u.l_orderkey WHERE u.units > 50"),
        ("step_out", "SELECT o_orderpriority, count(*) AS n_orders, sum(units) AS units FROM {step_big} GROUP BY o_orderpriority"),
    ])


@query("dynamic_sql_expand", """
SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS amount
FROM orders GROUP BY 1, 2
""")
def dynamic_sql_expand(spark, d):
    orders = read_table(spark, d, "orders")
    orders.createOrReplaceTempView("expand_orders")
    config = orders.select(F.col("o_orderpriority").alias("priority")).distinct()
    return merge.dynamic_sql_expand(spark, config, (
        "SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n_orders, "
        "sum(CAST(o_totalprice AS DECIMAL(18,2))) AS amount FROM expand_orders WHERE o_orderpriority = '{priority}' GROUP BY 1, 2"
    ))


@query("dim_date", """
WITH b AS (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders),
     x AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS cal_date FROM b)
SELECT CAST(strftime(cal_date, '%Y%m%d') AS INTEGER) AS date_key, cal_date, CAST(dayofweek(cal_date) + 1 AS INTEGER) AS day_of_week,
       CAST(month(cal_date) AS INTEGER) AS month, CAST(quarter(cal_date) AS INTEGER) AS quarter, CAST(year(cal_date) AS INTEGER) AS year
FROM x
""")
def dim_date(spark, d):
    bounds = read_table(spark, d, "orders").agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    return merge.dim_date(bounds, "lo", "hi")


SESSIONS_SQL = """
l AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
n AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM l),
p AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS page_views FROM n GROUP BY user_id, no)"""


@query("sessionize", f"WITH {SESSIONS_SQL} SELECT * FROM p")
def sessionize(spark, d):
    # The surrogate key is a Spark hash without a counterpart in SQL.
    return merge.sessionize(read_table(spark, d, "events"), "user_id", "ts", 1800).drop("session_key")


# --- extraction and round trips ---------------------------------------------

@query("watermark_extract", f"""
SELECT l_orderkey, l_linenumber, l_shipdate,
       CAST(ceil((epoch_us(l_shipdate) - epoch_us({_PREV})) * 8.0 / (epoch_us({_WM}) - epoch_us({_PREV}))) - 1 AS INTEGER) AS slice
FROM lineitem WHERE l_shipdate > {_PREV} AND l_shipdate <= {_WM}
""")
def watermark_extract(spark, d):
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return extract.watermark_extract(li, "l_shipdate", PREV, WATERMARK, 8)


@query("metadata_multi_ingest", f"""
WITH landed AS (
  SELECT 'orders' AS table_name, o_orderkey AS key, o_orderdate AS wm FROM orders WHERE o_orderdate > {_PREV} AND o_orderdate <= {_WM}
  UNION ALL SELECT 'lineitem', l_orderkey, l_shipdate FROM lineitem WHERE l_shipdate > TIMESTAMP '1999-01-01' AND l_shipdate <= {_WM})
SELECT 'landed' AS kind, table_name, key, wm, CAST(NULL AS VARCHAR) AS status FROM landed
UNION ALL SELECT 'load', table_name, count(*), max(wm), NULL FROM landed GROUP BY table_name
UNION ALL SELECT 'control', c.table_name, NULL, greatest(c.wm, l.wm), CASE WHEN l.wm IS NOT NULL THEN 'SUCCESS' ELSE 'NEW' END
FROM (VALUES ('orders', {_PREV}), ('lineitem', TIMESTAMP '1999-01-01'), ('customer', TIMESTAMP '1990-01-01')) c(table_name, wm)
LEFT JOIN (SELECT table_name, max(wm) AS wm FROM landed GROUP BY table_name) l ON l.table_name = c.table_name
""")
def metadata_multi_ingest(spark, d):
    control = spark.createDataFrame(
        [("orders", "o_orderdate", PREV), ("lineitem", "l_shipdate", dt.datetime(1999, 1, 1))],
        "table_name string, watermark_col string, watermark_value timestamp_ntz",
    )
    extracts, loads = extract.metadata_multi_ingest(control, lambda t: read_table(spark, d, t), WATERMARK)
    loads = materialize(loads, "loads")
    landed = [
        tables.land_bronze(df, fresh_path(spark, f"bronze-{t}")).select(
            F.lit("landed").alias("kind"), F.lit(t).alias("table_name"), F.col(key).alias("key"), F.col(wm).alias("wm"), F.lit(None).cast("string").alias("status")
        )
        for t, df, key, wm in (("orders", extracts["orders"], "o_orderkey", "o_orderdate"), ("lineitem", extracts["lineitem"], "l_orderkey", "l_shipdate"))
    ]
    idle = spark.createDataFrame([("customer", "c_since", dt.datetime(1990, 1, 1))], control.schema)
    registry = control.unionAll(idle).select("*", F.lit(None).cast("timestamp_ntz").alias("last_run_ts"), F.lit("NEW").alias("status"))
    advanced = merge.advance_watermark(registry, loads.select("table_name", "wm"), dt.datetime(2024, 2, 1))
    return landed[0].unionAll(landed[1]).unionAll(
        loads.select(F.lit("load"), "table_name", "loaded_rows", "wm", F.lit(None).cast("string"))
    ).unionAll(advanced.select(F.lit("control"), "table_name", F.lit(None).cast("bigint"), "watermark_value", "status"))


@query("replace_window", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus, count(*) AS n FROM orders
WHERE o_orderstatus <> 'F' OR year(o_orderdate) < 2000 GROUP BY 1, 2
""")
def replace_window(spark, d):
    """Years from 2000 on are rebuilt without finished orders; earlier partitions stay as they were."""
    path = fresh_path(spark, "by-year")
    per_year = read_table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), "o_orderstatus").agg(F.count("*").alias("n"))
    per_year.repartition("year").write.partitionBy("year").parquet(path)
    merge.replace_window(per_year.where("year >= 2000 AND o_orderstatus <> 'F'"), path, "year")
    return spark.read.parquet(path)


@query("replace_table", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def replace_table(spark, d):
    """A catalog table made twice; the second content stays, and no table beside it."""
    name = f"proof_{uuid.uuid4().hex}"
    segments = read_table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    tables.replace_table(segments.limit(0), name)
    tables.replace_table(segments, name)
    return spark.table(name)


@query("file_intake", "SELECT event_id, ts, user_id, event_type, CAST(value AS DECIMAL(12,2)) AS value, props FROM events")
def file_intake(spark, d):
    """Round trip through JSON files with a declared schema."""
    ev = read_table(spark, d, "events").withColumn("value", dec("value"))
    path = fresh_path(spark, "intake")
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    ev.write.option("timestampNTZFormat", micros).json(path)
    return extract.file_intake(spark, path, "json", ev.schema, timestampNTZFormat=micros)


@query("file_intake_csv", "SELECT * FROM customer")
def file_intake_csv(spark, d):
    """Round trip through CSV files with a header."""
    c = read_table(spark, d, "customer")
    path = fresh_path(spark, "intake-csv")
    c.write.option("header", True).csv(path)
    return extract.file_intake(spark, path, "csv", c.schema, header="true")


@query("land_bronze", "SELECT * FROM orders")
def land_bronze(spark, d):
    return tables.land_bronze(read_table(spark, d, "orders"), fresh_path(spark, "bronze"))


@query("append_table", "SELECT c_custkey AS party, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def append_table(spark, d):
    path = fresh_path(spark, "party")
    parties = [
        read_table(spark, d, "customer").select(F.col("c_custkey").alias("party"), F.col("c_name").alias("name")),
        read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("party"), F.col("s_name").alias("name")),
    ]
    for df in parties:
        tables.append_table(df, path)
    return spark.read.schema(parties[0].schema).parquet(path)


@query("create_view", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def create_view(spark, d):
    tables.create_view(read_table(spark, d, "customer").where("c_acctbal > 0"), "v_solvent_customers")
    return spark.sql("SELECT c_mktsegment, count(*) AS n FROM v_solvent_customers GROUP BY c_mktsegment")


@query("snapshot_result", marts._PART_SALES)
def snapshot_result(spark, d):
    return tables.snapshot_result(marts.part_sales(spark, d), fresh_path(spark, "snapshot"))


@query("serving_copy", f"""
SELECT cal_date, CAST(sum(net_amount) AS DECIMAL(28,2)) AS net_amount, CAST(sum(order_count) AS BIGINT) AS order_count
FROM ({marts._SERVING}) GROUP BY cal_date
""")
def serving_copy(spark, d):
    aggs = [F.sum("net_amount").alias("net_amount"), F.sum("order_count").alias("order_count")]
    return tables.serving_copy(marts.serving(spark, d), ["cal_date"], aggs, fresh_path(spark, "serving"))


@query("on_conflict_do_nothing", """
SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem
""")
def on_conflict_do_nothing(spark, d):
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").dropDuplicates(["l_orderkey", "l_linenumber"])


@query("rows_for_seed", """
SELECT o_orderkey, CAST(j AS INTEGER) AS line_no, (o_orderkey + j * 7) % 200 + 1 AS product_id
FROM (SELECT o_orderkey, unnest(generate_series(1, 1 + o_orderkey % 4)) AS j FROM orders)
""")
def rows_for_seed(spark, d):
    from tableproof.operators.synth import lines_of

    heads = read_table(spark, d, "orders").select("o_orderkey")
    lines = lines_of(heads, (F.col("o_orderkey") % 4 + 1).cast("int"))
    return lines.withColumn("product_id", (F.col("o_orderkey") + F.col("line_no") * 7) % 200 + 1)
