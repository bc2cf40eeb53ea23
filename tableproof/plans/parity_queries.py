"""Registered queries: table parity on ``orders`` against its defective build."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from tableproof.operators import diff, filters, parity
from tableproof.plans.pair import ORDERS, PAIR_SQL, PINNED, PREV, WATERMARK, build, source
from tableproof.plans.registry import query
from tableproof.sources.tables import read_table
from tableproof.target import FK, Target

_WM, _PREV = f"TIMESTAMP '{WATERMARK}'", f"TIMESTAMP '{PREV}'"


@query("row_count", f"""
WITH {PAIR_SQL}
SELECT 'orders' AS table_name, 'row_count' AS check_name, ns = nb AS passed,
       CAST(ns AS VARCHAR) AS src_value, CAST(nb AS VARCHAR) AS build_value
FROM (SELECT (SELECT count(*) FROM s WHERE o_orderdate <= {_WM}) AS ns,
             (SELECT count(*) FROM b WHERE o_orderdate <= {_WM}) AS nb)
""")
def row_count(spark, d):
    return parity.row_count(source(spark, d), build(spark, d), PINNED)


@query("partition_row_count", f"""
WITH {PAIR_SQL},
t AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS order_month, 1 AS side FROM s
      UNION ALL SELECT CAST(date_trunc('month', o_orderdate) AS DATE), -1 FROM b)
SELECT order_month, count(*) FILTER (side = 1) AS src_rows, count(*) FILTER (side = -1) AS build_rows,
       count(*) FILTER (side = 1) = count(*) FILTER (side = -1) AS passed
FROM t GROUP BY order_month
""")
def partition_row_count(spark, d):
    month = F.date_trunc("month", "o_orderdate").cast("date")
    s, b = (df.withColumn("order_month", month) for df in (source(spark, d), build(spark, d)))
    return parity.partition_row_count(s, b, ORDERS, ["order_month"])


@query("key_parity_rows", f"""
WITH {PAIR_SQL}
SELECT 'missing_in_build' AS side, o_orderkey FROM s WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)
UNION ALL
SELECT 'extra_in_build', o_orderkey FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s)
""")
def key_parity_rows(spark, d):
    return parity.key_parity_rows(source(spark, d), build(spark, d), ORDERS)


@query("key_parity", f"""
WITH {PAIR_SQL},
k AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT o_orderkey FROM s EXCEPT SELECT o_orderkey FROM b)) AS missing,
             (SELECT count(*) FROM (SELECT DISTINCT o_orderkey FROM b EXCEPT SELECT o_orderkey FROM s)) AS extra,
             (SELECT count(*) FROM (SELECT o_orderkey FROM s GROUP BY 1 HAVING count(*) > 1)) AS sd,
             (SELECT count(*) FROM (SELECT o_orderkey FROM b GROUP BY 1 HAVING count(*) > 1)) AS bd)
SELECT 'orders' AS table_name, 'key_parity' AS check_name, missing + extra + sd + bd = 0 AS passed,
       'missing=' || missing || ' dupes=' || sd AS src_value, 'extra=' || extra || ' dupes=' || bd AS build_value
FROM k
""")
def key_parity(spark, d):
    return parity.key_parity(source(spark, d), build(spark, d), ORDERS)


@query("duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
""")
def duplicate_keys(spark, d):
    return parity.duplicate_keys(read_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("content_checksum_flag", f"""
WITH {PAIR_SQL},
r AS (SELECT md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)) AS h, 1 AS n FROM s
      UNION ALL
      SELECT md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)), -1 FROM b)
SELECT 'orders' AS table_name, 'content_checksum' AS check_name,
       NOT EXISTS (SELECT 1 FROM r GROUP BY h HAVING sum(n) <> 0) AS passed,
       CAST((SELECT count(*) FROM s) AS VARCHAR) AS src_rows, CAST((SELECT count(*) FROM b) AS VARCHAR) AS build_rows
""")
def content_checksum_flag(spark, d):
    # The hash itself has no counterpart in SQL: verdict and row counts are compared.
    return parity.content_checksum(source(spark, d), build(spark, d), ORDERS).select(
        "table_name", "check_name", "passed",
        F.substring_index("src_value", ":", 1).alias("src_rows"),
        F.substring_index("build_value", ":", 1).alias("build_rows"),
    )


def _profile_sql(table: str, cols: list[tuple[str, str]], where: str = "") -> str:
    """One profile row per (column, kind); kind is num, dec2, ts or text."""
    shown = {
        "num": "CAST({x} AS VARCHAR)", "text": "{x}", "ts": "strftime({x}, '%Y-%m-%d %H:%M:%S.%f')",
        "dec2": "CAST({x} AS VARCHAR)", "dbl": "CAST(CAST({x} AS DECIMAL(30,6)) AS VARCHAR)",
    }
    total = {
        "num": "CAST(sum(CAST({c} AS DECIMAL(20,0))) AS VARCHAR)",
        "dec2": "CAST(sum({c}) AS VARCHAR)",
        "dbl": "CAST(sum(CAST({c} AS DECIMAL(30,6))) AS VARCHAR)",
        "text": "CAST(NULL AS VARCHAR)", "ts": "CAST(NULL AS VARCHAR)",
    }
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, count({c}) AS non_null, count(*) - count({c}) AS null_count, "
        f"{shown[k].format(x=f'min({c})')} AS min_value, {shown[k].format(x=f'max({c})')} AS max_value, "
        f"{total[k].format(c=c)} AS sum_value, "
        f"{f'count(*) FILTER (isnan({c}))' if k == 'dbl' else 'CAST(NULL AS BIGINT)'} AS nan_count, "
        f"{f'count(*) FILTER (isinf({c}))' if k == 'dbl' else 'CAST(NULL AS BIGINT)'} AS infinite_count, "
        f"count(DISTINCT {c}) AS distinct_count FROM {table} {where}"
        for c, k in cols
    )


_LINE_COLS = [
    ("l_orderkey", "num"), ("l_partkey", "num"), ("l_suppkey", "num"), ("l_linenumber", "num"), ("l_quantity", "dbl"),
    ("l_extendedprice", "dbl"), ("l_discount", "dbl"), ("l_tax", "dbl"), ("l_returnflag", "text"),
    ("l_linestatus", "text"), ("l_shipdate", "ts"),
]
_ORDER_COLS = [
    ("o_orderkey", "num"), ("o_custkey", "num"), ("o_orderstatus", "text"), ("o_totalprice", "dec2"),
    ("o_orderdate", "ts"), ("o_orderpriority", "text"),
]


@query("column_profile", _profile_sql("lineitem", _LINE_COLS))
def column_profile(spark, d):
    return parity.column_profile(read_table(spark, d, "lineitem"))


def _side_by_side(columns: str) -> str:
    return f"""
WITH {PAIR_SQL},
ps AS ({_profile_sql('s', _ORDER_COLS)}),
pb AS ({_profile_sql('b', _ORDER_COLS)})
SELECT {columns} FROM ps JOIN pb ON ps.column_name = pb.column_name
"""


@query("column_aggregates", _side_by_side("""
       ps.column_name, ps.distinct_count AS src_distinct_count, pb.distinct_count AS build_distinct_count,
       ps.min_value AS src_min_value, pb.min_value AS build_min_value, ps.max_value AS src_max_value,
       pb.max_value AS build_max_value, ps.sum_value AS src_sum_value, pb.sum_value AS build_sum_value,
       ps.non_null = pb.non_null AND ps.distinct_count = pb.distinct_count
         AND ps.min_value = pb.min_value AND ps.max_value = pb.max_value
         AND ps.sum_value IS NOT DISTINCT FROM pb.sum_value AS aggregates_ok"""))
def column_aggregates(spark, d):
    rows = parity.column_parity_rows(source(spark, d), build(spark, d), ORDERS)
    return rows.select("column_name", *[
        f"{side}_{x}" for x in ("distinct_count", "min_value", "max_value", "sum_value") for side in ("src", "build")
    ], "aggregates_ok")


_DOUBLES = ("same", "tiny", "nan", "huge", "swapped")


@query("column_aggregates_doubles", "WITH " + """
n AS (SELECT event_id, value AS same, value AS tiny, CASE WHEN event_id % 50 = 0 THEN CAST('nan' AS DOUBLE) ELSE value END AS nan,
             CASE WHEN event_id % 50 = 1 THEN 1e30 ELSE value END AS huge, CASE WHEN event_id % 2 = 0 THEN value ELSE -value END AS swapped FROM events),
m AS (SELECT event_id, value AS same, CASE WHEN event_id % 50 = 2 THEN value + 1e-7 ELSE value END AS tiny,
             CASE WHEN event_id % 50 = 0 THEN CAST('inf' AS DOUBLE) ELSE value END AS nan,
             CASE WHEN event_id % 50 = 1 THEN 2e30 ELSE value END AS huge, CASE WHEN event_id % 2 = 0 THEN value ELSE -value END AS swapped FROM events)
""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, NOT EXISTS (SELECT 1 FROM (SELECT {c} AS v, 1 AS g FROM n UNION ALL SELECT {c}, -1 FROM m) GROUP BY v HAVING sum(g) <> 0) AS aggregates_ok"
    for c in _DOUBLES
))
def column_aggregates_doubles(spark, d):
    """Doubles with NaN against infinity, values no decimal holds, and drift in the seventh decimal."""
    v, at = F.col("value"), F.col("event_id") % 50
    swapped = F.when(F.col("event_id") % 2 == 0, v).otherwise(-v)

    def side(tiny, odd: str, huge: float) -> DataFrame:
        return read_table(spark, d, "events").select(
            "event_id", v.alias("same"), tiny.alias("tiny"), F.when(at == 0, F.lit(float(odd))).otherwise(v).alias("nan"),
            F.when(at == 1, F.lit(huge)).otherwise(v).alias("huge"), swapped.alias("swapped"),
        )

    rows = parity.column_parity_rows(
        side(v, "nan", 1e30), side(F.when(at == 2, v + F.lit(1e-7)).otherwise(v), "inf", 2e30), Target("events", ("event_id",), _DOUBLES)
    )
    return rows.select("column_name", "aggregates_ok")


_NULLABLE = """
n AS (SELECT event_id, user_id, CASE WHEN value < 100 THEN value END AS value FROM events),
m AS (SELECT event_id, user_id, CASE WHEN value < 90 THEN value END AS value FROM events)"""


@query("null_distribution", f"""
WITH {_NULLABLE},
ps AS ({_profile_sql('n', [('event_id', 'num'), ('user_id', 'num'), ('value', 'dbl')])}),
pb AS ({_profile_sql('m', [('event_id', 'num'), ('user_id', 'num'), ('value', 'dbl')])})
SELECT ps.column_name, ps.null_count AS src_null_count, pb.null_count AS build_null_count,
       ps.null_count = pb.null_count AND ps.distinct_count = pb.distinct_count AS nulls_ok
FROM ps JOIN pb ON ps.column_name = pb.column_name
""")
def null_distribution(spark, d):
    ev = read_table(spark, d, "events")
    n, m = (ev.select("event_id", "user_id", F.when(F.col("value") < top, F.col("value")).alias("value")) for top in (100, 90))
    return parity.column_parity_rows(n, m, Target("events", ("event_id",))).select(
        "column_name", "src_null_count", "build_null_count", "nulls_ok"
    )


_WEAK_PARENT = "SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'"


@query("ri_orphans", f"""
SELECT l_orderkey AS fk_value, count(*) AS n_rows FROM lineitem
WHERE l_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ({_WEAK_PARENT}) p WHERE p.o_orderkey = l_orderkey)
GROUP BY l_orderkey
""")
def ri_orphans(spark, d):
    parent = read_table(spark, d, "orders").where("o_orderdate < TIMESTAMP_NTZ '2000-01-01'")
    return parity.orphans(read_table(spark, d, "lineitem"), parent, FK("l_orderkey", "orders", "o_orderkey"))


@query("referential_integrity", f"""
WITH o AS (SELECT l_orderkey AS v, count(*) AS n FROM lineitem
           WHERE l_orderkey NOT IN (SELECT o_orderkey FROM ({_WEAK_PARENT}) p) GROUP BY 1),
     p AS (SELECT l_partkey AS v, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) GROUP BY 1),
     a AS (SELECT * FROM o UNION ALL SELECT * FROM p)
SELECT 'lineitem' AS table_name, 'referential_integrity' AS check_name, count(*) = 0 AS passed, '0' AS src_value,
       'orphan_values=' || count(*) || ' orphan_rows=' || CAST(coalesce(sum(n), 0) AS BIGINT) AS build_value
FROM a
""")
def referential_integrity(spark, d):
    parents = {
        "orders": read_table(spark, d, "orders").where("o_orderdate < TIMESTAMP_NTZ '2000-01-01'"),
        "part": read_table(spark, d, "part"),
    }
    fks = [FK("l_orderkey", "orders", "o_orderkey"), FK("l_partkey", "part", "p_partkey")]
    return parity.referential_integrity(read_table(spark, d, "lineitem"), parents, fks, Target("lineitem"))



def _schema_sql() -> str:
    """Observed schema of source and build, the build with two columns swapped and the price as text."""
    src = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "decimal(18,2)"),
           ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]
    bld = [("o_orderkey", "bigint"), ("o_orderstatus", "string"), ("o_custkey", "bigint"), ("o_totalprice", "string"),
           ("o_orderdate", "timestamp_ntz"), ("o_comment", "string")]

    def rows(cols, table, p):
        return " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, {i + 1} AS {p}_ordinal, '{t}' AS {p}_type, "
            f"count(*) > count({c}) AS {p}_has_nulls, "
            + (f"CAST(max(length(CAST({c} AS VARCHAR))) AS INTEGER)" if t.startswith(("string", "decimal")) else "CAST(NULL AS INTEGER)")
            + f" AS {p}_width FROM {table}"
            for i, (c, t) in enumerate(cols)
        )

    return f"""
WITH {PAIR_SQL},
b2 AS (SELECT o_orderkey, o_orderstatus, o_custkey, CAST(o_totalprice AS VARCHAR) AS o_totalprice, o_orderdate,
              CASE WHEN o_orderstatus = 'X' THEN o_orderpriority END AS o_comment FROM b),
x AS ({rows(src, 's', 'src')}),
y AS ({rows(bld, 'b2', 'build')})
SELECT coalesce(x.column_name, y.column_name) AS column_name, src_ordinal, src_type, src_has_nulls, src_width,
       build_ordinal, build_type, build_has_nulls, build_width,
       src_ordinal IS NOT DISTINCT FROM build_ordinal AND src_type IS NOT DISTINCT FROM build_type
         AND src_has_nulls IS NOT DISTINCT FROM build_has_nulls AND src_width IS NOT DISTINCT FROM build_width AS passed
FROM x FULL JOIN y ON x.column_name = y.column_name
"""


def _drifted(spark, d):
    return build(spark, d).select(
        "o_orderkey", "o_orderstatus", "o_custkey", F.col("o_totalprice").cast("string").alias("o_totalprice"), "o_orderdate",
        F.when(F.col("o_orderstatus") == "X", F.col("o_orderpriority")).alias("o_comment"),
    )


@query("schema_parity", _schema_sql())
def schema_parity(spark, d):
    return parity.schema_parity_rows(source(spark, d), _drifted(spark, d), ORDERS)


@query("no_extra_output", f"""
WITH {PAIR_SQL}
SELECT 'o_comment' AS column_name, 'extra' AS problem, count(CASE WHEN o_orderstatus = 'X' THEN o_orderpriority END) AS non_null FROM b
UNION ALL SELECT 'o_orderpriority', 'missing', 0
""")
def no_extra_output(spark, d):
    return parity.extra_output_rows(_drifted(spark, d), source(spark, d).columns)


@query("idempotency", f"""
WITH {PAIR_SQL}
SELECT 'orders' AS table_name, 'idempotency' AS check_name, true AS passed,
       CAST(count(*) AS VARCHAR) AS src_rows, CAST(count(*) AS VARCHAR) AS build_rows FROM b
""")
def idempotency(spark, d):
    return parity.idempotency(lambda: build(spark, d), ORDERS).select(
        "table_name", "check_name", "passed",
        F.substring_index("src_value", ":", 1).alias("src_rows"), F.substring_index("build_value", ":", 1).alias("build_rows"),
    )


# The pair has one row per key, so a full join on the key shows every difference.
_DIFF_SQL = f"""
{PAIR_SQL},
j AS (
  SELECT coalesce(s.o_orderkey, b.o_orderkey) AS o_orderkey, s.o_orderkey IS NOT NULL AS in_s, b.o_orderkey IS NOT NULL AS in_b,
         s.o_custkey AS sc, b.o_custkey AS bc, s.o_orderstatus AS ss, b.o_orderstatus AS bs, s.o_totalprice AS sp, b.o_totalprice AS bp,
         s.o_orderdate AS sd, b.o_orderdate AS bd, s.o_orderpriority AS sq, b.o_orderpriority AS bq
  FROM s FULL JOIN b ON s.o_orderkey = b.o_orderkey
),
cells AS (
  SELECT o_orderkey, 'changed' AS change, CAST(1 AS BIGINT) AS n_rows, 'o_orderstatus' AS column_name, ss AS src_value, bs AS build_value
  FROM j WHERE in_s AND in_b AND ss IS DISTINCT FROM bs
  UNION ALL
  SELECT o_orderkey, 'changed', 1, 'o_totalprice', CAST(sp AS VARCHAR), CAST(bp AS VARCHAR)
  FROM j WHERE in_s AND in_b AND sp IS DISTINCT FROM bp
  UNION ALL
  SELECT o_orderkey, 'missing_in_build', 1, '*', NULL, NULL FROM j WHERE NOT in_b
  UNION ALL
  SELECT o_orderkey, 'extra_in_build', 1, '*', NULL, NULL FROM j WHERE NOT in_s
)"""


@query("row_diff", f"""
WITH {_DIFF_SQL}
SELECT o_orderkey, CASE WHEN NOT in_b THEN 'missing_in_build' WHEN NOT in_s THEN 'extra_in_build' ELSE 'changed' END AS change,
       CAST(1 AS BIGINT) AS n_rows, ss AS src_status, bs AS build_status, sp AS src_price, bp AS build_price
FROM j WHERE NOT in_s OR NOT in_b OR ss IS DISTINCT FROM bs OR sp IS DISTINCT FROM bp
""")
def row_diff(spark, d):
    return diff.row_diff(source(spark, d), build(spark, d), ORDERS).select(
        "o_orderkey", "change", "n_rows",
        F.col("src.o_orderstatus").alias("src_status"), F.col("build.o_orderstatus").alias("build_status"),
        F.col("src.o_totalprice").alias("src_price"), F.col("build.o_totalprice").alias("build_price"),
    )


@query("column_diff", f"WITH {_DIFF_SQL} SELECT o_orderkey, change, n_rows, column_name, src_value, build_value FROM cells")
def column_diff(spark, d):
    return diff.column_diff(source(spark, d), build(spark, d), ORDERS)


@query("row_level_sample", f"""
WITH {_DIFF_SQL}
SELECT o_orderkey, change, n_rows, column_name, src_value, build_value FROM cells
ORDER BY o_orderkey, column_name, change LIMIT 100
""")
def row_level_sample(spark, d):
    return diff.row_level_sample(source(spark, d), build(spark, d), ORDERS)


@query("row_diff_repeated_keys", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem),
     b AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linestatus = 'F' THEN 'Z' ELSE l_returnflag END AS l_returnflag FROM lineitem),
     d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, sum(g) AS net
           FROM (SELECT *, 1 AS g FROM s UNION ALL SELECT *, -1 FROM b)
           GROUP BY ALL HAVING sum(g) <> 0),
     k AS (SELECT l_orderkey, l_linenumber, count(*) FILTER (net > 0) = 1 AND count(*) FILTER (net < 0) = 1 AND sum(abs(net)) = 2 AS one
           FROM d GROUP BY ALL)
SELECT d.l_orderkey, d.l_linenumber, 'changed' AS change, CAST(1 AS BIGINT) AS n_rows,
       max(l_returnflag) FILTER (net > 0) AS src_flag, max(l_returnflag) FILTER (net < 0) AS build_flag
FROM d JOIN k USING (l_orderkey, l_linenumber) WHERE one GROUP BY d.l_orderkey, d.l_linenumber
UNION ALL
SELECT d.l_orderkey, d.l_linenumber, CASE WHEN net > 0 THEN 'missing_in_build' ELSE 'extra_in_build' END, CAST(abs(net) AS BIGINT),
       CASE WHEN net > 0 THEN l_returnflag END, CASE WHEN net < 0 THEN l_returnflag END
FROM d JOIN k USING (l_orderkey, l_linenumber) WHERE NOT one
""")
def row_diff_repeated_keys(spark, d):
    li = read_table(spark, d, "lineitem")
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"]
    b = li.withColumn("l_returnflag", F.when(F.col("l_linestatus") == "F", "Z").otherwise(F.col("l_returnflag")))
    t = Target("lineitem", ("l_orderkey", "l_linenumber"), tuple(cols))
    return diff.row_diff(li.select(cols), b.select(cols), t).select(
        "l_orderkey", "l_linenumber", "change", "n_rows",
        F.col("src.l_returnflag").alias("src_flag"), F.col("build.l_returnflag").alias("build_flag"),
    )


@query("soak_delta", f"""
WITH {PAIR_SQL},
x AS (SELECT count(*) AS n FROM s WHERE o_orderdate > {_PREV} AND o_orderdate <= {_WM}),
y AS (SELECT count(*) AS n FROM b WHERE o_orderdate > {_PREV} AND o_orderdate <= {_WM}),
r AS (SELECT md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)) AS h, 1 AS g, o_orderdate FROM s
      UNION ALL
      SELECT md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)), -1, o_orderdate FROM b)
SELECT 'orders' AS table_name, 'soak_delta_parity' AS check_name,
       NOT EXISTS (SELECT 1 FROM r WHERE o_orderdate > {_PREV} AND o_orderdate <= {_WM} GROUP BY h HAVING sum(g) <> 0) AS passed,
       CAST(x.n AS VARCHAR) AS src_rows, CAST(y.n AS VARCHAR) AS build_rows FROM x, y
""")
def soak_delta(spark, d):
    return parity.soak_delta_parity(source(spark, d), build(spark, d), PINNED).select(
        "table_name", "check_name", "passed",
        F.substring_index("src_value", ":", 1).alias("src_rows"), F.substring_index("build_value", ":", 1).alias("build_rows"),
    )


@query("soak_schedule", """
SELECT o_custkey AS unit, CAST(max(o_orderdate) AS DATE) AS certified_on, d AS days_after_cert, 'T+' || d AS checkpoint,
       CAST(max(o_orderdate) AS DATE) + CAST(d AS INTEGER) AS due_date
FROM orders, (VALUES (7), (14)) v(d) GROUP BY o_custkey, d
""")
def soak_schedule(spark, d):
    units = read_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("unit")).agg(
        F.max("o_orderdate").cast("date").alias("certified_on")
    )
    return parity.soak_schedule(units, "certified_on")


@query("drift_tolerance", f"""
WITH {PAIR_SQL},
j AS (SELECT s.o_orderpriority, s.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR s.o_totalprice IS DISTINCT FROM b.o_totalprice AS drift
      FROM s LEFT JOIN b ON s.o_orderkey = b.o_orderkey)
SELECT o_orderpriority, count(*) AS total_rows, count(*) FILTER (drift) AS drift_rows,
       CAST(count(*) FILTER (drift) AS DOUBLE) / count(*) <= 0.03 AS within
FROM j GROUP BY o_orderpriority
""")
def drift_tolerance(spark, d):
    drift = diff.row_diff(source(spark, d), build(spark, d), ORDERS).where("change <> 'extra_in_build'")
    bad = drift.groupBy(F.col("src.o_orderpriority").alias("o_orderpriority")).agg(F.sum("n_rows").alias("drift_rows"))
    total = source(spark, d).groupBy("o_orderpriority").agg(F.count("*").alias("total_rows"))
    counts = total.join(bad, "o_orderpriority", "left").na.fill(0, ["drift_rows"])
    return parity.within_tolerance(counts, "drift_rows", "total_rows", 0.03).drop("drift_fraction")


@query("drift_reason", f"""
WITH {_DIFF_SQL},
e AS (SELECT c.*, coalesce(j.sd, j.bd) AS event_time FROM cells c JOIN j ON c.o_orderkey = j.o_orderkey)
SELECT o_orderkey, change, column_name,
       CASE WHEN o_orderkey % 303 = 0 AND column_name = 'o_orderstatus' THEN 'LEGACY-BUG'
            WHEN change = 'changed' AND lower(trim(src_value)) = lower(trim(build_value)) THEN 'TYPE-NUANCE'
            WHEN change <> 'changed' AND event_time <= {_PREV} THEN 'LATE-DATA'
            WHEN change <> 'changed' AND event_time >= {_WM} - INTERVAL 30 DAY THEN 'TIMING'
            WHEN event_time > {_PREV} THEN 'INCREMENTAL-LOGIC'
            ELSE 'TRANSLATION' END AS reason_code
FROM e
""")
def drift_reason(spark, d):
    s, b = source(spark, d), build(spark, d)
    cells = diff.column_diff(s, b, ORDERS)
    times = s.select("o_orderkey", F.col("o_orderdate").alias("event_time")).unionAll(
        b.select("o_orderkey", F.col("o_orderdate").alias("event_time"))
    ).groupBy("o_orderkey").agg(F.min("event_time").alias("event_time"))
    waived = s.where(F.col("o_orderkey") % 303 == 0).select(
        "o_orderkey", F.lit("o_orderstatus").alias("column_name"), F.lit("LEGACY-BUG").alias("reason_code")
    )
    return diff.drift_reason(
        cells.join(times, "o_orderkey"), PINNED, "event_time", edge="30 days", waivers=waived
    ).select("o_orderkey", "change", "column_name", "reason_code")


_PROFILE_FK = [FK("o_custkey", "customer", "c_custkey")]


def _profile(spark, d, env):
    return parity.run_profile(
        env, source(spark, d), build(spark, d), PINNED if env == "soak" else ORDERS,
        parents={"customer": read_table(spark, d, "customer")}, fks=_PROFILE_FK, rebuild=lambda: build(spark, d),
    ).select("table_name", "check_name", "passed")


def _verdicts(rows: dict[str, str]) -> str:
    """Verdicts that the oracle works out from the data, one scalar query each."""
    return f"WITH {PAIR_SQL}\n" + "\nUNION ALL\n".join(
        f"SELECT 'orders' AS table_name, '{check}' AS check_name, {test} AS passed" for check, test in rows.items()
    )


def _bag_equal(cols: str, where: str = "") -> str:
    return (f"NOT EXISTS (SELECT 1 FROM (SELECT {cols}, 1 AS g FROM s {where} UNION ALL SELECT {cols}, -1 FROM b {where}) "
            f"GROUP BY {cols} HAVING sum(g) <> 0)")


def _profile_verdicts(where: str, soak: bool) -> dict[str, str]:
    every = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
    counts = " AND ".join(
        f"(SELECT count(DISTINCT {c}) FROM s {where}) = (SELECT count(DISTINCT {c}) FROM b {where}) "
        f"AND (SELECT count({c}) FROM s {where}) = (SELECT count({c}) FROM b {where})" for c in every.split(", ")
    )
    sums = "(SELECT sum(o_totalprice) FROM s {w}) = (SELECT sum(o_totalprice) FROM b {w})".replace("{w}", where)
    width = " AND ".join(
        f"(SELECT max(length(CAST({c} AS VARCHAR))) FROM s {where}) = (SELECT max(length(CAST({c} AS VARCHAR))) FROM b {where})"
        for c in ("o_orderstatus", "o_totalprice", "o_orderpriority")
    )
    out = {
        "schema_parity": width,
        "row_count": f"(SELECT count(*) FROM s {where}) = (SELECT count(*) FROM b {where})",
        "content_checksum": _bag_equal(every, where),
        "column_aggregates": f"{counts} AND {sums}",
        "null_distribution": counts,
        "key_parity": _bag_equal("o_orderkey", where),
        "referential_integrity": f"NOT EXISTS (SELECT 1 FROM (SELECT * FROM b {where}) x WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))",
        "no_extra_output": "true",
        "idempotency": "true",
        "row_level_sample": _bag_equal(every, where),
    }
    if soak:
        out["soak_delta_parity"] = _bag_equal(every, f"WHERE o_orderdate > {_PREV} AND o_orderdate <= {_WM}")
    return out


_DEV = _profile_verdicts("", False)


@query("run_profile_dev", _verdicts({c: _DEV[c] for c in parity.SAMPLE_CHECKS}))
def run_profile_dev(spark, d):
    return _profile(spark, d, "dev")


@query("run_profile_sit", _verdicts(_DEV))
def run_profile_sit(spark, d):
    return _profile(spark, d, "sit")


@query("run_profile_soak", _verdicts(_profile_verdicts(f"WHERE o_orderdate <= {_WM}", True)))
def run_profile_soak(spark, d):
    return _profile(spark, d, "soak")


_LINES = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_LINE_PAIR = f"""
ls AS (SELECT {_LINES} FROM lineitem),
lb AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_partkey % 53 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity,
              l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
       FROM lineitem WHERE l_orderkey % 89 <> 0
       UNION ALL SELECT * FROM ls WHERE l_orderkey % 83 = 0),
ld AS (SELECT {_LINES}, sum(g) AS net FROM (SELECT *, 1 AS g FROM ls UNION ALL SELECT *, -1 FROM lb) GROUP BY {_LINES} HAVING sum(g) <> 0)"""


def _lines(spark, d) -> tuple[DataFrame, DataFrame]:
    """``lineitem``, which has no key, and a build with rows lost, repeated and changed."""
    s = read_table(spark, d, "lineitem")
    quantity = F.when(F.col("l_partkey") % 53 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    b = s.where(F.col("l_orderkey") % 89 != 0).withColumn("l_quantity", quantity)
    return s, b.unionByName(s.where(F.col("l_orderkey") % 83 == 0))


@query("row_diff_keyless", f"""
WITH {_LINE_PAIR}
SELECT CASE WHEN net > 0 THEN 'missing_in_build' ELSE 'extra_in_build' END AS change, CAST(abs(net) AS BIGINT) AS n_rows,
       l_orderkey, l_partkey, l_linenumber, l_quantity, l_shipdate FROM ld
""")
def row_diff_keyless(spark, d):
    out = diff.row_diff(*_lines(spark, d), Target("lineitem"))
    return out.select("change", "n_rows", *[
        F.coalesce(f"src.{c}", f"build.{c}").alias(c) for c in ("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate")
    ])


@query("key_parity_keyless", f"""
WITH {_LINE_PAIR}
SELECT 'missing_in_build' AS side, l_orderkey, l_linenumber, l_quantity FROM (SELECT * FROM ls EXCEPT SELECT * FROM lb)
UNION ALL SELECT 'extra_in_build', l_orderkey, l_linenumber, l_quantity FROM (SELECT * FROM lb EXCEPT SELECT * FROM ls)
""")
def key_parity_keyless(spark, d):
    return parity.key_parity_rows(*_lines(spark, d), Target("lineitem")).select("side", "l_orderkey", "l_linenumber", "l_quantity")


@query("run_profile_keyless", f"""
WITH {_LINE_PAIR}, v(check_name, passed) AS (VALUES
  ('schema_parity', true), ('row_count', (SELECT count(*) FROM ls) = (SELECT count(*) FROM lb) AND NOT EXISTS (
     SELECT 1 FROM (SELECT l_returnflag, 1 AS g FROM ls UNION ALL SELECT l_returnflag, -1 FROM lb) GROUP BY 1 HAVING sum(g) <> 0)),
  ('key_parity', NOT EXISTS (SELECT * FROM ls EXCEPT SELECT * FROM lb) AND NOT EXISTS (SELECT * FROM lb EXCEPT SELECT * FROM ls)),
  ('content_checksum', NOT EXISTS (SELECT 1 FROM ld)), ('column_aggregates', (SELECT count(*) FROM ls) = (SELECT count(*) FROM lb)),
  ('null_distribution', {" AND ".join(f"(SELECT count(DISTINCT {c}) FROM ls) = (SELECT count(DISTINCT {c}) FROM lb)" for c in _LINES.split(", "))}),
  ('referential_integrity', true), ('no_extra_output', true), ('idempotency', false), ('row_level_sample', NOT EXISTS (SELECT 1 FROM ld)))
SELECT 'lineitem' AS table_name, check_name, passed FROM v
""")
def run_profile_keyless(spark, d):
    """Ten rows for a table without key and foreign keys; the build is not repeated, so idempotency is not shown."""
    return parity.run_profile("sit", *_lines(spark, d), Target("lineitem"), part_cols=["l_returnflag"]).select("table_name", "check_name", "passed")


# --- pinning, conforming, keys ----------------------------------------------

@query("as_of", f"SELECT * FROM orders WHERE o_orderdate <= {_WM}")
def as_of(spark, d):
    return filters.as_of(read_table(spark, d, "orders"), "o_orderdate", WATERMARK)


@query("delta_window", f"SELECT * FROM orders WHERE o_orderdate > {_PREV} AND o_orderdate <= {_WM}")
def delta_window(spark, d):
    return filters.delta_window(read_table(spark, d, "orders"), "o_orderdate", PREV, WATERMARK)


@query("conform", """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CAST(p_retailprice AS DECIMAL(18,2)) AS p_retailprice,
       CAST(p_size AS BIGINT) AS p_size, p_brand FROM part
""")
def conform(spark, d):
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL("p_partkey STRING, p_retailprice DECIMAL(18,2), p_size BIGINT, p_brand STRING")
    return filters.conform(read_table(spark, d, "part"), schema)


@query("surrogate_key", """
WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS a, CASE WHEN c_acctbal < 0 THEN c_mktsegment END AS b FROM customer)
SELECT c_custkey, md5(length(CAST(c_custkey AS VARCHAR)) || ':' || c_custkey || '|' || CASE WHEN a IS NULL THEN '-' ELSE length(a) || ':' || a END
                      || '|' || CASE WHEN b IS NULL THEN '-' ELSE length(b) || ':' || b END) AS customer_key FROM c
""")
def surrogate_key(spark, d):
    """A three-column key in which nulls change places."""
    c = read_table(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("a"), F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")).alias("b")
    )
    return c.select("c_custkey", filters.surrogate_key(["c_custkey", "a", "b"], "md5").alias("customer_key"))


@query("late_rows", """
SELECT l_orderkey, l_linenumber, l_shipdate, o_orderdate
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate + INTERVAL 60 DAY
""")
def late_rows(spark, d):
    both = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(
        read_table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")
    ).drop("o_orderkey")
    return filters.late_rows(both, "o_orderdate", "l_shipdate", "60 days")


@query("purge_expired", """
SELECT event_type, count(*) FILTER (ts > TIMESTAMP '2024-01-21') AS kept, count(*) FILTER (ts <= TIMESTAMP '2024-01-21') AS purged,
       count(*) FILTER (ts IS NULL) AS undated
FROM events GROUP BY event_type
""")
def purge_expired(spark, d):
    from tableproof.operators.merge import purge_report

    return purge_report(read_table(spark, d, "events"), "ts", 10, dt.datetime(2024, 1, 31), "event_type")


def flagship(spark, d):
    """All ten checks on the pair."""
    return parity.run_profile(
        "sit", source(spark, d), build(spark, d), ORDERS, parents={"customer": read_table(spark, d, "customer")},
        fks=_PROFILE_FK, rebuild=lambda: build(spark, d),
    )


