"""Registered queries: samples, closure, synthesis, key inference, result parity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from tableproof.operators import results, sampling, synth
from tableproof.plans import mart_queries as marts
from tableproof.plans.pair import PAIR_SQL, build, source
from tableproof.plans.registry import query
from tableproof.session import fresh_path
from tableproof.sources.tables import read_table, snapshot_result
from tableproof.target import FK, SampleSpec

SEED = 42


def _sample_sql(table: str, keys: str, n: int) -> str:
    return f"SELECT * FROM {table} ORDER BY md5(concat_ws('|', {keys}, '{SEED}')) LIMIT {n}"


@query("seed_sample", _sample_sql("orders", "o_orderkey", 1000))
def seed_sample(spark, d):
    return sampling.seed_sample(read_table(spark, d, "orders"), ["o_orderkey"], 1000, SEED, digest="md5")


LINE_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
SPECS = (
    SampleSpec("lineitem", LINE_KEYS, (
        FK("l_orderkey", "orders", "o_orderkey"), FK("l_partkey", "part", "p_partkey"), FK("l_suppkey", "supplier", "s_suppkey"),
    ), 500),
    SampleSpec("orders", ("o_orderkey",), (FK("o_custkey", "customer", "c_custkey"),), 200),
    SampleSpec("customer", ("c_custkey",), (FK("c_nationkey", "nation", "n_nationkey"),), 50),
    SampleSpec("part", ("p_partkey",), (), 50),
    SampleSpec("supplier", ("s_suppkey",), (FK("s_nationkey", "nation", "n_nationkey"),), 10),
    SampleSpec("nation", ("n_nationkey",), (FK("n_regionkey", "region", "r_regionkey"),), 5, True),
    SampleSpec("region", ("r_regionkey",), (), 5, True),
)


def _estate(spark, d):
    return sampling.sample_estate({s.table: read_table(spark, d, s.table) for s in SPECS}, SPECS, SEED, digest="md5")


_CLOSED = f"""
sl AS ({_sample_sql('lineitem', ', '.join(LINE_KEYS), 500)}),
so AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM ({_sample_sql('orders', 'o_orderkey', 200)}))
       OR o_orderkey IN (SELECT l_orderkey FROM sl)),
sc AS (SELECT * FROM customer WHERE c_custkey IN (SELECT c_custkey FROM ({_sample_sql('customer', 'c_custkey', 50)}))
       OR c_custkey IN (SELECT o_custkey FROM so)),
sp AS (SELECT * FROM part WHERE p_partkey IN (SELECT p_partkey FROM ({_sample_sql('part', 'p_partkey', 50)}))
       OR p_partkey IN (SELECT l_partkey FROM sl)),
ss AS (SELECT * FROM supplier WHERE s_suppkey IN (SELECT s_suppkey FROM ({_sample_sql('supplier', 's_suppkey', 10)}))
       OR s_suppkey IN (SELECT l_suppkey FROM sl))"""


@query("fk_closure", f"""
WITH {_CLOSED}
SELECT 'orders' AS table_name, o_orderkey AS key FROM so UNION ALL SELECT 'customer', c_custkey FROM sc
UNION ALL SELECT 'part', p_partkey FROM sp UNION ALL SELECT 'supplier', s_suppkey FROM ss
UNION ALL SELECT 'nation', n_nationkey FROM nation
""")
def fk_closure(spark, d):
    closed, _ = _estate(spark, d)
    keys = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey"}
    return reduce(DataFrame.unionAll, [
        closed[t].select(F.lit(t).alias("table_name"), F.col(k).cast("bigint").alias("key")) for t, k in keys.items()
    ])


@query("sample_manifest", f"""
WITH {_CLOSED},
m AS (
  SELECT 'lineitem' AS table_name, 'sample' AS kind, '500' AS target_rows, (SELECT count(*) FROM sl) AS actual_rows, '{';'.join(LINE_KEYS)}' AS keys
  UNION ALL SELECT 'orders', 'sample', '200', (SELECT count(*) FROM so), 'o_orderkey'
  UNION ALL SELECT 'customer', 'sample', '50', (SELECT count(*) FROM sc), 'c_custkey'
  UNION ALL SELECT 'part', 'sample', '50', (SELECT count(*) FROM sp), 'p_partkey'
  UNION ALL SELECT 'supplier', 'sample', '10', (SELECT count(*) FROM ss), 's_suppkey'
  UNION ALL SELECT 'nation', 'reference_full', 'all', (SELECT count(*) FROM nation), 'n_nationkey'
  UNION ALL SELECT 'region', 'reference_full', 'all', (SELECT count(*) FROM region), 'r_regionkey'
)
SELECT *, CAST({SEED} AS INTEGER) AS seed, 'ri_preserving' AS sampling FROM m
""")
def sample_manifest(spark, d):
    return _estate(spark, d)[1]


# --- synthesis: schema and volume of the given tables ------------------------

_NATION = "n_nationkey INT, n_name STRING"
_CUSTOMER = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_since DATE, c_active BOOLEAN"
_ORDER = "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DECIMAL(18,2), o_orderdate DATE, o_priority INT"


def _specs(spark, d):
    rows = {t: read_table(spark, d, t).count() for t in ("nation", "customer", "orders")}
    layouts = (
        ("nation", _NATION, "n_nationkey", {}),
        ("customer", _CUSTOMER, "c_custkey", {"c_nationkey": "nation"}),
        ("orders", _ORDER, "o_orderkey", {"o_custkey": "customer"}),
    )
    return [synth.SynthSpec(t, T.StructType.fromDDL(ddl), rows[t], (pk,), fks) for t, ddl, pk, fks in layouts]


@query("synth_customers", """
SELECT i AS c_custkey, 'c_name_' || i AS c_name, CAST((i - 1) % (SELECT count(*) FROM nation) + 1 AS INTEGER) AS c_nationkey,
       CAST(i AS DOUBLE) AS c_acctbal, DATE '2024-01-01' + CAST(i % 365 AS INTEGER) AS c_since, i % 2 = 1 AS c_active
FROM (SELECT unnest(generate_series(1, (SELECT count(*) FROM customer))) AS i)
""")
def synth_customers(spark, d):
    return synth.synth_estate(spark, _specs(spark, d))["customer"]


@query("synth_orders_ri", """
SELECT i AS o_orderkey, (i - 1) % (SELECT count(*) FROM customer) + 1 AS o_custkey, CAST(i AS DECIMAL(18,2)) AS o_totalprice,
       DATE '2024-01-01' + CAST(i % 365 AS INTEGER) AS o_orderdate, CAST(i AS INTEGER) AS o_priority
FROM (SELECT unnest(generate_series(1, (SELECT count(*) FROM orders))) AS i)
""")
def synth_orders_ri(spark, d):
    return synth.synth_estate(spark, _specs(spark, d))["orders"]


@query("replication_manifest", """
SELECT object, 'table' AS kind, 'synthetic' AS fill, n AS planned_rows, n AS actual_rows, pk, fks, CAST(wave AS INTEGER) AS wave, true AS replicated
FROM (SELECT 'nation' AS object, (SELECT count(*) FROM nation) AS n, 'n_nationkey' AS pk, '' AS fks, 0 AS wave
      UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), 'c_custkey', 'c_nationkey->nation', 1
      UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), 'o_orderkey', 'o_custkey->customer', 2)
""")
def replication_manifest(spark, d):
    specs = _specs(spark, d)
    return synth.replication_manifest(synth.synth_estate(spark, specs), specs, {"nation": 0, "customer": 1, "orders": 2})


# --- key inference ----------------------------------------------------------

_KEYED = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                 "l_returnflag", "l_linestatus", "l_shipdate"],
}


@query("infer_keys", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(DISTINCT {c}) AS distinct_count, "
    f"count(*) - count({c}) AS null_count, count(DISTINCT {c}) = count(*) AS is_key FROM {t}"
    for t, cols in _KEYED.items() for c in cols
))
def infer_keys(spark, d):
    return reduce(DataFrame.unionAll, [
        sampling.infer_keys(read_table(spark, d, t)).select(F.lit(t).alias("table_name"), "*") for t in _KEYED
    ])


_ALIAS = {
    "l_orderkey": "o_orderkey", "l_partkey": "p_partkey", "l_suppkey": "s_suppkey", "o_custkey": "c_custkey",
    "user_id": "c_custkey", "c_nationkey": "n_nationkey", "s_nationkey": "n_nationkey",
}
_PKS = {"orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey", "customer": "c_custkey", "nation": "n_nationkey"}
_LINKS = (
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("events", "user_id", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
)


@query("infer_fks", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS child_table, '{f}' AS child_column, '{p}' AS parent_table, '{k}' AS parent_key, count({f}) AS child_rows, "
    f"count({f}) FILTER ({f} IN (SELECT {k} FROM {p})) AS resolved_rows, "
    f"count({f}) = count({f}) FILTER ({f} IN (SELECT {k} FROM {p})) AS is_fk FROM {c}"
    for c, f, p, k in _LINKS
))
def infer_fks(spark, d):
    names = ("lineitem", "orders", "events", "customer", "supplier", "part", "nation")
    return sampling.infer_fks({t: read_table(spark, d, t) for t in names}, _PKS, _ALIAS)


# --- result parity: a mart from the source and from the defective build ------

def _mart(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.col("o_orderdate").cast("date").alias("day"), "o_orderstatus").agg(
        F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("amount")
    )


def _marts(spark, d):
    return _mart(source(spark, d)), _mart(build(spark, d))


_MARTS = f"""
{PAIR_SQL},
o AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderstatus, count(*) AS n_orders, CAST(sum(o_totalprice) AS DECIMAL(28,2)) AS amount FROM s GROUP BY 1, 2),
n AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderstatus, count(*) AS n_orders, CAST(sum(o_totalprice) AS DECIMAL(28,2)) AS amount FROM b GROUP BY 1, 2)"""


@query("result_schema", f"""
WITH {_MARTS},
x AS (SELECT (SELECT count(*) FROM o) >= 0 AS t)
SELECT column_name, CAST(ord AS INTEGER) AS src_ordinal, typ AS src_type, CAST(ord AS INTEGER) AS build_ordinal, typ AS build_type, t AS passed
FROM x, (VALUES ('day', 1, 'date'), ('o_orderstatus', 2, 'string'), ('n_orders', 3, 'bigint'), ('amount', 4, 'decimal(28,2)')) v(column_name, ord, typ)
""")
def result_schema(spark, d):
    return results.result_schema(*_marts(spark, d))


@query("result_rowcount", f"""
WITH {_MARTS}
SELECT 'result' AS table_name, 'result_rowcount' AS check_name, a = c AS passed, CAST(a AS VARCHAR) AS src_value, CAST(c AS VARCHAR) AS build_value
FROM (SELECT (SELECT count(*) FROM o) AS a, (SELECT count(*) FROM n) AS c)
""")
def result_rowcount(spark, d):
    return results.result_rowcount(*_marts(spark, d))


@query("result_set_difference", f"""
WITH {_MARTS}
SELECT 'missing_in_new' AS tag, *, CAST(1 AS BIGINT) AS n_rows FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n)
UNION ALL SELECT 'extra_in_new', *, 1 FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o)
""")
def result_set_difference(spark, d):
    return results.result_set_difference(*_marts(spark, d))


@query("result_set_equality", f"""
WITH {_MARTS}
SELECT 'result' AS table_name, 'result_set_equality' AS check_name, a + c = 0 AS passed, CAST(a AS VARCHAR) AS src_value, CAST(c AS VARCHAR) AS build_value
FROM (SELECT (SELECT count(*) FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n)) AS a,
             (SELECT count(*) FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o)) AS c)
""")
def result_set_equality(spark, d):
    return results.result_set_equality(*_marts(spark, d))


@query("result_checksum", f"""
WITH {_MARTS}
SELECT 'result_checksum' AS check_name, NOT EXISTS (SELECT * FROM o EXCEPT ALL SELECT * FROM n) AND NOT EXISTS (SELECT * FROM n EXCEPT ALL SELECT * FROM o) AS passed
""")
def result_checksum(spark, d):
    return results.result_checksum(*_marts(spark, d)).select("check_name", "passed")


_ORDERING = ("amount DESC", "day", "o_orderstatus")


@query("result_order", f"""
WITH {_MARTS},
ro AS (SELECT *, row_number() OVER (ORDER BY {', '.join(_ORDERING)}) - 1 AS p FROM o),
rn AS (SELECT *, row_number() OVER (ORDER BY {', '.join(_ORDERING)}) - 1 AS p FROM n)
SELECT coalesce(ro.p, rn.p) AS position FROM ro FULL JOIN rn ON ro.p = rn.p
WHERE ro.p IS NULL OR rn.p IS NULL OR (ro.day, ro.o_orderstatus, ro.n_orders, ro.amount) IS DISTINCT FROM (rn.day, rn.o_orderstatus, rn.n_orders, rn.amount)
""")
def result_order(spark, d):
    return results.order_mismatches(*_marts(spark, d), [F.desc("amount"), "day", "o_orderstatus"]).select("position")


@query("row_positions", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS position FROM lineitem
""")
def row_positions(spark, d):
    li = read_table(spark, d, "lineitem").select(*LINE_KEYS)
    return results.with_positions(li, LINE_KEYS)


@query("result_parity_same", f"""
SELECT check_name, true AS passed
FROM (VALUES ('result_schema'), ('result_rowcount'), ('result_set_equality'), ('result_checksum'), ('result_order')) v(check_name)
WHERE (SELECT count(*) FROM ({marts._SERVING})) > 0
""")
def result_parity_same(spark, d):
    """A landed mart against the same query in another row order: every check must be green."""
    landed = snapshot_result(marts.serving(spark, d), fresh_path(spark, "original"))
    return results.result_parity(landed, marts.serving(spark, d).repartition("region"), ["net_amount", "cal_date", "region"]).select("check_name", "passed")
