"""Registered queries: keys of several columns, and inclusions found from values."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from tableproof.operators import inference
from tableproof.plans.registry import query
from tableproof.plans.sample_queries import _KEYED
from tableproof.sources.tables import read_table

_MOST = 3


def _sets(table: str):
    # Only lineitem has no key of one column, so only there SQL needs the larger sets.
    for size in range(1, _MOST + 1 if table == "lineitem" else 2):
        yield from combinations(_KEYED[table], size)


def _is_key(columns: tuple[str, ...]) -> str:
    whole = " AND ".join(f"count({c}) = count(*)" for c in columns)
    value = columns[0] if len(columns) == 1 else f"({', '.join(columns)})"
    return f"{whole} AND count(DISTINCT {value}) = count(*)"


@query("smallest_keys", "WITH s AS (\n" + "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{','.join(c)}' AS key_columns, {len(c)} AS n_columns, count(*) AS row_count, {_is_key(c)} AS ok FROM {t}"
    for t in _KEYED for c in _sets(t)
) + ")\nSELECT table_name, key_columns, n_columns, row_count FROM s WHERE ok QUALIFY n_columns = min(n_columns) OVER (PARTITION BY table_name)")
def smallest_keys(spark, d):
    return reduce(DataFrame.unionAll, [
        inference.smallest_keys(read_table(spark, d, t), _MOST).select(F.lit(t).alias("table_name"), "*") for t in _KEYED
    ])


_WHOLE = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "orders": ["o_orderkey", "o_custkey"], "events": ["event_id", "user_id"],
    "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey", "p_size"],
    "nation": ["n_nationkey", "n_regionkey"], "region": ["r_regionkey"],
}
_TEXT = {
    "lineitem": ["l_returnflag", "l_linestatus"], "orders": ["o_orderstatus", "o_orderpriority"], "events": ["event_type", "props"],
    "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"], "part": ["p_name", "p_brand", "p_type"], "nation": ["n_name"], "region": ["r_name"],
}


def _values(columns: dict[str, list[str]], cast: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS t, '{c}' AS c, CAST({c} AS {cast}) AS v, count(*) AS n FROM {t} GROUP BY 3" for t, cs in columns.items() for c in cs
    )


@query("inclusions", f"""
WITH whole AS ({_values(_WHOLE, 'BIGINT')}), txt AS ({_values(_TEXT, 'VARCHAR')}),
vals AS (SELECT 'w' AS f, t, c, CAST(v AS VARCHAR) AS v, n FROM whole UNION ALL SELECT 't', t, c, v, n FROM txt),
cols AS (SELECT t, c, count(v) AS distinct_count, sum(n) FILTER (v IS NOT NULL) AS filled, sum(n) AS n FROM vals GROUP BY 1, 2),
keys AS (SELECT t, c, distinct_count FROM cols WHERE distinct_count = n),
hits AS (SELECT a.t AS ct, a.c AS cc, b.t AS pt, b.c AS pc, count(*) AS n FROM vals a JOIN vals b ON a.f = b.f AND a.v = b.v
         WHERE (a.t, a.c) <> (b.t, b.c) GROUP BY 1, 2, 3, 4)
SELECT ct AS child_table, cc AS child_column, pt AS parent_table, pc AS parent_column, CAST(x.filled AS BIGINT) AS child_rows,
       x.distinct_count AS child_values, k.distinct_count AS parent_values
FROM hits h JOIN cols x ON x.t = ct AND x.c = cc JOIN keys k ON k.t = pt AND k.c = pc WHERE h.n = x.distinct_count
""")
def inclusions(spark, d):
    return inference.inclusions({t: read_table(spark, d, t).drop("ts", "o_orderdate", "l_shipdate") for t in _WHOLE})
