"""Registered queries: checkpoints of the order pair from stored hash trees."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tableproof.operators import hashtree
from tableproof.plans.pair import PAIR_SQL, PINNED, PREV, WATERMARK, build, source
from tableproof.plans.registry import query
from tableproof.session import fresh_path

_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
_FIRST = replace(PINNED, watermark=PREV, prev_watermark=None)


def _at(checkpoint: str, moment) -> str:
    s, b = (f"SELECT * FROM {side} WHERE o_orderdate <= TIMESTAMP '{moment}'" for side in "sb")
    return f"""
SELECT '{checkpoint}' AS checkpoint, 'orders' AS table_name, 'content_checksum' AS check_name,
       NOT EXISTS ({s} EXCEPT ALL {b}) AND NOT EXISTS ({b} EXCEPT ALL {s}) AS passed,
       CAST((SELECT count(*) FROM ({s})) AS VARCHAR) AS src_rows, CAST((SELECT count(*) FROM ({b})) AS VARCHAR) AS build_rows"""


def _verdict(trees, checkpoint: str):
    return hashtree.tree_checksum(trees, PINNED).select(
        F.lit(checkpoint).alias("checkpoint"), "table_name", "check_name", "passed",
        F.substring_index("src_value", ":", 1).alias("src_rows"), F.substring_index("build_value", ":", 1).alias("build_rows"),
    )


def _trees(spark, d, defective: bool = True):
    """Trees at the earlier watermark, then grown by what came up to the later one."""
    s, b = source(spark, d), build(spark, d) if defective else source(spark, d)
    trees = hashtree.open_trees(spark, fresh_path(spark, "hash-tree"), s, b, PINNED)
    hashtree.checkpoint(s, b, _FIRST, trees, "certified")
    # Written verdicts stay as they were when the trees grow on.
    first = _verdict(trees, "certified").collect()
    hashtree.checkpoint(s, b, PINNED, trees, "soak")
    return s, b, trees, first


@query("hash_tree_checkpoints", f"WITH {PAIR_SQL} {_at('certified', PREV)} UNION ALL {_at('soak', WATERMARK)}")
def hash_tree_checkpoints(spark, d):
    _, _, trees, first = _trees(spark, d)
    later = _verdict(trees, "soak")
    return spark.createDataFrame(first, later.schema).unionAll(later)


@query("hash_tree_differences", f"""
WITH {PAIR_SQL},
x AS (SELECT * FROM s WHERE o_orderdate <= TIMESTAMP '{WATERMARK}'), y AS (SELECT * FROM b WHERE o_orderdate <= TIMESTAMP '{WATERMARK}')
SELECT {', '.join(_COLUMNS)}, CAST(sum(g) AS BIGINT) AS net FROM (SELECT *, 1 AS g FROM x UNION ALL SELECT *, -1 FROM y) GROUP BY ALL HAVING sum(g) <> 0
""")
def hash_tree_differences(spark, d):
    s, b, trees, _ = _trees(spark, d)
    return hashtree.tree_differences(trees, s, b, PINNED)
