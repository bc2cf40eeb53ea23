"""The table pair of the parity queries: ``orders`` and a build with seeded defects.

The build is the whole of ``orders`` with known defects planted by key: some rows are
left out, some statuses and prices are changed, some rows are added under new keys.
Both sides always cover the whole table; the key rules only place the defects.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from tableproof.functions.money import dec
from tableproof.sources.tables import read_table
from tableproof.target import Target

EXTRA_KEY_OFFSET = 10_000_000

ORDERS = Target("orders", keys=("o_orderkey",))
PREV = dt.datetime(1998, 1, 1)
WATERMARK = dt.datetime(2000, 6, 30)
PINNED = Target("orders", keys=("o_orderkey",), watermark_col="o_orderdate", watermark=WATERMARK, prev_watermark=PREV)


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").withColumn("o_totalprice", dec("o_totalprice", 18))


def build(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    src = source(spark, sf_dir)
    price = F.when(key % 103 == 0, F.col("o_totalprice") + F.lit("0.01").cast("decimal(3,2)")).otherwise(F.col("o_totalprice"))
    changed = src.where(key % 97 != 0).withColumns({
        "o_orderstatus": F.when(key % 101 == 0, "X").otherwise(F.col("o_orderstatus")),
        "o_totalprice": price.cast("decimal(18,2)"),
    })
    added = src.where(key % 107 == 0).withColumn("o_orderkey", key + EXTRA_KEY_OFFSET)
    return changed.unionByName(added)


# The same pair as common table expressions s (source) and b (build).
PAIR_SQL = f"""
s AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice,
         o_orderdate, o_orderpriority
  FROM orders
),
b AS (
  SELECT o_orderkey, o_custkey,
         CASE WHEN o_orderkey % 101 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
         CAST(o_totalprice + CASE WHEN o_orderkey % 103 = 0 THEN 0.01 ELSE 0.00 END AS DECIMAL(18,2)) AS o_totalprice,
         o_orderdate, o_orderpriority
  FROM s WHERE o_orderkey % 97 <> 0
  UNION ALL
  SELECT o_orderkey + {EXTRA_KEY_OFFSET}, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM s WHERE o_orderkey % 107 = 0
)"""
