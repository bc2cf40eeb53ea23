"""Stored hash trees: a later checkpoint reads what was loaded since, and only key ranges that differ.

Each side of a parity pair keeps its rows by leaf, a range of key hashes, and per leaf the number of rows and
the sum of row hashes. Sums add up: nodes are sums of leaves, the root is the table's checksum, and a window of new
rows only adds to them. Two trees are compared from the root down, into differing nodes only; the rows
of equal leaves are never read, because leaves are partition folders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tableproof.functions.hashing import hash_sum, row_hash
from tableproof.operators.diff import signed_difference
from tableproof.operators.filters import as_of, delta_window
from tableproof.operators.parity import aligned, result, row_keys, shared_columns, tagged
from tableproof.target import Target

#: Leaves of a tree, and leaves under one node. Each leaf is a folder per window, so more leaves pay on larger tables only.
LEAVES, FANOUT = 64, 8


class HashTree:
    """One side's rows and sums in a folder that driver and executors share; reopened by its path."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def add(self, rows: DataFrame, window: str) -> HashTree:
        """Store a window of rows under its name; the same window again replaces itself, so a failed run is repeated."""
        columns = rows.columns
        leaf = F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(LEAVES)).cast("int")
        marked = rows.withColumns({"__leaf": leaf, "__hash": row_hash(columns)})
        # Rebalancing gathers a leaf in one task, and splits it by size where a key holds much of the table.
        marked.hint("rebalance", F.col("__leaf")).write.mode("overwrite").partitionBy("__leaf").parquet(f"{self.path}/rows/__window={window}")
        # An empty window has no files, so its schema cannot be read from them.
        stored = self.spark.read.schema(marked.schema).parquet(f"{self.path}/rows/__window={window}")
        sums = stored.groupBy("__leaf").agg(F.count("*").alias("rows"), hash_sum(F.col("__hash")).alias("hash"))
        sums.write.mode("overwrite").parquet(f"{self.path}/sums/__window={window}")
        return self

    def leaves(self) -> DataFrame:
        """(leaf, rows, hash) over all windows, without empty leaves."""
        stored = self.spark.read.schema("__leaf int, rows bigint, hash decimal(38,0), __window string").parquet(f"{self.path}/sums")
        return stored.groupBy(F.col("__leaf").alias("leaf")).agg(F.sum("rows").alias("rows"), F.sum("hash").cast("decimal(38,0)").alias("hash"))

    def nodes(self) -> DataFrame:
        """(level, node, rows, hash): the root at level 0, its nodes, and the leaves at level 2; 1 + 8 + 64 rows at most."""
        summed = self.leaves().withColumn("branch", F.floor(F.col("leaf") / FANOUT).cast("int")).rollup("branch", "leaf").agg(
            F.sum("rows").alias("rows"), F.sum("hash").cast("decimal(38,0)").alias("hash"), F.grouping_id().alias("g")
        )
        level = F.when(F.col("g") == 3, 0).when(F.col("g") == 1, 1).otherwise(2)
        node = F.when(F.col("g") == 3, 0).when(F.col("g") == 1, F.col("branch")).otherwise(F.col("leaf"))
        return summed.select(level.alias("level"), node.alias("node"), F.coalesce("rows", F.lit(0)).alias("rows"), "hash")

    def rows(self, leaves: Sequence[int], schema: DataFrame) -> DataFrame:
        """Stored rows of some leaves; the scan opens their folders only."""
        full = schema.withColumns({"__hash": F.lit(0).cast("bigint"), "__window": F.lit(""), "__leaf": F.lit(0)}).schema
        stored = self.spark.read.schema(full).option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")
        return stored.where(F.col("__leaf").isin([int(x) for x in leaves])).select(*schema.columns)


def differing_leaves(a: HashTree, b: HashTree) -> list[int]:
    """Leaves whose sums differ, found from the root down."""
    x, y = ({(r["level"], r["node"]): (r["rows"], r["hash"]) for r in t.nodes().collect()} for t in (a, b))

    def differ(level: int, node: int) -> bool:
        return x.get((level, node)) != y.get((level, node))

    if not differ(0, 0):
        return []
    branches = [n for n in range(LEAVES // FANOUT) if differ(1, n)]
    return [leaf for n in branches for leaf in range(n * FANOUT, (n + 1) * FANOUT) if differ(2, leaf)]


def checkpoint(source: DataFrame, build: DataFrame, t: Target, trees: tuple[HashTree, HashTree], window: str) -> None:
    """Bring both trees up to the target's watermark.

    With ``prev_watermark`` only rows of ``(prev, watermark]`` are read and added, else all rows up to the watermark.
    Rows that reach a window after it was stored are seen when that window is stored anew.
    """
    cols = shared_columns(source, build, t)
    for side, tree in zip(aligned(source, build, cols), trees):
        some = as_of(side, t.watermark_col, t.watermark) if t.prev_watermark is None else delta_window(side, t.watermark_col, t.prev_watermark, t.watermark)
        tree.add(some, window)


def open_trees(spark: SparkSession, path: str, source: DataFrame, build: DataFrame, t: Target) -> tuple[HashTree, HashTree]:
    keys = row_keys(t, shared_columns(source, build, t))
    return HashTree(spark, f"{path}/source", keys), HashTree(spark, f"{path}/build", keys)


def tree_checksum(trees: tuple[HashTree, HashTree], t: Target) -> DataFrame:
    """The ``content_checksum`` verdict from the two roots; an empty side has no rows and no hash."""
    def root(tree: HashTree, side: str) -> DataFrame:
        return tree.leaves().agg(F.coalesce(F.sum("rows"), F.lit(0)).alias(f"{side}_rows"), F.sum("hash").cast("decimal(38,0)").alias(f"{side}_hash"))

    sides = root(trees[0], "src").unionByName(root(trees[1], "build"), allowMissingColumns=True)
    one = sides.agg(*[F.max(c).alias(c) for c in ("src_rows", "build_rows", "src_hash", "build_hash")])
    ok = (F.col("src_rows") == F.col("build_rows")) & F.col("src_hash").eqNullSafe(F.col("build_hash"))
    text = [F.concat_ws(":", F.col(f"{s}_rows").cast("string"), F.col(f"{s}_hash").cast("string")) for s in ("src", "build")]
    return result(one, t, "content_checksum", ok, *text)


def tree_differences(trees: tuple[HashTree, HashTree], source: DataFrame, build: DataFrame, t: Target) -> DataFrame:
    """Rows on one side only, ``net`` = source count - build count, read from the differing leaves alone."""
    cols = shared_columns(source, build, t)
    leaves = differing_leaves(*trees)
    schemas = aligned(source, build, cols)
    a, b = (tree.rows(leaves, s) for tree, s in zip(trees, schemas))
    return signed_difference(tagged(a, b, cols), cols)
