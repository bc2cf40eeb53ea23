"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tableproof.session import materialize


def _stars(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Ties every neighbour of a node (``larger_only``: only those above it) to the least of node and neighbours."""
    if larger_only:
        seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        seen = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    tied = seen.join(least, "a")
    if larger_only:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the least node reached.

    Large stars and small stars by turns: every round ties neighbours to a common least node, at
    most one edge per old edge, until nothing changes. State is an edge table written to the shared
    folder each round; no node's neighbours are ever gathered, only their minimum.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.hash("a", "b"), F.lit(1 << 20)))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        now = materialize(_stars(_stars(now, True), False), "edges")
    own = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own)
