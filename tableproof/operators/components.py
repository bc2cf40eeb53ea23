"""Strongly connected components of an edge table, one row per node and never pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tableproof.session import materialize

# Propagation steps between two writes: enough to outweigh the cost of a write.
ROUNDS_PER_TABLE = 2


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Strongly connected component of every node: (node, component = its smallest member).

    Edges that cannot lie on a cycle are trimmed. Every node left learns the smallest
    name that reaches it and the smallest name it reaches: where both are the same
    name, node and name are on a common cycle, so that is its component. Members of
    one component agree on both names, so edges between nodes that do not are cut,
    and what is left goes round again. State is one row per node, never pairs.
    """
    every = materialize(nodes.select("node").distinct(), "scc-nodes")
    live = _trim(edges.select("src", "dst").where("src <> dst").distinct())
    done = None
    while not live.isEmpty():
        names = _smallest_names(live)
        found = names.where("up = down").select("node", F.col("up").alias("component"))
        done = found if done is None else done.unionAll(found)
        rest = names.where("up <> down")
        s = rest.select(F.col("node").alias("src"), F.col("up").alias("u"), F.col("down").alias("v"))
        d = rest.select(F.col("node").alias("dst"), F.col("up").alias("u"), F.col("down").alias("v"))
        live = _trim(live.join(s, "src").join(d, ["dst", "u", "v"]).select("src", "dst"))
    if done is None:
        return every.select("node", F.col("node").alias("component"))
    return every.join(done, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def _trim(live: DataFrame) -> DataFrame:
    """Drop edges that start where none arrives or end where none leaves, until all lie between such nodes."""
    live = materialize(live, "scc-edges")
    before = live.count()
    while before:
        for _ in range(ROUNDS_PER_TABLE):
            fed = live.select(F.col("dst").alias("src")).distinct()
            feeding = live.select(F.col("src").alias("dst")).distinct()
            live = live.join(fed, "src", "left_semi").join(feeding, "dst", "left_semi").select("src", "dst")
        live = materialize(live, "scc-edges")
        after = live.count()
        if after == before:
            break
        before = after
    return live


def _smallest_names(live: DataFrame) -> DataFrame:
    """(node, up, down): the smallest name that reaches the node, and that it reaches, itself included."""
    both_ways = materialize(live.select(F.inline(F.array(
        F.struct(F.col("src").alias("at"), F.col("dst").alias("to"), F.lit(True).alias("forward")),
        F.struct(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(False).alias("forward")),
    ))), "scc-ways")
    state = both_ways.select(F.col("at").alias("node")).distinct().select(
        "node", F.col("node").alias("up"), F.col("node").alias("down")
    )
    state = materialize(state, "scc-names")
    while True:
        nxt = state.withColumns({"up0": F.col("up"), "down0": F.col("down")})
        for _ in range(ROUNDS_PER_TABLE):
            sent = both_ways.join(nxt, both_ways["at"] == nxt["node"]).select(
                F.col("to").alias("node"),
                F.when(F.col("forward"), F.col("up")).alias("up"), F.when(~F.col("forward"), F.col("down")).alias("down"),
            )
            nxt = sent.unionByName(nxt, allowMissingColumns=True).groupBy("node").agg(
                F.min("up").alias("up"), F.min("down").alias("down"), F.max("up0").alias("up0"), F.max("down0").alias("down0")
            )
        nxt = materialize(nxt, "scc-names")
        state = nxt.select("node", "up", "down")
        if nxt.where("up <> up0 OR down <> down0").isEmpty():
            return state
