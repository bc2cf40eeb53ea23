"""Analytics over an estate's edge table: closures, cycles, build waves.

Fixpoints run as rounds of joins. Each round's result is written to the shared
folder, which cuts the lineage and shows the planner the real size; a round only
extends what the round before it found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tableproof.operators import reach
from tableproof.operators.components import ROUNDS_PER_TABLE, components, ends as _ends
from tableproof.operators.filters import layer_of
from tableproof.session import materialize

# Edge and node types.
READS, WRITES, CALLS, EXECUTES, CONFIG = (
    "READS_TABLE", "WRITES_TABLE", "CALLS_PROC", "EXECUTES_PIPELINE", "READS_CONFIG",
)
PIPELINE_TYPES = ("PIPELINE", "SYNAPSE_PIPELINE")
TABLE_TYPES = ("TABLE", "CONFIG_TABLE")
VIEW_TYPE = "VIEW"
#: Rows of bits that one task unites, and how many rows of producers' bits are sent to every task at once.
WORDS_PER_TASK, WORDS_TO_ALL = 250_000, 250_000

def of_type(edges: DataFrame, edge_type: str) -> DataFrame:
    """Distinct (src, dst) of one edge type."""
    return edges.where(F.col("edge_type") == edge_type).select(F.col("src_key").alias("src"), F.col("dst_key").alias("dst")).distinct()


def table_edges(edges: DataFrame, edge_type: str) -> DataFrame:
    """Distinct (src, table) of one edge type; table names are compared in lower case."""
    return (
        edges.where(F.col("edge_type") == edge_type)
        .select(F.col("src_key").alias("src"), F.lower("dst_name").alias("table")).distinct()
    )


def transitive(start: DataFrame, step: DataFrame) -> DataFrame:
    """Pairs (node, reached) from ``start`` (node, reached) along ``step`` (src, dst), to the fixpoint.

    Semi-naive: only the pairs that were new in the last round are joined again.
    """
    known = materialize(start.select("node", "reached").distinct(), "closure")
    fresh = known
    step = materialize(step, "steps")
    while True:
        found = fresh.join(step, fresh["reached"] == step["src"]).select("node", F.col("dst").alias("reached")).distinct()
        fresh = materialize(found.join(known, ["node", "reached"], "left_anti"), "closure")
        if fresh.isEmpty():
            return known
        known = known.unionAll(fresh)


def proc_closure(edges: DataFrame) -> DataFrame:
    """Procedures each caller reaches, directly or through other procedures, itself only on a cycle.

    The pairs are the result; they are read off a reachability index, whose rounds handle bitmaps.
    """
    calls = of_type(edges, CALLS)
    targets = reach.numbered(calls.select(F.col("dst").alias("node")))
    return reach.members(reach.reach_index(calls, targets), targets).withColumnRenamed("member", "reached")


def pipeline_io(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """(pipeline, mode, table): what a pipeline reads and writes itself and through its procedures.

    Tables read or written are bits of the actor that names them, and travel up the calls; which pipeline
    calls which procedure in the end is never written out.
    """
    io = table_edges(edges, READS).withColumn("mode", F.lit("read")).unionAll(table_edges(edges, WRITES).withColumn("mode", F.lit("write")))
    named = F.concat(F.when(F.col("mode") == "read", "r:").otherwise("w:"), F.col("table"))
    io = materialize(io.select("src", named.alias("node")), "actor-io")
    calls = of_type(edges, CALLS)
    targets = reach.numbered(io)
    own = io.join(targets, "node").select(F.col("src").alias("node"), "bucket", "bit")
    pipelines = pipelines_of(objects).select(F.col("pipeline").alias("node"))
    mine = reach.bitmaps(own.join(pipelines, "node", "left_semi"), "node")
    called = reach.reach_index(calls, own).join(pipelines, "node", "left_semi")
    both = reach.united(called.unionByName(mine), "node")
    return reach.members(both, targets).select(
        F.col("node").alias("pipeline"),
        F.when(F.col("member").startswith("r:"), "read").otherwise("write").alias("mode"),
        F.substring("member", 3, 1 << 30).alias("table"),
    )


def producers_consumers(io: DataFrame) -> DataFrame:
    """Per table, how many pipelines produce and consume it, and the first of each.

    The full lists are the rows of ``pipeline_io``; a table that a third of all
    pipelines read is never gathered into one value.
    """
    wrote, read = F.col("mode") == "write", F.col("mode") == "read"
    return io.groupBy("table").agg(
        F.count_if(wrote).alias("n_producers"),
        F.count_if(read).alias("n_consumers"),
        F.min(F.when(wrote, F.col("pipeline"))).alias("first_producer"),
        F.min(F.when(read, F.col("pipeline"))).alias("first_consumer"),
    )


def table_dependencies(edges: DataFrame) -> DataFrame:
    """Distinct input -> output tables of the same writer, without self-loops.

    The pairs are the result itself; both sides are distinct per writer before they meet.
    """
    r, w = table_edges(edges, READS), table_edges(edges, WRITES)
    return (
        r.join(w.withColumnRenamed("table", "dst"), "src").where(F.col("table") != F.col("dst"))
        .select(F.col("table").alias("src"), "dst").distinct()
    )


def pipelines_of(objects: DataFrame) -> DataFrame:
    return objects.where(F.col("type").isin(*PIPELINE_TYPES)).select(F.col("object_key").alias("pipeline")).distinct()


def _dependency_sides(io: DataFrame, edges: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Writers (src, table), readers (dst, table) of written tables, and child -> parent runs (src, dst)."""
    w = materialize(io.where("mode = 'write'").select(F.col("pipeline").alias("src"), "table").distinct(), "producers")
    r = io.where("mode = 'read'").select(F.col("pipeline").alias("dst"), "table").join(w.select("table").distinct(), "table", "left_semi").distinct()
    known = pipelines_of(objects)
    runs = of_type(edges, EXECUTES).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    for end in ("src", "dst"):
        runs = runs.join(known.withColumnRenamed("pipeline", end), end, "left_semi").select("src", "dst")
    return w, materialize(r.select("dst", "table"), "consumers"), materialize(runs, "runs")


def _predecessor_bits(w: DataFrame, r: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dst, bucket, bits): a pipeline's predecessors as bits, itself only where it runs itself; and their numbers.

    A table's producers are words of bits. What a pipeline reads and runs is dealt by its name while it is a narrow list;
    the words arise, lose the pipeline's own bit and are united where that list lies, so no words and no pairs are shuffled.
    More words than are sent to every task at once come in parts; then a bucket may have a row per part.
    """
    targets = reach.numbered(w.select(F.col("src").alias("node")).unionAll(runs.select(F.col("src").alias("node"))))
    numbers = targets.withColumnRenamed("node", "src")
    produced = materialize(reach.words(w.join(numbers, "src"), "table"), "producer-words")
    # A pipeline that reads what it writes does not precede itself, unless it runs itself.
    own = numbers.join(runs.where("src = dst").select("src"), "src", "left_anti").withColumnRenamed("src", "dst")
    lists = r.join(own, "dst", "left").select("dst", "table", "bucket", "bit", F.lit(False).alias("ran")).unionAll(
        runs.join(numbers, "src").select("dst", F.lit(None).cast("string"), "bucket", "bit", F.lit(True))
    ).select("dst", "table", "ran", F.col("bucket").alias("own_bucket"), reach.word_of("bit").alias("own_word"), *[c.alias(f"own_{name}") for name, c in zip(reach.LANES, reach.lanes_of("bit"))])
    lists = materialize(lists, "predecessor-lists")
    parts = max(1, -(-produced.count() // WORDS_TO_ALL))
    # Rows that the words of a part can come to, at most.
    wide = r.select("dst").distinct().count() * produced.select("bucket", "word").distinct().count()
    met = r.groupBy("table").count().join(produced.groupBy("table").agg(F.count("*").alias("n_words")), "table").agg(F.sum(F.col("count") * F.col("n_words"))).first()[0]
    n = max(r.sparkSession.sparkContext.defaultParallelism, min(wide, met or 0) // parts // WORDS_PER_TASK + 1)
    dealt = lists.repartition(n, "dst")
    found = []
    for nth in range(parts):
        here = [F.pmod(F.xxhash64(*c), F.lit(parts)) == nth for c in (("own_bucket", "own_word"), ("bucket", "word"))]
        rows = dealt.where(~F.col("ran") | here[0]).join(F.broadcast(produced.where(here[1])), "table", "left")
        found.append(reach.packed(reach.either(_less_own(rows), "dst"), "dst"))
    return reduce(DataFrame.unionAll, found), targets


def _less_own(rows: DataFrame) -> DataFrame:
    """(dst, bucket, word, lanes): words of what is read, less the pipeline's own bit, and the words of what it is run by."""
    ran, own = F.col("ran"), (F.col("bucket") == F.col("own_bucket")) & (F.col("word") == F.col("own_word"))
    lanes = [
        F.when(ran, F.col(f"own_{c}")).when(own, F.col(c).bitwiseAND(F.bitwise_not(F.col(f"own_{c}")))).otherwise(F.col(c)).alias(c) for c in reach.LANES
    ]
    named = [F.when(ran, F.col(f"own_{c}")).otherwise(F.col(c)).alias(c) for c in ("bucket", "word")]
    return rows.select("dst", *named, *lanes).where(" OR ".join(f"{c} <> 0" for c in reach.LANES))


def pipeline_dependencies(io: DataFrame, edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Producer -> consumer through a table, and child -> parent for executed pipelines, with or without own tables.

    The pairs are the result itself; they are read off bitmaps, so each arises once and none is shuffled.
    """
    found, targets = _predecessor_bits(*_dependency_sides(io, edges, objects))
    return reach.members(found, targets, "dst").select(F.col("member").alias("src"), "dst")


def build_graph(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Edges table -> writer -> table of distinct (src, table) lists.

    A writer is a node of its own, so its inputs and outputs make a list and never all
    their pairs. Two tables reach each other here exactly when they do in the graph of
    pairs, because a writer on a cycle reads and writes tables of that cycle.
    """
    t, w = F.concat(F.lit("t:"), F.col("table")), F.concat(F.lit("w:"), F.col("src"))
    return reads.select(t.alias("src"), w.alias("dst")).unionAll(writes.select(w.alias("src"), t.alias("dst"))).distinct()


def table_components(edges: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The build graph of an estate, and (node, component) of its tables and writers."""
    graph = materialize(build_graph(table_edges(edges, READS), table_edges(edges, WRITES)), "build-graph")
    tables = all_tables(edges, objects).select(F.concat(F.lit("t:"), F.col("node")).alias("node"))
    nodes = tables.unionAll(_ends(graph)).distinct()
    # Tables sort before writers: a component with a table is named after a table.
    return graph, materialize(components(nodes, graph), "components")


def _tables_of(rows: DataFrame) -> DataFrame:
    """Table rows only, without the node prefix."""
    named = {c: F.substring(c, 3, 1 << 30) for c in rows.columns if c in ("node", "component", "cycle_id")}
    return rows.where(F.col("node").startswith("t:")).withColumns(named)


def cycles(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Tables that depend on each other: (node, cycle_id, cycle_size), one row per table on a cycle."""
    comp = _tables_of(table_components(edges, objects)[1])
    size = comp.groupBy("component").agg(F.count("*").alias("cycle_size")).where("cycle_size > 1")
    return comp.join(size, "component").select("node", F.col("component").alias("cycle_id"), "cycle_size")


def table_waves(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Build wave of every table: (node, component, wave)."""
    graph, comp = table_components(edges, objects)
    return _tables_of(wave_layers(graph, comp, F.col("node").startswith("t:")))


def wave_layers(edges: DataFrame, comp: DataFrame, counted: Column | None = None) -> DataFrame:
    """Longest path, in components, from any start to the component of every node.

    With ``counted`` only components that hold such a node make a step; the others
    (writers) stand between two that do. Step ``k`` finds the components that some
    component of step ``k - 1`` feeds; the last step that finds one is its wave. The
    component graph has no cycle, so there are as many steps as waves.
    """
    comp = materialize(comp.withColumn("counted", F.lit(True) if counted is None else counted), "wave-comp")
    kinds = comp.groupBy("component").agg(F.max("counted").alias("counted"))
    a = comp.select(F.col("node").alias("src"), F.col("component").alias("csrc"))
    b = comp.select(F.col("node").alias("dst"), F.col("component").alias("cdst"))
    dag = edges.join(a, "src").join(b, "dst").where("csrc <> cdst").select("csrc", "cdst").distinct()
    dag = materialize(
        dag.join(kinds.select(F.col("component").alias("cdst"), F.col("counted").alias("to_counted")), "cdst")
        .select("csrc", "cdst", "to_counted"), "wave-dag"
    )

    def onward(front: DataFrame) -> DataFrame:
        return front.join(dag, front["component"] == dag["csrc"]).select(F.col("cdst").alias("component"), "to_counted").distinct()

    front, k = kinds.where("counted").select("component"), 0
    wave = front.withColumn("wave", F.lit(0))
    while True:
        steps = None
        for _ in range(ROUNDS_PER_TABLE):
            k += 1
            near = onward(front)
            if counted is not None:
                near = near.unionAll(onward(near.where(~F.col("to_counted")).select("component")))
            front = near.where("to_counted").select("component").distinct()
            step = front.withColumn("wave", F.lit(k))
            steps = step if steps is None else steps.unionAll(step)
        steps = materialize(steps, "wave-front")
        wave = wave.unionAll(steps)
        front = steps.where(F.col("wave") == k).select("component")
        if front.isEmpty():
            break
    top = wave.groupBy("component").agg(F.max("wave").alias("wave"))
    return comp.join(top, "component").select("node", "component", "wave")


def all_tables(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Every table that is read, written or defined."""
    used = edges.where(F.col("edge_type").isin(READS, WRITES)).select(F.lower("dst_name").alias("node"))
    defined = objects.where(F.col("type").isin(*TABLE_TYPES)).select(F.lower("name").alias("node"))
    return used.unionAll(defined).distinct()


def dependent_counts(edges: DataFrame) -> DataFrame:
    """(node, n): distinct tables that writers of other tables build from a table, counted without pairs.

    A writer's outputs are bitmaps; a table unites those of its readers, and its own bit, set where a
    reader writes it too, does not count.
    """
    reads, writes = table_edges(edges, READS), table_edges(edges, WRITES)
    targets = reach.numbered(writes.select(F.col("table").alias("node")))
    outputs = reach.bitmaps(writes.select("src", F.col("table").alias("node")).join(targets, "node").select("src", "bucket", "bit"), "src")
    fed = reach.united(reads.join(outputs, "src").select(F.col("table").alias("node"), "bucket", "bits"), "node")
    total = fed.groupBy("node").agg(F.sum(reach.count_of()).alias("bits_set"))
    own = reads.join(writes, ["src", "table"]).select(F.col("table").alias("node")).distinct().withColumn("own", F.lit(1))
    n = F.col("bits_set") - F.coalesce("own", F.lit(0))
    return total.join(own, "node", "left").select("node", n.alias("n")).where("n > 0")


def table_kind(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Per table: derived, source or isolated; whether it has a definition; its direct dependents."""
    written = table_edges(edges, WRITES).select(F.col("table").alias("node"), F.lit(True).alias("w")).distinct()
    read = table_edges(edges, READS).select(F.col("table").alias("node"), F.lit(True).alias("r")).distinct()
    defined = objects.where(
        F.col("type").isin(*TABLE_TYPES) & (F.coalesce("source_file", F.lit("")) != "")
    ).select(F.lower("name").alias("node"), F.lit(True).alias("d")).distinct()
    dependents = dependent_counts(edges)
    out = all_tables(edges, objects)
    for part in (written, read, defined, dependents):
        out = out.join(part, "node", "left")
    return out.select(
        F.col("node").alias("table"),
        F.when(F.col("w"), "derived").when(F.col("r"), "source").otherwise("isolated").alias("kind"),
        F.coalesce("d", F.lit(False)).alias("has_ddl"),
        F.coalesce("n", F.lit(0)).alias("num_dependents"),
    )


def order_audit(tables: DataFrame, reads: DataFrame, writes: DataFrame, published: DataFrame) -> DataFrame:
    """Independent check of published waves (node, component, wave) against (src, table) reads and writes.

    C1 every table is published; C2 each wave is one more than the greatest wave among
    its component's inputs (0 without any), which pins all waves; C3 no table is built
    from another component's later wave; C4 components whose inputs all come in earlier
    waves, that is, what a build in wave order reaches. Per writer only its latest input
    and the latest one of any other component are needed, never its pairs.
    """
    where = published.select(F.col("node").alias("table"), "component", "wave")
    fed = reads.join(where, "table").groupBy("src", "component").agg(F.max("wave").alias("wave"))
    latest = fed.groupBy("src").agg(F.max(F.struct("wave", "component")).alias("top"))
    others = fed.join(latest, "src").where(F.col("component") != F.col("top.component")).groupBy("src").agg(F.max("wave").alias("next"))
    inputs = latest.join(others, "src", "left")
    built = writes.join(where, "table").join(inputs, "src", "left").select(
        "component", "wave",
        F.when(F.col("top.component") != F.col("component"), F.col("top.wave")).otherwise(F.col("next")).alias("before"),
    )
    by_comp = where.select("component", "wave").withColumn("before", F.lit(None).cast("int")).unionByName(built).groupBy(
        "component"
    ).agg(F.max("wave").alias("wave"), F.max("before").alias("before"))
    c1 = tables.select("node").distinct().join(published, "node", "left").agg(F.count_if(F.col("wave").isNull()).alias("c1_missing"))
    c234 = by_comp.agg(
        F.count_if(F.col("wave") != F.coalesce(F.col("before") + 1, F.lit(0))).alias("c2_mismatches"),
        F.count_if(F.col("before") > F.col("wave")).alias("c3_violations"),
        F.count_if(F.coalesce(F.col("before") < F.col("wave"), F.lit(True))).alias("c4_reached"),
        F.count("*").alias("components"),
        F.max("wave").alias("last_wave"),
    )
    names = ("c1_missing", "c2_mismatches", "c3_violations", "c4_reached", "components", "last_wave")
    total = c1.unionByName(c234, True).agg(*[F.max(c).alias(c) for c in names])
    return total.withColumn(
        "passed",
        (F.col("c1_missing") == 0) & (F.col("c2_mismatches") == 0) & (F.col("c3_violations") == 0)
        & (F.col("c4_reached") == F.col("components")),
    )


def references(io: DataFrame, edges: DataFrame, objects: DataFrame) -> DataFrame:
    """(pipeline, table): reads, configuration reads of any pipeline included."""
    config = table_edges(edges, CONFIG).select(F.col("src").alias("pipeline"), "table")
    known = pipelines_of(objects)
    return io.where("mode = 'read'").select("pipeline", "table").unionAll(
        config.join(known, "pipeline", "left_semi")
    ).distinct()


def _known_tables(io: DataFrame, objects: DataFrame) -> DataFrame:
    """Tables that are produced, defined or external."""
    defined = objects.where(
        F.col("type").isin(*TABLE_TYPES, VIEW_TYPE) | (F.coalesce("external_system", F.lit("")) != "")
    ).select(F.lower("name").alias("table"))
    return io.where("mode = 'write'").select("table").unionAll(defined).distinct()


def reference_index(io: DataFrame, edges: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What every pipeline refers to through the producers of what it reads, as bitmaps (pipeline, bucket, bits), and the tables' numbers.

    Tables that nobody produces, defines or delivers are of kind 1, all others of kind 0.
    """
    refs = references(io, edges, objects)

    def table(c: str) -> Column:
        return F.concat(F.lit("t:"), F.col(c))

    def pipeline(c: str) -> Column:
        return F.concat(F.lit("p:"), F.col(c))

    # Table -> its producers -> what they refer to: two plain edge lists instead of
    # all pairs of a producer's outputs and inputs.
    step = materialize(io.where("mode = 'write'").select(table("table").alias("src"), pipeline("pipeline").alias("dst")).unionAll(
        refs.select(pipeline("pipeline").alias("src"), table("table").alias("dst"))
    ), "reference-steps")
    known = _known_tables(io, objects).withColumn("known", F.lit(0))
    tables = refs.select("table").distinct().join(known, "table", "left")
    targets = reach.numbered(tables.select(table("table").alias("node"), "known"), F.coalesce("known", F.lit(1)))
    found = reach.reach_index(step, targets).where(F.col("node").startswith("p:")).select(F.substring("node", 3, 1 << 30).alias("pipeline"), "bucket", "bits")
    return materialize(found, "references"), targets.withColumn("node", F.substring("node", 3, 1 << 30))


def upstream_closure(io: DataFrame, edges: DataFrame, objects: DataFrame) -> DataFrame:
    """(pipeline, table): everything a pipeline refers to, through the producers of what it reads."""
    found, targets = reference_index(io, edges, objects)
    return reach.members(found, targets, "pipeline").withColumnRenamed("member", "table")


def resolved_references(closure: DataFrame, io: DataFrame, objects: DataFrame) -> DataFrame:
    """(pipeline, table, resolved): whether each reference is produced, defined or external."""
    known = _known_tables(io, objects).withColumn("resolved", F.lit(True))
    return closure.join(known, "table", "left").select("pipeline", "table", F.coalesce("resolved", F.lit(False)).alias("resolved"))


def unresolved_references(io: DataFrame, edges: DataFrame, objects: DataFrame) -> DataFrame:
    """(pipeline, table): references that ``resolved_references`` finds neither produced nor defined nor external.

    The numbers of such tables have a kind of their own, so only these pairs are made.
    """
    found, targets = reference_index(io, edges, objects)
    open_ones = found.where(reach.kind_of(F.col("bucket")) == 1)
    return reach.members(open_ones, targets, "pipeline").withColumnRenamed("member", "table")


def traversability_score(io: DataFrame, edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Share of a pipeline's references that resolve, and the first that does not; 1 for a pipeline without any.

    Counts are bits set; the first unresolved table is the least bit of the least bucket of its kind. No
    pair of pipeline and table is made.
    """
    found, targets = reference_index(io, edges, objects)
    resolved = reach.kind_of(F.col("bucket")) == 0
    per = found.groupBy("pipeline").agg(
        F.sum(reach.count_of()).alias("refs_total"),
        F.coalesce(F.sum(F.when(resolved, reach.count_of())), F.lit(0)).alias("refs_resolved"),
        F.min(F.when(~resolved, F.struct("bucket", reach.first_bit().cast("bigint").alias("bit")))).alias("at"),
    )
    first = targets.where(reach.kind_of(F.col("bucket")) == 1).select(F.struct("bucket", "bit").alias("at"), F.col("node").alias("first_unresolved"))
    per = per.join(first, "at", "left")
    share = (F.col("refs_resolved") / F.col("refs_total")).cast("decimal(20,10)")
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("decimal(6,4)")
    return pipelines_of(objects).join(per, "pipeline", "left").select(
        "pipeline", F.coalesce("refs_total", zero).alias("refs_total"), F.coalesce("refs_resolved", zero).alias("refs_resolved"),
        "first_unresolved", F.coalesce(F.round(share, 4).cast("decimal(6,4)"), one).alias("score"),
    )


def traversability_gate(scores: DataFrame, io: DataFrame, objects: DataFrame) -> DataFrame:
    """One row: how many pipelines resolve in full, how many defined objects nobody can identify, and the verdict.

    A defined table or view is identified by its definition or by a producer, so only nameless ones are left.
    """
    defined = objects.where(F.col("type").isin(*TABLE_TYPES, VIEW_TYPE)).select(F.lower("name").alias("table"))
    n = scores.agg(
        F.count("*").alias("pipelines_scored"), F.count_if(F.col("refs_resolved") == F.col("refs_total")).alias("pipelines_at_100")
    )
    t = defined.agg(F.count("*").alias("tables_views"), F.count_if(F.coalesce("table", F.lit("")) == "").alias("unidentified"))
    names = ("pipelines_scored", "pipelines_at_100", "tables_views", "unidentified")
    one = n.unionByName(t, True).agg(*[F.max(c).alias(c) for c in names])
    return one.withColumn("passed", (F.col("pipelines_scored") == F.col("pipelines_at_100")) & (F.col("unidentified") == 0))


def landing_set(io: DataFrame) -> DataFrame:
    """(pipeline, table): reads that the pipeline does not write itself."""
    r = io.where("mode = 'read'").select("pipeline", "table")
    return r.join(io.where("mode = 'write'").select("pipeline", "table"), ["pipeline", "table"], "left_anti")


def parity_targets(io: DataFrame, layers: dict[str, str] | None = None) -> DataFrame:
    """(pipeline, table, layer): written tables of the silver and gold layers."""
    written = io.where("mode = 'write'").select("pipeline", "table")
    return written.withColumn("layer", layer_of(F.col("table"), layers)).where(F.col("layer").isin("silver", "gold"))


def pipeline_table_counts(io: DataFrame, objects: DataFrame, layers: dict[str, str] | None = None) -> DataFrame:
    """Per pipeline, tables or not, the sizes of its landing set and of its parity targets."""
    landed = landing_set(io).groupBy("pipeline").agg(F.count("*").alias("n_landing"))
    proved = parity_targets(io, layers).groupBy("pipeline").agg(F.count("*").alias("n_parity"))
    zero = F.lit(0).cast("bigint")
    return pipelines_of(objects).join(landed, "pipeline", "left").join(proved, "pipeline", "left").select(
        "pipeline", F.coalesce("n_landing", zero).alias("n_landing"), F.coalesce("n_parity", zero).alias("n_parity")
    )


def predecessor_gate(dependencies: DataFrame, status: DataFrame) -> DataFrame:
    """Per pipeline of ``status`` (pipeline, status): blocked until every predecessor is known to be certified.

    A predecessor without a status row blocks like one that is not certified.
    """
    waiting = dependencies.join(_certified(status), "src", "left_anti").groupBy(F.col("dst").alias("pipeline")).agg(
        F.count("*").alias("n_blocking"), F.min("src").alias("first_blocking")
    )
    return _gated(status, waiting)


def estate_predecessor_gate(io: DataFrame, edges: DataFrame, objects: DataFrame, status: DataFrame) -> DataFrame:
    """``predecessor_gate`` over the ``pipeline_dependencies`` of an estate, without their pairs.

    Only predecessors that block have bits: they are counted, and the first by name is the least bit.
    """
    w, r, runs = _dependency_sides(io, edges, objects)
    certified = _certified(status)
    found, targets = _predecessor_bits(w.join(certified, "src", "left_anti"), r, runs.join(certified, "src", "left_anti"))
    per = found.groupBy(F.col("dst").alias("pipeline")).agg(
        F.sum(reach.count_of()).alias("n_blocking"), F.min(F.struct("bucket", reach.first_bit().cast("bigint").alias("bit"))).alias("at")
    )
    first = targets.select(F.struct("bucket", "bit").alias("at"), F.col("node").alias("first_blocking"))
    return _gated(status, per.join(first, "at").select("pipeline", "n_blocking", "first_blocking"))


def _certified(status: DataFrame) -> DataFrame:
    return status.where(F.col("status") == "CERTIFIED").select(F.col("pipeline").alias("src"))


def _gated(status: DataFrame, waiting: DataFrame) -> DataFrame:
    return status.join(waiting, "pipeline", "left").select(
        "pipeline",
        F.when(F.col("n_blocking") > 0, "BLOCKED").otherwise(F.col("status")).alias("status"),
        F.coalesce("n_blocking", F.lit(0)).alias("n_blocking"),
        "first_blocking",
    )
