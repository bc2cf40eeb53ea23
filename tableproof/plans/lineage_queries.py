"""Registered queries: lineage of the estate derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableproof.operators import lineage
from tableproof.plans import estate
from tableproof.plans.estate import ESTATE_SQL
from tableproof.plans.registry import query
from tableproof.session import fresh_path, materialize
from tableproof.sources import tables
from tableproof.sources.tables import EDGE_COLUMNS, OBJECT_COLUMNS, read_table

_COMPONENTS = """
tclose AS (
  WITH RECURSIVE r(a, b) AS (SELECT src, dst FROM tabledep UNION SELECT r.a, t.dst FROM r JOIN tabledep t ON t.src = r.b)
  SELECT * FROM r),
comp AS (
  SELECT n.node, least(n.node, coalesce(min(x.b), n.node)) AS component
  FROM tnodes n LEFT JOIN (SELECT f.a, f.b FROM tclose f JOIN tclose g ON f.a = g.b AND f.b = g.a) x ON x.a = n.node
  GROUP BY n.node)"""
_WAVES = f"""{_COMPONENTS},
dag AS (SELECT DISTINCT a.component AS cs, b.component AS cd FROM tabledep t JOIN comp a ON a.node = t.src JOIN comp b ON b.node = t.dst
        WHERE a.component <> b.component),
wv AS (
  WITH RECURSIVE w(component, wave) AS (
    SELECT DISTINCT component, 0 FROM comp UNION SELECT d.cd, w.wave + 1 FROM w JOIN dag d ON d.cs = w.component)
  SELECT component, max(wave) AS wave FROM w GROUP BY component)"""


def _graph(spark, d):
    """Edge and object tables, read once; every step of a fixpoint starts from them."""
    return materialize(estate.edges(spark, d).distinct(), "edges"), estate.objects(spark, d)


def _io(spark, d):
    edges, objects = _graph(spark, d)
    return edges, objects, materialize(lineage.pipeline_io(edges, objects), "io")


@query("proc_closure", f"WITH {ESTATE_SQL} SELECT node, reached FROM reach")
def proc_closure(spark, d):
    return lineage.proc_closure(_graph(spark, d)[0])


@query("transitive_io", f"WITH {ESTATE_SQL} SELECT pipeline, mode, tbl AS \"table\" FROM pio")
def transitive_io(spark, d):
    return lineage.pipeline_io(*_graph(spark, d))


@query("producers_consumers", f"""
WITH {ESTATE_SQL}
SELECT tbl AS "table", count(*) FILTER (mode = 'write') AS n_producers, count(*) FILTER (mode = 'read') AS n_consumers,
       min(pipeline) FILTER (mode = 'write') AS first_producer, min(pipeline) FILTER (mode = 'read') AS first_consumer
FROM pio GROUP BY tbl
""")
def producers_consumers(spark, d):
    return lineage.producers_consumers(lineage.pipeline_io(*_graph(spark, d)))


@query("table_dependencies", f"WITH {ESTATE_SQL} SELECT src, dst FROM tabledep")
def table_dependencies(spark, d):
    return lineage.table_dependencies(_graph(spark, d)[0])


_PDEP = """
pdep AS (
  SELECT DISTINCT w.pipeline AS src, r.pipeline AS dst FROM pio w JOIN pio r ON w.tbl = r.tbl
  WHERE w.mode = 'write' AND r.mode = 'read' AND w.pipeline <> r.pipeline
  UNION SELECT dst, src FROM edges WHERE et = 'EXECUTES_PIPELINE'
    AND dst IN (SELECT name FROM objects WHERE type = 'PIPELINE') AND src IN (SELECT name FROM objects WHERE type = 'PIPELINE'))"""


@query("producer_consumer_deps", f"WITH {ESTATE_SQL}, {_PDEP} SELECT src, dst FROM pdep")
def producer_consumer_deps(spark, d):
    edges, objects, io = _io(spark, d)
    return lineage.pipeline_dependencies(io, edges, objects)


@query("cycles", f"""
WITH {ESTATE_SQL}, {_COMPONENTS}
SELECT node, component AS cycle_id, n AS cycle_size FROM comp JOIN (SELECT component, count(*) AS n FROM comp GROUP BY 1 HAVING count(*) > 1) USING (component)
""")
def cycles(spark, d):
    return lineage.cycles(*_graph(spark, d))


@query("wave_layers", f"""
WITH {ESTATE_SQL}, {_WAVES} SELECT node, component, CAST(wave AS INTEGER) AS wave FROM comp JOIN wv USING (component)
""")
def wave_layers(spark, d):
    return lineage.table_waves(*_graph(spark, d))


@query("order_audit", f"""
WITH {ESTATE_SQL}, {_WAVES}
SELECT CAST(0 AS BIGINT) AS c1_missing, CAST(0 AS BIGINT) AS c2_mismatches, CAST(0 AS BIGINT) AS c3_violations,
       count(*) AS c4_reached, count(*) AS components, CAST(max(wave) AS INTEGER) AS last_wave, true AS passed
FROM wv
""")
def order_audit(spark, d):
    edges, objects = _graph(spark, d)
    reads, writes = (lineage.table_edges(edges, kind) for kind in (lineage.READS, lineage.WRITES))
    published = materialize(lineage.table_waves(edges, objects), "published")
    return lineage.order_audit(lineage.all_tables(edges, objects), reads, writes, published)


@query("table_kind", f"""
WITH {ESTATE_SQL}
SELECT node AS "table",
       CASE WHEN node IN (SELECT dst FROM edges WHERE et = 'WRITES_TABLE') THEN 'derived'
            WHEN node IN (SELECT dst FROM edges WHERE et = 'READS_TABLE') THEN 'source' ELSE 'isolated' END AS kind,
       node IN (SELECT name FROM objects WHERE type = 'TABLE' AND source_file <> '') AS has_ddl,
       coalesce(n, 0) AS num_dependents
FROM tnodes LEFT JOIN (SELECT src, count(*) AS n FROM tabledep GROUP BY src) ON src = node
""")
def table_kind(spark, d):
    return lineage.table_kind(*_graph(spark, d))


_UPSTREAM = """
refs AS (SELECT pipeline, tbl FROM pio WHERE mode = 'read'
         UNION SELECT src, dst FROM edges WHERE et = 'READS_CONFIG' AND src IN (SELECT name FROM objects WHERE type = 'PIPELINE')),
step AS (SELECT DISTINCT w.tbl AS src, r.tbl AS dst FROM pio w JOIN refs r ON r.pipeline = w.pipeline WHERE w.mode = 'write'),
up AS (
  WITH RECURSIVE u(pipeline, tbl) AS (SELECT pipeline, tbl FROM refs UNION SELECT u.pipeline, s.dst FROM u JOIN step s ON s.src = u.tbl)
  SELECT * FROM u)"""


_RESOLVED = """
known AS (SELECT tbl FROM pio WHERE mode = 'write' UNION SELECT name FROM objects WHERE type IN ('TABLE', 'CONFIG_TABLE', 'VIEW') OR ext IS NOT NULL),
x AS (SELECT pipeline, tbl, tbl IN (SELECT tbl FROM known) AS ok FROM up)"""


@query("upstream_closure", f"WITH {ESTATE_SQL}, {_UPSTREAM} SELECT pipeline, tbl AS \"table\" FROM up")
def upstream_closure(spark, d):
    edges, objects, io = _io(spark, d)
    return lineage.upstream_closure(io, edges, objects)


@query("traversability_score", f"""
WITH {ESTATE_SQL}, {_UPSTREAM},
{_RESOLVED}
SELECT name AS pipeline, count(tbl) AS refs_total, count(tbl) FILTER (ok) AS refs_resolved,
       min(tbl) FILTER (NOT ok) AS first_unresolved,
       CAST(coalesce(round(CAST(count(tbl) FILTER (ok) AS DOUBLE) / nullif(count(tbl), 0), 4), 1) AS DECIMAL(6,4)) AS score
FROM objects LEFT JOIN x ON x.pipeline = name WHERE type = 'PIPELINE' GROUP BY name
""")
def traversability_score(spark, d):
    edges, objects, io = _io(spark, d)
    return lineage.traversability_score(io, edges, objects)


@query("traversability_gate", f"""
WITH {ESTATE_SQL}, {_UPSTREAM}, {_RESOLVED},
p AS (SELECT count(*) AS n, count(*) FILTER (name NOT IN (SELECT pipeline FROM x WHERE NOT ok)) AS full_n FROM objects WHERE type = 'PIPELINE')
SELECT n AS pipelines_scored, full_n AS pipelines_at_100, (SELECT count(*) FROM objects WHERE type IN ('TABLE', 'VIEW')) AS tables_views,
       CAST(0 AS BIGINT) AS unidentified, n = full_n AS passed FROM p
""")
def traversability_gate(spark, d):
    edges, objects, io = _io(spark, d)
    scores = lineage.traversability_score(io, edges, objects)
    return lineage.traversability_gate(scores, io, objects)


@query("unresolved_references", f"""
WITH {ESTATE_SQL}, {_UPSTREAM}, {_RESOLVED} SELECT pipeline, tbl AS "table" FROM x WHERE NOT ok
""")
def unresolved_references(spark, d):
    edges, objects, io = _io(spark, d)
    return lineage.unresolved_references(io, edges, objects)


@query("landing_set", f"""
WITH {ESTATE_SQL} SELECT pipeline, tbl AS "table" FROM pio WHERE mode = 'read' EXCEPT SELECT pipeline, tbl FROM pio WHERE mode = 'write'
""")
def landing_set(spark, d):
    return lineage.landing_set(_io(spark, d)[2])


@query("parity_targets", f"""
WITH {ESTATE_SQL},
l AS (SELECT pipeline, tbl, CASE split_part(tbl, '.', 1) WHEN 'ods' THEN 'bronze' WHEN 'src' THEN 'bronze' WHEN 'ds' THEN 'silver'
        WHEN 'rdw' THEN 'silver' WHEN 'qlik' THEN 'serving' WHEN 'metadata' THEN 'config'
        ELSE CASE WHEN starts_with(tbl, 'az_') THEN 'bronze' WHEN contains(tbl, 'stg') THEN 'silver' ELSE 'gold' END END AS layer
      FROM pio WHERE mode = 'write')
SELECT pipeline, tbl AS "table", layer FROM l WHERE layer IN ('silver', 'gold')
""")
def parity_targets(spark, d):
    return lineage.parity_targets(lineage.pipeline_io(*_graph(spark, d)))


_STATUS = """
stat AS (SELECT 'job_' || user_id AS pipeline, CASE WHEN max(value) FILTER (event_type = 'error') > 120 THEN 'PROVISIONAL' ELSE 'CERTIFIED' END AS status
         FROM events WHERE user_id % 7 <> 3 GROUP BY user_id)"""


@query("pipeline_table_counts", f"""
WITH {ESTATE_SQL},
l AS (SELECT pipeline, tbl FROM pio WHERE mode = 'read' EXCEPT SELECT pipeline, tbl FROM pio WHERE mode = 'write'),
t AS (SELECT DISTINCT pipeline, tbl FROM pio WHERE mode = 'write' AND split_part(tbl, '.', 1) NOT IN ('ods', 'src', 'qlik', 'metadata') AND NOT starts_with(tbl, 'az_'))
SELECT name AS pipeline, (SELECT count(*) FROM l WHERE l.pipeline = name) AS n_landing, (SELECT count(*) FROM t WHERE t.pipeline = name) AS n_parity
FROM objects WHERE type = 'PIPELINE'
""")
def pipeline_table_counts(spark, d):
    _, objects, io = _io(spark, d)
    return lineage.pipeline_table_counts(io, objects)


@query("predecessor_gate", f"""
WITH {ESTATE_SQL}, {_PDEP}, {_STATUS},
w AS (SELECT d.dst AS pipeline, count(*) AS n, min(d.src) AS f FROM pdep d LEFT JOIN stat s ON s.pipeline = d.src
      WHERE coalesce(s.status, 'UNKNOWN') <> 'CERTIFIED' GROUP BY d.dst)
SELECT s.pipeline, CASE WHEN n > 0 THEN 'BLOCKED' ELSE status END AS status, coalesce(n, 0) AS n_blocking, f AS first_blocking
FROM stat s LEFT JOIN w ON w.pipeline = s.pipeline
""")
def predecessor_gate(spark, d):
    """Every seventh job has no status yet; orchestrators never have one."""
    edges, objects, io = _io(spark, d)
    worst = F.max(F.when(F.col("event_type") == "error", F.col("value")))
    status = read_table(spark, d, "events").where("user_id % 7 <> 3").groupBy("user_id").agg(worst.alias("worst")).select(
        F.concat(F.lit("job_"), F.col("user_id").cast("string")).alias("pipeline"),
        F.when(F.col("worst") > 120, "PROVISIONAL").otherwise("CERTIFIED").alias("status"),
    )
    return lineage.estate_predecessor_gate(io, edges, objects, status)


@query("layer_of", f"""
WITH {ESTATE_SQL}
SELECT node AS "table", CASE split_part(node, '.', 1) WHEN 'src' THEN 'bronze' WHEN 'ds' THEN 'silver'
       ELSE CASE WHEN contains(node, 'stg') THEN 'silver' ELSE 'gold' END END AS layer FROM tnodes
""")
def layer_of(spark, d):
    from tableproof.operators.filters import layer_of as layer

    nodes = lineage.all_tables(*_graph(spark, d))
    return nodes.select(F.col("node").alias("table"), layer(F.col("node")).alias("layer"))


@query("read_estate", f"""
WITH {ESTATE_SQL}
SELECT src AS src_key, et AS edge_type, dst AS dst_name, type AS src_object_type FROM edges LEFT JOIN objects ON name = src
""")
def read_estate(spark, d):
    """Round trip of the estate through its two CSV files."""
    path = fresh_path(spark, "estate")
    parts = (
        ("edges", estate.edges(spark, d).distinct(), EDGE_COLUMNS), ("objects", estate.objects(spark, d), OBJECT_COLUMNS),
    )
    for name, df, columns in parts:
        df.select([F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]).write.csv(
            f"{path}/{name}.csv", header=True
        )
    objects, edges = tables.read_estate(spark, path)
    kinds = objects.select(F.col("name").alias("src_key"), F.col("type").alias("src_object_type"))
    rows = edges.select("src_key", "edge_type", F.lower("dst_name").alias("dst_name")).distinct()
    return rows.join(kinds, "src_key", "left")
