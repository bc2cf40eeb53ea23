"""An estate derived from the given tables, in Spark and as SQL.

``events`` is read as an access log: the user is a job, the event type what the job
did, ``props.k`` the object it touched. ``part``, ``nation`` and ``events`` give the
object catalogue. Nothing is made up: every edge and object comes from a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tableproof.sources.tables import read_table

# Schemas along the layers; a job of level n reads from n and writes to n + 1.
SCHEMAS = ("ext", "src", "stg", "ds", "rdm", "serving")


def _schema_at(level) -> F.Column:
    return F.element_at(F.array(*[F.lit(s) for s in SCHEMAS]), level)


def edges(spark, d) -> DataFrame:
    ev = read_table(spark, d, "events").select(
        "event_type", "value", F.col("user_id").alias("u"), F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.concat(F.lit("job_"), F.col("user_id").cast("string")).alias("job"),
    ).withColumn("level", (F.col("u") % 5 + 1).cast("int"))
    reads_from, writes_to = _schema_at(F.col("level")), _schema_at(F.col("level") + 1)
    k, proc = F.col("k").cast("string"), F.concat(F.lit("proc_"), F.col("k").cast("string"))

    def edge(src, kind: str, dst):
        return F.struct(src.alias("src_key"), F.lit(kind).alias("edge_type"), dst.alias("dst_key"))

    job = F.col("job")
    kind = F.col("event_type")
    picked = (
        F.when(kind == "view", F.array(edge(job, "READS_TABLE", F.concat(
            F.when(F.col("value") > 150, writes_to).otherwise(reads_from), F.lit(".T"), k))))
        .when(kind == "purchase", F.array(edge(job, "WRITES_TABLE", F.concat(writes_to, F.lit(".t"), k))))
        .when(kind == "click", F.array(edge(job, "CALLS_PROC", proc)))
        .when(kind == "signup", F.array(
            edge(proc, "CALLS_PROC", F.concat(F.lit("proc_"), (F.col("k") + 20 + F.col("u") % 20).cast("string"))),
            edge(proc, "READS_TABLE", F.concat(F.lit("ext.p"), F.floor("value").cast("string"))),
        ))
        .when(F.col("value") > 60, F.array(edge(F.concat(F.lit("master_"), k), "EXECUTES_PIPELINE", job)))
        .otherwise(F.array(edge(job, "READS_CONFIG", F.concat(F.lit("metadata.c"), k))))
    )
    return ev.select(F.inline(picked)).withColumn("dst_name", F.col("dst_key"))


def objects(spark, d) -> DataFrame:
    ev = read_table(spark, d, "events")
    jobs = ev.select(F.concat(F.lit("job_"), F.col("user_id").cast("string")).alias("name")).distinct()
    masters = ev.where("event_type = 'error' AND value > 60").select(
        F.concat(F.lit("master_"), F.get_json_object("props", "$.k")).alias("name")
    ).distinct()
    sizes = read_table(spark, d, "part").select("p_size").distinct()
    defined = sizes.select(
        F.explode(F.array(*[F.lit(s) for s in SCHEMAS[1:]])).alias("s"), F.col("p_size")
    ).select(
        F.concat("s", F.lit(".t"), F.col("p_size").cast("string")).alias("name"),
        F.when(F.col("p_size") >= 10, F.concat(F.lit("ddl/"), "s")).otherwise("").alias("source_file"),
    )
    nations = read_table(spark, d, "nation")
    external = nations.select(F.concat(F.lit("ext.t"), F.col("n_nationkey").cast("string")).alias("name"), F.lit("erp").alias("external_system"))
    views = nations.select(F.concat(F.lit("rdm.v"), F.col("n_nationkey").cast("string")).alias("name"))
    parts = [
        jobs.withColumn("type", F.lit("PIPELINE")), masters.withColumn("type", F.lit("PIPELINE")),
        defined.withColumn("type", F.lit("TABLE")), external.withColumn("type", F.lit("EXTERNAL")), views.withColumn("type", F.lit("VIEW")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(F.col("name").alias("object_key"), "name", "type", "source_file", "external_system")


_LIST = "[" + ", ".join(f"'{s}'" for s in SCHEMAS) + "]"
ESTATE_SQL = f"""
ev AS (SELECT event_type, value, user_id AS u, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 'job_' || user_id AS job,
              {_LIST}[user_id % 5 + 1] AS rs, {_LIST}[user_id % 5 + 2] AS ws FROM events),
edges AS (
  SELECT job AS src, 'READS_TABLE' AS et, CASE WHEN value > 150 THEN ws ELSE rs END || '.t' || k AS dst FROM ev WHERE event_type = 'view'
  UNION SELECT job, 'WRITES_TABLE', ws || '.t' || k FROM ev WHERE event_type = 'purchase'
  UNION SELECT job, 'CALLS_PROC', 'proc_' || k FROM ev WHERE event_type = 'click'
  UNION SELECT 'proc_' || k, 'CALLS_PROC', 'proc_' || (k + 20 + u % 20) FROM ev WHERE event_type = 'signup'
  UNION SELECT 'proc_' || k, 'READS_TABLE', 'ext.p' || CAST(floor(value) AS BIGINT) FROM ev WHERE event_type = 'signup'
  UNION SELECT 'master_' || k, 'EXECUTES_PIPELINE', job FROM ev WHERE event_type = 'error' AND value > 60
  UNION SELECT job, 'READS_CONFIG', 'metadata.c' || k FROM ev WHERE event_type = 'error' AND value <= 60),
objects AS (
  SELECT DISTINCT job AS name, 'PIPELINE' AS type, NULL AS source_file, NULL AS ext FROM ev
  UNION ALL SELECT DISTINCT 'master_' || k, 'PIPELINE', NULL, NULL FROM ev WHERE event_type = 'error' AND value > 60
  UNION ALL SELECT s || '.t' || p_size, 'TABLE', CASE WHEN p_size >= 10 THEN 'ddl/' || s ELSE '' END, NULL
            FROM (SELECT DISTINCT p_size FROM part), (SELECT unnest({_LIST}[2:]) AS s)
  UNION ALL SELECT 'ext.t' || n_nationkey, 'EXTERNAL', NULL, 'erp' FROM nation
  UNION ALL SELECT 'rdm.v' || n_nationkey, 'VIEW', NULL, NULL FROM nation),
calls AS (SELECT src, dst FROM edges WHERE et = 'CALLS_PROC'),
reach AS (
  WITH RECURSIVE r(node, reached) AS (
    SELECT src, dst FROM calls UNION SELECT r.node, c.dst FROM r JOIN calls c ON c.src = r.reached)
  SELECT * FROM r),
pio AS (
  SELECT DISTINCT o.name AS pipeline, CASE WHEN e.et = 'READS_TABLE' THEN 'read' ELSE 'write' END AS mode, e.dst AS tbl
  FROM objects o JOIN (SELECT name AS node, name AS actor FROM objects WHERE type = 'PIPELINE' UNION ALL SELECT node, reached FROM reach) a ON a.node = o.name
  JOIN edges e ON e.src = a.actor AND e.et IN ('READS_TABLE', 'WRITES_TABLE')
  WHERE o.type = 'PIPELINE'),
tabledep AS (
  SELECT DISTINCT r.dst AS src, w.dst AS dst FROM edges r JOIN edges w ON r.src = w.src
  WHERE r.et = 'READS_TABLE' AND w.et = 'WRITES_TABLE' AND r.dst <> w.dst),
tnodes AS (
  SELECT dst AS node FROM edges WHERE et IN ('READS_TABLE', 'WRITES_TABLE')
  UNION SELECT name FROM objects WHERE type = 'TABLE')"""
