"""Registered queries: classification, masks, grants, access audit, dialect rewrite."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tableproof.operators import governance, translate
from tableproof.plans import estate
from tableproof.plans.estate import ESTATE_SQL
from tableproof.plans.registry import query
from tableproof.sources.tables import read_table

_CONTACT = """
contact AS (SELECT c_custkey, c_name, lower(replace(c_name, '#', '')) || '@example.com' AS email,
                   '+1-555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone, c_mktsegment FROM customer)"""


def contacts(spark, d) -> DataFrame:
    return read_table(spark, d, "customer").select(
        "c_custkey", "c_name",
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit(""))), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("+1-555-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")).alias("phone"),
        "c_mktsegment",
    )


@query("apply_masks", f"""
WITH {_CONTACT}
SELECT c_custkey, CASE WHEN s THEN c_name ELSE substr(c_name, 1, 1) || '****' END AS c_name,
       CASE WHEN s THEN email ELSE '***@' || split_part(email, '@', 2) END AS email,
       CASE WHEN s THEN phone ELSE '***-***-' || right(phone, 4) END AS phone,
       CASE WHEN s THEN c_mktsegment ELSE '****' END AS c_mktsegment
FROM (SELECT *, c_mktsegment = 'BUILDING' AS s FROM contact)
""")
def apply_masks(spark, d):
    rules = {"c_name": "name", "email": "email", "phone": "phone", "c_mktsegment": "default"}
    return governance.apply_masks(contacts(spark, d), rules, F.col("c_mktsegment") == "BUILDING")


_SCANNED = {
    "documents": ("text", "lang", "source"), "customer": ("c_name", "c_mktsegment"), "conversations": ("role", "text"),
    "contact": ("c_name", "email", "phone", "c_mktsegment"),
}


def _scan_sql(table: str, col: str) -> str:
    by_name = str(any(p in col for p in governance.PII_NAME_PARTS)).lower()
    hits = {k: f"count(*) FILTER (regexp_matches({col}, '{p}'))" for k, p in governance.PII_VALUE_PATTERNS.items()}
    return (
        f"SELECT '{table}' AS table_name, '{col}' AS column_name, {by_name} AS flagged_by_name, count(*) AS row_count, "
        + ", ".join(f"{h} AS {k}_rows" for k, h in hits.items())
        + f", CASE WHEN {by_name} OR {' OR '.join(f'{h} > 0' for h in hits.values())} THEN 'PII' END AS classification FROM {table}"
    )


@query("classify_pii", f"WITH {_CONTACT}\n" + "\nUNION ALL\n".join(_scan_sql(t, c) for t, cols in _SCANNED.items() for c in cols))
def classify_pii(spark, d):
    parts = [
        governance.classify_pii((contacts(spark, d) if t == "contact" else read_table(spark, d, t)).select(*cols), t)
        for t, cols in _SCANNED.items()
    ]
    return reduce(DataFrame.unionAll, parts)


@query("row_filter", """
SELECT o_orderkey, o_custkey, o_orderpriority FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3')
""")
def row_filter(spark, d):
    """The agent of a nation sees the orders of that nation's customers."""
    owns = read_table(spark, d, "customer").join(read_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    entitlements = owns.select(F.col("n_name").alias("principal"), F.col("c_custkey").alias("value"))
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return governance.row_filter(orders, "o_custkey", entitlements, "NATION_3")


_GRANTS = """
gr AS (SELECT 'user_' || user_id AS principal,
         CASE event_type WHEN 'signup' THEN 'RDM' WHEN 'click' THEN 'rdm.V' || k ELSE 'ds.t' || k END AS object,
         CASE event_type WHEN 'view' THEN 'select' WHEN 'purchase' THEN 'all' WHEN 'click' THEN ' Select ' WHEN 'signup' THEN 'All Privileges' ELSE 'modify' END AS privilege
       FROM (SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def grants(spark, d) -> DataFrame:
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
    privilege = (
        F.when(kind == "view", "select").when(kind == "purchase", "all").when(kind == "click", " Select ")
        .when(kind == "signup", "All Privileges").otherwise("modify")
    )
    obj = F.when(kind == "signup", "RDM").when(kind == "click", F.concat(F.lit("rdm.V"), k)).otherwise(F.concat(F.lit("ds.t"), k))
    return read_table(spark, d, "events").select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("principal"), obj.alias("object"), privilege.alias("privilege")
    )


def _schemas(objects: DataFrame) -> DataFrame:
    return objects.where(F.col("name").contains(".")).select(F.substring_index("name", ".", 1).alias("schema")).distinct()


@query("map_grants", f"""
WITH {ESTATE_SQL}, {_GRANTS},
sch AS (SELECT DISTINCT split_part(name, '.', 1) AS s FROM objects WHERE contains(name, '.'))
SELECT principal, object, CASE WHEN upper(trim(privilege)) IN ('ALL', 'ALL PRIVILEGES') THEN 'ALL PRIVILEGES' ELSE upper(trim(privilege)) END AS privilege,
       CASE WHEN lower(object) IN (SELECT s FROM sch) THEN 'SCHEMA' WHEN lower(object) IN (SELECT name FROM objects WHERE type = 'VIEW') THEN 'VIEW' ELSE 'TABLE' END AS securable
FROM gr
""")
def map_grants(spark, d):
    objects = estate.objects(spark, d)
    return governance.map_grants(grants(spark, d), objects, _schemas(objects))


_FINDINGS = """
pr AS (SELECT 'USER_' || c_custkey AS principal FROM customer WHERE c_acctbal > 0),
ob AS (SELECT lower(name) AS name FROM objects UNION SELECT split_part(name, '.', 1) FROM objects WHERE contains(name, '.')),
con AS (SELECT 'conn_' || s_suppkey AS connection, s_nationkey AS n FROM supplier),
sec AS (SELECT 'Conn_' || (s_suppkey + 5) AS connection FROM supplier WHERE s_acctbal > 500),
cls AS (SELECT 'doc_' || doc_id AS tbl, CASE WHEN toxic = 1 THEN 'pii' ELSE 'internal' END AS c, CASE WHEN quality = 1 THEN 'default' ELSE ' ' END AS mask FROM labels),
f AS (
  SELECT 'unknown_principal' AS finding, principal AS item FROM (SELECT DISTINCT principal FROM gr) WHERE lower(principal) NOT IN (SELECT lower(principal) FROM pr)
  UNION ALL SELECT 'unresolved_object', object FROM (SELECT DISTINCT object FROM gr) WHERE lower(object) NOT IN (SELECT name FROM ob)
  UNION ALL SELECT 'bad_secret_connection', connection FROM (SELECT DISTINCT connection FROM sec) WHERE lower(connection) NOT IN (SELECT connection FROM con)
  UNION ALL SELECT 'unsecured_connection', connection FROM con WHERE n > 0 AND connection NOT IN (SELECT lower(connection) FROM sec)
  UNION ALL SELECT 'unmasked_column', tbl || '.text' FROM cls WHERE upper(c) = 'PII' AND trim(mask) = '')"""


@query("access_audit", f"""
WITH {ESTATE_SQL}, {_GRANTS}, {_FINDINGS},
k AS (SELECT unnest(['unknown_principal', 'unresolved_object', 'bad_secret_connection', 'unsecured_connection', 'unmasked_column', 'no_principals', 'no_sensitive_columns']) AS finding)
SELECT k.finding, count(item) AS n_findings, min(item) AS first_item, count(item) = 0 AS passed FROM k LEFT JOIN f ON f.finding = k.finding GROUP BY k.finding
""")
def access_audit(spark, d):
    return _audit(spark, d)


@query("access_gate", f"WITH {ESTATE_SQL}, {_GRANTS}, {_FINDINGS} SELECT count(item) = 0 AS passed, count(item) AS n_findings FROM f")
def access_gate(spark, d):
    return governance.access_gate(_audit(spark, d))


def _audit(spark, d):
    objects = estate.objects(spark, d)
    names = objects.select("name").unionAll(_schemas(objects).select(F.col("schema").alias("name")))
    principals = read_table(spark, d, "customer").where("c_acctbal > 0").select(
        F.concat(F.lit("USER_"), F.col("c_custkey").cast("string")).alias("principal")
    )
    sup = read_table(spark, d, "supplier")
    connections = sup.select(F.concat(F.lit("conn_"), F.col("s_suppkey").cast("string")).alias("connection"), F.col("s_nationkey").alias("n_pipelines"))
    secrets = sup.where("s_acctbal > 500").select(F.concat(F.lit("Conn_"), (F.col("s_suppkey") + 5).cast("string")).alias("connection"))
    classification = read_table(spark, d, "labels").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("table"), F.lit("text").alias("column"),
        F.when(F.col("toxic") == 1, "pii").otherwise("internal").alias("classification"),
        F.when(F.col("quality") == 1, "default").otherwise(" ").alias("mask"),
    )
    return governance.access_audit(principals, grants(spark, d), names, secrets, connections, classification)


# Query text made of the rows of part, one statement per part, in the source dialects. The oracles build the expected
# text from the same columns, not by rewriting.
_BRAND = "replace(p_brand, '#', '_')"
_TSQL = f"""
q AS (SELECT p_partkey, 'SELECT ' || CASE WHEN p_size > 25 THEN 'TOP (' || p_size || ') ' ELSE '' END || 'ISNULL ([' || p_type || '],''' || p_name ||
             '''), len(name), ''len(x) [y]'', [unit price], GetDate( ) ' || CASE WHEN p_size % 3 = 0 THEN ', CONVERT(int, a)' ELSE '' END ||
             ' FROM [dbo].' || {_BRAND} || ' WHERE id = newid( ) -- GETDATE()' AS sql_text,
             'SELECT ' || CASE WHEN p_size > 25 THEN 'TOP (' || p_size || ') ' ELSE '' END || 'coalesce(' || p_type || ',''' || p_name ||
             '''), length(name), ''len(x) [y]'', `unit price`, current_timestamp() ' || CASE WHEN p_size % 3 = 0 THEN ', CONVERT(int, a)' ELSE '' END ||
             ' FROM dbo.' || {_BRAND} || ' WHERE id = uuid() -- GETDATE()' AS translated,
             concat_ws(';', CASE WHEN p_size > 25 THEN 'TOP' END, CASE WHEN p_size % 3 = 0 THEN 'CONVERT' END) AS needs_review FROM part)"""


def _tsql(spark, d) -> DataFrame:
    top = F.when(F.col("p_size") > 25, F.concat(F.lit("TOP ("), F.col("p_size").cast("string"), F.lit(") "))).otherwise("")
    convert = F.when(F.col("p_size") % 3 == 0, ", CONVERT(int, a)").otherwise("")
    return read_table(spark, d, "part").select("p_partkey", F.concat(
        F.lit("SELECT "), top, F.lit("ISNULL (["), "p_type", F.lit("],'"), "p_name",
        F.lit("'), len(name), 'len(x) [y]', [unit price], GetDate( ) "), convert, F.lit(" FROM [dbo]."),
        F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(" WHERE id = newid( ) -- GETDATE()"),
    ).alias("sql_text"))


@query("translate_queries", f"WITH {_TSQL} SELECT * FROM q")
def translate_tsql(spark, d):
    return translate.translate_queries(_tsql(spark, d), "sql_text", "tsql")


@query("translate_postgres", """
SELECT p_partkey, 'SELECT CAST(''' || p_name || ''' AS STRING), CAST((' || p_size || ' + 1) AS BIGINT), CAST(sum(price) AS DECIMAL(12,2)), ' ||
       '''now() at noon'', current_timestamp(), left(CAST(code AS STRING), 3), CAST(CAST(s.x AS INT) AS DOUBLE), `Odd Name` FROM gold.daily WHERE name ' ||
       CASE WHEN p_size > 25 THEN 'ILIKE' ELSE 'LIKE' END || ' ''' || p_type || ''' AND tag <> ''mart.sales_by_day''' ||
       CASE WHEN p_size % 3 = 0 THEN ' AND list[1] = nextval(''s'')' ELSE '' END AS translated,
       CASE WHEN p_size % 3 = 0 THEN 'ARRAY;NEXTVAL' ELSE '' END AS needs_review
FROM part
""")
def translate_postgres(spark, d):
    like = F.when(F.col("p_size") > 25, "ILIKE").otherwise("LIKE")
    odd = F.when(F.col("p_size") % 3 == 0, " AND list[1] = nextval('s')").otherwise("")
    q = read_table(spark, d, "part").select("p_partkey", F.concat(
        F.lit("SELECT '"), "p_name", F.lit("'::text, ("), F.col("p_size").cast("string"),
        F.lit(" + 1)::int8, sum(price)::numeric(12,2), 'now() at noon', now( ), code::varchar(3), s.x::int::double precision, \"Odd Name\" "
              "FROM mart.sales_by_day WHERE name "), like, F.lit(" '"), "p_type", F.lit("' AND tag <> 'mart.sales_by_day'"), odd,
    ).alias("sql_text"))
    out = translate.translate_queries(q, "sql_text", "postgres")
    return out.select(
        "p_partkey", translate.repoint_tables(F.col("translated"), {"mart.sales_by_day": "gold.daily"}).alias("translated"), "needs_review"
    )
