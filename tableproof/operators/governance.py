"""Classification, masks, row filters, grants and the access audit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Parts of a column name that mark personal data.
PII_NAME_PARTS = (
    "name", "email", "e_mail", "phone", "mobile", "ssn", "dob",
    "birth", "address", "addr", "zip", "postal",
)

# Value patterns for the row scan.
PII_VALUE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+?[0-9]{1,3}[-. ]\(?[0-9]{3}\)?[-. ][0-9]{3,4}[-. ]?[0-9]{0,4}",
    "id": r"(^|[^0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}($|[^0-9])",
}

SENSITIVE = ("PII", "PHI", "PCI")


def classify_pii(df: DataFrame, table: str) -> DataFrame:
    """One row per string column: flagged by name, and rows that match each value pattern.

    One pass over whole values for all columns and patterns.
    """
    cols = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(cols):
        aggs += [F.count_if(F.col(c).rlike(p)).alias(f"{kind}_{i}") for kind, p in PII_VALUE_PATTERNS.items()]
    rows = [
        F.struct(
            F.lit(table).alias("table_name"),
            F.lit(c).alias("column_name"),
            F.lit(any(p in c.lower() for p in PII_NAME_PARTS)).alias("flagged_by_name"),
            F.col("n").alias("row_count"),
            *[F.col(f"{kind}_{i}").alias(f"{kind}_rows") for kind in PII_VALUE_PATTERNS],
        )
        for i, c in enumerate(cols)
    ]
    hit = reduce(lambda a, b: a | b, [F.col(f"{kind}_rows") > 0 for kind in PII_VALUE_PATTERNS])
    return df.agg(*aggs).select(F.inline(F.array(*rows))).withColumn(
        "classification", F.when(F.col("flagged_by_name") | hit, "PII")
    )


def mask_email(c: Column) -> Column:
    return F.concat(F.lit("***@"), F.get(F.split(c, "@"), F.lit(1)))


def mask_phone(c: Column) -> Column:
    return F.concat(F.lit("***-***-"), F.substring(c, -4, 4))


def mask_name(c: Column) -> Column:
    return F.concat(F.substring(c, 1, 1), F.lit("****"))


def mask_default(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit("****"))


MASKS = {"email": mask_email, "phone": mask_phone, "name": mask_name, "default": mask_default}


def apply_masks(df: DataFrame, rules: Mapping[str, str], is_steward: Column | bool = False) -> DataFrame:
    """Mask every classified column; stewards see the raw value. Unknown masks hide everything."""
    steward = is_steward if isinstance(is_steward, Column) else F.lit(is_steward)
    return df.withColumns({
        c: F.when(steward, F.col(c)).otherwise(MASKS.get(m, mask_default)(F.col(c))) for c, m in rules.items()
    })


def row_filter(df: DataFrame, col: str, entitlements: DataFrame, principal: str) -> DataFrame:
    """Rows whose ``col`` value the principal is entitled to (``principal``, ``value``)."""
    allowed = entitlements.where(F.col("principal") == principal).select(F.col("value").alias(col)).distinct()
    return df.join(allowed, col, "left_semi")


def map_grants(grants: DataFrame, objects: DataFrame, schemas: DataFrame) -> DataFrame:
    """Privilege and kind of securable of every source grant.

    ``schemas`` (schema) holds the schema names; anything that is neither a schema
    nor a view is granted as a table.
    """
    kinds = objects.groupBy(F.lower("name").alias("object_lc")).agg(F.max("type").alias("object_type"))
    known = schemas.select(F.lower("schema").alias("object_lc"), F.lit(True).alias("is_schema")).distinct()
    privilege = F.upper(F.trim("privilege"))
    return (
        grants.withColumn("object_lc", F.lower("object"))
        .join(kinds, "object_lc", "left").join(known, "object_lc", "left")
        .select(
            "principal", "object",
            F.when(privilege.isin("ALL", "ALL PRIVILEGES"), "ALL PRIVILEGES").otherwise(privilege).alias("privilege"),
            F.when(F.col("is_schema"), "SCHEMA").when(F.col("object_type") == "VIEW", "VIEW").otherwise("TABLE").alias("securable"),
        )
    )


def access_audit(
    principals: DataFrame, grants: DataFrame, objects: DataFrame, secrets: DataFrame, connections: DataFrame,
    classification: DataFrame,
) -> DataFrame:
    """Findings per kind, one row each, with a count and the first offender; the gate is 'no findings'.

    Names are compared in lower case. ``objects`` (name) holds tables, views and schemas;
    ``connections`` (connection, n_pipelines), unused ones need no secret.
    """
    def missing(left: DataFrame, lcol: str, right: DataFrame, rcol: str) -> DataFrame:
        wanted = left.select(F.coalesce(F.col(lcol), F.lit("")).alias("item")).distinct()
        have = right.select(F.lower(rcol).alias("k")).distinct()
        return wanted.join(have, F.lower("item") == F.col("k"), "left_anti")

    active = connections.where(F.coalesce(F.col("n_pipelines").cast("bigint"), F.lit(0)) > 0)
    sensitive = classification.where(F.upper("classification").isin(*SENSITIVE))
    unmasked = sensitive.where(F.trim(F.coalesce("mask", F.lit(""))) == "").select(F.concat_ws(".", "table", "column").alias("item"))
    found: Sequence[tuple[str, DataFrame]] = (
        ("unknown_principal", missing(grants, "principal", principals, "principal")),
        ("unresolved_object", missing(grants, "object", objects, "name")),
        ("bad_secret_connection", missing(secrets, "connection", connections, "connection")),
        ("unsecured_connection", missing(active, "connection", secrets, "connection")),
        ("unmasked_column", unmasked),
        ("no_principals", principals.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("").alias("item"))),
        ("no_sensitive_columns", sensitive.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("").alias("item"))),
    )
    return reduce(DataFrame.unionAll, [
        df.agg(F.count("*").alias("n_findings"), F.min("item").alias("first_item")).select(
            F.lit(kind).alias("finding"), "n_findings", "first_item", (F.col("n_findings") == 0).alias("passed")
        )
        for kind, df in found
    ])


def access_gate(audit: DataFrame) -> DataFrame:
    return audit.agg(F.every("passed").alias("passed"), F.sum("n_findings").alias("n_findings"))
