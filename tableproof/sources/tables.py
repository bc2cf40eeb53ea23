"""Table readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# The columns of the estate tables.
OBJECT_COLUMNS = (
    "object_key", "name", "type", "layer", "schema_or_domain", "title", "source_file", "active",
    "target_database", "job_class", "external_system",
)
EDGE_COLUMNS = (
    "src_key", "src_name", "src_type", "edge_type", "dst_key", "dst_name", "dst_type", "exec_order",
    "predecessors", "when_condition", "context",
)


def _strings(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_estate(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Objects and edges of an estate from its two CSV files; malformed bytes are replaced, not fatal."""
    def read(name: str, columns) -> DataFrame:
        return spark.read.csv(f"{directory}/{name}.csv", schema=_strings(columns), header=True, encoding="UTF-8")

    return read("objects", OBJECT_COLUMNS), read("edges", EDGE_COLUMNS)


BI_SCHEMA = T.StructType([
    T.StructField("obj_id", T.StringType()),
    T.StructField("system", T.StringType()),
    T.StructField("dashboard", T.StringType()),
    T.StructField("tile", T.StringType()),
    T.StructField("original_query", T.StringType()),
    T.StructField("converted_query", T.StringType()),
    T.StructField("datasource", T.StringType()),
    T.StructField("target_tables", T.ArrayType(T.StringType())),
    T.StructField("ordered", T.BooleanType()),
])


def read_bi_objects(spark: SparkSession, path: str, system: str | None = None, lines: bool = False) -> DataFrame:
    """Query-bearing report objects from JSON: one array per file, or one object per line.

    A file that holds one array is read by one task; large exports should come as lines.
    """
    df = spark.read.schema(BI_SCHEMA).json(path, multiLine=not lines)
    return df if system is None else df.where(F.col("system") == system)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def land_bronze(df: DataFrame, path: str) -> DataFrame:
    """As-is copy of a prerequisite; returns the landed table."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_table(df: DataFrame, name: str) -> None:
    """Create or replace a catalog table from a query."""
    df.write.mode("overwrite").saveAsTable(name)


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def create_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def snapshot_result(df: DataFrame, path: str) -> DataFrame:
    """Land the original query's result, for comparison later on."""
    return land_bronze(df, path)


def serving_copy(df: DataFrame, keys: list[str], aggregates: list[Column], path: str) -> DataFrame:
    """Aggregate a gold table and land the copy that is served."""
    return land_bronze(df.groupBy(*keys).agg(*aggregates), path)


def sync_read_model(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Projection of a gold table in the shape an application reads."""
    return df.select([expr.alias(name) for name, expr in columns.items()])


def write_results(rows: DataFrame, path: str) -> None:
    """Append result rows, manifests or gates to their table."""
    append_table(rows, path)
