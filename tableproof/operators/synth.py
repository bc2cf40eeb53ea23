"""Deterministic synthetic tables with referential integrity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


@dataclass(frozen=True)
class SynthSpec:
    """``fks`` maps a column to the table whose single key it refers to."""

    table: str
    schema: T.StructType
    rows: int
    pk: tuple[str, ...] = ()
    fks: Mapping[str, str] = field(default_factory=dict)


def synthetic_value(i: Column, f: T.StructField, pk: str | None, parent_rows: int | None) -> Column:
    """Closed-form value of row ``i`` (1-based): parents need not exist yet."""
    if f.name == pk:
        value = i
    elif parent_rows:
        value = F.pmod(i - 1, F.lit(parent_rows)) + 1
    elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        value = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(i, F.lit(365)).cast("int"))
    elif isinstance(f.dataType, (T.DecimalType, T.DoubleType, T.FloatType)):
        value = i.cast("double") * 1.0
    elif isinstance(f.dataType, T.BooleanType):
        value = F.pmod(i, F.lit(2)) == 1
    elif isinstance(f.dataType, T.NumericType):
        value = i
    else:
        value = F.concat(F.lit(f"{f.name}_"), i.cast("string"))
    return value.cast(f.dataType).alias(f.name)


def synth_table(
    spark: SparkSession, schema: T.StructType, rows: int, pk: Sequence[str] = (), fk_rows: Mapping[str, int] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """``rows`` rows made in parallel from a range, each from its own number."""
    fk_rows = fk_rows or {}
    single = pk[0] if len(pk) == 1 else None
    ids = spark.range(1, rows + 1, 1, partitions) if partitions else spark.range(1, rows + 1)
    return ids.select([synthetic_value(F.col("id"), f, single, fk_rows.get(f.name)) for f in schema])


def synth_estate(spark: SparkSession, specs: Sequence[SynthSpec], overrides: Mapping[str, int] | None = None) -> dict[str, DataFrame]:
    """All tables, mutually consistent; any order will do, values being closed-form."""
    rows = {s.table: (overrides or {}).get(s.table, s.rows) for s in specs}
    return {
        s.table: synth_table(spark, s.schema, rows[s.table], s.pk, {c: rows[p] for c, p in s.fks.items()}) for s in specs
    }


def replication_manifest(tables: Mapping[str, DataFrame], specs: Sequence[SynthSpec], waves: Mapping[str, int] | None = None) -> DataFrame:
    """Rows made per table against the plan; the estate passes when all agree."""
    waves = waves or {}
    return reduce(DataFrame.unionAll, [
        tables[s.table].agg(F.count("*").alias("actual_rows")).select(
            F.lit(s.table).alias("object"),
            F.lit("table").alias("kind"),
            F.lit("synthetic").alias("fill"),
            F.lit(s.rows).cast("bigint").alias("planned_rows"),
            "actual_rows",
            F.lit(";".join(s.pk)).alias("pk"),
            F.lit(";".join(f"{c}->{p}" for c, p in s.fks.items())).alias("fks"),
            F.lit(waves.get(s.table, 0)).alias("wave"),
            (F.col("actual_rows") == F.lit(s.rows)).alias("replicated"),
        )
        for s in specs
    ])


def lines_of(headers: DataFrame, n_lines: Column, line_col: str = "line_no") -> DataFrame:
    """One row per line of each header, ``n_lines`` of them."""
    return headers.withColumn(line_col, F.explode(F.sequence(F.lit(1), n_lines)))
