"""Watermarked extraction, file intake and control-table ingestion."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tableproof.operators.filters import delta_window


def extract_predicates(watermark_col: str, lo: dt.datetime, hi: dt.datetime, parts: int) -> list[str]:
    """WHERE clauses that cut ``(lo, hi]`` into adjoining half-open slices, one read task each."""
    step = (hi - lo) / parts
    edges = [lo + step * i for i in range(parts)] + [hi]

    def text(x: dt.datetime) -> str:
        return f"TIMESTAMP '{x.isoformat(sep=' ', timespec='microseconds')}'"

    return [f"{watermark_col} > {text(a)} AND {watermark_col} <= {text(b)}" for a, b in zip(edges, edges[1:])]


def jdbc_extract(
    spark: SparkSession, url: str, table: str, watermark_col: str, lo: dt.datetime, hi: dt.datetime,
    parts: int = 8, properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rows of ``(lo, hi]`` from a database, read in parallel; the filter runs in the database."""
    return spark.read.jdbc(
        url, table, predicates=extract_predicates(watermark_col, lo, hi, parts), properties=dict(properties or {})
    )


def watermark_extract(df: DataFrame, watermark_col: str, lo: dt.datetime, hi: dt.datetime, parts: int = 8) -> DataFrame:
    """The same slices over a file table: one scan, with the slice number of each row."""
    slices = extract_predicates(watermark_col, lo, hi, parts)
    number = F.coalesce(*[F.when(F.expr(p.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")), F.lit(i)) for i, p in enumerate(slices)])
    return delta_window(df, watermark_col, lo, hi).withColumn("slice", number)


def file_intake(spark: SparkSession, path: str, fmt: str, schema: T.StructType, **options: str) -> DataFrame:
    """Files of a declared schema; no inference pass over the data."""
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def metadata_multi_ingest(
    control: DataFrame, read: Callable[[str], DataFrame], hi: dt.datetime
) -> tuple[dict[str, DataFrame], DataFrame]:
    """One incremental extract per control row, and the loads table that advances the control.

    Control rows (one per table) are configuration and are read on the driver; the
    table rows stay distributed. The greatest watermark of each load is one small row.
    """
    extracts, loads = {}, None
    for row in control.toLocalIterator():
        df = delta_window(read(row["table_name"]), row["watermark_col"], row["watermark_value"], hi)
        extracts[row["table_name"]] = df
        high = df.agg(F.max(row["watermark_col"]).alias("wm"), F.count("*").alias("loaded_rows")).select(
            F.lit(row["table_name"]).alias("table_name"), "wm", "loaded_rows"
        )
        loads = high if loads is None else loads.unionAll(high)
    return extracts, loads
