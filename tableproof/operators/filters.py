"""Projections and filters: pinning, windows, conforming, layers, keys."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tableproof.functions.hashing import keyed_text, row_hash
from tableproof.target import Watermark

# Schema name -> layer.
SCHEMA_LAYERS = {
    "ods": "bronze",
    "src": "bronze",
    "ds": "silver",
    "rdw": "silver",
    "qlik": "serving",
    "metadata": "config",
}


def typed_literal(df: DataFrame, col: str, value: Watermark) -> Column:
    """Literal of the column's own type, so that the filter reaches the scan."""
    if isinstance(value, dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(value, dt.date):
        value = value.isoformat()
    return F.lit(value).cast(df.schema[col].dataType)


def as_of(df: DataFrame, watermark_col: str | None, watermark: Watermark) -> DataFrame:
    """Rows up to and including the watermark; everything when it is unset."""
    if watermark_col is None or watermark is None:
        return df
    return df.where(F.col(watermark_col) <= typed_literal(df, watermark_col, watermark))


def delta_window(df: DataFrame, watermark_col: str, prev: Watermark, watermark: Watermark) -> DataFrame:
    """Rows of the half-open window ``(prev, watermark]``."""
    return df.where(
        (F.col(watermark_col) > typed_literal(df, watermark_col, prev))
        & (F.col(watermark_col) <= typed_literal(df, watermark_col, watermark))
    )


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the declared names, order and types."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def layer_of(table: Column, layers: dict[str, str] | None = None) -> Column:
    """Layer of a ``schema.name`` table name."""
    name = F.lower(table)
    schema = F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", 1)).otherwise(F.lit(""))
    out = None
    for key, layer in (layers or SCHEMA_LAYERS).items():
        hit = schema == F.lit(key)
        out = F.when(hit, layer) if out is None else out.when(hit, layer)
    return (
        out.when(schema.startswith("az_"), "bronze")
        .when(name.contains("stg"), "silver")
        .otherwise("gold")
    )


def surrogate_key(columns: Sequence[str], digest: str = "xxhash64") -> Column:
    """Deterministic surrogate for a natural key: stable across runs and partitions, nulls told apart by column."""
    return F.md5(keyed_text(columns)) if digest == "md5" else row_hash(columns)


def late_rows(df: DataFrame, event_col: str, load_col: str, delay: str) -> DataFrame:
    """Rows that were loaded more than ``delay`` (an interval such as '2 days') after their event."""
    return df.where(F.col(load_col) > F.col(event_col) + F.expr(f"INTERVAL {delay}"))
