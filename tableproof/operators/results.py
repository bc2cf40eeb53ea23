"""Query-result parity: the original query's landed result against the new query."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tableproof.functions.hashing import row_hash
from tableproof.operators.diff import signed_difference
from tableproof.operators.parity import (
    _checksum_result,
    result,
    row_count,
    schema_parity_rows,
    side_checksums,
    tagged,
)
from tableproof.session import materialize
from tableproof.target import Target

_T = Target("result")


def result_schema(original: DataFrame, converted: DataFrame) -> DataFrame:
    """Column names, positions and types of the two results, one row per column."""
    return schema_parity_rows(original, converted, _T).select(
        "column_name", "src_ordinal", "src_type", "build_ordinal", "build_type",
        (F.col("src_ordinal").eqNullSafe(F.col("build_ordinal")) & F.col("src_type").eqNullSafe(F.col("build_type"))).alias("passed"),
    )


def result_rowcount(original: DataFrame, converted: DataFrame) -> DataFrame:
    return row_count(original, converted, _T).withColumn("check_name", F.lit("result_rowcount"))


def result_set_difference(original: DataFrame, converted: DataFrame) -> DataFrame:
    """Rows on one side only, with multiplicity; empty when the bags are equal."""
    cols = original.columns
    diff = signed_difference(tagged(original, converted, cols), cols)
    return diff.select(
        F.when(F.col("net") > 0, "missing_in_new").otherwise("extra_in_new").alias("tag"),
        *cols,
        F.abs("net").alias("n_rows"),
    )


def result_set_equality(original: DataFrame, converted: DataFrame) -> DataFrame:
    n = result_set_difference(original, converted).agg(
        F.coalesce(F.sum(F.when(F.col("tag") == "missing_in_new", F.col("n_rows"))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.when(F.col("tag") == "extra_in_new", F.col("n_rows"))), F.lit(0)).alias("extra"),
    )
    return result(
        n, _T, "result_set_equality", (F.col("missing") == 0) & (F.col("extra") == 0), F.col("missing"), F.col("extra")
    )


def result_checksum(original: DataFrame, converted: DataFrame) -> DataFrame:
    cols = original.columns
    return _checksum_result(side_checksums(tagged(original, converted, cols), cols), _T, "result_checksum")


def with_positions(df: DataFrame, order_by: Sequence) -> DataFrame:
    """Global 0-based position of every row in the given order.

    A sort spreads the rows over range partitions; the row's number within its
    partition plus the rows of all earlier partitions is its position, so no task
    ever holds more than one range. The sorted rows are written first: range
    bounds come from a sample and could differ between two runs of one plan. Rows that
    tie are ordered by their other columns, and copies of a row by where they lie, so
    that a sort value shared by many rows still spreads over several ranges.
    """
    salted = df.withColumn("__salt", F.monotonically_increasing_id())
    ordered = salted.orderBy(*order_by, *df.columns, "__salt").drop("__salt")
    marked = materialize(ordered.withColumn("__id", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("__id", 33)
    marked = marked.withColumn("__part", part).withColumn("__idx", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = marked.groupBy("__part").agg(F.count("*").alias("__n"))
    # One row per sort partition, a number the session fixes: small enough for one
    # running sum and to send everywhere.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return (
        marked.join(F.broadcast(earlier), "__part")
        .withColumn("position", F.col("__offset") + F.col("__idx"))
        .drop("__id", "__part", "__idx", "__offset")
    )


def order_mismatches(original: DataFrame, converted: DataFrame, order_by: Sequence) -> DataFrame:
    """Positions at which the two ordered results differ, a missing row included."""
    cols = original.columns
    o = with_positions(original, order_by).select("position", row_hash(cols).alias("src_hash"))
    n = with_positions(converted.select(*cols), order_by).select("position", row_hash(cols).alias("build_hash"))
    return o.join(n, "position", "full").where(~F.col("src_hash").eqNullSafe(F.col("build_hash")))


def result_order(original: DataFrame, converted: DataFrame, order_by: Sequence) -> DataFrame:
    n = order_mismatches(original, converted, order_by).agg(F.count("*").alias("n"), F.min("position").alias("first"))
    return result(n, _T, "result_order", F.col("n") == 0, F.lit(0), F.col("n"))


def result_parity(original: DataFrame, converted: DataFrame, order_by: Sequence | None = None) -> DataFrame:
    """All result checks of one query; the order check only for ordered queries."""
    schema = result_schema(original, converted).agg(
        F.count("src_ordinal").alias("s"), F.count("build_ordinal").alias("b"), F.count_if(~F.col("passed")).alias("bad")
    )
    parts = [
        result(schema, _T, "result_schema", F.col("bad") == 0, F.col("s"), F.col("b")),
        result_rowcount(original, converted),
        result_set_equality(original, converted),
        result_checksum(original, converted),
    ]
    if order_by:
        parts.append(result_order(original, converted, order_by))
    return reduce(DataFrame.unionAll, parts)
