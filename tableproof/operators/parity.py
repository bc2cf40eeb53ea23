"""Table parity: the ten checks and their phases.

Both sides are tagged ``+1`` (source) and ``-1`` (build) and unioned once, so
every check is one grouped aggregate that Spark combines on the map side: a hot
key or value reaches the shuffle as one row per task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from tableproof.functions.hashing import (
    exact_sum,
    exact_text,
    hash_sum,
    is_finite,
    is_fractional,
    is_numeric,
    report_text,
    row_hash,
)
from tableproof.operators.filters import as_of, delta_window
from tableproof.session import materialize
from tableproof.target import FK, Target

SIGN = "__sign"

# The checks of each phase, in report order.
CHECKS = (
    "schema_parity",
    "row_count",
    "key_parity",
    "content_checksum",
    "column_aggregates",
    "null_distribution",
    "referential_integrity",
    "no_extra_output",
    "idempotency",
    "row_level_sample",
)
SAMPLE_CHECKS = (
    "schema_parity",
    "key_parity",
    "referential_integrity",
    "no_extra_output",
    "idempotency",
    "row_level_sample",
)
PROFILES = {"dev": SAMPLE_CHECKS, "sit": CHECKS, "soak": CHECKS + ("soak_delta_parity",)}

RESULT_COLUMNS = ("table_name", "check_name", "passed", "src_value", "build_value")


def shared_columns(source: DataFrame, build: DataFrame, t: Target) -> list[str]:
    if t.columns:
        return list(t.columns)
    other = set(build.columns)
    return [c for c in source.columns if c in other]


def row_keys(t: Target, columns: Sequence[str]) -> list[str]:
    """The target's keys; a table without a key is compared as a bag, its whole rows being the keys."""
    return list(t.keys) or list(columns)


def aligned(source: DataFrame, build: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with the same columns. Columns of unequal type are compared as text."""
    def side(df: DataFrame) -> DataFrame:
        return df.select([
            (F.col(c) if source.schema[c].dataType == build.schema[c].dataType else exact_text(F.col(c), df.schema[c].dataType)).alias(c)
            for c in columns
        ])

    return side(source), side(build)


def tagged(source: DataFrame, build: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Union of both sides with a sign."""
    s, b = aligned(source, build, columns)
    return s.withColumn(SIGN, F.lit(1)).unionAll(b.withColumn(SIGN, F.lit(-1)))


def _at_watermark(source: DataFrame, build: DataFrame, t: Target) -> tuple[DataFrame, DataFrame]:
    return as_of(source, t.watermark_col, t.watermark), as_of(build, t.watermark_col, t.watermark)


def pinned(source: DataFrame, build: DataFrame, t: Target, columns: Sequence[str] | None = None) -> DataFrame:
    """Both sides at the pinned watermark, tagged."""
    return tagged(*_at_watermark(source, build, t), list(columns or shared_columns(source, build, t)))


def result(df: DataFrame, t: Target, check: str, passed, src, build) -> DataFrame:
    return df.select(
        F.lit(t.table).alias("table_name"),
        F.lit(check).alias("check_name"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        src.cast("string").alias("src_value"),
        build.cast("string").alias("build_value"),
    )


def _verdict(check: str, passed, src, build):
    """The same as one struct, for checks that unfold from one aggregate row."""
    return F.struct(
        F.lit(check).alias("check_name"), F.coalesce(passed, F.lit(False)).alias("passed"),
        src.cast("string").alias("src_value"), build.cast("string").alias("build_value"),
    )


# --- 1 schema ---------------------------------------------------------------

def observed_schema(df: DataFrame, prefix: str) -> DataFrame:
    """Declared name, position and type, with the nullability and the width the rows show.

    File formats declare every column nullable, so both are taken from the data in
    one aggregate: nulls seen, and the widest text of string and decimal columns.
    """
    aggs = []
    for i, f in enumerate(df.schema):
        wide = isinstance(f.dataType, (T.StringType, T.DecimalType))
        width = F.max(F.length(F.col(f.name).cast("string"))) if wide else F.lit(None).cast("int")
        aggs += [
            (F.count("*") > F.count(f.name)).alias(f"nul_{i}"),
            width.alias(f"wid_{i}"),
        ]
    one = df.agg(*aggs)
    rows = F.array(*[
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(i + 1).alias(f"{prefix}_ordinal"),
            F.lit(f.dataType.simpleString()).alias(f"{prefix}_type"),
            F.col(f"nul_{i}").alias(f"{prefix}_has_nulls"),
            F.col(f"wid_{i}").alias(f"{prefix}_width"),
        )
        for i, f in enumerate(df.schema)
    ])
    return one.select(F.inline(rows))


def schema_parity_rows(source: DataFrame, build: DataFrame, t: Target) -> DataFrame:
    """One row per column of either side: name, position, type, nullability, width."""
    s, b = _at_watermark(source, build, t)
    s, b = observed_schema(s, "src"), observed_schema(b, "build")
    same = [F.col(f"src_{x}").eqNullSafe(F.col(f"build_{x}")) for x in ("ordinal", "type", "has_nulls", "width")]
    return s.join(b, "column_name", "full").withColumn("passed", reduce(lambda x, y: x & y, same))


def schema_parity(source: DataFrame, build: DataFrame, t: Target) -> DataFrame:
    n = schema_parity_rows(source, build, t).agg(
        F.count("src_ordinal").alias("s"), F.count("build_ordinal").alias("b"),
        F.count_if(~F.col("passed")).alias("bad"),
    )
    return result(n, t, "schema_parity", F.col("bad") == 0, F.col("s"), F.col("b"))


# --- 2 row counts -----------------------------------------------------------

def _side_counts(df: DataFrame, *group: str) -> DataFrame:
    return df.groupBy(*group).agg(
        F.count_if(F.col(SIGN) == 1).alias("src_rows"),
        F.count_if(F.col(SIGN) == -1).alias("build_rows"),
    )


def row_count(source: DataFrame, build: DataFrame, t: Target) -> DataFrame:
    cols = [t.keys[0] if t.keys else shared_columns(source, build, t)[0]]
    n = _side_counts(pinned(source, build, t, cols))
    return result(n, t, "row_count", F.col("src_rows") == F.col("build_rows"), F.col("src_rows"), F.col("build_rows"))


def partition_row_count(source: DataFrame, build: DataFrame, t: Target, part_cols: Sequence[str]) -> DataFrame:
    """Row counts of both sides per partition value; a side without rows counts 0."""
    n = _side_counts(pinned(source, build, t, part_cols), *part_cols)
    return n.withColumn("passed", F.col("src_rows") == F.col("build_rows"))


# --- 3 keys -----------------------------------------------------------------

def key_state(both: DataFrame, keys: Sequence[str], columns: Sequence[str] = ()) -> DataFrame:
    """Per key of a tagged union: rows of each side and, with ``columns``, the signed sums of two row hashes.

    The sums are zero when both sides hold the same rows for the key. Two hashes of
    64 bits make a false zero as unlikely as a collision of 128 bits.
    """
    aggs = []
    if columns:
        h = row_hash(columns)
        again = F.xxhash64(F.lit(1), *[F.col(c) for c in columns], h)
        aggs = [F.sum(F.when(F.col(SIGN) == 1, x.cast("decimal(38,0)")).otherwise(-x.cast("decimal(38,0)"))).alias(n) for n, x in (("__h1", h), ("__h2", again))]
    return both.groupBy(*keys).agg(
        F.count_if(F.col(SIGN) == 1).alias("src_rows"), F.count_if(F.col(SIGN) == -1).alias("build_rows"), *aggs
    )


def differing_keys(state: DataFrame) -> DataFrame:
    return state.where((F.col("src_rows") != F.col("build_rows")) | (F.col("__h1") != 0) | (F.col("__h2") != 0))


def key_parity_rows(source: DataFrame, build: DataFrame, t: Target) -> DataFrame:
    """Keys on one side only; whole rows for a table without a key."""
    keys = row_keys(t, shared_columns(source, build, t))
    return (
        key_state(pinned(source, build, t, keys), keys)
        .where((F.col("src_rows") == 0) | (F.col("build_rows") == 0))
        .withColumn("side", F.when(F.col("build_rows") == 0, "missing_in_build").otherwise("extra_in_build"))
        .select("side", *keys)
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def key_results(state: DataFrame, t: Target) -> DataFrame:
    """``key_parity`` and, when row hashes are there, ``row_level_sample``: one shuffle on the keys for both."""
    hashed = "__h1" in state.columns
    differs = (F.col("src_rows") != F.col("build_rows")) | (F.col("__h1") != 0) | (F.col("__h2") != 0) if hashed else F.lit(False)
    n = state.agg(
        F.count_if(F.col("build_rows") == 0).alias("missing"),
        F.count_if(F.col("src_rows") == 0).alias("extra"),
        F.count_if(F.col("src_rows") > 1).alias("src_dupes"),
        F.count_if(F.col("build_rows") > 1).alias("build_dupes"),
        F.count_if(differs).alias("differing"),
    )
    clean = (F.col("missing") == 0) & (F.col("extra") == 0)
    if t.keys:  # without a key, rows may repeat
        clean = clean & (F.col("src_dupes") == 0) & (F.col("build_dupes") == 0)
    rows = [_verdict(
        "key_parity", clean,
        F.concat(F.lit("missing="), "missing", F.lit(" dupes="), "src_dupes"),
        F.concat(F.lit("extra="), "extra", F.lit(" dupes="), "build_dupes"),
    )]
    if hashed:
        rows.append(_verdict(
            "row_level_sample", F.col("differing") == 0, F.lit("0"), F.concat(F.lit("differing_keys="), "differing")
        ))
    return n.select(F.lit(t.table).alias("table_name"), F.inline(F.array(*rows)))


def key_parity(source: DataFrame, build: DataFrame, t: Target) -> DataFrame:
    keys = row_keys(t, shared_columns(source, build, t))
    return key_results(key_state(pinned(source, build, t, keys), keys), t)


# --- 4 checksum -------------------------------------------------------------

def side_checksums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: row count and hash sum of each side of a tagged union."""
    h = row_hash(columns)
    src, build = F.col(SIGN) == 1, F.col(SIGN) == -1
    return df.agg(
        F.count_if(src).alias("src_rows"),
        F.count_if(build).alias("build_rows"),
        hash_sum(F.when(src, h)).alias("src_hash"),
        hash_sum(F.when(build, h)).alias("build_hash"),
    )


def _checksum_result(sums: DataFrame, t: Target, check: str) -> DataFrame:
    ok = (F.col("src_rows") == F.col("build_rows")) & F.col("src_hash").eqNullSafe(F.col("build_hash"))
    text = [F.concat_ws(":", F.col(f"{s}_rows").cast("string"), F.col(f"{s}_hash").cast("string")) for s in ("src", "build")]
    return result(sums, t, check, ok, *text)


def content_checksum(source: DataFrame, build: DataFrame, t: Target) -> DataFrame:
    cols = shared_columns(source, build, t)
    return _checksum_result(side_checksums(pinned(source, build, t, cols), cols), t, "content_checksum")


def soak_delta_parity(source: DataFrame, build: DataFrame, t: Target) -> DataFrame:
    """Count and checksum of the rows loaded in ``(prev, watermark]`` only."""
    cols = shared_columns(source, build, t)
    window = (t.watermark_col, t.prev_watermark, t.watermark)
    df = tagged(delta_window(source, *window), delta_window(build, *window), cols)
    return _checksum_result(side_checksums(df, cols), t, "soak_delta_parity")


# --- 5, 6 column profile ----------------------------------------------------

def side_summary(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """One wide row: rows, hash sum, and per column counts, extremes, sums and widest text.

    Without grouping keys: extremes of strings would turn a grouped aggregate into one
    that sorts every row first.
    """
    schema = df.schema
    aggs = [F.count("*").alias("__rows"), hash_sum(row_hash(columns)).alias("__hash")]
    for i, c in enumerate(columns):
        dtype = schema[c].dataType
        nothing = F.lit(None).cast("string")
        wide = isinstance(dtype, (T.StringType, T.DecimalType))
        aggs += [
            F.count(c).alias(f"cnt_{i}"),
            report_text(F.min(c), dtype).alias(f"min_{i}"),
            report_text(F.max(c), dtype).alias(f"max_{i}"),
            (exact_sum(F.col(c), dtype).cast("string") if is_numeric(dtype) else nothing).alias(f"sum_{i}"),
            (F.max(F.length(F.col(c).cast("string"))) if wide else F.lit(None).cast("int")).alias(f"wid_{i}"),
        ]
        if is_fractional(dtype):
            # Rounded figures are for the report; the hash sum of the values tells the least drift.
            v = F.col(c)
            aggs += [
                F.count_if(F.isnan(v)).alias(f"nan_{i}"), F.count_if(~is_finite(v) & ~F.isnan(v)).alias(f"inf_{i}"),
                hash_sum(F.when(v.isNotNull(), F.xxhash64(v + F.lit(0.0)))).cast("string").alias(f"hsh_{i}"),
            ]
        else:
            aggs += [F.lit(None).cast(k).alias(f"{n}_{i}") for n, k in (("nan", "bigint"), ("inf", "bigint"), ("hsh", "string"))]
        if approx:
            aggs.append(F.approx_count_distinct(c).alias(f"dis_{i}"))
    return df.agg(*aggs)


def unfold_summary(wide: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """The summary as one row per column, any other columns (a side's sign) kept."""
    parts = [c for c in wide.columns if c == SIGN]
    return wide.select(*parts, F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("column_name"),
            F.col("__rows").alias("row_count"),
            F.col(f"cnt_{i}").alias("non_null"),
            (F.col("__rows") - F.col(f"cnt_{i}")).alias("null_count"),
            F.col(f"min_{i}").alias("min_value"),
            F.col(f"max_{i}").alias("max_value"),
            F.col(f"sum_{i}").alias("sum_value"),
            F.col(f"nan_{i}").alias("nan_count"),
            F.col(f"inf_{i}").alias("infinite_count"),
            F.col(f"hsh_{i}").alias("value_hash"),
            *([F.col(f"dis_{i}").alias("distinct_count")] if approx else []),
        )
        for i, c in enumerate(columns)
    ])))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: distinct values, rows, and rows without a value.

    One narrow aggregate per column, side by side in one job. Together they read each
    column once, group typed values without expanding any row, and combine on the map
    side; several distinct counts in one aggregate would expand every row once per column.
    """
    def one(c: str) -> DataFrame:
        per_value = df.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
        return per_value.agg(
            F.count("v").alias("distinct_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        ).select(F.lit(c).alias("column_name"), "*")

    return reduce(DataFrame.unionAll, [one(c) for c in columns])


def _distinct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return value_counts(df, columns).select("column_name", "distinct_count")


def each_side(fn: Callable[[DataFrame], DataFrame], source: DataFrame, build: DataFrame) -> DataFrame:
    """``fn`` of both sides, tagged with the sign."""
    return fn(source).withColumn(SIGN, F.lit(1)).unionAll(fn(build).withColumn(SIGN, F.lit(-1)))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Profile of one table, one row per column: rows, non-null, null, distinct, min, max, sum."""
    columns = list(columns or df.columns)
    stats = unfold_summary(side_summary(df, columns, approx), columns, approx).drop("value_hash")
    # Both inputs have one row per column.
    return stats if approx else stats.join(_distinct(df, columns), "column_name")


_PROFILE = (
    "row_count", "non_null", "null_count", "min_value", "max_value", "sum_value", "nan_count", "infinite_count", "value_hash",
)


def _distinct_of_both(both: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column the distinct values of each side of a tagged union: one aggregate per column for both sides."""
    def one(c: str) -> DataFrame:
        per_value = both.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(
            F.max(SIGN).alias("hi"), F.min(SIGN).alias("lo")
        )
        return per_value.agg(
            F.count_if(F.col("hi") == 1).alias("src_distinct_count"), F.count_if(F.col("lo") == -1).alias("build_distinct_count")
        ).select(F.lit(c).alias("column_name"), "*")

    return reduce(DataFrame.unionAll, [one(c) for c in columns])


def column_parity_rows(source: DataFrame, build: DataFrame, t: Target) -> DataFrame:
    """Both profiles side by side, one row per column, with the two verdicts."""
    cols = shared_columns(source, build, t)
    sides = aligned(*_at_watermark(source, build, t), cols)
    profile = each_side(lambda df: unfold_summary(side_summary(df, cols), cols), *sides)
    return _side_by_side(profile, _distinct_of_both(tagged(*sides, cols), cols))


def _side_by_side(profile: DataFrame, distinct: DataFrame) -> DataFrame:
    # Both inputs have a row or two per column.
    both = profile.groupBy("column_name").agg(*[
        F.max(F.when(F.col(SIGN) == sign, F.col(x))).alias(f"{name}_{x}")
        for x in _PROFILE for name, sign in (("src", 1), ("build", -1))
    ]).join(distinct, "column_name")

    def same(*names: str):
        return reduce(lambda a, b: a & b, [F.col(f"src_{x}").eqNullSafe(F.col(f"build_{x}")) for x in names])

    return both.withColumn(
        "aggregates_ok",
        same("non_null", "distinct_count", "min_value", "max_value", "sum_value", "nan_count", "infinite_count", "value_hash"),
    ).withColumn("nulls_ok", same("null_count", "distinct_count"))


def _column_results(rows: DataFrame, t: Target) -> DataFrame:
    n = rows.agg(
        F.count("*").alias("n"),
        F.count_if("aggregates_ok").alias("agg_ok"),
        F.count_if("nulls_ok").alias("nul_ok"),
    )
    out = [
        result(n, t, check, F.col(ok) == F.col("n"), F.col("n"), F.col(ok))
        for check, ok in (("column_aggregates", "agg_ok"), ("null_distribution", "nul_ok"))
    ]
    return out[0].unionAll(out[1])


def column_aggregates(source: DataFrame, build: DataFrame, t: Target) -> DataFrame:
    return _column_results(column_parity_rows(source, build, t), t).where("check_name = 'column_aggregates'")


def null_distribution(source: DataFrame, build: DataFrame, t: Target) -> DataFrame:
    return _column_results(column_parity_rows(source, build, t), t).where("check_name = 'null_distribution'")


# --- 7 referential integrity ------------------------------------------------

def orphans(child: DataFrame, parent: DataFrame, fk: FK) -> DataFrame:
    """Foreign-key values without a parent, with the number of child rows.

    The child is counted per value first: a value carried by a third of all rows
    is one row in the join.
    """
    values = child.where(F.col(fk.col).isNotNull()).groupBy(F.col(fk.col).alias("fk_value")).agg(F.count("*").alias("n_rows"))
    keys = parent.select(F.col(fk.parent_key).alias("fk_value"))
    return values.join(keys, "fk_value", "left_anti")


def referential_integrity(child: DataFrame, parents: Mapping[str, DataFrame], fks: Sequence[FK], t: Target) -> DataFrame:
    """One result row for all foreign keys of the table; a table without any cannot break one."""
    if not fks:
        return result(child.sparkSession.range(1), t, "referential_integrity", F.lit(True), F.lit(0), F.lit("no foreign keys"))
    each = [
        orphans(as_of(child, t.watermark_col, t.watermark), parents[fk.parent_table], fk)
        .agg(F.count("*").alias("n_values"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))
        for fk in fks
    ]
    total = reduce(DataFrame.unionAll, each).agg(F.sum("n_values").alias("v"), F.sum("n_rows").alias("r"))
    return result(
        total, t, "referential_integrity", F.col("r") == 0,
        F.lit(0), F.concat(F.lit("orphan_values="), "v", F.lit(" orphan_rows="), "r"),
    )


# --- 8 no extra output ------------------------------------------------------

def extra_output_rows(build: DataFrame, contract: Sequence[str]) -> DataFrame:
    """Columns outside the contract, or missing from it, with the values they hold."""
    extra = [c for c in build.columns if c not in set(contract)]
    missing = [c for c in contract if c not in set(build.columns)]
    one = build.agg(*([F.count(c).alias(f"n_{i}") for i, c in enumerate(extra)] or [F.count("*").alias("n")]))
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.lit("extra").alias("problem"), F.col(f"n_{i}").alias("non_null"))
        for i, c in enumerate(extra)
    ] + [
        F.struct(F.lit(c).alias("column_name"), F.lit("missing").alias("problem"), F.lit(0).cast("bigint").alias("non_null"))
        for c in missing
    ]
    if not rows:
        return one.select(
            F.lit("").alias("column_name"), F.lit("").alias("problem"), F.lit(0).cast("bigint").alias("non_null")
        ).where(F.lit(False))
    return one.select(F.inline(F.array(*rows)))


def extra_tables(spark, database: str, contract: Sequence[str]) -> DataFrame:
    """Tables of a database that the contract does not name."""
    names = spark.sql(f"SHOW TABLES IN {database}").where("NOT isTemporary").select(F.col("tableName").alias("table_name"))
    return names.where(~F.col("table_name").isin(list(contract)))


def no_extra_output(build: DataFrame, contract: Sequence[str], t: Target) -> DataFrame:
    n = extra_output_rows(build, contract).agg(F.count("*").alias("bad"))
    return result(n, t, "no_extra_output", F.col("bad") == 0, F.lit(len(contract)), F.lit(len(build.columns)))


# --- 9 idempotency ----------------------------------------------------------

def idempotency(build_fn: Callable[[], DataFrame], t: Target) -> DataFrame:
    """Run the build twice; both outputs must have the same checksum."""
    first, second = build_fn(), build_fn()
    cols = first.columns
    return _checksum_result(side_checksums(tagged(first, second, cols), cols), t, "idempotency")


# --- 12 soak schedule, 14 tolerance -----------------------------------------

def soak_schedule(units: DataFrame, cert_col: str, days: Sequence[int] = (7, 14)) -> DataFrame:
    """Due date of every soak checkpoint of every certified unit."""
    return (
        units.where(F.col(cert_col).isNotNull())
        .withColumn("days_after_cert", F.explode(F.array(*[F.lit(d) for d in days])))
        .withColumn("checkpoint", F.concat(F.lit("T+"), F.col("days_after_cert").cast("string")))
        .withColumn("due_date", F.date_add(F.col(cert_col).cast("date"), F.col("days_after_cert")))
    )


def within_tolerance(counts: DataFrame, drift_col: str, total_col: str, fraction: float = 0.0) -> DataFrame:
    """Verdict per row of counts; 0 allows no drift at all. No rows: no drift."""
    share = F.when(F.col(total_col) > 0, F.col(drift_col) / F.col(total_col)).otherwise(F.lit(0.0))
    return counts.withColumn("drift_fraction", share).withColumn("within", share <= F.lit(float(fraction)))


# --- 13 phases --------------------------------------------------------------

def run_profile(
    env: str,
    source: DataFrame,
    build: DataFrame,
    t: Target,
    parents: Mapping[str, DataFrame] | None = None,
    fks: Sequence[FK] = (),
    contract: Sequence[str] | None = None,
    rebuild: Callable[[], DataFrame] | None = None,
    part_cols: Sequence[str] = (),
) -> DataFrame:
    """Result rows of every check of a phase (``dev``, ``sit`` or ``soak``), one per check of the phase, always.

    Tables without keys are compared as bags, tables without foreign keys pass that check. With
    ``part_cols`` the row counts must also agree for each of their values. Idempotency can only be
    shown by a second build: without ``rebuild`` it is red. A build that is a costly plan should be
    written first; every check reads it.
    """
    wanted = PROFILES[env]
    cols = shared_columns(source, build, t)
    both = pinned(source, build, t, cols)
    if "content_checksum" in wanted:
        # Schema widths, counts, checksum and column statistics are one aggregate over one
        # scan; its two rows are written, so that every check below reads them from there.
        sides = aligned(*_at_watermark(source, build, t), cols)
        one = materialize(each_side(lambda df: side_summary(df, cols), *sides), "summary")
        summary = _summary_results(one, source, build, cols, t)
        if part_cols:
            summary = summary.where("check_name <> 'row_count'").unionAll(_counted_parts(source, build, t, part_cols))
        distinct = _distinct_of_both(tagged(*sides, cols), cols)
        parts = [summary, _column_results(_side_by_side(unfold_summary(one, cols), distinct), t)]
    else:
        parts = [schema_parity(source, build, t)]
    parts.append(key_results(key_state(both, row_keys(t, cols), cols), t))
    parts.append(referential_integrity(build, parents or {}, fks, t))
    parts.append(no_extra_output(build, contract or source.columns, t))
    if rebuild is None:
        not_run = F.lit(None).cast("string")
        parts.append(result(build.sparkSession.range(1), t, "idempotency", F.lit(False), not_run, F.lit("not run")))
    elif "content_checksum" in wanted and t.watermark is None and set(build.columns) <= set(cols):
        # The summary already has the first build's checksum.
        parts.append(_idempotent(one, rebuild(), cols, source, t))
    else:
        parts.append(idempotency(rebuild, t))
    if "soak_delta_parity" in wanted:
        parts.append(soak_delta_parity(source, build, t))
    return reduce(DataFrame.unionAll, parts)


def _counted_parts(source: DataFrame, build: DataFrame, t: Target, part_cols: Sequence[str]) -> DataFrame:
    """``row_count`` over the values of the partition columns: all of them must agree."""
    n = partition_row_count(source, build, t, part_cols).agg(
        F.coalesce(F.sum("src_rows"), F.lit(0)).alias("s"), F.coalesce(F.sum("build_rows"), F.lit(0)).alias("b"),
        F.count_if(~F.col("passed")).alias("bad"),
    )
    return result(n, t, "row_count", F.col("bad") == 0, F.col("s"), F.concat(F.col("b").cast("string"), F.lit(" red_partitions="), "bad"))


def _idempotent(one: DataFrame, second: DataFrame, cols: Sequence[str], source: DataFrame, t: Target) -> DataFrame:
    """``idempotency`` from the first build's summary row and one pass over a second build."""
    again = aligned(source, second, cols)[1].agg(F.count("*").alias("n"), hash_sum(row_hash(cols)).alias("h"))
    first = one.where(F.col(SIGN) == -1).select(F.col("__rows").alias("src_rows"), F.col("__hash").alias("src_hash"))
    both = first.select("*", F.lit(None).cast("bigint").alias("build_rows"), F.lit(None).cast("decimal(38,0)").alias("build_hash")).unionAll(
        again.select(F.lit(None).cast("bigint"), F.lit(None).cast("decimal(38,0)"), "n", F.col("h").cast("decimal(38,0)"))
    ).agg(*[F.max(c).alias(c) for c in ("src_rows", "src_hash", "build_rows", "build_hash")])
    return _checksum_result(both, t, "idempotency")


def _summary_results(one: DataFrame, source: DataFrame, build: DataFrame, cols: Sequence[str], t: Target) -> DataFrame:
    """``schema_parity``, ``row_count`` and ``content_checksum`` from the summary rows of both sides."""
    src, new = F.col(SIGN) == 1, F.col(SIGN) == -1
    shape_ok = [(f.name, f.dataType) for f in source.schema] == [(f.name, f.dataType) for f in build.schema]

    def of(side, name: str):
        return F.max(F.when(side, F.col(name)))

    folded = one.agg(
        F.coalesce(of(src, "__rows"), F.lit(0)).alias("src_rows"), F.coalesce(of(new, "__rows"), F.lit(0)).alias("build_rows"),
        of(src, "__hash").alias("src_hash"), of(new, "__hash").alias("build_hash"),
        reduce(lambda a, b: a & b, [
            (of(src, f"wid_{i}").eqNullSafe(of(new, f"wid_{i}")))
            & ((of(src, "__rows") > of(src, f"cnt_{i}")).eqNullSafe(of(new, "__rows") > of(new, f"cnt_{i}")))
            for i in range(len(cols))
        ]).alias("widths_ok"),
    )
    same_n = F.col("src_rows") == F.col("build_rows")
    text = [F.concat_ws(":", F.col(f"{s}_rows").cast("string"), F.col(f"{s}_hash").cast("string")) for s in ("src", "build")]
    return folded.select(F.lit(t.table).alias("table_name"), F.inline(F.array(
        _verdict("schema_parity", F.lit(shape_ok) & F.col("widths_ok"), F.lit(len(source.columns)), F.lit(len(build.columns))),
        _verdict("row_count", same_n, F.col("src_rows"), F.col("build_rows")),
        _verdict("content_checksum", same_n & F.col("src_hash").eqNullSafe(F.col("build_hash")), *text),
    )))


def stamp(
    rows: DataFrame, unit: str, env: str, checkpoint: str, watermark: str | None, attempt: int, recorded_at,
    reason_code: str | None = None,
) -> DataFrame:
    """Result rows in the layout of the results table."""
    return rows.select(
        F.lit(unit).alias("pipeline"),
        F.lit(env).alias("env"),
        F.lit(checkpoint).alias("checkpoint"),
        "table_name",
        "check_name",
        F.lit(watermark).cast("string").alias("watermark"),
        "passed",
        "src_value",
        "build_value",
        F.when(~F.col("passed"), F.lit(reason_code).cast("string")).alias("reason_code"),
        F.lit(attempt).alias("attempt"),
        F.lit(recorded_at).cast("timestamp").alias("recorded_at"),
    )
