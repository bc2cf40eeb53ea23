"""Merges, change capture, history, deduplication and maintenance."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tableproof.operators.diff import row_diff
from tableproof.operators.filters import delta_window, typed_literal
from tableproof.session import fresh_path, materialize
from tableproof.target import Target, Watermark

OPEN_END = "9999-12-31"


def keys_match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def dedup(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Latest row per key: greatest ``order_by``, remaining columns break ties.

    ``max`` of a struct combines on the map side, so a key that holds a third of
    all rows reaches the shuffle as one row per task; a ranking window would put
    the whole group into one task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    best = F.max(F.struct(*order_by, *rest)).alias("__best")
    out = df.groupBy(*keys).agg(best)
    return out.select(*[F.col(c) if c in keys else F.col(f"__best.{c}").alias(c) for c in df.columns])


def scd1_merge(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert: matched rows take the update's columns, new keys are inserted.

    ``updates`` holds one row per key (``dedup`` first) and may lack columns, which
    then keep the target's value. The updates are written first: when they are few,
    the planner sends them to the target and the target is not shuffled at all,
    which a full outer join would always do.
    """
    u = materialize(updates, "updates")
    marked = u.withColumn("__u", F.lit(True))
    both = target.join(marked, keys_match(target, marked, keys), "left")
    kept = both.select(*[
        (F.when(F.col("__u"), marked[c]).otherwise(target[c]) if c in updates.columns and c not in keys else target[c]).alias(c)
        for c in target.columns
    ])
    found = u.select(*keys)
    found = target.select(*keys).join(found, keys_match(target, found, keys), "left_semi").distinct()
    new = u.join(found, keys_match(u, found, keys), "left_anti").select(*[
        F.col(c) if c in updates.columns else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in target.columns
    ])
    return kept.unionByName(new)


def neighbour(
    df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], bucket: Column, out: str, following: bool = False
) -> DataFrame:
    """Struct ``out`` of the previous (or following) row's ``values`` in ``order`` within ``keys``.

    The window runs per key and time bucket, so that a hot key spreads over its
    buckets. The edge row of a bucket is carried over into the key's next bucket
    that has rows, where it is the neighbour of the first row there; carried rows
    are dropped again. ``order`` must be unique within a key. ``df`` is read twice:
    pass a stored table.
    """
    shift = F.lead if following else F.lag
    edge = F.min_by if following else F.max_by
    payload = F.struct(*values)
    rows = df.withColumn("__bucket", bucket).withColumn("__payload", payload).withColumn("__carried", F.lit(False))
    edges = rows.groupBy(*keys, "__bucket").agg(
        edge("__payload", F.col(order)).alias("__payload"), edge(F.col(order), F.col(order)).alias(order)
    )
    # One row per key and bucket: bounded by the time span, however many rows a key has.
    onward = (F.lag if following else F.lead)("__bucket").over(Window.partitionBy(*keys).orderBy("__bucket"))
    carried = edges.withColumn("__bucket", onward).where(F.col("__bucket").isNotNull()).withColumn("__carried", F.lit(True))
    local = Window.partitionBy(*keys, "__bucket").orderBy(order)
    both = rows.unionByName(carried, allowMissingColumns=True).withColumn(out, shift("__payload").over(local))
    return both.where(~F.col("__carried")).select(*df.columns, out)


def scd2_merge(
    target: DataFrame, updates: DataFrame, keys: Sequence[str], tracked: Sequence[str], eff_col: str, bucket: str = "day"
) -> DataFrame:
    """Historised merge: ``effective_from``, ``effective_to``, ``is_active``.

    ``updates`` carries keys, tracked columns and ``eff_col``, any number of changes
    per key and in any order. The history of the touched keys is laid out anew with
    the changes at their place in time, late ones included; versions that repeat
    their predecessor are dropped; untouched keys pass through.
    """
    cols = [*keys, *tracked, "effective_from", "effective_to", "is_active"]
    from_type = target.schema["effective_from"].dataType
    touched = materialize(updates.select(*keys).distinct(), "scd2-touched")
    match = keys_match(target, touched, keys)
    untouched = target.join(touched, match, "left_anti").select(*cols)
    versions = target.join(touched, match, "left_semi").select(
        *keys, "effective_from", F.struct(F.lit(0).alias("src"), *tracked).alias("v")
    ).unionAll(updates.select(
        *keys, F.col(eff_col).cast(from_type).alias("effective_from"), F.struct(F.lit(1).alias("src"), *tracked).alias("v")
    ))
    # One version per key and moment; an update replaces the stored one.
    versions = versions.groupBy(*keys, "effective_from").agg(F.max("v").alias("v"))
    versions = versions.select(*keys, "effective_from", *[F.col(f"v.{c}").alias(c) for c in tracked])
    versions = materialize(versions.withColumn("__now", F.struct(*tracked)), "scd2-versions")
    time_bucket = F.date_trunc(bucket, F.col("effective_from").cast("timestamp"))
    seen = neighbour(versions, keys, "effective_from", ["__now"], time_bucket, "__before")
    changed = seen.where(
        F.col("__before").isNull() | ~F.col("__before.__now").eqNullSafe(F.col("__now"))
    ).drop("__before", "__now")
    changed = materialize(changed, "scd2-changed")
    dated = neighbour(changed, keys, "effective_from", ["effective_from"], time_bucket, "__next", following=True)
    history = dated.select(
        *keys, *tracked, "effective_from",
        F.coalesce(F.col("__next.effective_from"), F.lit(OPEN_END).cast(from_type)).alias("effective_to"),
        F.col("__next").isNull().alias("is_active"),
    )
    return untouched.unionByName(history)


def delta_apply(target: DataFrame, changes: DataFrame, keys: Sequence[str], op_col: str, seq_col: str) -> DataFrame:
    """Apply I/U/D changes: the last change per key by sequence decides.

    The collapsed changes are written first: few changes are sent to the target,
    which then is not shuffled.
    """
    cols = target.columns
    last = changes.groupBy(*keys).agg(
        F.max(F.struct(seq_col, op_col, *[c for c in cols if c not in keys])).alias("__last")
    )
    last = materialize(last, "last-changes")
    gone = last.select(*keys)
    kept = target.join(gone, keys_match(target, gone, keys), "left_anti")
    new = last.where(F.col(f"__last.{op_col}") != "D").select(
        *[F.col(c) if c in keys else F.col(f"__last.{c}").alias(c) for c in cols]
    )
    return kept.unionByName(new)


def cdc_snapshot(prev: DataFrame, curr: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Change rows that turn ``prev`` into ``curr``: I, U with new values, D with the old ones."""
    diff = row_diff(prev, curr, Target("snapshot", tuple(keys)))
    values = [c for c in prev.columns if c not in keys]
    if not keys:  # whole rows come and go, repeated ones as often as they do
        diff = diff.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("bigint"), "n_rows"))).drop("__n")
    op = F.when(F.col("change") == "changed", "U").when(F.col("change") == "missing_in_build", "D").otherwise("I")
    row = F.when(F.col("change") == "missing_in_build", F.col("src")).otherwise(F.col("build"))
    return diff.select(op.alias("op"), *keys, row.alias("__row")).select("op", *keys, *[F.col(f"__row.{c}").alias(c) for c in values])


def retention_purge(df: DataFrame, ts_col: str, days: int, as_of: Watermark) -> DataFrame:
    """Rows newer than ``as_of - days``, and rows of unknown age; the date is an argument, never the clock."""
    return df.where((F.col(ts_col) > _horizon(df, ts_col, days, as_of)) | F.col(ts_col).isNull())


def _horizon(df: DataFrame, ts_col: str, days: int, as_of: Watermark) -> Column:
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    return typed_literal(df, ts_col, as_of - dt.timedelta(days=days))


def purge_report(df: DataFrame, ts_col: str, days: int, as_of: Watermark, group: str) -> DataFrame:
    """Kept, purged and undated (always kept) rows per group."""
    old = F.col(ts_col) <= _horizon(df, ts_col, days, as_of)
    return df.groupBy(group).agg(
        F.count_if(~old).alias("kept"), F.count_if(old).alias("purged"), F.count_if(F.col(ts_col).isNull()).alias("undated")
    )


def copy_table(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    return df if predicate is None else df.where(predicate)


def backfill(
    current: DataFrame, rebuild: Callable[[DataFrame], DataFrame], source: DataFrame, watermark_col: str, prev: Watermark, watermark: Watermark
) -> DataFrame:
    """Recompute ``(prev, watermark]`` from the source and replace only that window."""
    lo, hi = typed_literal(current, watermark_col, prev), typed_literal(current, watermark_col, watermark)
    col = F.col(watermark_col)
    outside = current.where((col <= lo) | (col > hi) | col.isNull())
    return outside.unionByName(rebuild(delta_window(source, watermark_col, prev, watermark)))


def advance_watermark(control: DataFrame, loads: DataFrame, run_ts: dt.datetime) -> DataFrame:
    """New control rows: greatest loaded watermark per table; tables without loads keep theirs.

    ``loads`` has ``table_name`` and ``wm``; it is combined per table before the join.
    """
    high = loads.groupBy("table_name").agg(F.max("wm").alias("new_wm"))
    stamp = F.lit(run_ts.isoformat(sep=" ")).cast("timestamp_ntz")
    return control.join(high, "table_name", "left").select(
        "table_name",
        "watermark_col",
        F.greatest("watermark_value", "new_wm").alias("watermark_value"),
        F.when(F.col("new_wm").isNotNull(), stamp).otherwise(F.col("last_run_ts")).alias("last_run_ts"),
        F.when(F.col("new_wm").isNotNull(), "SUCCESS").otherwise(F.col("status")).alias("status"),
    )


def sql_steps(spark: SparkSession, inputs: Mapping[str, DataFrame], steps: Sequence[tuple[str, str]]) -> DataFrame:
    """Named SQL steps in order; a step sees the inputs and every earlier step. Returns the last.

    Steps name each other as ``{name}``, which stands for this run's own frame: no view is
    left in the session, so runs with the same step names cannot meet.
    """
    known = dict(inputs)
    for name, sql in steps:
        used = {n: df for n, df in known.items() if "{" + n + "}" in sql}
        known[name] = spark.sql(sql, **used)
    return known[steps[-1][0]]


def dynamic_sql_expand(spark: SparkSession, config: DataFrame, template: str, per_job: int = 100) -> DataFrame:
    """One SELECT per configuration row, all in one result.

    Each SELECT is a plan of its own, so configuration rows pass through the driver, one by one, and
    every ``per_job`` of them run as one job that appends to a table: plans stay small however many rows there
    are. For one template over one table, joining the table with the configuration is cheaper.
    """
    path, schema = fresh_path(spark, "expanded"), None
    rows = config.toLocalIterator()
    while chunk := list(islice(rows, per_job)):
        part = reduce(DataFrame.unionByName, [spark.sql(template.format(**r.asDict())) for r in chunk])
        part.write.mode("append").parquet(path)
        schema = schema or part.schema
    if schema is None:
        raise ValueError("no configuration rows")
    return spark.read.schema(schema).parquet(path)


def dim_date(bounds: DataFrame, from_col: str, to_col: str) -> DataFrame:
    """Calendar rows from the first to the last day of a one-row bounds table."""
    days = bounds.select(F.explode(F.sequence(F.col(from_col).cast("date"), F.col(to_col).cast("date"))).alias("cal_date"))
    return days.select(
        F.date_format("cal_date", "yyyyMMdd").cast("int").alias("date_key"),
        "cal_date",
        F.dayofweek("cal_date").alias("day_of_week"),
        F.month("cal_date").alias("month"),
        F.quarter("cal_date").alias("quarter"),
        F.year("cal_date").alias("year"),
    )


def sessionize(events: DataFrame, user_col: str, ts_col: str, gap_seconds: int) -> DataFrame:
    """Sessions per user: events at most ``gap_seconds`` apart belong together.

    Events within one time slot of that width always do, so they are first counted per user and slot,
    combined on the map side: a hot user is one row per slot. Slots of a user are at most as many as the
    time span has, and only they go through a window that joins them up.
    """
    micros = max(1, gap_seconds * 1_000_000)
    at = F.unix_micros(F.col(ts_col).cast("timestamp"))
    partial = events.groupBy(user_col, (at - F.pmod(at, F.lit(micros))).alias("__slot")).agg(
        F.min(ts_col).alias("start"), F.max(ts_col).alias("last"), F.count("*").alias("views")
    ).where(F.col("start").isNotNull())
    gap = F.expr(f"INTERVAL {gap_seconds} SECONDS")
    chain = Window.partitionBy(user_col).orderBy("start")
    joined = (
        partial.withColumn("__prev", F.lag("last").over(chain))
        .withColumn("__new", (F.col("__prev").isNull() | (F.col("start") > F.col("__prev") + gap)).cast("int"))
        .withColumn("__no", F.sum("__new").over(chain.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    return joined.groupBy(user_col, "__no").agg(
        F.min("start").alias("session_start"), F.max("last").alias("session_last"), F.sum("views").alias("page_views")
    ).select(
        F.xxhash64(user_col, "session_start").alias("session_key"),
        user_col,
        "session_start",
        (F.col("session_last") + gap).alias("session_end"),
        "page_views",
    )


def replace_window(df: DataFrame, path: str, partition_col: str) -> None:
    """Overwrite only the partitions that ``df`` contains."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_col).parquet(path)
