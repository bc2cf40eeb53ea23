"""Which half-open windows ``(lo, hi]`` of a table were loaded, by which load, and which checks that makes stale.

A window table has ``table_name``, ``lo``, ``hi``, ``load_id`` and ``loaded_at``; its windows do not overlap. A table has as
many rows as loads, never as many as data rows, so one sorted pass per table lays them out.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from tableproof.operators.filters import typed_literal
from tableproof.operators.merge import backfill
from tableproof.operators.parity import soak_delta_parity
from tableproof.session import materialize
from tableproof.target import Target, Watermark

_COLUMNS = ("table_name", "lo", "hi", "load_id", "loaded_at")


def _edges(windows: DataFrame, side: str, other: str) -> DataFrame:
    """Both ends of every window; windows without an extent are left out."""
    load = F.struct("load_id", "loaded_at")
    some = windows.where("lo < hi")
    state = F.struct(F.col("open"), F.col("load"))
    ends = some.select("table_name", F.col("lo").alias("at"), F.lit(True).alias("open"), load.alias("load")).unionAll(
        some.select("table_name", "hi", F.lit(False), F.when(F.lit(False), load))
    )
    nothing = F.when(F.lit(False), state)
    return ends.select("table_name", "at", state.alias(side), nothing.alias(other))


def overlay(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """``stored`` with the ``fresh`` windows laid over: covered parts are cut out, neighbours of one load merged.

    Neither input may overlap itself within a table. No windows are joined: per table the edges are passed in order,
    and the last edge of either side tells which load holds the stretch up to the next edge.
    """
    order = Window.partitionBy("table_name").orderBy("at")
    edges = _edges(stored, "old", "new").unionByName(_edges(fresh, "new", "old"))
    # Where one window ends and the next begins, the beginning counts.
    edges = edges.groupBy("table_name", "at").agg(F.max("old").alias("old"), F.max("new").alias("new"))
    now = edges.select(
        "table_name", F.col("at"), F.lead("at").over(order).alias("until"),
        F.last("old", ignorenulls=True).over(order).alias("old"), F.last("new", ignorenulls=True).over(order).alias("new"),
    )
    load = F.when(F.col("new.open"), F.col("new.load")).when(F.col("old.open"), F.col("old.load"))
    held = now.select("table_name", "at", "until", load.alias("load")).where(F.col("load").isNotNull() & F.col("until").isNotNull())
    same = F.lag("load").over(order).eqNullSafe(F.col("load")) & F.lag("until").over(order).eqNullSafe(F.col("at"))
    runs = held.withColumn("starts", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("starts").over(order))
    return runs.groupBy("table_name", "run").agg(
        F.min("at").alias("lo"), F.max("until").alias("hi"), F.first("load").alias("load")
    ).select("table_name", "lo", "hi", "load.load_id", "load.loaded_at")


def gaps(windows: DataFrame, lo: Watermark, hi: Watermark) -> DataFrame:
    """Stretches of ``(lo, hi]`` that no load covers, per table that has a window; ``windows`` must not overlap."""
    first, last = typed_literal(windows, "lo", lo), typed_literal(windows, "hi", hi)
    cut = windows.select("table_name", F.greatest("lo", first).alias("lo"), F.least("hi", last).alias("hi"))
    ends = windows.select("table_name").distinct().select("table_name", last.alias("lo"), last.alias("hi"))
    order = Window.partitionBy("table_name").orderBy("lo", "hi")
    before = F.greatest(F.coalesce(F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), first), first)
    return cut.unionAll(ends).select("table_name", before.alias("lo"), F.col("lo").alias("hi")).where("lo < hi")


def stale(checks: DataFrame, windows: DataFrame) -> DataFrame:
    """Checks (``table_name``, ``lo``, ``hi``, ``ran_at``) that overlap a window loaded after they ran.

    A semi-join: it stops at the first such window and writes no pairs.
    """
    w = windows.select(F.col("table_name").alias("t"), F.col("lo").alias("a"), F.col("hi").alias("b"), "loaded_at")
    overlap: Column = (F.col("a") < F.col("hi")) & (F.col("b") > F.col("lo"))
    return checks.join(w, (F.col("table_name") == F.col("t")) & overlap & (F.col("loaded_at") > F.col("ran_at")), "left_semi")


class Backfilled(NamedTuple):
    table: DataFrame
    verdict: DataFrame
    windows: DataFrame
    stale: DataFrame


def verified_backfill(
    current: DataFrame, rebuild: Callable[[DataFrame], DataFrame], source: DataFrame, t: Target,
    windows: DataFrame, checks: DataFrame, load_id: str, loaded_at: dt.datetime,
) -> Backfilled:
    """Replace the target's delta window, prove it again, and name the checks that looked at the replaced rows.

    The new table is written once; the verdict of ``soak_delta_parity`` is that of the written rows. A red
    verdict leaves the window recorded, because the rows were replaced: its checks are stale either way.
    """
    table = materialize(backfill(current, rebuild, source, t.watermark_col, t.prev_watermark, t.watermark), "backfilled")
    lo, hi = typed_literal(windows, "lo", t.prev_watermark), typed_literal(windows, "hi", t.watermark)
    stamp = typed_literal(windows, "loaded_at", loaded_at)
    row = current.sparkSession.range(1).select(
        F.lit(t.table).alias("table_name"), lo.alias("lo"), hi.alias("hi"), F.lit(load_id).alias("load_id"), stamp.alias("loaded_at")
    )
    mine = checks.where(F.col("table_name") == t.table)
    return Backfilled(table, soak_delta_parity(source, table, t), overlay(windows.select(*_COLUMNS), row), stale(mine, row))
