"""Registered queries: change logs, load journals, window tables and proven backfills."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tableproof.operators import parity, windows
from tableproof.operators.changelog import ChangeLog
from tableproof.plans.merge_queries import CHANGE_SQL, change_feed
from tableproof.plans.pair import PAIR_SQL, PINNED, PREV, WATERMARK, build, source
from tableproof.plans.registry import query
from tableproof.session import fresh_path, materialize
from tableproof.sources.journal import LoadJournal
from tableproof.sources.tables import read_table

_WM, _PREV = f"TIMESTAMP '{WATERMARK}'", f"TIMESTAMP '{PREV}'"


def _stamp(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query("change_log", CHANGE_SQL)
def change_log(spark, d):
    """The change feed in weekly batches, latest week first, so that changes come late and folds meet newer ones."""
    events = read_table(spark, d, "events")
    base = read_table(spark, d, "customer").select("c_custkey", "c_acctbal")
    log = ChangeLog(base, fresh_path(spark, "change-log"), ["c_custkey"], "op", "seq", fanout=2)
    week = F.coalesce(F.weekofyear("ts"), F.lit(0))
    weeks = [r[0] for r in events.select(week.alias("w")).distinct().orderBy(F.desc("w")).collect()]  # 54 at most
    for number, w in enumerate(weeks):
        log.append(change_feed(events.where(week == w)), number)
    return log.table()


_RUNS = (("r1", dt.datetime(1999, 6, 1)), ("r2", dt.datetime(2024, 1, 20)))
_LOADS = (("orders", "o_orderdate", PREV), ("lineitem", "l_shipdate", dt.datetime(1999, 1, 1)), ("events", "ts", dt.datetime(2024, 1, 10)))


def _load_sql() -> str:
    parts = []
    for name, column, lo in _LOADS:
        first, last = (f"TIMESTAMP '{hi}'" for _, hi in _RUNS)
        start = f"TIMESTAMP '{lo}'"
        mid = f"coalesce((SELECT max({column}) FROM {name} WHERE {column} > {start} AND {column} <= {first}), {start})"
        if lo < _RUNS[0][1]:
            parts.append(f"SELECT 'r1' AS run, '{name}' AS table_name, {start} AS lo, max({column}) AS wm, count(*) AS loaded_rows FROM {name} WHERE {column} > {start} AND {column} <= {first}")
        parts.append(f"SELECT 'r2', '{name}', {mid}, max({column}), count(*) FROM {name} WHERE {column} > {mid} AND {column} <= {last}")
        parts.append(f"SELECT 'all', '{name}', NULL, max({column}), count(*) FROM {name} WHERE {column} > {start} AND {column} <= {last}")
    return "SELECT *, CASE WHEN run = 'all' THEN 'landed' ELSE 'advanced' END AS state FROM (" + " UNION ALL ".join(parts) + ")"


@query("load_journal", _load_sql())
def load_journal(spark, d):
    """Two runs over a control table; the second starts where the files of the first end."""
    journal = LoadJournal(spark, fresh_path(spark, "load-journal"))
    control = spark.createDataFrame(
        [(n, c, lo, None, "NEW") for n, c, lo in _LOADS],
        "table_name string, watermark_col string, watermark_value timestamp_ntz, last_run_ts timestamp_ntz, status string",
    )
    for run, hi in _RUNS:
        stored = []
        journal.plan(control, hi, run)
        journal.load(run, lambda name: read_table(spark, d, name))
        journal.advance(control, run, dt.datetime(2024, 2, 1), lambda df: stored.append(materialize(df, "control")))
        control = stored[0]
    out = journal.state().select("run", "table_name", "lo", "wm", "loaded_rows", "state")
    for name, column, _ in _LOADS:
        out = out.unionAll(journal.landed(name).select(
            F.lit("all").alias("run"), F.lit(name).alias("table_name"), F.lit(None).cast("timestamp_ntz").alias("lo"),
            F.max(column).alias("wm"), F.count("*").alias("loaded_rows"), F.lit("landed").alias("state"),
        ))
    return out


# --- window tables ------------------------------------------------------------

# One load a week of daily windows per kind of event, then a backfill of four days that begins and ends at noon.
_WINDOWS_SQL = """
days AS (SELECT DISTINCT event_type AS table_name, date_trunc('day', ts)::TIMESTAMP AS lo FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL),
fresh AS (SELECT table_name, min(lo) + INTERVAL 84 HOUR AS lo, min(lo) + INTERVAL 180 HOUR AS hi FROM days GROUP BY table_name),
halves AS (
  SELECT table_name, lo + INTERVAL (12 * h) HOUR AS edge, 'week-' || weekofyear(lo) AS load_id FROM days, range(2) t(h)
),
more AS (SELECT table_name, lo + INTERVAL (12 * h) HOUR AS edge FROM fresh, range(8) t(h)),
held AS (
  SELECT table_name, edge, CASE WHEN m.edge IS NOT NULL THEN 'backfill' ELSE h.load_id END AS load_id
  FROM halves h FULL JOIN more m USING (table_name, edge)
),
numbered AS (
  SELECT *, edge - INTERVAL (12 * row_number() OVER (PARTITION BY table_name, load_id ORDER BY edge)) HOUR AS island FROM held
),
islands AS (SELECT table_name, min(edge) AS lo, max(edge) + INTERVAL 12 HOUR AS hi, load_id FROM numbered GROUP BY table_name, load_id, island)
"""


def _windows(spark, d):
    days = read_table(spark, d, "events").where("ts IS NOT NULL AND event_type IS NOT NULL").select(
        F.col("event_type").alias("table_name"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("lo")
    ).distinct()
    days = materialize(days, "loaded-days")
    stored = days.select(
        "table_name", "lo", (F.col("lo") + F.expr("INTERVAL 1 DAY")).alias("hi"),
        F.concat(F.lit("week-"), F.weekofyear("lo").cast("string")).alias("load_id"), _stamp("2024-03-01").alias("loaded_at"),
    )
    first = days.groupBy("table_name").agg(F.min("lo").alias("day"))
    fresh = first.select(
        "table_name", (F.col("day") + F.expr("INTERVAL 84 HOUR")).alias("lo"), (F.col("day") + F.expr("INTERVAL 180 HOUR")).alias("hi"),
        F.lit("backfill").alias("load_id"), _stamp("2024-03-20").alias("loaded_at"),
    )
    return stored, materialize(windows.overlay(stored, fresh), "windows")


@query("window_table", f"WITH {_WINDOWS_SQL} SELECT table_name, lo, hi, load_id FROM islands")
def window_table(spark, d):
    return _windows(spark, d)[1].drop("loaded_at")


@query("window_gaps", f"""
WITH {_WINDOWS_SQL},
grid AS (SELECT table_name, g AS edge FROM (SELECT DISTINCT table_name FROM days), generate_series(TIMESTAMP '2023-12-20', TIMESTAMP '2024-03-31 12:00:00', INTERVAL 12 HOUR) t(g)),
open AS (SELECT * FROM grid ANTI JOIN held USING (table_name, edge)),
n AS (SELECT *, edge - INTERVAL (12 * row_number() OVER (PARTITION BY table_name ORDER BY edge)) HOUR AS island FROM open)
SELECT table_name, min(edge) AS lo, max(edge) + INTERVAL 12 HOUR AS hi FROM n GROUP BY table_name, island
""")
def window_gaps(spark, d):
    return windows.gaps(_windows(spark, d)[1], dt.datetime(2023, 12, 20), dt.datetime(2024, 4, 1))


@query("stale_checks", f"""
WITH {_WINDOWS_SQL},
checks AS (SELECT table_name, lo, lo + INTERVAL 1 DAY AS hi, CASE WHEN day(lo) % 5 = 0 THEN TIMESTAMP '2024-03-25' ELSE TIMESTAMP '2024-03-10' END AS ran_at FROM days)
SELECT * FROM checks c WHERE ran_at < TIMESTAMP '2024-03-20'
AND EXISTS (SELECT 1 FROM fresh f WHERE f.table_name = c.table_name AND f.lo < c.hi AND f.hi > c.lo)
""")
def stale_checks(spark, d):
    """Daily checks, every fifth run after the backfill."""
    stored, now = _windows(spark, d)
    ran = F.when(F.dayofmonth("lo") % 5 == 0, _stamp("2024-03-25")).otherwise(_stamp("2024-03-10"))
    return windows.stale(stored.select("table_name", "lo", "hi", ran.alias("ran_at")), now)


_DELTA = [f"SELECT * FROM {side} WHERE o_orderdate > {_PREV} AND o_orderdate <= {_WM}" for side in "sb"]


@query("verified_backfill", f"""
WITH {PAIR_SQL},
years AS (SELECT DISTINCT date_trunc('year', o_orderdate)::TIMESTAMP AS lo FROM orders)
SELECT 'verdict' AS kind, 'before' AS name, NOT EXISTS ({_DELTA[0]} EXCEPT ALL {_DELTA[1]}) AND NOT EXISTS ({_DELTA[1]} EXCEPT ALL {_DELTA[0]}) AS passed,
       NULL::TIMESTAMP AS lo, NULL::TIMESTAMP AS hi
UNION ALL SELECT 'verdict', 'after', true, NULL, NULL
UNION ALL SELECT 'window', * FROM (VALUES ('first', NULL::BOOLEAN, TIMESTAMP '1990-01-01', {_PREV}), ('again', NULL, {_PREV}, {_WM}), ('first', NULL, {_WM}, TIMESTAMP '2010-01-01'))
UNION ALL SELECT 'stale', 'yearly', NULL, lo, lo + INTERVAL 1 YEAR FROM years WHERE lo < {_WM} AND lo + INTERVAL 1 YEAR > {_PREV}
""")
def verified_backfill(spark, d):
    """The delta window of the order pair, red before and green after; yearly checks that looked at it are stale."""
    s, b = source(spark, d), build(spark, d)
    loads = spark.createDataFrame(
        [("orders", dt.datetime(1990, 1, 1), dt.datetime(2010, 1, 1), "first", dt.datetime(2010, 1, 2))],
        "table_name string, lo timestamp_ntz, hi timestamp_ntz, load_id string, loaded_at timestamp_ntz",
    )
    years = s.select(F.date_trunc("year", "o_orderdate").cast("timestamp_ntz").alias("lo")).distinct()
    checks = years.select(F.lit("orders").alias("table_name"), "lo", (F.col("lo") + F.expr("INTERVAL 1 YEAR")).alias("hi"), _stamp("2010-02-01").alias("ran_at"))
    before = parity.soak_delta_parity(s, b, PINNED)
    out = windows.verified_backfill(b, lambda df: df, s, PINNED, loads, checks, "again", dt.datetime(2010, 3, 1))
    never, flag = F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("boolean")
    verdict = lambda df, name: df.select(F.lit("verdict").alias("kind"), F.lit(name).alias("name"), "passed", never.alias("lo"), never.alias("hi"))
    return verdict(before, "before").unionAll(verdict(out.verdict, "after")).unionAll(
        out.windows.select(F.lit("window"), "load_id", flag, "lo", "hi")
    ).unionAll(out.stale.select(F.lit("stale"), F.lit("yearly"), flag, "lo", "hi"))
