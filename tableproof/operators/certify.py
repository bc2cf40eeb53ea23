"""Gates, certification states, dashboard views and monitors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tableproof.operators.parity import CHECKS, PROFILES, SAMPLE_CHECKS


def _green(env: str, checks: Sequence[str], checkpoint: str | None = None) -> Column:
    """All of the checks are recorded and passed; a missing check is red.

    Passed checks are folded into one integer, a bit per check, so that nothing is
    gathered per pipeline.
    """
    hit = (F.col("env") == env) & F.col("check_name").isin(list(checks))
    if checkpoint is not None:
        hit = hit & (F.col("checkpoint") == checkpoint)
    bit = reduce(lambda w, i: w.when(F.col("check_name") == checks[i], 1 << i), range(1, len(checks)), F.when(F.col("check_name") == checks[0], 1))
    seen = F.coalesce(F.bit_or(F.when(hit & F.col("passed"), bit)), F.lit(0))
    red = F.count_if(hit & ~F.coalesce("passed", F.lit(False)))
    return (seen == (1 << len(checks)) - 1) & (red == 0)


def latest_attempt(results: DataFrame) -> DataFrame:
    """The last attempt of every check counts; earlier ones are history."""
    keys = ["pipeline", "env", "checkpoint", "table_name", "check_name"]
    return results.groupBy(*keys).agg(F.max_by("passed", "attempt").alias("passed"))


def pipeline_gate(
    results: DataFrame,
    contract: DataFrame | None = None,
    checkpoints: Sequence[str] = ("T+7", "T+14"),
    require_both: bool = True,
    require_soak: bool = True,
) -> DataFrame:
    """State per pipeline from its check rows: BLOCKED, PROVISIONAL or CERTIFIED.

    Checks are folded per table, and a pipeline is as green as its least table. ``contract``
    (pipeline, table_name) names the tables that must be proved: one without rows is red, and
    so is a pipeline that has none. Soak checkpoints need the delta check beside the ten.
    """
    soak = [_green("soak", PROFILES["soak"], c) for c in checkpoints]
    tables = latest_attempt(results).groupBy("pipeline", "table_name").agg(
        _green("dev", SAMPLE_CHECKS).alias("dev_ok"),
        _green("sit", CHECKS).alias("sit_ok"),
        (reduce(lambda a, b: a & b, soak) if soak else F.lit(False)).alias("soak_ok"),
        (F.count_if(F.col("env") == "soak") > 0).alias("soaked"),
    )
    if contract is not None:
        wanted = contract.select("pipeline", "table_name").distinct()
        tables = wanted.join(tables, ["pipeline", "table_name"], "full")
    red = F.lit(False)
    per = tables.groupBy("pipeline").agg(
        *[F.bool_and(F.coalesce(c, red)).alias(c) for c in ("dev_ok", "sit_ok", "soak_ok")],
        F.bool_or(F.coalesce("soaked", red)).alias("soaked"),
    )
    build_ok = F.col("dev_ok") & F.col("sit_ok") if require_both else F.col("sit_ok")
    soaking = F.lit(require_soak) & ~F.col("soak_ok")
    return per.select(
        "pipeline",
        F.when(F.col("dev_ok"), "PASS").otherwise("FAIL").alias("dev_state"),
        F.when(F.col("sit_ok"), "PASS").otherwise("FAIL").alias("sit_state"),
        F.when(~build_ok, "PENDING")
        .when(soaking, F.when(F.col("soaked"), "FAIL").otherwise("PENDING"))
        .otherwise(F.when(F.col("soak_ok"), "PASS").otherwise("N/A")).alias("soak_state"),
        F.when(~build_ok, "BLOCKED").when(soaking, "PROVISIONAL").otherwise("CERTIFIED").alias("status"),
    )


def certification_record(
    gates: DataFrame, watermarks: DataFrame, by: str, evidence: Column, soak: DataFrame | None = None,
    checkpoints: Sequence[str] = ("T+7", "T+14"),
) -> DataFrame:
    """Frozen evidence row of every certified pipeline (``watermarks``: pipeline, watermark).

    ``soak`` (pipeline, checkpoint, passed) gives ``soak_windows``, the green checkpoints in their order.
    """
    out = gates.where("status = 'CERTIFIED'").join(watermarks, "pipeline", "left")
    if soak is None:
        out = out.withColumn("soak_windows", F.lit(""))
    else:
        green = soak.groupBy("pipeline").agg(F.concat_ws(";", *[
            F.max(F.when((F.col("checkpoint") == c) & F.col("passed"), c)) for c in checkpoints
        ]).alias("soak_windows"))
        out = out.join(green, "pipeline", "left")
    return out.select(
        "pipeline", "watermark", F.lit(by).alias("certified_by"), evidence.alias("evidence"),
        F.lit(";".join(CHECKS)).alias("checks"), F.coalesce("soak_windows", F.lit("")).alias("soak_windows"), "status",
    )


def system_state(gates: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """One row for the whole system (``reports``: obj_id, done)."""
    g = gates.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "CERTIFIED").alias("certified"),
        F.count_if(F.col("status") == "PROVISIONAL").alias("provisional"),
    ).withColumn("blocked", F.col("total") - F.col("certified") - F.col("provisional"))
    if reports is None:
        b = g.select(F.lit(0).cast("bigint").alias("reports_done"), F.lit(0).cast("bigint").alias("reports_total"))
    else:
        b = reports.agg(F.count_if("done").alias("reports_done"), F.count("*").alias("reports_total"))
    # Two one-row aggregates: their union folded into one row needs no join.
    one = g.unionByName(b, allowMissingColumns=True).agg(*[
        F.max(c).alias(c) for c in ("total", "certified", "provisional", "blocked", "reports_done", "reports_total")
    ])
    complete = (F.col("certified") == F.col("total")) & (F.col("reports_done") == F.col("reports_total"))
    return one.withColumn(
        "status",
        F.when((F.col("total") == 0) | (F.col("blocked") > 0), "MIGRATION_IN_PROGRESS")
        .when(complete, "MIGRATION_COMPLETE").otherwise("SYSTEM_PROVISIONAL"),
    )


def blocking(gates: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """What stands in the way: blocked pipelines, or, when none is blocked, the provisional ones and the open reports.

    Reports (obj_id, done) show as one entry ``BI:<done>/<total>``.
    """
    rank = F.when(F.col("status") == "CERTIFIED", 2).when(F.col("status") == "PROVISIONAL", 1).otherwise(0)
    worst = gates.select(F.col("pipeline"), rank.alias("rank"))
    if reports is not None:
        done = reports.agg(F.count_if("done").alias("d"), F.count("*").alias("n")).where("d < n")
        entry = F.concat(F.lit("BI:"), F.col("d").cast("string"), F.lit("/"), F.col("n").cast("string"))
        worst = worst.unionAll(done.select(entry, F.lit(1)))
    least = worst.agg(F.min("rank").alias("least")).where("least < 2")
    return worst.join(F.broadcast(least), F.col("rank") == F.col("least")).select("pipeline")


def by_wave(gates: DataFrame, waves: DataFrame) -> DataFrame:
    """Counts of states per wave; pipelines without a wave go under 99."""
    return gates.join(waves, "pipeline", "left").groupBy(F.coalesce("wave", F.lit(99)).alias("wave")).agg(
        F.count_if(F.col("status") == "CERTIFIED").alias("certified"),
        F.count_if(F.col("status") == "PROVISIONAL").alias("provisional"),
        F.count_if(~F.col("status").isin("CERTIFIED", "PROVISIONAL")).alias("blocked"),
        F.count("*").alias("total"),
    )


# Gates in the order a unit crosses them.
GATES = (
    "G0_contract", "G1_connections", "G2_bronze", "G3_silver", "G4_gold",
    "G5_self_check", "G6_dev", "G7_sit", "G8_provisional", "G9_soak_certified",
)


def gate_crossings(crossings: DataFrame) -> DataFrame:
    """Latest crossing per pipeline and gate, rolled up: gates passed, first gate that is not.

    Grouped by pipeline and gate first (combined on the map side), so the second
    grouping sees at most one row per gate.
    """
    latest = crossings.groupBy("pipeline", "gate").agg(F.max_by("passed", "recorded_at").alias("passed"))
    return latest.groupBy("pipeline").agg(
        F.count_if("passed").alias("gates_passed"),
        F.min(F.when(~F.col("passed"), F.col("gate"))).alias("first_failed"),
    )


def restart_soak(soak: DataFrame) -> DataFrame:
    """New start of the soak clock: the date of the last red checkpoint per pipeline."""
    return soak.where(~F.col("passed")).groupBy("pipeline").agg(F.max("ran_at").cast("date").alias("soak_start"))


def bi_status(reports: DataFrame) -> DataFrame:
    """Done and pending reports per system."""
    return reports.groupBy("system").agg(
        F.count("*").alias("total"), F.count_if("done").alias("done"), F.count_if(~F.col("done")).alias("pending")
    )


def ready_reports(reports: DataFrame, certified_tables: DataFrame) -> DataFrame:
    """Reports (obj_id, target_tables) all of whose tables are certified (``table``)."""
    needs = reports.select("obj_id", F.explode("target_tables").alias("t")).select("obj_id", F.lower("t").alias("table")).distinct()
    open_ = needs.join(certified_tables.select(F.lower("table").alias("table")).distinct(), "table", "left_anti")
    return reports.join(open_.select("obj_id").distinct(), "obj_id", "left_anti")


def app_gate(grades: DataFrame, require_sync: bool = True) -> DataFrame:
    """State per application from its schema and sync grades ('green' or not)."""
    schema_ok = F.col("schema_grade") == "green"
    sync_ok = F.col("sync_grade") == "green"
    pending = F.lit(require_sync) & ~sync_ok
    return grades.select(
        "app", "schema_grade", "sync_grade",
        F.when(~schema_ok, "BLOCKED").when(pending, "PROVISIONAL").otherwise("CERTIFIED").alias("status"),
        F.when(~schema_ok, "schema").when(pending, "sync").otherwise("").alias("blocked_by"),
    )


# --- dashboard views --------------------------------------------------------

def v_progress(jobs: DataFrame) -> DataFrame:
    done = F.count_if(F.col("status") == "CERTIFIED")
    return jobs.groupBy("wave").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("dev_state") == "PASS").alias("dev_passed"),
        F.count_if(F.col("sit_state") == "PASS").alias("sit_passed"),
        F.count_if(F.col("status") == "PROVISIONAL").alias("provisional"),
        F.count_if(F.col("status") == "SOAKING").alias("soaking"),
        done.alias("certified"),
        F.round(F.lit(100).cast("decimal(12,4)") * done / F.count("*"), 1).cast("decimal(5,1)").alias("pct_done"),
    )


def v_drift(results: DataFrame) -> DataFrame:
    """Open red checks; the reader orders them by ``recorded_at``."""
    return results.where(~F.col("passed"))


def v_funnel(jobs: DataFrame) -> DataFrame:
    return jobs.agg(
        F.count("*").alias("pipelines"),
        F.count_if(F.col("dev_state") == "PASS").alias("cleared_dev"),
        F.count_if(F.col("sit_state") == "PASS").alias("cleared_sit"),
        F.count_if(F.col("status") == "PROVISIONAL").alias("provisional"),
        F.count_if(F.col("soak_state") == "PASS").alias("cleared_soak"),
        F.count_if(F.col("status") == "CERTIFIED").alias("certified"),
    )


def v_soak_watch(jobs: DataFrame, soak: DataFrame, today: Column) -> DataFrame:
    """Soaking pipelines with the days left and each checkpoint's outcome."""
    watched = jobs.where(F.col("status").isin("PROVISIONAL", "SOAKING")).withColumn(
        "days_remaining", F.datediff("soak_due_at", today)
    )
    return watched.join(soak, "pipeline", "left")


def v_bi_progress(reports: DataFrame) -> DataFrame:
    return reports.groupBy("system").agg(
        F.count("*").alias("objects"),
        F.count_if("parity_passed").alias("parity_green"),
        F.count_if("republished").alias("republished"),
        F.count_if("done").alias("done"),
    )


# --- monitors ---------------------------------------------------------------

def freshness(df: DataFrame, group: str, ts_col: str, as_of: Column, max_age: str) -> DataFrame:
    """Newest row per group, its age in seconds at ``as_of``, and whether that breaches ``max_age``."""
    newest = df.groupBy(group).agg(F.max(ts_col).alias("newest"))
    return newest.withColumn("age_seconds", F.timestamp_diff("SECOND", F.col("newest"), as_of)).withColumn(
        "breach", F.col("newest") + F.expr(f"INTERVAL {max_age}") < as_of
    )


def row_count_delta(df: DataFrame, group: str, period: Column) -> DataFrame:
    """Rows per group and period, and the change since the group's previous period.

    The window sees one row per group and period, not the rows themselves.
    """
    counts = df.groupBy(F.col(group), period.alias("period")).agg(F.count("*").alias("n_rows"))
    prev = F.lag("n_rows").over(Window.partitionBy(group).orderBy("period"))
    return counts.withColumn("delta", F.col("n_rows") - prev)


def _share(part: Column, whole: Column) -> Column:
    return F.round((part / whole).cast("decimal(20,10)"), 4).cast("decimal(6,4)")


def parity_drift(results: DataFrame) -> DataFrame:
    """Share of red checks per check name."""
    red = F.count_if(~F.col("passed"))
    return results.groupBy("check_name").agg(F.count("*").alias("runs"), red.alias("red"), _share(red, F.count("*")).alias("red_rate"))


def job_success_rate(runs: DataFrame, group: str) -> DataFrame:
    ok = F.count_if("succeeded")
    return runs.groupBy(group).agg(F.count("*").alias("runs"), ok.alias("succeeded"), _share(ok, F.count("*")).alias("success_rate"))


def pipeline_latency(runs: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Longest and summed duration in seconds per group."""
    seconds = F.timestamp_diff("SECOND", F.col(start), F.col(end))
    return runs.groupBy(group).agg(F.max(seconds).alias("max_seconds"), F.sum(seconds).alias("total_seconds"), F.count("*").alias("runs"))
