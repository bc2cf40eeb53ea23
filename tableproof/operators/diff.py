"""Row-level differences and why they happened."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tableproof.functions.hashing import exact_text, is_fractional, report_text
from tableproof.operators.parity import SIGN, differing_keys, key_state, pinned, row_keys, shared_columns, tagged
from tableproof.session import materialize
from tableproof.target import Target


def signed_difference(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose multiplicity differs, with ``net`` = source count - build count.

    One shuffle of combined rows replaces EXCEPT ALL in both directions.
    """
    return df.groupBy(*columns).agg(F.sum(SIGN).alias("net")).where("net <> 0")


def row_diff(source: DataFrame, build: DataFrame, t: Target) -> DataFrame:
    """One row per differing row, with the values of both sides as structs.

    ``change`` is ``changed`` when a key has exactly one differing row on each side,
    else ``missing_in_build`` or ``extra_in_build`` with the multiplicity ``n_rows``.

    Keys with row hashes are compared first, which shuffles a few bytes per row. The
    keys that differ are written, so that their size is known, and only their rows
    are fetched and compared value by value: two scans, whatever is done with the
    result. Equal rows cancel, and rows of a repeated key are never paired. Without a key
    whole rows are compared, in one pass: they are missing or extra, and ``src`` and ``build`` hold them.
    """
    cols = shared_columns(source, build, t)
    keys = row_keys(t, cols)
    both = pinned(source, build, t, cols)
    if t.keys:
        suspects = materialize(differing_keys(key_state(both, keys, cols)).select(*keys), "differing-keys")
        both = both.join(suspects, _null_safe(both, suspects, keys), "left_semi")
    diff = materialize(signed_difference(both, cols), "differing-rows")
    if not t.keys:
        whole = F.struct(*cols)
        return diff.select(
            F.when(F.col("net") > 0, "missing_in_build").otherwise("extra_in_build").alias("change"), F.abs("net").alias("n_rows"),
            F.when(F.col("net") > 0, whole).alias("src"), F.when(F.col("net") < 0, whole).alias("build"),
        )
    values = F.struct(*[F.col(c) for c in cols if c not in keys])
    per_key = diff.groupBy(*keys).agg(
        F.count_if(F.col("net") > 0).alias("s_variants"),
        F.count_if(F.col("net") < 0).alias("b_variants"),
        F.sum(F.abs("net")).alias("total"),
        F.first(F.when(F.col("net") > 0, values), ignorenulls=True).alias("src"),
        F.first(F.when(F.col("net") < 0, values), ignorenulls=True).alias("build"),
    )
    single = (F.col("s_variants") == 1) & (F.col("b_variants") == 1) & (F.col("total") == 2)
    paired = per_key.where(single).select(
        *keys, F.lit("changed").alias("change"), F.lit(1).cast("bigint").alias("n_rows"), "src", "build"
    )
    unpaired = per_key.where(~single).select(*keys)
    alone = diff.join(unpaired, _null_safe(diff, unpaired, keys), "left_semi").select(
        *keys,
        F.when(F.col("net") > 0, "missing_in_build").otherwise("extra_in_build").alias("change"),
        F.abs("net").alias("n_rows"),
        F.when(F.col("net") > 0, values).alias("src"),
        F.when(F.col("net") < 0, values).alias("build"),
    )
    return paired.unionByName(alone)


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]):
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def column_diff(source: DataFrame, build: DataFrame, t: Target) -> DataFrame:
    """One row per differing cell; whole missing or extra rows show as ``column_name = '*'``.

    Without a key every difference is a whole row, shown as JSON.
    """
    if not t.keys:
        return row_diff(source, build, t).select(
            "change", "n_rows", F.lit("*").alias("column_name"),
            *[F.to_json(side, {"ignoreNullFields": "false"}).alias(f"{side}_value") for side in ("src", "build")],
        )
    cols = [c for c in shared_columns(source, build, t) if c not in t.keys]
    types = tagged(source, build, cols).schema
    diff = row_diff(source, build, t)

    def text(side: str, c: str):
        show = exact_text if is_fractional(types[c].dataType) else report_text
        return show(F.col(f"{side}.{c}"), types[c].dataType)

    cells = F.array(*[
        F.when(
            ~F.col(f"src.{c}").eqNullSafe(F.col(f"build.{c}")),
            F.struct(F.lit(c).alias("column_name"), text("src", c).alias("src_value"), text("build", c).alias("build_value")),
        )
        for c in cols
    ])
    whole = F.array(F.struct(
        F.lit("*").alias("column_name"), F.lit(None).cast("string").alias("src_value"), F.lit(None).cast("string").alias("build_value"),
    ))
    picked = F.when(F.col("change") == "changed", F.filter(cells, lambda x: x.isNotNull())).otherwise(whole)
    return diff.select(*t.keys, "change", "n_rows", F.inline(picked))


def row_level_sample(source: DataFrame, build: DataFrame, t: Target, limit: int = 100) -> DataFrame:
    """The first differing cells in key order: the report an operator reads."""
    return column_diff(source, build, t).orderBy(*t.keys, "column_name", "change").limit(limit)


# The reason codes.
REASON_CODES = (
    "TRANSLATION", "SCHEMA", "TIMING", "SOURCE-CHANGE", "TYPE-NUANCE", "LEGACY-BUG", "INCREMENTAL-LOGIC", "LATE-DATA",
)


def drift_reason(
    diffs: DataFrame,
    t: Target,
    event_col: str,
    mistyped: Sequence[str] = (),
    edge: str = "0 days",
    waivers: DataFrame | None = None,
    scales: Mapping[str, int] | None = None,
) -> DataFrame:
    """Reason code for every cell difference.

    ``diffs`` are ``column_diff`` rows with the row's event time in ``event_col``.
    ``waivers`` (keys, ``column_name``, ``reason_code``) carries what only a person
    can decide and wins over the rules; of several waivers of a cell the first by name
    counts, and null keys match. ``scales`` names the columns in which values that agree
    at so many decimals are one value; without it nothing is rounded.
    """
    time = F.col(event_col)
    wm = F.lit(str(t.watermark)).cast(diffs.schema[event_col].dataType)
    src, build = F.lower(F.trim("src_value")), F.lower(F.trim("build_value"))
    alike = src.eqNullSafe(build)
    for name, scale in (scales or {}).items():
        rounded = [F.round(F.col(c).try_cast("decimal(38,18)"), scale) for c in ("src_value", "build_value")]
        alike = alike | ((F.col("column_name") == name) & F.coalesce(rounded[0] == rounded[1], F.lit(False)))
    changed = F.col("change") == "changed"
    rule = F.when(F.col("column_name").isin(list(mistyped)), "SCHEMA").when(
        changed & alike, "TYPE-NUANCE"
    )
    if t.prev_watermark is not None:
        prev = F.lit(str(t.prev_watermark)).cast(diffs.schema[event_col].dataType)
        rule = rule.when(~changed & (time <= prev), "LATE-DATA")
    rule = rule.when(~changed & (time >= wm - F.expr(f"INTERVAL {edge}")), "TIMING")
    if t.prev_watermark is not None:
        rule = rule.when(time > prev, "INCREMENTAL-LOGIC")
    out = diffs.withColumn("reason_code", rule.otherwise("TRANSLATION"))
    if waivers is None:
        return out
    on = [*t.keys, "column_name"]
    w = waivers.groupBy(*on).agg(F.min("reason_code").alias("waived"))
    w = w.select(*[F.col(k).alias(f"__w_{k}") for k in on], "waived")
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__w_{k}")) for k in on])
    return (
        out.join(w, match, "left")
        .withColumn("reason_code", F.coalesce("waived", "reason_code"))
        .drop("waived", *[f"__w_{k}" for k in on])
    )
