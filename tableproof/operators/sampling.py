"""Deterministic samples that stay closed under foreign keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tableproof.functions.hashing import md5_key, row_hash
from tableproof.operators.parity import value_counts
from tableproof.operators.results import with_positions
from tableproof.session import materialize
from tableproof.target import FK, SampleSpec

def order_digits(keys: Sequence[str], seed: int, digest: str) -> list[Column]:
    """The sampling order as 16-bit digits, most significant first."""
    if digest == "md5":
        text = md5_key(keys, F.lit(str(seed)))
        return [F.conv(F.substring(text, 1 + 4 * i, 4), 16, 10).cast("int") for i in range(8)]
    return _hash_digits(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)))


def _hash_digits(h: Column) -> list[Column]:
    return [F.shiftright(h, 48).cast("int")] + [
        F.shiftright(h, 48 - 16 * i).bitwiseAND(F.lit(0xFFFF)).cast("int") for i in (1, 2, 3)
    ]


def top_by_digits(df: DataFrame, digits: Sequence[Column], rows: int) -> DataFrame:
    """Exactly the first ``rows`` rows in digit order, without sorting the table.

    Rows are counted per value of the first digit (at most 65,536 counts), which gives the value
    at which the running count passes ``rows``. Everything below it is taken where it lies; the rows
    of that one value are numbered in the order of all digits, over as many range partitions as
    they need. The other digits must tell all rows apart that are not equal.
    """
    if rows <= 0:
        return df.limit(0)
    counts = df.groupBy(digits[0].alias("d")).agg(F.count("*").alias("n"))
    need, cut = rows, None
    for d, n in sorted(counts.collect()):  # at most 65,536 pairs
        if n >= need:
            cut = (d, n)
            break
        need -= n
    if cut is None:  # fewer rows than asked for
        return df
    if cut[1] == need:
        return df.where(digits[0] <= F.lit(cut[0]))
    names = [f"__d{i}" for i in range(len(digits))]
    edge = df.where(digits[0] == F.lit(cut[0])).withColumns(dict(zip(names, digits)))
    first = with_positions(edge, names).where(F.col("position") < need).select(*df.columns)
    return df.where(digits[0] < F.lit(cut[0])).unionByName(first)


def seed_sample(
    df: DataFrame, keys: Sequence[str], rows: int, seed: int = 42, mode: str = "ri_preserving", digest: str = "xxhash64"
) -> DataFrame:
    """The ``rows`` rows with the smallest seeded key hash; the same on every run.

    ``ri_preserving`` and ``random`` pick the same rows (closure is a separate step);
    ``none`` means the input is already a sample. Without keys all columns are hashed.
    """
    if mode == "none":
        return df
    by_key = order_digits(list(keys) or df.columns, seed, digest)
    by_row = _hash_digits(F.xxhash64(*[F.col(c) for c in df.columns], row_hash(df.columns)))
    return top_by_digits(df, by_key + by_row, rows)


def reference_copy(df: DataFrame) -> DataFrame:
    """Small dimensions and configuration go in whole."""
    return df


def _parents_last(tables: Sequence[str], fks: Mapping[str, Sequence[FK]]) -> list[str]:
    """Children before their parents, so that one pass reaches grandparents."""
    done: list[str] = []
    left = list(tables)
    while left:
        ready = [t for t in left if not any(fk.parent_table == t for c in left if c != t for fk in fks.get(c, ()))]
        nxt = ready or [left[0]]  # a reference cycle: take any, the caller repeats
        done += nxt
        left = [t for t in left if t not in nxt]
    return done


def _has_cycle(tables: Sequence[str], fks: Mapping[str, Sequence[FK]]) -> bool:
    order = {t: i for i, t in enumerate(_parents_last(tables, fks))}
    return any(order.get(fk.parent_table, len(order)) <= order[t] for t in tables for fk in fks.get(t, ()))


def fk_closure(
    sources: Mapping[str, DataFrame], samples: Mapping[str, DataFrame], fks: Mapping[str, Sequence[FK]]
) -> dict[str, DataFrame]:
    """Add every parent row that a sampled child refers to, up to the grandparents.

    Only distinct key values meet the parent. They are written first, so that the
    planner knows their size and leaves the parent where it lies when they are few.
    Without reference cycles one pass, children first, is complete; with cycles it
    repeats until no row is new.
    """
    closed = dict(samples)
    tables = sorted(set(sources) | set(samples))
    cyclic = _has_cycle(tables, fks)
    while True:
        added = 0
        for parent in _parents_last(tables, fks):
            refs = [(c, fk) for c in tables if c in closed for fk in fks.get(c, ()) if fk.parent_table == parent]
            if not refs:
                continue
            for key in sorted({fk.parent_key for _, fk in refs}):
                wanted = reduce(DataFrame.unionAll, [
                    closed[c].select(F.col(fk.col).alias(key)).where(F.col(fk.col).isNotNull())
                    for c, fk in refs if fk.parent_key == key
                ]).distinct()
                if parent in closed:
                    wanted = wanted.join(closed[parent].select(key), key, "left_anti")
                wanted = materialize(wanted, "wanted-keys")
                new = sources[parent].join(wanted, key, "left_semi").select(*sources[parent].columns)
                if cyclic:
                    new = materialize(new, "closure")
                    added += new.count()
                closed[parent] = closed[parent].unionByName(new) if parent in closed else new
        if not cyclic or added == 0:
            return closed


def sample_estate(
    sources: Mapping[str, DataFrame], specs: Sequence[SampleSpec], seed: int = 42, mode: str = "ri_preserving",
    digest: str = "xxhash64", overrides: Mapping[str, int] | None = None,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Seed every table, close under foreign keys, and describe the outcome."""
    overrides = overrides or {}
    specs = [SampleSpec(s.table, s.keys, s.fks, overrides.get(s.table, s.rows), s.is_reference) for s in specs]
    seeds = {
        s.table: reference_copy(sources[s.table]) if s.is_reference
        else materialize(seed_sample(sources[s.table], s.keys, s.rows, seed, mode, digest), f"seed-{s.table}")
        for s in specs
    }
    closed = fk_closure(sources, seeds, {s.table: s.fks for s in specs})
    reference = {s.table for s in specs if s.is_reference}
    closed = {t: df if t in reference else materialize(df, f"sample-{t}") for t, df in closed.items()}
    return closed, sample_manifest(closed, specs, seed, mode)


def sample_manifest(samples: Mapping[str, DataFrame], specs: Sequence[SampleSpec], seed: int, mode: str) -> DataFrame:
    """What the small estate was meant to hold and what it holds."""
    return reduce(DataFrame.unionAll, [
        samples[s.table].agg(F.count("*").alias("actual_rows")).select(
            F.lit(s.table).alias("table_name"),
            F.lit("reference_full" if s.is_reference else "sample").alias("kind"),
            F.lit("all" if s.is_reference else str(s.rows)).alias("target_rows"),
            "actual_rows",
            F.lit(";".join(s.keys)).alias("keys"),
            F.lit(seed).alias("seed"),
            F.lit(mode).alias("sampling"),
        )
        for s in specs
    ])


# --- key inference ----------------------------------------------------------

def infer_keys(df: DataFrame) -> DataFrame:
    """Columns whose values identify a row: no nulls, and as many values as rows."""
    cols = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]
    return value_counts(df, cols).withColumn("is_key", F.col("distinct_count") == F.col("row_count"))


def candidate_fks(tables: Mapping[str, DataFrame], pks: Mapping[str, str], alias: Mapping[str, str] | None = None) -> list[tuple[str, FK]]:
    """Name rule: a column called like another table's single-column key (or aliased to it)."""
    alias = alias or {}
    owner: dict[str, str] = {}
    for table, pk in pks.items():
        owner.setdefault(pk, table)
    out = []
    for table, df in tables.items():
        for c in df.columns:
            key = alias.get(c, c)
            parent = owner.get(key)
            if parent and parent != table and c != pks.get(table):
                out.append((table, FK(c, parent, key)))
    return out


def infer_fks(tables: Mapping[str, DataFrame], pks: Mapping[str, str], alias: Mapping[str, str] | None = None) -> DataFrame:
    """Candidates of the name rule, verified on the values: share of child rows with a parent."""
    parts = []
    for table, fk in candidate_fks(tables, pks, alias):
        values = tables[table].where(F.col(fk.col).isNotNull()).groupBy(F.col(fk.col).alias("v")).agg(F.count("*").alias("n"))
        parent = tables[fk.parent_table].select(F.col(fk.parent_key).alias("v"), F.lit(1).alias("hit")).distinct()
        parts.append(values.join(parent, "v", "left").agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("child_rows"),
            F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("resolved_rows"),
        ).select(
            F.lit(table).alias("child_table"), F.lit(fk.col).alias("child_column"),
            F.lit(fk.parent_table).alias("parent_table"), F.lit(fk.parent_key).alias("parent_key"),
            "child_rows", "resolved_rows",
            (F.col("child_rows") == F.col("resolved_rows")).alias("is_fk"),
        ))
    if not parts:
        schema = "child_table string, child_column string, parent_table string, parent_key string, child_rows bigint, resolved_rows bigint, is_fk boolean"
        return next(iter(tables.values())).sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, parts)
