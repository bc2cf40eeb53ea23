"""Keys of several columns and inclusions between columns, found from the values alone."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tableproof.operators.parity import value_counts
from tableproof.session import materialize, tasks_for

#: Rows per slice of a table when sets of columns are ruled out, and how many slices at most.
ROWS_PER_SLICE, SLICES = 100_000, 64
#: Sets of columns tried in one pass over the slices.
SETS_PER_PASS = 48
#: How many times finer the part of the slices is that goes first, and how often a value that is not hot comes in them at most.
FINER, HOT = 8, 100
#: Share of a table's rows that may repeat in a set of columns for larger sets to be counted over those rows.
FEW = 0.1
#: Hashes that one task counts where hardly any comes twice.
HASHES_PER_TASK = 500_000
#: Least hashes kept per column as its signature.
SIGNATURE = 256

_KEY_SCHEMA = "key_columns string, n_columns int, row_count bigint"


def _atomic(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))]


def _quoted(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def smallest_keys(df: DataFrame, most_columns: int = 3) -> DataFrame:
    """All smallest sets of columns whose values identify a row: (key_columns, n_columns, row_count).

    Level by level: sets of one column, then of two, up to ``most_columns``; the first level with a key ends the
    search, so no superset of a key is looked at. A column with a null is in no key. A set goes without being
    counted if the product of its columns' distinct counts is below the number of rows, or if a value that comes
    twice is found in slices of the table (two hashes, 128 bits, agree). The sets left are counted exactly, over the whole
    table or over all rows that repeat in a set of one column less. All sets of a level share one pass over the table, which
    only reads the columns in play. A table that repeats a row has no key, an empty one every column.
    """
    spark = df.sparkSession
    counts = {r["column_name"]: r for r in value_counts(df, _atomic(df)).collect()}
    if not counts:
        return spark.createDataFrame([], _KEY_SCHEMA)
    n = next(iter(counts.values()))["row_count"]
    usable = [c for c in _atomic(df) if counts[c]["null_count"] == 0]
    distinct = {c: counts[c]["distinct_count"] for c in usable}
    found = [(c,) for c in usable if distinct[c] == n]
    # Rows whose value comes twice, as a share of all: at most so many for a column, as its slice has it for a larger set.
    shares = {(c,): 2 - 2 * distinct[c] / max(n, 1) for c in usable}
    size = 1
    while not found and size < most_columns:
        size += 1
        sets = [s for s in combinations(usable, size) if reduce(lambda x, c: x * distinct[c], s, 1) >= n]
        slices, smaller, shares = min(SLICES, n // ROWS_PER_SLICE + 1), shares, {}
        repeated = _repeated(df, sets, slices, distinct, shares)
        found = _keys(df, [s for s in sets if s not in repeated], smaller if slices > 1 else {})
    return spark.createDataFrame([(",".join(s), len(s), n) for s in found], _KEY_SCHEMA)


def _repeated(
    df: DataFrame, sets: Sequence[tuple[str, ...]], slices: int, distinct: Mapping[str, int] | None = None, shares: dict[tuple[str, ...], float] | None = None
) -> set[tuple[str, ...]]:
    """Sets of columns of which a value comes twice among the rows of two of ``slices``.

    Rows that agree in a set agree in each of its columns, so the slice by one column's hash holds all or none of them:
    sets share the slice of their most distinct column. The other slice is by the hash of the row and shows hot values.
    One pass over the table tests a hash per column, not two per set; a finer part of the slices goes first, which
    is enough for most sets. ``shares`` takes, for sets without a hot value, how many of the rows seen repeat.
    """
    if not sets:
        return set()
    by = {s: max(s, key=lambda c: (distinct or {}).get(c, 0)) for s in sets}
    used = [_quoted(c) for c in dict.fromkeys(c for s in sets for c in s)]
    rows = df.select(*used, F.xxhash64(*used).alias("__row"))
    hashes = {c: F.xxhash64(_quoted(c)) for c in by.values()}
    out: set[tuple[str, ...]] = set()
    # The widest slices are written first, and the finer part is read from them.
    parts = {}
    for n in (slices, slices * FINER) if slices > 1 else ():
        rows = parts[n] = materialize(rows.where(_in_slice([F.col("__row"), *hashes.values()], n)), "slices")
    for n, rows in sorted(parts.items(), reverse=True) or [(1, rows)]:
        left = [s for s in sets if s not in out]
        for lo in range(0, len(left), SETS_PER_PASS):
            tried = []
            for i, s in enumerate(left[lo : lo + SETS_PER_PASS], lo):
                h = F.xxhash64(*map(_quoted, s))
                again = F.xxhash64(F.lit(1), *map(_quoted, s), h)
                tried.append(rows.where(_in_slice([F.col("__row"), hashes[by[s]]], n)).select(F.lit(i).alias("nth"), h.alias("h"), again.alias("again")))
            values = reduce(DataFrame.unionAll, tried).groupBy("nth", "h", "again").agg(F.count("*").alias("n"))
            for r in values.groupBy("nth").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("twice"), F.max("n").alias("most")).collect():
                if r["most"] > 1:
                    out.add(left[r["nth"]])
                if shares is not None and r["most"] <= HOT:
                    shares[left[r["nth"]]] = (r["twice"] or 0) / r["n"]
    return out


def _in_slice(hashes: Sequence[Column], slices: int) -> Column:
    return reduce(Column.__or__, [F.pmod(h, F.lit(slices)) == 0 for h in hashes])


def _keys(df: DataFrame, sets: Sequence[tuple[str, ...]], shares: Mapping[tuple[str, ...], float]) -> list[tuple[str, ...]]:
    """Those of ``sets`` that identify a row.

    Rows that agree in a set agree in it without one column. So where such a smaller set serves several and few rows repeat
    in it, all those rows are found once, and the others cannot tell whether the larger sets are keys.
    """
    left, found = list(sets), []
    while True:
        served = {p: [s for s in left if set(p) < set(s)] for p, share in shares.items() if share <= FEW}
        p = max(served, key=lambda p: (len(served[p]), -shares[p]), default=None)
        if p is None or len(served[p]) < 2:
            return found + [s for s in left if _identifies(df, s)]
        rows = _agreeing(df.select(*[_quoted(c) for c in dict.fromkeys(c for s in served[p] for c in s)]), p)
        repeated = _repeated(rows, served[p], 1)
        found += [s for s in served[p] if s not in repeated and _identifies(rows, s)]
        left = [s for s in left if s not in served[p]]


def _hashes_twice(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Hashes of ``columns`` that come twice. Hardly any does, so the map side has nothing to combine; a hot value is what slices show first."""
    hashes = df.select(F.xxhash64(*map(_quoted, columns)).alias("__h")).repartition(tasks_for(df, HASHES_PER_TASK), "__h")
    return materialize(hashes.groupBy("__h").agg(F.count("*").alias("__n")).where("__n > 1").select("__h"), "hashes")


def _agreeing(df: DataFrame, columns: Sequence[str], hashes: DataFrame | None = None) -> DataFrame:
    """All rows that agree with another in ``columns``, and rows that only share the hash."""
    h = F.xxhash64(*map(_quoted, columns)).alias("__h")
    twice = _hashes_twice(df, columns) if hashes is None else hashes
    return materialize(df.select("*", h).join(twice, "__h", "left_semi").drop("__h"), "agreeing")


def _identifies(df: DataFrame, columns: Sequence[str]) -> bool:
    """Whether no two rows agree in ``columns``: no two hashes do, or else the rows of those hashes differ in value."""
    used = df.select(*map(_quoted, columns))
    hashes = _hashes_twice(used, columns)
    if hashes.isEmpty():
        return True
    return _agreeing(used, columns, hashes).groupBy(*map(_quoted, columns)).agg(F.count("*").alias("__n")).where("__n > 1").isEmpty()


def _family(t: T.DataType) -> str | None:
    """Types whose values compare with each other; None for those that are no keys (floating point, nested)."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "whole"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    return "day" if isinstance(t, T.DateType) else None


def _as_family(c: Column, family: str) -> Column:
    return c.cast({"whole": "bigint", "text": "string", "day": "date"}[family])


def signatures(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, family, h): the ``SIGNATURE`` least hashes of each column's values, one scan per table."""
    parts = []
    for name, df in tables.items():
        columns = [(f.name, _family(f.dataType)) for f in df.schema if _family(f.dataType)]
        if not columns:
            continue
        cells = F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("family"), F.when(_quoted(c).isNotNull(), F.xxhash64(_as_family(_quoted(c), k))).alias("h"))
            for c, k in columns
        ])
        rows = df.select(F.inline(cells)).where("h IS NOT NULL").distinct()
        nth = F.row_number().over(Window.partitionBy("column_name").orderBy("h"))
        parts.append(rows.withColumn("nth", nth).where(F.col("nth") <= SIGNATURE).select(F.lit(name).alias("table_name"), "column_name", "family", "h"))
    if not parts:
        return next(iter(tables.values())).sparkSession.createDataFrame([], "table_name string, column_name string, family string, h bigint")
    return reduce(DataFrame.unionAll, parts)


def inclusion_candidates(sketches: DataFrame) -> DataFrame:
    """Pairs of columns that an inclusion is not ruled out for: (child_table, child_column, parent_table, parent_column).

    If all values of a child are among a parent's, then each of the child's hashes up to the parent's last kept one is
    kept for the parent too, and a parent with fewer hashes than a signature holds keeps all. So no inclusion is lost.
    """
    kept = materialize(sketches, "signatures")
    last = kept.groupBy("family", "table_name", "column_name").agg(F.max("h").alias("last"), F.count("*").alias("n"))
    last = last.withColumn("last", F.when(F.col("n") < SIGNATURE, F.lit((1 << 63) - 1)).otherwise(F.col("last"))).drop("n")
    # Pairs of columns: as many as the schemas have. Hashes in common, against those that there would have to be.
    child = kept.select("family", F.col("table_name").alias("child_table"), F.col("column_name").alias("child_column"), "h")
    parent = kept.select("family", F.col("table_name").alias("parent_table"), F.col("column_name").alias("parent_column"), "h")
    ends = last.select("family", F.col("table_name").alias("parent_table"), F.col("column_name").alias("parent_column"), "last")
    pair = ["child_table", "child_column", "parent_table", "parent_column"]
    needed = child.join(ends, "family").where("child_table <> parent_table OR child_column <> parent_column").groupBy(*pair).agg(
        F.count_if(F.col("h") <= F.col("last")).alias("needed")
    )
    shared = child.join(parent, ["family", "h"]).groupBy(*pair).agg(F.count("*").alias("shared"))
    return needed.join(shared, pair, "left").where(F.coalesce("shared", F.lit(0)) >= F.col("needed")).select(*pair)


def inclusions(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Columns all of whose values are in a column that identifies the rows of its table.

    (child_table, child_column, parent_table, parent_column, child_rows, child_values, parent_values): rows and distinct values of
    the child without nulls, and of the parent. Candidates come from signatures of all columns, made in one scan per table;
    only they are joined on their values. Whole numbers compare with whole numbers of any width, text with
    text, dates with dates; floating-point and nested columns take no part, nor do columns without a value.
    Names play no part, so a key is found under any name. Small ranges of numbers are included in many keys: the
    nearer ``child_values`` are to ``parent_values``, the more an inclusion says.
    """
    spark = next(iter(tables.values())).sparkSession
    counts = {
        (t, r["column_name"]): r
        for t, df in tables.items()
        for r in value_counts(df, [f.name for f in df.schema if _family(f.dataType)] or df.columns[:1]).collect()
    }
    keys = {k for k, r in counts.items() if r["null_count"] == 0 and r["distinct_count"] == r["row_count"] > 0}
    # One row per pair of columns: as many as the schemas have, not the data.
    pairs = [
        (r["child_table"], r["child_column"], r["parent_table"], r["parent_column"])
        for r in inclusion_candidates(signatures(tables)).collect()
        if (r["parent_table"], r["parent_column"]) in keys
        and counts[r["child_table"], r["child_column"]]["distinct_count"] <= counts[r["parent_table"], r["parent_column"]]["distinct_count"]
    ]
    parts = []
    for child, column, parent, key in sorted(pairs):
        family = _family(tables[child].schema[column].dataType)
        values = tables[child].select(_as_family(_quoted(column), family).alias("v")).where("v IS NOT NULL").distinct()
        known = tables[parent].select(_as_family(_quoted(key), family).alias("v"))
        parts.append(values.join(known, "v", "left_anti").agg(F.count("*").alias("lost")).select(
            F.lit(child).alias("child_table"), F.lit(column).alias("child_column"), F.lit(parent).alias("parent_table"), F.lit(key).alias("parent_column"),
            F.lit(counts[child, column]["row_count"] - counts[child, column]["null_count"]).cast("bigint").alias("child_rows"),
            F.lit(counts[child, column]["distinct_count"]).cast("bigint").alias("child_values"),
            F.lit(counts[parent, key]["distinct_count"]).cast("bigint").alias("parent_values"), "lost",
        ))
    if not parts:
        return spark.createDataFrame(
            [], "child_table string, child_column string, parent_table string, parent_column string, child_rows bigint, child_values bigint, parent_values bigint"
        )
    return reduce(DataFrame.unionAll, parts).where("lost = 0").drop("lost")
