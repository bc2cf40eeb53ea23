"""Approximate nearest neighbours by cosine: cross-polytope hashing with multiprobe tables.

A pseudo-random rotation (sign flips and fast Hadamard transforms, three times) turns a unit vector,
and the signed axis nearest to it is its hash. A table joins the axes of two rotations into one
bucket number. Queries probe buckets in the order of the sums of their two coordinates, until the
buckets probed hold a number of rows; the rows met in any table are ranked by their exact cosine.
That number is fitted on every run: a bounded set of queries is compared with all rows, and their
true neighbours' buckets tell how far queries have to probe for the wanted recall, whatever the
table's size. Buckets are never joined row by row: cells of buckets meet their queries in bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tableproof.llm.joins import lookup_join
from tableproof.session import materialize


@dataclass(frozen=True)
class CrossPolytope:
    """Parameters of the index."""

    tables: int = 10
    #: A query probes a table until its buckets hold this many times the square root of all rows, at least.
    probe_factor: float = 5.0
    least_probed: int = 64
    #: Share of the true neighbours of the fitted queries that probing has to find, less two standard errors.
    recall: float = 0.95
    #: Queries that are compared with all rows, at most.
    fit_queries: int = 512
    #: Cells that a table's buckets are dealt into.
    cells: int = 16
    #: Rows and queries that meet in one task.
    block_rows: int = 16_384
    block_queries: int = 16_384
    #: Bytes of probe lists that one batch of dealt queries holds, about.
    batch_bytes: int = 8 << 20
    seed: int = 17


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of every row; the width is a power of two."""
    n, h = x.shape[1], 1
    y = x.copy()
    while h < n:
        y = y.reshape(len(x), n // (2 * h), 2, h)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2)
        h *= 2
    return y.reshape(len(x), n) / np.sqrt(n)


def rotations(dim: int, p: CrossPolytope) -> np.ndarray:
    """Signs of all pseudo-rotations: (tables, 2, 3, width)."""
    width = 1 << max(0, dim - 1).bit_length()
    return np.random.Generator(np.random.PCG64(p.seed)).choice([-1.0, 1.0], size=(p.tables, 2, 3, width))


def _turned(unit: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Coordinates along all signed axes after one pseudo-rotation."""
    x = np.zeros((len(unit), signs.shape[1]))
    x[:, : unit.shape[1]] = unit
    for s in signs:
        x = hadamard(x * s)
    return np.concatenate([x, -x], axis=1)


def _codes(unit: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Bucket of every vector in one table: the nearest axes of its two rotations."""
    a, b = _turned(unit, table[0]), _turned(unit, table[1])
    return a.argmax(axis=1) * a.shape[1] + b.argmax(axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Packed float64 vectors as rows."""
    return np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in column])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and vector (array of double) of the rows that take part, equal rows once.

    Left out: null ids; vectors that are null, empty or zero, that hold null or non-finite
    components, or whose length is not the table's most frequent one (of equally frequent, the least).
    """
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("vector") == (top["d"] if top else 0))


def _packed(rows: DataFrame) -> DataFrame:
    """vec_id and the bytes of the vector as float64, scaled by a power of two to below 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
            if len(flat):
                flat = flat.reshape(len(column), -1)
                # Powers of two change no cosine, and squares then neither overflow nor vanish.
                flat = np.ldexp(flat, -np.frexp(np.abs(flat).max(axis=1, keepdims=True))[1])
            width = flat.size // max(1, len(column)) * 8
            data = flat.tobytes()
            packed = [data[i * width : (i + 1) * width] for i in range(len(column))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["vec_id", "packed"])

    return rows.toDF("vec_id", "vector").mapInArrow(run, "vec_id bigint, packed binary")


def nearest(vectors: DataFrame, is_query, k: int = 5, p: CrossPolytope = CrossPolytope()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for every row of which ``is_query`` (a column on vec_id) holds.

    ``vectors`` has vec_id and embedding; see ``usable`` for the rows that take part. Nearness is the
    cosine of the original vectors in double precision, ties go to the smaller vec_id, a query's
    own id is left out. Fewer than ``k`` rows come back only where the table has fewer others.

    Of equal vectors only the k + 1 smallest ids can be among anyone's k nearest, so the index
    holds these, and equal queries are searched once: a vector that a third of all rows share costs
    no more than another. That is exact, no cap.
    """
    rows = materialize(usable(vectors), "vectors")
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    held = rows.distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth")
    index = materialize(_packed(held.select("vec_id", "vector")), "index")
    n = index.count()
    queries = rows.where(is_query).select("vec_id", "vector").distinct()
    shared = queries.groupBy("vector").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n_queries"))
    shared = materialize(shared, "distinct-queries")
    if not n or shared.isEmpty():
        return index.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = len(shared.select("vector").first()[0])
    signs = rotations(dim, p)
    axes = 2 * signs.shape[3]
    counts = _bucket_counts(index, signs, axes)
    asked = _packed(shared.select("first_id", "vector"))
    least = max(p.least_probed, k + 1, int(np.ceil(p.probe_factor * np.sqrt(n))))
    budget = max(least, _fitted_budget(index, asked, signs, counts, axes, k, p))
    found = _search(index, asked, signs, counts, axes, budget, k, p)
    best = Window.partitionBy("first_id").orderBy(F.desc("score"), "vec_id")
    few = found.distinct().withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    few = few.groupBy("first_id").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    lists = materialize(shared.join(few, "first_id").select("vector", "n_queries", "near"), "near-lists")
    total = queries.count()
    each = lookup_join(queries.withColumnRenamed("vec_id", "query_id"), lists, ["vector"], "n_queries", total)
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return each.select("query_id", F.posexplode(others).alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score"
    )


def _bucket_counts(index: DataFrame, signs: np.ndarray, axes: int) -> np.ndarray:
    """Rows per table and bucket: at most tables * axes**2 numbers, however many rows there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(signs), axes * axes), np.int64)
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_matrix(batch.column(1)))
                for t, table in enumerate(signs):
                    total[t] += np.bincount(_codes(unit, table), minlength=axes * axes)
        t, code = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t * axes * axes + code), pa.array(total[t, code])], names=["bucket", "n"])

    rows = index.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(signs) * axes * axes, np.int64)
    counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return counts.reshape(len(signs), axes * axes)


def _probe_order(a: np.ndarray, b: np.ndarray, filled: np.ndarray, axes: int) -> np.ndarray:
    """Filled buckets of a table in the order in which a query with these coordinates probes them."""
    return filled[np.argsort(-(a[filled // axes] + b[filled % axes]), kind="stable")]


def _fitted_budget(index, queries, signs, counts, axes, k, p: CrossPolytope) -> int:
    """Rows to probe per table so that ``p.recall`` of the true neighbours are met in one table or another.

    Up to ``p.fit_queries`` queries are compared with all rows in one pass. A true neighbour is met as
    soon as some table is probed up to its bucket, so what it needs is known without searching.
    """
    chosen = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(p.fit_queries).toArrow().combine_chunks()
    own, asked = chosen.column(0).to_numpy(), _unit(_matrix(chosen.column(1).combine_chunks()))

    def nearest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                ids, unit = batch.column(0)[lo : lo + 4096].to_numpy(), _unit(_matrix(batch.column(1)[lo : lo + 4096]))
                score = asked @ unit.T
                score[own[:, None] == ids] = -np.inf
                m = min(k, len(ids))
                at = np.argpartition(-score, m - 1, axis=1)[:, :m]
                q, at = np.repeat(np.arange(len(own)), m), at.ravel()
                met, back = np.unique(at, return_inverse=True)
                codes = np.stack([_codes(unit[met], table) for table in signs], axis=1)[back]
                ends = np.arange(len(at) + 1, dtype=np.int32) * len(signs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q), pa.array(ids[at]), pa.array(score[q, at]), pa.ListArray.from_arrays(pa.array(ends), pa.array(codes.ravel()))],
                    names=["q", "vec_id", "score", "codes"],
                )

    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    near = index.mapInArrow(nearest_rows, "q bigint, vec_id bigint, score double, codes array<bigint>").where(F.col("score") > float("-inf"))
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("q", "codes").collect()
    if not near:
        return 0
    q, codes = np.array([r["q"] for r in near]), np.array([r["codes"] for r in near])
    need = np.full(len(q), counts.sum())
    for t, table in enumerate(signs):
        a, b = _turned(asked, table[0]), _turned(asked, table[1])
        filled = np.flatnonzero(counts[t])
        before = np.zeros(axes * axes, np.int64)
        for i in np.unique(q):
            order = _probe_order(a[i], b[i], filled, axes)
            # A bucket is probed once those before it hold fewer rows than the budget.
            before[order] = np.cumsum(counts[t][order]) - counts[t][order]
            mine = q == i
            need[mine] = np.minimum(need[mine], before[codes[mine, t]] + 1)
    per_query = np.bincount(q, minlength=len(own))
    asks = per_query > 0
    for budget in np.unique(need):
        hits = (np.bincount(q, weights=need <= budget, minlength=len(own))[asks]) / per_query[asks]
        if hits.mean() - 2 * hits.std() / np.sqrt(len(hits)) >= p.recall:
            return int(budget)
    return int(need.max())


def _search(index, queries, signs, counts, axes, budget, k, p: CrossPolytope) -> DataFrame:
    """first_id, vec_id, score: per query and block the k + 1 best of the rows in probed buckets."""
    cell_of = (np.arange(axes * axes) // axes) * p.cells // axes
    sizes = np.stack([np.bincount(cell_of, weights=c, minlength=p.cells) for c in counts]).astype(np.int64)
    row_blocks = np.maximum(1, -(-sizes // p.block_rows))
    query_blocks = max(1, -(-queries.count() // p.block_queries))
    keys = ["table", "cell", "row_block", "query_block"]

    def salted(ids: np.ndarray, blocks) -> np.ndarray:
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x >> np.uint64(32)) % np.asarray(blocks, np.uint64)).astype(np.int64)

    def out(table, cell, row_block, query_block, ids, packed, codes, name):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int32()) for c in (table, cell, row_block, query_block)] + [pa.array(ids), packed, codes],
            names=[*keys, name, "packed", "codes"],
        )

    def deal_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, unit = batch.column(0).to_numpy(), _unit(_matrix(batch.column(1)))
            for t, table in enumerate(signs):
                code = _codes(unit, table)
                cell = cell_of[code]
                block = salted(ids, row_blocks[t][cell])
                for q in range(query_blocks):
                    yield out(np.full(len(ids), t), cell, block, np.full(len(ids), q), ids, batch.column(1), pa.array(code), "vec_id")

    def deal_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, unit = batch.column(0).to_numpy(), _unit(_matrix(batch.column(1)))
            for t, table in enumerate(signs):
                a, b = _turned(unit, table[0]), _turned(unit, table[1])
                filled = np.flatnonzero(counts[t])
                rows, probes, held = [], [], 0
                for i in range(len(ids)):
                    order = _probe_order(a[i], b[i], filled, axes)
                    last = int(np.searchsorted(np.cumsum(counts[t][order]), budget)) + 1
                    probed = np.sort(order[:last])
                    cell = cell_of[probed]
                    for c in np.unique(cell):
                        mine = probed[cell == c].astype(np.int32).tobytes()
                        for r in range(row_blocks[t][c]):
                            rows.append((i, c, r))
                            probes.append(mine)
                            held += len(mine)
                    if held < p.batch_bytes and i + 1 < len(ids):
                        continue
                    at = np.array([r[0] for r in rows])
                    yield out(
                        np.full(len(rows), t), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), salted(ids[at], query_blocks),
                        ids[at], batch.column(1).take(pa.array(at)), pa.array(probes, pa.binary()), "first_id",
                    )
                    rows, probes, held = [], [], 0

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        first, second, scores = [], [], []
        if rows.num_rows and asked.num_rows:
            ids, code = rows.column("vec_id").to_numpy(), rows.column("codes").to_numpy()
            data = _matrix(rows.column("packed").combine_chunks())
            length = np.sqrt((data * data).sum(axis=1))
            on = np.zeros(axes * axes, bool)
            for q, packed, probes in zip(
                asked.column("first_id").to_pylist(), asked.column("packed").to_pylist(), asked.column("codes").to_pylist()
            ):
                probed = np.frombuffer(probes, np.int32)
                on[probed] = True
                at = np.flatnonzero(on[code])
                on[probed] = False
                if not len(at):
                    continue
                x = np.frombuffer(packed, np.float64)
                # Row by row sums: the same two vectors give the same score in whatever block they meet.
                score = (data[at] * x).sum(axis=1) / (length[at] * np.sqrt((x * x).sum()))
                if len(at) > k + 1:
                    at, score = at[(cut := score >= np.partition(score, -(k + 1))[-(k + 1)])], score[cut]
                best = np.lexsort((ids[at], -score))[: k + 1]
                first.append(np.full(len(best), q))
                second.append(ids[at][best])
                scores.append(score[best])
        empty = np.zeros(0, np.int64)
        return pa.table({
            "first_id": np.concatenate(first) if first else empty,
            "vec_id": np.concatenate(second) if second else empty,
            "score": np.concatenate(scores) if scores else np.zeros(0),
        })

    shape = "table int, cell int, row_block int, query_block int, {} bigint, packed binary, codes {}"
    dealt = index.mapInArrow(deal_rows, shape.format("vec_id", "bigint"))
    asked = queries.mapInArrow(deal_queries, shape.format("first_id", "binary"))
    found = dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, "first_id bigint, vec_id bigint, score double")
    return materialize(found, "found")
