"""Vector best-fit packing of token sequences under token, document-count and attention-cost limits.

What a piece demands of a bin follows from its length alone, so the packing works on the histogram
of lengths: at most ``max_tokens`` numbers, whatever the corpus. Bins in the same state form a class
that is filled at once. The outcome is a bounded list of runs (length, rank, bins, offset); each piece
finds its place from its rank among the pieces of its length. No task or driver sees all pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tableproof.llm.tokens import Tokenizer
from tableproof.session import materialize


@dataclass(frozen=True)
class Limits:
    """Capacities of one sequence, and the weights of the three dimensions in the choice of a bin."""

    max_tokens: int = 1024
    #: Pieces in one sequence.
    max_docs: int = 1024
    #: Sum of squared piece lengths, the attention cost of block-diagonal masks.
    max_cost: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1)

    def capacity(self) -> np.ndarray:
        return np.array([self.max_tokens, self.max_docs, self.max_cost], np.int64)

    def demand(self, length: int) -> np.ndarray:
        return np.array([length, 1, length * length], np.int64)


#: length, rank of the run's first piece, pieces (one per bin), first bin, offset in each bin
Run = tuple[int, int, int, int, int]


def _same_length(limits: Limits, length: int) -> int:
    return int((limits.capacity() // limits.demand(length)).min())


def pack_by_norm(histogram: dict[int, int], limits: Limits) -> tuple[list[Run], int]:
    """Longest pieces first, each into the open bin that it leaves with the smallest weighted residual norm."""
    cap = limits.capacity().astype(float)
    scale = np.array(limits.weights) / cap**2
    room = np.zeros((64, 3), np.int64)
    first, size = np.zeros(64, np.int64), np.zeros(64, np.int64)
    used, bins, runs = 0, 0, []

    def add(state, at, n):
        nonlocal room, first, size, used
        if used == len(size):
            live = size[:used] > 0
            keep = int(live.sum())
            space = max(64, 2 * keep)
            room = np.concatenate([room[:used][live], np.zeros((space, 3), np.int64)])
            first = np.concatenate([first[:used][live], np.zeros(space, np.int64)])
            size = np.concatenate([size[:used][live], np.zeros(space, np.int64)])
            used = keep
        room[used], first[used], size[used] = state, at, n
        used += 1

    for length in sorted(histogram, reverse=True):
        need, left, rank = limits.demand(length), histogram[length], 0
        while left:
            fits = np.flatnonzero((size[:used] > 0) & (room[:used] >= need).all(axis=1))
            if not len(fits):
                break
            after = (room[fits] - need).astype(float)
            best = fits[np.argmin((after * after * scale).sum(axis=1))]
            n, state, at = min(left, int(size[best])), room[best].copy(), int(first[best])
            runs.append((length, rank, n, at, limits.max_tokens - int(state[0])))
            first[best] += n
            size[best] -= n
            add(state - need, at, n)
            rank, left = rank + n, left - n
        per = _same_length(limits, length)
        # Of pieces that fit no open bin, each next one best fits the bin that its like has just opened.
        for n, each in ((left // per, per), (1, left % per)):
            if n and each:
                for j in range(each):
                    runs.append((length, rank, n, bins, j * length))
                    rank += n
                add(limits.capacity() - need * each, bins, n)
                bins += n
    return runs, bins


def pack_by_dot_product(histogram: dict[int, int], limits: Limits) -> tuple[list[Run], int]:
    """Bin after bin takes the piece with the largest weighted dot product of demand and residual that fits.

    Bins that would be filled alike are filled together, until one of their lengths runs out.
    """
    lengths = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[int(x)] for x in lengths], np.int64)
    ranks = np.zeros(len(lengths), np.int64)
    need = np.stack([lengths, np.ones_like(lengths), lengths * lengths], axis=1)
    cap = limits.capacity()
    weigh = np.array(limits.weights) / cap.astype(float) ** 2
    bins, runs = 0, []
    while left.any():
        room, taken, order = cap.copy(), np.zeros(len(lengths), np.int64), []
        while True:
            fits = np.flatnonzero((taken < left) & (need <= room).all(axis=1))
            if not len(fits):
                break
            best = fits[np.argmax((need[fits] * room * weigh).sum(axis=1))]
            order.append((int(best), int(cap[0] - room[0])))
            taken[best] += 1
            room -= need[best]
        n = int((left[taken > 0] // taken[taken > 0]).min())
        for i, offset in order:
            runs.append((int(lengths[i]), int(ranks[i]), n, bins, offset))
            ranks[i] += n
            left[i] -= n
        bins += n
    return runs, bins


def pack(histogram: dict[int, int], limits: Limits) -> tuple[list[Run], int]:
    """The better of both rules: runs and the number of bins."""
    for length in histogram:
        if not 0 < length <= limits.max_tokens or _same_length(limits, length) < 1:
            raise ValueError(f"a piece of {length} tokens fits no sequence")
    return min(pack_by_norm(histogram, limits), pack_by_dot_product(histogram, limits), key=lambda r: r[1])


def tokenized_pieces(docs: DataFrame, tokenizer: str, end_id: int, max_tokens: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row of ``docs`` (doc_id, text).

    A text's ids and ``end_id`` behind them are one piece, or, if longer than ``max_tokens``, full
    pieces after a first one that takes the remainder. Null texts count as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Tokenizer(tokenizer, encode_special_tokens=False)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                ids = np.concatenate([ids, end]).astype("<u4", copy=False)
                n = len(ids)
                cut = n % max_tokens or max_tokens
                start = 0
                piece = 0
                while start < n:
                    for column, value in zip(rows, (doc_id, piece, start, cut - start, zlib.crc32(ids[start:cut].tobytes()))):
                        column.append(value)
                    start, cut, piece = cut, cut + max_tokens, piece + 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def _ranked(pieces: DataFrame, per_group: int = 100_000) -> DataFrame:
    """``rank`` of each piece among those of its length, without gaps; no window holds more than a hash group."""
    groups = pieces.count() // per_group + 1
    cols = pieces.columns
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    counts = dealt.groupBy("length", "__group").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("length", "__group", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("length", "__group").orderBy("doc_id", "piece", "ids_crc32", "start"))
    return dealt.withColumn("__nth", nth - 1).join(earlier, ["length", "__group"]).select(
        *cols, (F.col("__before") + F.col("__nth")).alias("rank")
    )


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 2) -> DataFrame:
    """Every piece of every row of ``docs`` and its place: sequence_id and offset beside the piece's columns.

    Sequences hold whole pieces one after the other, without gaps from offset 0, within all limits.
    Empty and null texts are one piece, the end id. Repeated rows are packed each; an empty table
    gives no rows; other columns of ``docs`` are not read.
    """
    pieces = materialize(tokenized_pieces(docs, tokenizer, end_id, limits.max_tokens), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = pack(histogram, limits) if histogram else ([], 0)
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    where = (table[:, 0] << 44) + table[:, 1]

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(where, (length.to_numpy() << 44) + rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": table[at, 3] + rank.to_numpy() - table[at, 1], "offset": table[at, 4]})

    placed = _ranked(pieces).withColumn("place", place("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
