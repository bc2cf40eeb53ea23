"""Reproducible shuffle into shards: a Feistel permutation of global row numbers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tableproof.operators.results import with_positions

ROUNDS = 8


def _round_keys(seed: int) -> np.ndarray:
    """One 64-bit key per round, from the seed alone."""
    state = np.random.Generator(np.random.PCG64(seed))
    return state.integers(0, 2**63, size=ROUNDS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _network(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    """Balanced Feistel network over ``2 * half`` bits."""
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for key in keys:
        left, right = right, left ^ (_mix(right + key) & mask)
    # Halves are swapped once more, so that the inverse is the same network with the keys reversed.
    return (right << shift) | left


def permute(positions: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """Image of each position in 0..n-1 under the seed's permutation of 0..n-1.

    The network permutes the next power of four; a value that falls outside 0..n-1 walks on along
    its cycle until it is inside, which needs fewer than four steps on average and keeps the map
    one-to-one.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    keys = _round_keys(seed)
    keys = keys[::-1] if inverse else keys
    out = _network(positions.astype(np.uint64), half, keys)
    outside = out >= n
    while outside.any():
        out[outside] = _network(out[outside], half, keys)
        outside = out >= n
    return out.astype(np.int64)


def shard_rows(rows: DataFrame, order_by: Sequence[str], shards: int, seed: int) -> DataFrame:
    """``rows`` with position, shard and slot: permuted row number modulo and divided by ``shards``.

    Row numbers follow ``order_by`` and then all columns, so equal rows are the only ones that may
    change places between runs. Shard sizes differ by one row at most, slots have no gaps, and
    ``locate`` and ``row_at`` compute a row's place, and a place's row, without the data.
    An empty table gives no rows; nulls sort first.
    """
    numbered = with_positions(rows, order_by)
    n = numbered.count()

    @F.pandas_udf("long")
    def place(position: pd.Series) -> pd.Series:
        return pd.Series(permute(position.to_numpy(), n, seed))

    return (
        numbered.withColumn("__place", place("position"))
        .withColumn("shard", F.pmod("__place", F.lit(shards)).cast("int"))
        .withColumn("slot", F.expr(f"__place div {int(shards)}"))
        .drop("__place")
    )


def locate(position: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of the row with this number."""
    p = int(permute(np.array([position]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """Number of the row at this place."""
    return int(permute(np.array([slot * shards + shard]), n, seed, inverse=True)[0])
