"""Joins and sizes that hold when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

#: A key is hot when it has more than this share of all rows, so there are fewer than 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 1000


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one ``lookup`` row per key, whatever the skew of ``rows``.

    ``weight`` is the lookup column that says how many of the ``total`` rows have the key. Keys
    with more than ``HOT_SHARE`` of them number fewer than 1,000, so that part of the lookup is
    broadcast; all other keys are joined by a shuffle in which no key is large.
    """
    keys = list(keys)
    is_hot = F.col(weight) > total * HOT_SHARE
    hot = lookup.where(is_hot)
    few = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(lookup.where(~is_hot), keys)
    return few.unionByName(rest)
