"""Hashed sparse features of whole texts: words and their first bytes, computed on Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tableproof.llm import shingles as sh

#: For features, a word is a run of ASCII letters, digits and bytes above 127.
_NOT_IN_WORDS = np.ones(256, bool)
_NOT_IN_WORDS[48:58] = _NOT_IN_WORDS[65:91] = _NOT_IN_WORDS[97:123] = False
_NOT_IN_WORDS[128:] = False


def feature_rows(column: pa.Array, bits: int, prefixes: tuple[int, ...], powers) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, features of all words, words per text) for parts of a text column.

    Features have a row per word and a column for the word and each prefix length, numbers below ``2 ** bits``.
    """
    data, offsets = sh.text_buffers(column)
    mask = np.uint64((1 << bits) - 1)
    for lo, hi in sh.slices(offsets):
        words, counts, heads = sh.word_hashes(data, offsets[lo : hi + 1], powers, _NOT_IN_WORDS, prefixes)
        columns = [(x & mask).astype(np.int64) for x in (words, *heads)]
        yield lo, hi, np.stack(columns, axis=1), counts


def labelled_sample(docs: DataFrame, labels: DataFrame, target: Column, rows: int) -> DataFrame:
    """doc_id, target, text of at most ``rows`` labelled documents, the same ones on every run.

    ``target`` is a column on ``labels`` (doc_id, ...); null targets and ids take no part, of several
    labels of an id the largest counts, of several texts the largest.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), target.alias("target"))
    known = known.where("doc_id IS NOT NULL AND target IS NOT NULL").groupBy("doc_id").agg(F.max("target").alias("target"))
    ids = known.join(docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct(), "doc_id", "left_semi")
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # The chosen rows are bounded by the parameter, so they are sent to the texts.
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "target").agg(F.max("text").alias("text"))
