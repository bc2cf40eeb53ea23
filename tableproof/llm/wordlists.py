"""Words of whole texts as Arrow arrays, cut with numpy over byte buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tableproof.llm.shingles import text_buffers

#: Bytes of text handled at a time; a longer single text is handled alone.
PORTION = 512 << 10


def byte_set(values: bytes) -> np.ndarray:
    """Table over all byte values that says which are in ``values``."""
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


#: Space and 0x09 to 0x0D.
BLANKS = byte_set(b"\x20\x09\x0a\x0b\x0c\x0d")


def portions(column: pa.Array, size: int = PORTION) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) for runs of texts of about ``size`` bytes; null counts as empty."""
    data, offsets = text_buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(max(int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1, lo + 1), n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def cut_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and byte after the last of every word, and words per text; no word crosses a text's edge."""
    inside = ~separators[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside & edge[:-1]
    begins[1:] |= inside[1:] & ~inside[:-1]
    closes = inside & edge[1:]
    closes[:-1] |= inside[:-1] & ~inside[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, separators: np.ndarray = BLANKS) -> pa.Array:
    """All words as one string array; ``starts`` and ``ends`` are those of ``cut_words``."""
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    kept = data[~separators[data]]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(kept)))
