"""Distinct word shingles of whole texts as sorted 64-bit hashes, computed on Arrow buffers.

Words are runs of bytes other than space and 0x09 to 0x0D, with A-Z lower-cased. A text with
fewer words than a shingle takes is one shingle, its whole sequence; a text without words has none.
All loops over bytes and words are numpy; working memory is about 45 times ``WINDOW`` bytes of text
(and eight bytes per word of one text, where a single text is longer). Texts are read where Arrow
holds them, without a copy of the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WINDOW = 256 << 10

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE_WORDS = np.random.Generator(np.random.PCG64(11)).integers(0, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser, one-to-one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if column.type not in (pa.string(), pa.binary(), pa.large_string(), pa.large_binary()):
        column = column.cast(pa.large_binary())
    wide = column.type in (pa.large_string(), pa.large_binary())
    width = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, width)
    if column.null_count and (np.diff(offsets)[column.is_null().to_numpy(zero_copy_only=False)] > 0).any():
        # Nulls may hide bytes; they are written anew without.
        return text_buffers(column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""))
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets.astype(np.int64)


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``WINDOW`` bytes together, one text at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + WINDOW, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def _windows(data: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of at most ``WINDOW`` that end at a separator, so that no word is cut."""
    while hi - lo > WINDOW:
        seps = np.flatnonzero(_SEPARATOR[data[lo : lo + WINDOW]])
        end = lo + int(seps[-1]) + 1 if len(seps) else hi
        yield lo, end
        lo = end
    yield lo, hi


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            ones = np.ones(n, np.uint64)
            self.up, self.down = ones.copy(), ones
            self.up[1:] = np.uint64(_BASE)
            self.down[1:] = np.uint64(_UNBASE)
            self.up, self.down = np.cumprod(self.up), np.cumprod(self.down)
        return self.up, self.down


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, powers: _Powers, separators: np.ndarray = _SEPARATOR, prefixes: tuple[int, ...] = ()
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Hash of every word, words per text, and for each length in ``prefixes`` the hash of each word's first bytes."""
    hashes, starts, heads = [], [], [[] for _ in prefixes]
    for lo, hi in _windows(data, int(offsets[0]), int(offsets[-1])):
        b = _LOWER[data[lo:hi]]
        n = len(b)
        if not n:
            continue
        inside = ~separators[b]
        cut = np.zeros(n + 1, bool)
        at = offsets[(offsets >= lo) & (offsets <= hi)] - lo
        cut[at] = True
        cut[0] = cut[n] = True
        before = np.empty(n, bool)
        before[0], before[1:] = True, ~inside[:-1]
        after = np.empty(n, bool)
        after[-1], after[:-1] = True, ~inside[1:]
        s = np.flatnonzero(inside & (before | cut[:-1]))
        e = np.flatnonzero(inside & (after | cut[1:])) + 1
        up, down = powers.to(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_WORDS[b] * up[:n], out=total[1:])
        h = (total[e] - total[s]) * down[s]
        hashes.append(mix(h ^ ((e - s).astype(np.uint64) * _STEP)))
        starts.append(s + lo)
        for m, out in zip(prefixes, heads):
            to = np.minimum(s + m, e)
            out.append(mix(((total[to] - total[s]) * down[s]) ^ (np.uint64(m) << np.uint64(40))))
    if not hashes:
        none = np.zeros(0, np.uint64)
        return none, np.zeros(len(offsets) - 1, np.int64), [none for _ in prefixes]
    counts = np.diff(np.searchsorted(np.concatenate(starts), offsets))
    return np.concatenate(hashes), counts, [np.concatenate(h) for h in heads]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, powers: _Powers | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingles, sorted within each text and laid end to end, and the size of each set."""
    words, counts, _ = word_hashes(data, offsets, powers or _Powers())
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    ends = np.cumsum(made)
    flat = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    text_of = np.repeat(np.arange(len(counts)), made)
    at = np.arange(len(flat)) - np.repeat(ends - made, made) + np.repeat(first, made)
    length = np.minimum(counts, k)[text_of]
    h = words[at] if len(at) else flat
    for j in range(1, k):
        more = length > j
        h = np.where(more, h * _STEP + words[np.minimum(at + j, len(words) - 1)], h) if len(at) else h
    flat[:] = mix(h + length.astype(np.uint64) * np.uint64(_BASE)) if len(at) else h
    for lo, hi in zip(ends - made, ends):
        flat[lo:hi].sort()
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] != flat[:-1]) | (text_of[1:] != text_of[:-1])
    return flat[keep], np.bincount(text_of[keep], minlength=len(counts)).astype(np.int64)


def set_ids(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit number of each set, the same for equal sets; 0 for an empty one.

    Two different sets out of n share a number with a chance of about n * n / 2**65.
    """
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat ^ _STEP))])
    ends = np.cumsum(sizes)
    ids = mix((total[ends] - total[ends - sizes]) + sizes.astype(np.uint64) * np.uint64(_BASE)) if len(sizes) else total[:0]
    return np.where(sizes > 0, ids, np.uint64(0))


def each_slice(column: pa.Array, k: int, powers: _Powers) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, shingles, set sizes) for parts of a text column."""
    data, offsets = text_buffers(column)
    for lo, hi in slices(offsets):
        flat, sizes = shingle_sets(data, offsets[lo : hi + 1], k, powers)
        yield lo, hi, flat, sizes


def powers() -> _Powers:
    return _Powers()
