"""Periodic runs in word sequences: loops such as a phrase repeated over and over.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that is
at least ``least_exponent`` periods and ``least_length`` words long and that no neighbouring word
extends keeping period q.

Method: a pair of places i < j is a *maximal pair* of length m if the m words from i and from j are
equal while the words before and the words after them differ. With q = j - i, the words i to j + m - 1
have period q and no neighbour keeps it, so the maximal pairs with m >= (least_exponent - 1) * q are
exactly the runs, without any extension; a run of period q shows again at multiples of q, and the
least one names it. Maximal pairs are read off the tree of LCP intervals from the bottom up: every
interval holds its places in order and, per left word, in class lists. Where children are joined,
places of different children differ in their right word and places of different classes in their left
word. Two near occurrences of a word sequence overlap, so at most the outermost place of a
neighbourhood is of another class, and counts in the lists tell whether it is there.

Suffixes are sorted per document by prefix doubling, all documents of a portion at once in numpy; the tree is
built only over suffixes that share enough words with another of their document. A document is one
task's work; memory grows with the words of the longest one (times the logarithm of its longest repeat).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from tableproof.llm.wordlists import cut_words, portions, word_array

_RUN_TYPE = "struct<start:bigint,length:bigint,period:bigint>"
RESULT = {"words": "bigint", "runs": f"array<{_RUN_TYPE}>", "strongest": _RUN_TYPE, "collapsed": "string"}
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Dense order numbers of the pairs (first, second), from 1."""
    key = first * (int(second.max(initial=0)) + 1) + second
    order = np.argsort(key, kind="stable")
    step = np.ones(len(key), np.int64)
    step[1:] = key[order[1:]] != key[order[:-1]]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(step)
    return out


def suffix_order(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of all texts, each text's sorted and in a row, and the words that each shares with the next (0 across texts).

    ``words`` are numbers of words, ``text`` the number of the text that each belongs to, ascending.
    """
    n = len(words)
    levels = [_ranks(text.astype(np.int64), words.astype(np.int64))]
    width = 1
    while int(levels[-1].max(initial=0)) < n:
        now, later = levels[-1], np.zeros(n, np.int64)
        same = text[width:] == text[:-width] if width < n else np.zeros(0, bool)
        later[: len(same)][same] = now[width:][same]
        levels.append(_ranks(now, later))
        width *= 2
    order = np.empty(n, np.int64)
    order[levels[-1] - 1] = np.arange(n)
    shared = np.zeros(max(0, n - 1), np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        # Equal numbers mean 2**k equal words of one text.
        rank = np.append(levels[k], -1)
        equal = np.flatnonzero(rank[a] == rank[b])
        shared[equal] += 1 << k
        a[equal] = np.minimum(a[equal] + (1 << k), n)
        b[equal] = np.minimum(b[equal] + (1 << k), n)
        both_out = (a == n) & (b == n)
        b[both_out] = 0
    return order, shared


class _Places:
    """Places of one LCP interval: all in order, and per left word in order."""

    __slots__ = ("all", "classes")

    def __init__(self, place: int, left: int):
        self.all, self.classes = [place], {left: [place]}

    def add(self, other: _Places) -> None:
        if len(other.all) < 8:
            for left, places in other.classes.items():
                own = self.classes.setdefault(left, [])
                for x in places:
                    insort(own, x)
                    insort(self.all, x)
            return
        self.all = sorted(self.all + other.all)
        for left, places in other.classes.items():
            own = self.classes.get(left)
            self.classes[left] = sorted(own + places) if own else places

    def differing(self, place: int, left: int, reach: int, lefts: list[int]) -> Iterator[int]:
        """Places within ``reach`` of ``place`` whose left word is not ``left``."""
        lo, hi = bisect_left(self.all, place - reach), bisect_right(self.all, place + reach)
        if lo == hi:
            return
        same = self.classes.get(left)
        if same and bisect_right(same, place + reach) - bisect_left(same, place - reach) == hi - lo:
            return
        middle = bisect_left(self.all, place, lo, hi)
        # Nearer places repeat the left word of this one, so those that differ lie outermost.
        for at in range(lo, middle):
            if lefts[self.all[at]] == left:
                break
            yield self.all[at]
        for at in range(hi - 1, middle - 1, -1):
            if lefts[self.all[at]] == left:
                break
            yield self.all[at]


def maximal_pairs(order: list[int], shared: list[int], lefts: list[int], least: int, ratio: int) -> Iterator[tuple[int, int, int]]:
    """(i, distance, words in common) of the maximal pairs with ``shared >= ratio * distance``, from sorted suffixes.

    ``shared[t]`` belongs to ``order[t]`` and its successor; values under ``least`` end a tree.
    """

    def join(a: _Places, b: _Places, depth: int) -> Iterator[tuple[int, int, int]]:
        if len(a.all) < len(b.all):
            a, b = b, a
        reach = depth // ratio
        for left, places in b.classes.items():
            for x in places:
                for y in a.differing(x, left, reach, lefts):
                    yield min(x, y), abs(x - y), depth
        a.add(b)
        joined.append(a)

    joined: list[_Places] = []
    stack: list[tuple[int, _Places]] = []
    current = _Places(order[0], lefts[order[0]]) if order else None
    for t in range(1, len(order) + 1):
        depth = shared[t - 1] if t < len(order) else 0
        while stack and stack[-1][0] > depth:
            d, open_places = stack.pop()
            yield from join(open_places, current, d)
            current = joined.pop()
        if depth < least:
            stack.clear()
        elif stack and stack[-1][0] == depth:
            yield from join(stack.pop()[1], current, depth)
            stack.append((depth, joined.pop()))
        else:
            stack.append((depth, current))
        if t < len(order):
            current = _Places(order[t], lefts[order[t]])


def find_runs(words: np.ndarray, text: np.ndarray, least_exponent: int, least_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs as places in ``words``, by start, then period."""
    ratio = least_exponent - 1
    least = min(max(ratio * q, least_length - q) for q in range(1, least_length + 1))
    # Only texts in which some sequence of ``least`` words comes twice can have runs.
    gram, size = _ranks(text.astype(np.int64), words.astype(np.int64)), 1
    while size < least:
        step = min(size, least - size)
        later = np.zeros(len(gram), np.int64)
        same = text[step:] == text[:-step] if step < len(text) else np.zeros(0, bool)
        later[: len(same)][same] = gram[step:][same]
        gram, size = _ranks(gram, later), size + step
    whole = np.zeros(len(text), bool)
    if len(text) >= least:
        whole[: len(text) - least + 1] = text[least - 1 :] == text[: len(text) - least + 1]
    twice = whole & (np.bincount(gram, minlength=len(gram) + 1)[gram] > 1) if len(gram) else whole
    looped = np.zeros(int(text.max(initial=-1)) + 1, bool)
    looped[text[twice]] = True
    kept = np.flatnonzero(looped[text]) if len(text) else np.zeros(0, np.int64)
    found: dict[tuple[int, int], int] = {}
    if len(kept):
        w, own = words[kept], text[kept]
        order, shared = suffix_order(w, own)
        lefts = np.empty(len(w), np.int64)
        lefts[0], lefts[1:] = -1, np.where(own[1:] == own[:-1], w[:-1], -1)
        deep = np.zeros(len(order), bool)
        deep[:-1] |= shared >= least
        deep[1:] |= shared >= least
        at = np.flatnonzero(deep)
        # Between two kept neighbours that were not neighbours nothing deep is shared.
        depth = np.append(shared, 0)[at]
        for i, q, m in maximal_pairs(order[at].tolist(), depth.tolist(), lefts.tolist(), least, ratio):
            if m + q >= least_length:
                run = (int(kept[i]), m + q)
                found[run] = min(found.get(run, q), q)
    rows = np.array(sorted((s, q, m) for (s, m), q in found.items()), np.int64).reshape(-1, 3)
    return rows[:, 0], rows[:, 2], rows[:, 1]


def _strongest(starts: list[int], lengths: list[int], periods: list[int]) -> int:
    """Index of the run with the greatest length / period; ties to the smaller start, then period."""
    best = 0
    for i in range(1, len(starts)):
        if lengths[i] * periods[best] > lengths[best] * periods[i]:
            best = i
    return best


def _result(data: np.ndarray, offsets: np.ndarray, least_exponent: int, least_length: int) -> pa.Array:
    starts, ends, counts = cut_words(data, offsets)
    words = word_array(data, starts, ends)
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    numbers = words.dictionary_encode().indices.to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)
    start, length, period = find_runs(numbers, text, least_exponent, least_length)
    covered = np.zeros(len(text) + 1, np.int64)
    np.add.at(covered, start + period, 1)
    np.add.at(covered, start + length, -1)
    kept = np.cumsum(covered)[:-1] == 0
    per_text = np.bincount(text[kept], minlength=len(counts)) if len(text) else np.zeros(len(counts), np.int64)
    lists = pa.LargeListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64)), words.filter(pa.array(kept)) if len(words) else words
    )
    collapsed = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())
    of = text[start] if len(start) else start
    bounds = np.searchsorted(of, np.arange(len(counts) + 1))
    local = start - first[of]
    runs = pa.ListArray.from_arrays(
        pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays([pa.array(local), pa.array(length), pa.array(period)], fields=list(_RUN))
    )
    strongest = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if lo == hi:
            strongest.append(None)
            continue
        at = lo + _strongest(local[lo:hi].tolist(), length[lo:hi].tolist(), period[lo:hi].tolist())
        strongest.append({"start": int(local[at]), "length": int(length[at]), "period": int(period[at])})
    return pa.StructArray.from_arrays(
        [pa.array(counts.astype(np.int64)), runs, pa.array(strongest, _RUN), collapsed],
        names=list(RESULT),
    )


def periodic_runs(docs: DataFrame, text_col: str = "text", keep: Sequence[str] | None = None, least_exponent: int = 4, least_length: int = 6) -> DataFrame:
    """Per row of ``docs``: ``row`` (its columns, or those in ``keep``, as one struct), words, runs, strongest, collapsed.

    ``runs`` are in order of start, then period, counted in words from 0; ``strongest`` has the greatest
    length / period (ties: smallest start, then period; null without runs). ``collapsed`` are the words
    joined by one space, without those that any run contains after its first period. Words are runs
    of bytes other than space and 0x09 to 0x0D. Null, empty and blank texts have no words, no
    runs and an empty ``collapsed``; a text of any length is taken whole. A result depends on its own row
    only, so repeated rows give repeated results, an empty table an empty one, and columns of ``docs``
    that are named like results stay inside ``row``.
    """
    if least_exponent < 2:
        raise ValueError("a run takes two periods at least")
    carried = docs.select(
        F.struct(*([F.col(f"`{c}`") for c in keep] if keep is not None else ["*"])).alias("row"),
        F.col(text_col).cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in portions(batch.column(1)):
                made = _result(data, offsets, least_exponent, least_length)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *made.flatten()], names=["row", *RESULT])

    schema = StructType([carried.schema["row"], *StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in RESULT.items()))])
    return carried.mapInArrow(run, schema)


def looped(text: Column, seed: Column) -> Column:
    """``text`` with loops planted by ``seed`` (a non-negative number), to have known runs.

    Where seed % 10 = 0 and the text has n > 0 words, every word i >= a becomes word a + (i - a) % p of
    the original, with g = floor(seed / 10), a = g % n and p = 1 + floor((n - a) / (3 + g % 8)); words are
    joined by one space. Other texts, and those with a null seed, stay as they are.
    """
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def planted(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        g = F.floor(seed / 10).cast("bigint")
        a = F.pmod(g, n)
        p = F.expr("1L") + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8)))).cast("bigint")
        # Struct of everything the words need, so that each value is computed once per text.
        return F.struct(w.alias("w"), n.alias("n"), a.alias("a"), p.alias("p"))

    def loop(s: Column) -> Column:
        turned = F.transform(F.sequence(s["a"], s["n"] - 1), lambda i: F.get(s["w"], (s["a"] + (i - s["a"]) % s["p"]).cast("int")))
        return F.array_join(F.concat(F.slice(s["w"], F.lit(1), s["a"].cast("int")), turned), " ")

    # A one-element array stands for a local variable.
    bound = F.transform(F.array(words), planted)
    return F.when((seed % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.transform(bound, loop)[0]).otherwise(text)
