"""Byte-level BPE ids of whole texts, read from a tokenizer file, a batch of texts at a time.

Texts are cut at spaces. A space that does not touch other white space always begins a new
pre-token, so a word with its leading space has the same ids wherever it stands. Each different
word of a slice is therefore encoded once, and ids are gathered by numpy. Texts in which a space
touches white space behind it, or which end in a space, are encoded whole. Texts that contain an
added token of the file go to the file's own tokenizer.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed value: the pre-token pattern of the byte-level tokenizer.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A space before any white space (more than Unicode's, to be safe) or at the end.
_TOUCHING = r" (?:[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)"
#: Bytes of text encoded together.
SLICE = 2 << 20


def _byte_of_char() -> dict[str, int]:
    """Printable stand-ins of the vocabulary file back to bytes: printable Latin-1 stands for itself, the rest follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizer:
    """Ids as the vocabulary file's tokenizer gives them when it adds no special tokens of its own.

    ``encode_special_tokens`` is the tokenizer's: if true, added tokens that a text shows are ordinary
    text; if false, as by the tokenizer's default, they have their own ids.
    """

    def __init__(self, path: str, encode_special_tokens: bool = True):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = _byte_of_char()
        special = {t["content"] for t in spec["added_tokens"]}
        self._path, self._original = path, None
        self._added = "|".join(re.escape(t) for t in sorted(special)) if special and not encode_special_tokens else None
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self._core = tiktoken.Encoding(path, pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
        self._bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self._bytes[i] = len(token)

    def _with_added(self, text: str) -> np.ndarray:
        """Ids of a text that contains added tokens, by the original; it is loaded when first needed."""
        if self._original is None:
            import tokenizers

            self._original = tokenizers.Tokenizer.from_file(self._path)
        return np.array(self._original.encode(text, add_special_tokens=False).ids, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self._core.encode_ordinary(text), np.uint32)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each with a space before it, laid end to end, and ids per word.

        Encoded in one go: words begin with their spaces, so none changes its neighbour's ids, and
        bytes per id tell where a word ends.
        """
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids = self.whole(" " + " ".join(words.to_numpy(zero_copy_only=False)))
        ends = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)
        return ids, np.diff(np.searchsorted(np.cumsum(self._bytes[ids]), ends) + 1, prepend=0)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a string column, in order; null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        sizes = pc.binary_length(texts).to_numpy()
        start = 0
        while start < len(texts):
            end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), SLICE, "right")))
            yield from self._slice(texts.slice(start, end - start))
            start = end

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        odd = pc.match_substring_regex(texts, _TOUCHING).to_numpy(zero_copy_only=False)
        added = np.zeros(len(texts), bool)
        if self._added:
            added = pc.match_substring_regex(texts, self._added).to_numpy(zero_copy_only=False)
            odd = odd | added
        split = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        if isinstance(split, pa.ChunkedArray):
            split = split.combine_chunks()
        words = split.flatten().dictionary_encode()
        at = words.indices.to_numpy().astype(np.int64)
        counts = np.asarray(pc.list_value_length(split), np.int64)
        first = np.cumsum(counts) - counts
        pool, lengths = self._words(words.dictionary)
        # A text's first word has no space before it.
        names = words.dictionary.take(pa.array(at[first])).to_pylist()
        at[first] = len(lengths) + np.arange(len(first))
        heads = [self.whole(w) for w in names]
        pool = np.concatenate([pool, *heads])
        lengths = np.concatenate([lengths, np.array([len(h) for h in heads], np.int64)])
        begin = np.cumsum(lengths) - lengths
        n = lengths[at]
        ends = np.cumsum(n)
        flat = pool[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin[at] - (ends - n), n)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)].tolist()
        nth = 0
        for i, is_odd in enumerate(odd.tolist()):
            if is_odd:
                yield (self._with_added if added[i] else self.whole)(texts[i].as_py())
            else:
                yield flat[bounds[nth] : bounds[nth + 1]]
                nth += 1
