"""Phrases whose words come together more often than their parts do, mined per language.

Top-order marginalisation: every word leads exactly one window, of itself and the words after it in its
piece, padded to the longest phrase. Only these windows are counted; a ROLLUP over their columns sums
the counts of ever shorter prefixes, and a phrase's count is that of the prefix it is. The sum over no
word column is the number of words.

Most windows hold a pair of words that is too rare for any phrase to be counted. Pairs, and then the longer
sequences made of pairs that pass, are first counted by hash into tables of bits (at most ``most_bits``, whatever
the corpus): where a cell's whole count is below ``least``, no sequence in it reaches it, and windows
end before it is complete. Nothing that could reach ``least`` is ever cut; a cell shared with other
sequences only lets more windows through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tableproof.llm.shingles import mix
from tableproof.llm.wordlists import byte_set, cut_words, portions, word_array
from tableproof.session import materialize

_BREAKS = byte_set(b".,;:!?\x0a\x0b\x0c\x0d")
_SEPARATORS = _BREAKS | byte_set(b"\x20\x09")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class PhraseParams:
    #: Words of the longest phrase.
    most_words: int = 4
    #: Occurrences of a candidate.
    least: int = 30
    #: A candidate goes if a longer one around it has this percentage of its occurrences.
    absorbed_percent: int = 80
    #: Cells of a filter, as a power of two, at most: 2**28 cells are 32 MB of bits on driver and executors.
    most_bits: int = 28
    #: Bytes of text per cell up to that size.
    bytes_per_cell: int = 32


class _Portion:
    """Words of some texts: numbers into a dictionary, language numbers, and whether the next word is in the same piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        data = _LOWER[data]
        starts, ends, counts = cut_words(data, offsets, _SEPARATORS)
        encoded = word_array(data, starts, ends, _SEPARATORS).dictionary_encode()
        self.words = encoded.dictionary
        self.ids = encoded.indices.to_numpy().astype(np.int64)
        self.langs = np.repeat(langs, counts)
        piece = np.cumsum(_BREAKS[data], dtype=np.int64)[starts]
        text = np.repeat(np.arange(len(counts)), counts)
        self.joined = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])

    def cells(self, lang_hashes: np.ndarray, bits: int, size: int) -> np.ndarray:
        """Filter cell of the ``size`` words from each place on (also of those that no piece holds)."""
        own = pd.util.hash_array(self.words.to_numpy(zero_copy_only=False).astype(object), categorize=False)[self.ids]
        n = max(0, len(own) - size + 1)
        gram = lang_hashes[self.langs[:n]] + np.uint64(size)
        for j in range(size):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + own[j : j + n]
        return (mix(gram) >> np.uint64(64 - bits)).astype(np.int64)

    def lengths(self, lang_hashes: np.ndarray, bits: int, filters: list[np.ndarray], most: int) -> np.ndarray:
        """Words of the window that each word leads: within its piece and as far as the filters (pairs, then longer) pass."""

        def marked(table: np.ndarray, size: int) -> np.ndarray:
            cells = self.cells(lang_hashes, bits, size)
            return (table[cells >> 6] >> (cells & 63) & 1).astype(bool)

        n = len(self.ids)
        goes_on = self.joined & marked(filters[0], 2) if filters else self.joined
        out, alive = np.ones(n, np.int64), np.ones(n, bool)
        for j in range(2, most + 1):
            m = max(0, n - j + 1)
            alive = alive[:m] & goes_on[j - 2 : j - 2 + m]
            if j > 2 and len(filters) > 1:
                alive &= marked(filters[1], j)
            out[:m][alive] = j
        return out


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[_Portion, pa.Array, np.ndarray]]:
    """Portions of a batch (lang, text) with its languages and their hashes."""
    langs = batch.column(0).dictionary_encode()
    numbers = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    hashes = pd.util.hash_array(langs.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    for lo, hi, data, offsets in portions(batch.column(1), 2 << 20):
        part = _Portion(data, offsets, numbers[lo:hi])
        if len(part.ids):
            yield part, langs.dictionary, hashes


def _cell_filter(texts: DataFrame, bits: int, least: int, sizes: range, filters: list) -> np.ndarray:
    """Bit per cell: whether the sequences of ``sizes`` words in it, those that ``filters`` pass, are ``least`` together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [f.value for f in filters]
        for batch in batches:
            for part, _, hashes in _portions(batch):
                length = part.lengths(hashes, bits, known, sizes[-1])
                found = [part.cells(hashes, bits, j)[length[: max(0, len(length) - j + 1)] >= j] for j in sizes]
                cells, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n.astype(np.int64))], names=["cell", "n"])

    full = texts.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    blocks = full.groupBy(F.shiftright("cell", 6).alias("block")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(cell & 63 AS INT))")).alias("bits")
    ).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[blocks.column("block").to_numpy()] = blocks.column("bits").to_numpy()
    return out


def lead_windows(texts: DataFrame, p: PhraseParams) -> DataFrame:
    """(lang, w1, ..., n): windows of the words that lead them, padded with '', and how often each comes.

    ``texts`` are rows (lang, text) without nulls. A window ends with its piece, at ``most_words``, or before
    it would become a sequence that the filters rule out.
    """
    spark, k = texts.sparkSession, p.most_words
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(1, size / p.bytes_per_cell))), 6, p.most_bits))
    filters = []
    for sizes in (range(2, 3), range(3, k + 1)):
        if sizes and sizes[-1] <= k:
            filters.append(spark.sparkContext.broadcast(_cell_filter(texts, bits, p.least, sizes, filters)))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [f.value for f in filters]
        for batch in batches:
            for part, langs, hashes in _portions(batch):
                length = part.lengths(hashes, bits, known, k)
                pad = len(part.words)
                columns = [part.ids]
                for j in range(2, k + 1):
                    column = np.full(len(part.ids), pad)
                    at = np.flatnonzero(length >= j)
                    column[at] = part.ids[at + j - 1]
                    columns.append(column)
                # One row per distinct window of the portion.
                code = part.langs
                for column in columns:
                    code = np.unique(code * (pad + 1) + column, return_inverse=True)[1]
                _, first, counts = np.unique(code, return_index=True, return_counts=True)
                words = pa.concat_arrays([part.words, pa.array([""], part.words.type)]).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(part.langs[first])).cast(pa.string()), *(words.take(pa.array(c[first])) for c in columns), pa.array(counts.astype(np.int64))],
                    names=["lang", *(f"w{j}" for j in range(1, k + 1)), "n"],
                )

    names = [f"w{j}" for j in range(1, k + 1)]
    rows = texts.mapInArrow(windows, f"lang string, {', '.join(f'{w} string' for w in names)}, n bigint")
    return rows.groupBy("lang", *names).agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, p: PhraseParams, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, words, phrase, f) of every phrase of up to ``most_words`` words that comes ``least`` times; no words: all occurrences of words."""
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    k = p.most_words
    names = [f"w{j}" for j in range(1, k + 1)]
    summed = lead_windows(texts, p).rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("left_out"))
    words = F.array_compact(F.array(*names))
    # Grouping leaves out the last columns as null; padding is '' and stands for no phrase of its own.
    return summed.where(
        (F.col("left_out") < 1 << k) & (F.col("left_out") == (1 << k) - 1)
        | (F.col("left_out") < (1 << k) - 1) & (F.element_at(words, -1) != "") & (F.col("f") >= p.least)
    ).select("lang", words.alias("words"), F.array_join(words, " ").alias("phrase"), "f")


def _part(first: Column, length: Column) -> Column:
    return F.array_join(F.slice("words", first.cast("int"), length.cast("int")), " ")


def collocations(docs: DataFrame, p: PhraseParams = PhraseParams(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All phrases that stay: lang, words, phrase, a, cut, l, r, score, n.

    ``a`` are the phrase's occurrences, ``cut`` the words before its weakest cut (least score, ties to the fewest
    words), ``l`` and ``r`` the occurrences of the parts, ``score`` floor(2000000 * a / (l + r)), ``n`` the words of the
    language. A phrase goes if its words lie inside a longer candidate with ``absorbed_percent`` of its
    occurrences, whether that one stays or not. Words are split at blanks, pieces at ``.,;:!?`` and line
    ends; A-Z counts as a-z. Null languages count as 'und'; null, empty and blank texts have no words;
    repeated rows count as often as they come; texts of any length are read whole; other columns are not read.
    """
    counted = materialize(phrase_counts(docs, p, text_col, lang_col), "phrases")
    phrases, total = counted.where(F.size("words") > 0), counted.where(F.size("words") == 0)
    candidates = phrases.where(F.size("words") > 1)
    cuts = candidates.select("lang", "words", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut"))
    cuts = cuts.withColumns({"lhs": _part(F.lit(1), F.col("cut")), "rhs": _part(F.col("cut") + 1, F.size("words") - F.col("cut"))})
    one = phrases.select("lang", F.col("phrase").alias("lhs"), F.col("f").alias("l"))
    two = phrases.select("lang", F.col("phrase").alias("rhs"), F.col("f").alias("r"))
    weak = F.expr("(CAST(a AS DECIMAL(20, 0)) * 2000000) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    scored = cuts.join(one, ["lang", "lhs"]).join(two, ["lang", "rhs"]).groupBy("lang", "phrase").agg(
        F.first("words").alias("words"), F.first("a").alias("a"), F.min(F.struct(weak.alias("score"), "cut", "l", "r")).alias("at")
    )
    # Every shorter phrase inside a candidate, with the largest count around it.
    inside = candidates.where(F.size("words") > 2).select(
        "lang", "words", "f", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("size")
    ).select("lang", "words", "f", "size", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("first"))
    around = inside.select("lang", _part(F.col("first"), F.col("size")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    absorbed = F.expr(f"CAST(around AS DECIMAL(20, 0)) * 100 >= CAST(a AS DECIMAL(20, 0)) * {int(p.absorbed_percent)}")
    return (
        scored.join(around, ["lang", "phrase"], "left").where(~F.coalesce(absorbed, F.lit(False)))
        .join(total.select("lang", F.col("f").alias("n")), "lang")
        .select("lang", "words", "phrase", "a", "at.cut", "at.l", "at.r", "at.score", "n")
    )


def top_phrases(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` phrases of each language, with their rank; a language's rows are cut in parts before they meet in one task."""
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    few = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= most)
    return few.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= most)


def top_phrases_sql(most: int, p: PhraseParams = PhraseParams()) -> str:
    """DuckDB SQL for the first ``most`` phrases of each language in ``documents``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents),
    lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
    totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM lists GROUP BY 1),
    grams AS (
      SELECT lang, ws[i : i + k - 1] AS words
      FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM lists, (SELECT unnest(range(1, {p.most_words + 1})) AS k))),
    f AS (SELECT lang, words, array_to_string(words, ' ') AS phrase, count(*) AS f FROM grams GROUP BY 1, 2 HAVING count(*) >= {p.least}),
    cuts AS (SELECT *, unnest(range(1, len(words))) AS cut FROM f WHERE len(words) > 1),
    scored AS (
      SELECT c.lang, c.words, c.phrase, c.f AS a, c.cut, x.f AS l, y.f AS r,
        ((2000000::HUGEINT * c.f) // (x.f + y.f))::BIGINT AS score
      FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1 : c.cut], ' ')
      JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[c.cut + 1 :], ' ')),
    weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    sizes AS (SELECT lang, words, f, unnest(range(2, len(words))) AS k FROM f),
    subs AS (SELECT lang, words, f, k, unnest(range(1, len(words) - k + 2)) AS i FROM sizes),
    around AS (SELECT lang, array_to_string(words[i : i + k - 1], ' ') AS phrase, max(f) AS around FROM subs GROUP BY 1, 2),
    kept AS (
      SELECT w.* FROM weakest w LEFT JOIN around o USING (lang, phrase)
      WHERE o.around IS NULL OR 100::HUGEINT * o.around < {p.absorbed_percent}::HUGEINT * w.a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {most}"""
