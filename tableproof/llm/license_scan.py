"""Licence scan by canonical digests: whole texts, and lines that mention a licence, against known digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A line that begins, after comment signs, with a copyright mark says whose work it is, not under which licence.
COPYRIGHT_LINE = r"(^|\n)[ \t#*/;%-]*(copyright|\(c\)|©)[^\n]*"
#: ASCII other than letters and digits.
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Typographic marks that stand for ASCII punctuation, each made a space.
TYPOGRAPHIC = "“”‘’–—…«»•\u00a0"

#: Spellings that licence comparisons treat as equal: (written, canonical).
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("centre", "center"), ("favour", "favor"),
    ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("labour", "labor"),
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("merchantability", "merchantability"),
    ("modelled", "modeled"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("noncommercial", "non commercial"),
    ("sublicence", "sublicense"), ("https", "http"),
)

_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)

#: Known texts: whole licences, and the notices that name one. More rows can be passed in.
KNOWN = (
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
     "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above "
     "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
     + _NO_WARRANTY),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
     "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE "
     "SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
     "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
     "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
     "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
)

#: Known digests up to this number (some 10 MB) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def canonical(text: Column) -> Column:
    """Lower-case words with a space between; copyright lines gone, equivalent spellings made one. Null counts as empty."""
    t = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    t = F.regexp_replace(t, COPYRIGHT_LINE, "\n")
    t = F.regexp_replace(F.translate(t, TYPOGRAPHIC, " " * len(TYPOGRAPHIC)), PUNCTUATION, "  ")
    # Two spaces between words: each word has its own, so neighbours are both replaced.
    t = F.concat(F.lit(" "), t, F.lit(" "))
    for written, one in EQUIVALENT:
        if written != one:
            t = F.replace(t, F.lit(f" {written} "), F.lit(f" {one} "))
    return F.trim(F.regexp_replace(t, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: Sequence[tuple[str, str]] = KNOWN) -> DataFrame:
    """(digest, license_id) of known texts, one row per digest."""
    rows = spark.createDataFrame(list(known), "license_id string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, canonical_sha256, license_id, notices.

    license_id names the licence whose canonical text the whole text is, else null. notices names those
    that lines with the word "licens..." announce, sorted and joined by commas, else empty. Canonically
    empty texts match nothing. Repeated rows are rows each; null ids are kept. Digests, never texts, meet the known table.
    """
    low = lambda x: F.translate(x, UPPER, LOWER)
    lines = F.filter(
        F.split(F.coalesce(F.col("text"), F.lit("")), "\n"),
        lambda x: F.contains(low(x), F.lit("licens")) | F.contains(low(x), F.lit("licenc")),
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    own = F.array(F.struct(F.lit(True).alias("whole"), digest(F.col("text")).alias("digest")))
    named = F.transform(lines, lambda x: F.struct(F.lit(False).alias("whole"), digest(x).alias("digest")))
    units = rows.select("doc_id", "row", F.explode(F.concat(own, named)).alias("u"))
    units = units.select("doc_id", "row", "u.whole", "u.digest")
    known = known.where(F.col("digest") != F.sha2(F.lit(""), 256)).select("digest", "license_id")
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    met = units.join(known, "digest", "left")
    return met.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("whole"), F.col("digest"))).alias("canonical_sha256"),
        F.max(F.when(F.col("whole"), F.col("license_id"))).alias("license_id"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license_id")))), ",").alias("notices"),
    ).select("doc_id", "canonical_sha256", "license_id", "notices")


def scan_sql(known: Sequence[tuple[str, str]] = KNOWN) -> str:
    """DuckDB SQL over ``documents`` that gives the rows of ``scan`` with these known texts."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    words = "concat(' ', x, ' ')"
    for written, one in EQUIVALENT:
        words = f"replace({words}, ' {written} ', ' {one} ')"
    plain = (
        f"regexp_replace(translate(regexp_replace(translate(coalesce(t, ''), '{UPPER}', '{LOWER}'), {quoted(COPYRIGHT_LINE)}, chr(10), 'g'), "
        f"'{TYPOGRAPHIC}', '{' ' * len(TYPOGRAPHIC)}'), {quoted(PUNCTUATION)}, '  ', 'g')"
    )
    return f"""
    WITH k AS (SELECT * FROM (VALUES {", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in known)}) v(license_id, t)),
    lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, false AS whole FROM documents),
    units AS (
        SELECT doc_id, text AS t, true AS whole, NULL AS license_id FROM documents
        UNION ALL SELECT doc_id, t, whole, NULL FROM lines WHERE regexp_matches(translate(t, '{UPPER}', '{LOWER}'), 'licen[sc]')
        UNION ALL SELECT NULL, t, NULL, license_id FROM k),
    spread AS (SELECT *, {plain} AS x FROM units),
    canon AS (SELECT *, sha256(trim(regexp_replace({words}, ' +', ' ', 'g'))) AS digest FROM spread),
    known AS (SELECT digest, min(license_id) AS license_id FROM canon WHERE whole IS NULL AND digest <> sha256('') GROUP BY digest)
    SELECT doc_id, max(CASE WHEN whole THEN c.digest END) AS canonical_sha256, max(CASE WHEN whole THEN known.license_id END) AS license_id,
        coalesce(string_agg(DISTINCT CASE WHEN NOT whole THEN known.license_id END, ',' ORDER BY CASE WHEN NOT whole THEN known.license_id END), '') AS notices
    FROM canon c LEFT JOIN known USING (digest) WHERE whole IS NOT NULL GROUP BY doc_id"""
