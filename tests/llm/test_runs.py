import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tableproof.llm.runs import find_runs, looped, periodic_runs, suffix_order


def brute_runs(words, exponent=4, least=6):
    """All runs by looking at every period and every maximal stretch."""
    n, out = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, exponent * q):
                out.setdefault((i, length), q)
            i = max(j, i + 1)
    return sorted((s, q, m) for (s, m), q in out.items())


def collapsed(words, runs):
    gone = {k for s, q, m in runs for k in range(s + q, s + m)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 2), (3, 5)])
def test_random_words_against_brute_force(exponent, least):
    rng = random.Random(5)
    for turn in range(300):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, kinds = rng.randint(0, 60), rng.choice([1, 2, 3])
            t = [rng.randrange(kinds) for _ in range(n)]
            if rng.random() < 0.5:
                p = [rng.randrange(3) for _ in range(rng.randint(1, 6))]
                t[n // 3 : n // 3] = (p * 12)[: rng.randint(0, 40)]
            texts.append(t)
        words = np.array([w for t in texts for w in t], np.int64)
        text = np.array([i for i, t in enumerate(texts) for _ in t], np.int64)
        s, m, q = find_runs(words, text, exponent, least)
        first = np.cumsum([0] + [len(t) for t in texts])
        for i, t in enumerate(texts):
            mine = [(int(a - first[i]), int(c), int(b)) for a, b, c in zip(s, m, q) if text[a] == i]
            assert mine == brute_runs(t, exponent, least), (turn, t)


def test_suffixes_are_sorted_and_share_what_is_said():
    rng = random.Random(2)
    words = np.array([rng.randrange(2) for _ in range(200)])
    text = np.sort(np.array([rng.randrange(4) for _ in range(200)]))
    order, shared = suffix_order(words, text)
    end = {t: int(np.flatnonzero(text == t)[-1]) + 1 for t in set(text.tolist())}
    whole = [tuple(words[i : end[int(text[i])]].tolist()) for i in order]
    assert [(text[i], w) for i, w in zip(order, whole)] == sorted((text[i], w) for i, w in zip(order, whole))
    for t in range(len(order) - 1):
        common = 0
        if text[order[t]] == text[order[t + 1]]:
            while common < min(len(whole[t]), len(whole[t + 1])) and whole[t][common] == whole[t + 1][common]:
                common += 1
        assert shared[t] == common


def test_hard_sequences():
    many = [w for i in range(100) for w in ([1000 + i] + [1] * 9)]  # one sequence under hundreds of left words
    for words in ([1] * 2000, [1, 2] * 1000 + [0], [1, 2] * 1000 + [9], many, [i for i in range(400)] * 5):
        w = np.array(words, np.int64)
        s, m, q = find_runs(w, np.zeros(len(w), np.int64), 4, 6)
        assert list(zip(s.tolist(), q.tolist(), m.tolist())) == brute_runs(words)


def expected(doc_id, text, plant=True):
    words = words_of(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1])) if runs else None
    lines = "".join(f"{s},{m},{q}\n" for s, q, m in runs)
    return (
        doc_id, len(runs), *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4),
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest(),
    )


def test_query_against_brute_force_on_the_smallest_tables(spark):
    from tableproof.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in QUERIES["op13_periodic_runs"](spark, sf).collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted(expected(r.doc_id, r.text) for r in docs)
    assert any(r[1] for r in got)


def test_odd_rows(spark, docs, tmp_path):
    rows = periodic_runs(docs.withColumn("runs", F.lit("own"))).collect()
    assert len(rows) == docs.count() and rows[0].row.runs == "own"
    for r in rows:
        words = words_of(r.row.text)
        assert r.words == len(words)
        if len(words) < 3000:
            runs = brute_runs(words)
            assert [(x.start, x.period, x.length) for x in r.runs] == runs and r.collapsed == collapsed(words, runs)
    assert periodic_runs(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([("é x é x é x é x",), ("\x00 \x00 \x00 \x00 \x00 \x00",), ("a\x0bb " * 70_000,)], "text string")
    got = periodic_runs(odd, keep=[]).collect()
    assert [(len(x.runs), x.strongest.length, x.strongest.period) for x in got] == [(1, 8, 2), (1, 6, 1), (1, 140_000, 2)]
    assert got[2].collapsed == "a b"


def test_planted_loops_keep_null_seeds_and_blank_texts(spark):
    rows = [(1, "a b"), (10, None), (20, " \t"), (None, "a b c"), (0, "a b c d e f g h i j k l")]
    df = spark.createDataFrame(rows, "s bigint, t string")
    assert [r[0] for r in df.select(looped(F.col("t"), F.col("s"))).collect()] == ["a b", None, " \t", "a b c", "a b c d e a b c d e a b"]
