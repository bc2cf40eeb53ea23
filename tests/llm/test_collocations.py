import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tableproof.llm import collocations
from tableproof.llm.collocations import PhraseParams, top_phrases


def brute(rows, p, most):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for k in range(1, p.most_words + 1):
                for i in range(len(ws) - k + 1):
                    count[lang, tuple(ws[i : i + k])] += 1
    found = defaultdict(list)
    for (lang, ws), a in count.items():
        if len(ws) < 2 or a < p.least:
            continue
        s, c = min(((2_000_000 * a) // (count[lang, ws[:c]] + count[lang, ws[c:]]), c) for c in range(1, len(ws)))
        inside = any(
            l2 == lang and len(o) > len(ws) and f >= p.least and 100 * f >= p.absorbed_percent * a
            and any(o[i : i + len(ws)] == ws for i in range(len(o) - len(ws) + 1))
            for (l2, o), f in count.items()
        )
        if not inside:
            found[lang].append((-s, -a, " ".join(ws).encode(), c, count[lang, ws[:c]], count[lang, ws[c:]], total[lang]))
    return sorted(
        (lang, rank, ph.decode(), -a, l, r, n, -s, c)
        for lang, got in found.items() for rank, (s, a, ph, c, l, r, n) in enumerate(sorted(got)[:most], 1)
    )


def mined(df, p, most):
    got = top_phrases(collocations.collocations(df, p), most)
    return sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut").collect())


@pytest.mark.parametrize("p", [PhraseParams(least=3), PhraseParams(least=2, most_words=3), PhraseParams(least=3, most_bits=6), PhraseParams(least=1, most_words=2, absorbed_percent=30)])
def test_against_brute_force(spark, p):
    rng = random.Random(3)
    vocabulary = ["a", "B", "c", "dé", "É", "e-f", "\x00", "ß", "​z"]
    rows = []
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        text = "".join(w + rng.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\r\n", "; "]) for w in words)
        rows.append((rng.choice(["en", "fr", None, "und"]), rng.choice([text, text, text, "the same old line of words here. " * 2])))
    rows += [("en", None), (None, ""), ("en", " .\n\t "), ("xx", "lonely")]
    df = spark.createDataFrame([(lang, t, "own", 1) for lang, t in rows], "lang string, text string, phrase string, w1 int").repartition(3)
    assert mined(df, p, 25) == brute(rows, p, 25)


def test_odd_tables(spark, docs):
    assert mined(docs.limit(0), PhraseParams(), 10) == []
    assert mined(docs.where("text IS NULL"), PhraseParams(least=1), 10) == []
    rows = [(r.lang, r.text) for r in docs.where("length(text) < 1000").collect()]
    p = PhraseParams(least=2)
    assert mined(docs.where("length(text) < 1000").withColumn("n", F.lit("x")), p, 50) == brute(rows, p, 50)


def test_long_text_and_sums_past_64_bits(spark):
    df = spark.createDataFrame([("en", "x y " * 150_000)], "lang string, text string")
    got = mined(df, PhraseParams(), 5)
    # The longest phrases absorb the shorter ones; f counts overlaps.
    assert [(r[2], r[3], r[6]) for r in got] == [("x y x y", 149_999, 300_000), ("y x y x", 149_998, 300_000)]
    weak = spark.sql("SELECT (CAST(a AS DECIMAL(20, 0)) * 2000000) div (CAST(l AS DECIMAL(20, 0)) + CAST(l AS DECIMAL(20, 0))) AS s FROM VALUES (9000000000000000000L, 9100000000000000000L) t(a, l)")
    assert weak.first()[0] == 2_000_000 * 9 * 10**18 // (182 * 10**17)


def test_filter_never_rules_out_a_frequent_pair(spark):
    words = np.random.default_rng(1).integers(0, 300, 30_000)
    text = " ".join(f"w{w}" for w in words)
    df = spark.createDataFrame([("en", text)] * 2, "lang string, text string")
    p = PhraseParams(least=4, most_words=2, most_bits=10)
    want = {k: 2 * v for k, v in Counter(zip(words[:-1].tolist(), words[1:].tolist())).items() if 2 * v >= 4}
    got = {tuple(int(w[1:]) for w in r.words): r.f for r in collocations.phrase_counts(df, p).where("size(words) = 2").collect()}
    assert got == want
