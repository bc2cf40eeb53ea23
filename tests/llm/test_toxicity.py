import numpy as np
from pyspark.sql import functions as F
from tableproof.llm.toxicity import OrdinalModel, OrdinalParams, fit_ordinal, severity, train


def corpus(spark, n=1500):
    rng = np.random.default_rng(0)
    words = [f"word{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = list(rng.choice(words, size=int(rng.integers(5, 80))))
        toxic = int(i % 6 == 0)
        if toxic:
            for _ in range(int(rng.integers(1, 6))):
                text.insert(int(rng.integers(len(text))), str(rng.choice(["Vile", "vileness!", "nasty", "rotten,"])))
        docs.append((i, " ".join(text), "x", 1.0))
        if i < n // 2:
            labels.append((i, toxic))
    return (spark.createDataFrame(docs, "doc_id bigint, text string, score string, s double"),
            spark.createDataFrame(labels, "doc_id bigint, toxic int"), docs)


def test_held_out_rows(spark):
    docs, labels, rows = corpus(spark)
    p = OrdinalParams()
    out = docs.select("doc_id", severity(F.col("text"), train(docs, labels, p), p).alias("s")).collect()
    half = len(rows) // 2
    wrong = [r.doc_id for r in out if r.doc_id >= half and (r.s[0] >= p.reject_at) != (r.doc_id % 6 == 0)]
    assert len(wrong) <= 0.01 * half
    assert all(0 <= r.s[2] <= r.s[1] <= 1 and abs(r.s[0] - r.s[1] - r.s[2]) < 1e-9 for r in out)


def test_ordered_grades_share_weights():
    rng = np.random.default_rng(1)
    p = OrdinalParams(bits=10, l1=1e-5, screen=0.0, steps=400)
    strength = rng.integers(0, 5, size=4000)
    features = [np.unique(np.append(rng.integers(100, 200, size=6), np.arange(10, 10 + s))) for s in strength]
    indptr = np.concatenate([[0], np.cumsum([len(f) for f in features])])
    grades = np.digitize(strength + rng.normal(0, 0.4, size=4000), [1.5, 2.5, 3.5])
    model = fit_ordinal(indptr, np.concatenate(features), grades, p)
    assert model.grades == 4 and (np.diff(model.thresholds) > 0).all()
    table = np.zeros(1 << p.bits)
    table[model.features] = model.weights
    score = np.array([table[f].sum() for f in features])
    reached = model.reached(score)
    assert (np.diff(reached, axis=1) <= 0).all()
    assert np.corrcoef(reached.sum(axis=1), grades)[0, 1] > 0.9
    assert np.abs(reached.sum(axis=1).mean() - grades.mean()) < 0.1


def test_without_labels_or_rows(spark, docs):
    for labels in ([], [(1, 0), (2, 0)], [(None, 1), (4, None)]):
        model = train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
        assert all(r.s[0] < 0.01 for r in docs.select(severity(F.col("text"), model).alias("s")).collect())
    model = OrdinalModel(np.array([3]), np.array([1.0]), np.array([0.0, 1.0]))
    assert docs.limit(0).select(severity(F.col("text"), model)).count() == 0


def test_long_text_counts_a_feature_once(spark):
    docs, labels, _ = corpus(spark)
    p = OrdinalParams()
    model = train(docs, labels, p)
    rows = spark.createDataFrame([(1, "nasty " + "word1 " * 300_000), (2, "nasty word1"), (3, "nasty nasty word1"), (4, None)], "doc_id bigint, text string")
    s = {r.doc_id: r.s for r in rows.select("doc_id", severity(F.col("text"), model, p).alias("s")).collect()}
    assert s[1] == s[2] == s[3] and s[4][0] < p.reject_at
