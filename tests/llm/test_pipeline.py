import os

import corpus_pipeline
import pytest
from test_near_dup import brute
from test_toxicity import corpus


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Documents with toxic ones, exact and near copies, nulls and a clashing column; labels for half of them."""
    path = str(tmp_path_factory.mktemp("sf"))
    docs, labels, rows = corpus(spark, 600)
    texts = {i: t for i, t, *_ in rows}
    more = [(1000 + i, texts[i]) for i in (1, 2, 3)] + [(2000 + i, texts[i] + " tail") for i in range(1, 60, 2)]
    more += [(3000, None), (3001, ""), (None, texts[5])]
    extra = spark.createDataFrame([(i, t, "x", 1.0) for i, t in more], docs.schema)
    docs.unionByName(extra).withColumnRenamed("score", "sid").withColumnRenamed("s", "__id").write.parquet(os.path.join(path, "documents.parquet"))
    labels.selectExpr("doc_id", "1 - toxic * 0 AS quality", "toxic").write.parquet(os.path.join(path, "labels.parquet"))
    return path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dup", "mixing", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == columns
        kept[name] = before, [(r.doc_id, r.text) for r in docs.collect()]

    before, after = kept["toxicity"]
    toxic = {i for i, t in before if any(w in (t or "") for w in ("Vile", "vileness", "nasty", "rotten"))}
    lost = {i for i, _ in before} - {i for i, _ in after}
    assert len(toxic & lost) >= 0.95 * len(toxic) and len(lost - toxic) <= 0.01 * len(before)

    before, after = kept["exact_dedup"]
    best = {}
    for i, t in before:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    assert sorted((-1 if i is None else i, t or "") for i, t in after) == sorted((i, t) for t, i in best.items())

    before, after = kept["near_dup"]
    want = {i for i, _, c in brute(before, 5, 80) if i == c}
    assert {i for i, _ in after} == want and len(after) == len(want)

    before, after = kept["mixing"]
    assert set(before) == set(after) and len(after) >= len(before)

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in after}


def test_run_equals_its_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_registration():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 14))
