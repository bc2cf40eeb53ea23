import numpy as np
import pytest
from pyspark.sql import functions as F
from tableproof.llm.ann import CrossPolytope, hadamard, nearest


def exact(rows, k):
    """{query: [(vec_id, score)]} by comparing all rows; equal rows count once."""
    use = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = {}
    x = np.array([v for _, v in use])
    norm = np.sqrt((x * x).sum(axis=1))
    ids = np.array([i for i, _ in use])
    for i, v in use:
        if i % 50 == 0:
            q = np.array(v)
            s = (x * q).sum(axis=1) / (norm * np.sqrt((q * q).sum()))
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def search(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("packed", F.lit(1)).withColumn("vector", F.lit("x"))
    out = {}
    for r in sorted(nearest(df, F.col("vec_id") % 50 == 0, **kw).collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).standard_normal((5, 16))
    assert np.allclose(hadamard(hadamard(x)), x) and np.allclose((hadamard(x) ** 2).sum(1), (x**2).sum(1))


@pytest.mark.parametrize("dim", [3, 24, 64])
def test_recall(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(i, [float(x) for x in rng.standard_normal(dim).astype(np.float32)]) for i in range(4000)]
    got, want = search(spark, rows, p=CrossPolytope(block_rows=300, block_queries=30)), exact(rows, 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]
    assert np.mean(hits) >= 0.9
    scores = {q: dict(v) for q, v in want.items()}
    assert all(s == scores[q][i] for q, v in got.items() for i, s in v if i in scores[q])


def test_probing_is_fitted_to_the_rows(spark):
    """A start as small beside the table as the square root is beside a very large one."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.standard_normal(64).astype(np.float32)]) for i in range(6000)]
    got, want = search(spark, rows, p=CrossPolytope(probe_factor=0.5, least_probed=8)), exact(rows, 5)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]
    assert np.mean(hits) >= 0.9 and all(len(v) == 5 for v in got.values())


def test_copies_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(4)
    same = [1.0, 2.0, 0.0, -1.0]
    rows = [(i, same) for i in range(300)] + [(300 + i, [float(x) for x in rng.standard_normal(4).astype(np.float32)]) for i in range(100)]
    rows += [(50, same), (1000, None), (1050, [0.0] * 4), (1100, [1.0, None, 0.0, 0.0]), (1150, [float("nan")] * 4), (1200, [float("inf")] * 4),
             (None, same), (1250, [1.0, 2.0]), (1300, [1e30, 2e30, 0.0, -1e30])]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = search(spark, rows)
    want = exact([r for r in rows if not r[1] or len(r[1]) == 4], 5)
    assert set(got) == set(want)
    assert got[0] == want[0] and got[50] == want[50] and got[250] == want[250]
    assert [i for i, _ in got[100]] == [0, 1, 2, 3, 4]


def test_few_rows(spark):
    assert search(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])]) == {0: [(1, 0.0)]}
    assert search(spark, [(0, [1.0, 0.0])]) == {} and search(spark, [(1, [1.0])]) == {} and search(spark, []) == {}
