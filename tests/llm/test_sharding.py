import numpy as np
import pytest
from tableproof.llm.sharding import locate, permute, row_at, shard_rows


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 24, 255, 256, 257, 10_007])
def test_permutation_and_inverse(n):
    out = permute(np.arange(n), n, 5)
    assert sorted(out) == list(range(n))
    assert (permute(out, n, 5, inverse=True) == np.arange(n)).all()


def test_seeds_differ_and_neighbours_part():
    n = 100_000
    out = permute(np.arange(n), n, 5)
    assert (out != permute(np.arange(n), n, 6)).mean() > 0.99
    assert abs(np.corrcoef(np.arange(n), out)[0, 1]) < 0.02


def test_shards(docs):
    rows = docs.select("doc_id", "text")
    a = sorted(shard_rows(rows, ["doc_id"], 3, 9).collect(), key=str)
    assert a == sorted(shard_rows(rows.repartition(5), ["doc_id"], 3, 9).collect(), key=str)
    by = {s: sorted(r.slot for r in a if r.shard == s) for s in range(3)}
    assert all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    n = len(a)
    for r in a:
        assert locate(r.position, n, 3, 9) == (r.shard, r.slot) and row_at(r.shard, r.slot, n, 3, 9) == r.position


def test_empty_table(docs):
    assert shard_rows(docs.select("doc_id", "text").limit(0), ["doc_id"], 24, 1).count() == 0
