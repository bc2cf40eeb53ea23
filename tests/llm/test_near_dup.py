import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from tableproof.llm import near_dup
from tableproof.llm.graph import components
from tableproof.llm.near_dup import Jaccard, keep_one_per_component, near_duplicates


def shingle_set(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(rows, k, percent):
    """(doc_id, n_shingles, component_id) of every row, by comparing all pairs of sets."""
    sets = defaultdict(list)
    out = []
    for i, t in rows:
        s = shingle_set(t, k)
        if s:
            sets[s].append(i)
        else:
            out.append((i, 0, i))
    parent = {s: s for s in sets}

    def find(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for a, b in combinations(sets, 2):
        common = len(a & b)
        if 100 * common >= percent * (len(a) + len(b) - common):
            parent[find(a)] = find(b)
    least = {}
    for s, ids in sets.items():
        known = [i for i in ids if i is not None]
        root = find(s)
        if known:
            least[root] = min([*known, least.get(root, known[0])])
    for s, ids in sets.items():
        out += [(i, len(s), least.get(find(s))) for i in ids]
    return Counter(out)


def variants(rng, n, groups, common):
    """Texts of groups of copies with more and more words changed, all with a passage in common."""
    vocabulary = [f"t{i}" for i in range(4000)]
    rows = []
    for g in range(groups):
        words = list(rng.choice(vocabulary, size=int(rng.integers(3, 120))))
        for j in range(n):
            copy = list(words)
            for _ in range(int(rng.integers(0, max(2, len(words) // 8)))):
                copy[int(rng.integers(len(copy)))] = rng.choice(vocabulary)
            if common and j % 3 == 0:
                copy = common.split() + copy
            rows.append((len(rows) * 7 % 1009, " ".join(copy)))
    return rows


@pytest.mark.parametrize("k,percent,share", [(4, 85, 0.02), (5, 80, 0.02), (4, 85, 0.9), (3, 50, 0.05)])
def test_against_all_pairs(spark, k, percent, share):
    rng = np.random.default_rng(k * percent)
    rows = variants(rng, 12, 25, " ".join(f"passage{i}" for i in range(40)))
    rows += [(2000 + i, t) for i, (_, t) in enumerate(rows[:40])] + [(3000, None), (3001, ""), (3002, "a"), (3003, "A"), (3004, "a b")]
    p = Jaccard(words=k, percent=percent, frequent_share=share, chunk_members=16)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), p)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == brute(rows, k, percent)


def test_nulls_ties_long_texts(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = near_duplicates(docs, Jaccard(words=4, percent=85)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 4, 85)


def test_keep_one(docs):
    out = keep_one_per_component(docs, Jaccard(words=4, percent=85))
    assert out.columns == docs.columns
    kept = Counter((r.doc_id, (r.text or "")[:12]) for r in out.collect())
    base = docs.where("doc_id = 1").first().text[:12]
    assert kept[(1, base)] == 1 and kept[(2, base)] == kept[(3, base)] == kept[(None, base)] == 0
    assert sum(1 for i, _ in kept if i == 12) == 2 and kept[(None, "alone in the")] == 1
    assert kept[(4, "")] == kept[(5, "")] == 1 and kept[(7, "one two")] == 1 and kept[(8, "one two")] == 0


def test_empty_table(docs):
    assert near_duplicates(docs.limit(0)).count() == 0 and keep_one_per_component(docs.limit(0)).count() == 0


def test_linked_sets_share_a_key():
    """The pigeonhole claim itself, on sets of all sizes with the largest difference that still links."""
    rng = np.random.default_rng(1)
    p = Jaccard(words=4, percent=85)
    for n in [*range(1, 60), 200, 1000, 5000]:
        pool = rng.integers(0, 2**63, size=2 * n + 2, dtype=np.uint64)
        for union in range(n, n * 100 // 85 + 1):
            common = -(-85 * union // 100)
            if common > n:
                continue
            a = np.sort(pool[:n])
            b = np.sort(np.concatenate([pool[:common], pool[n : n + union - n]]))
            assert len(b) and 100 * common >= 85 * union
            stop = np.sort(rng.choice(pool, size=int(rng.integers(0, len(pool))), replace=False))
            sets, keys = near_dup.sketch_keys(np.concatenate([a, b]), np.array([len(a), len(b)]), stop, p)
            assert set(keys[sets == 0]) & set(keys[sets == 1]), (n, union)


def test_compact_sketch_bounds_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(50):
        pool = rng.integers(0, 2**63, size=600, dtype=np.uint64)
        a, b = pool[: int(rng.integers(200, 400))], pool[int(rng.integers(0, 100)) : 450]
        x, y = near_dup._compact(a), near_dup._compact(b)
        n = min(len(x), len(y))
        far = np.bitwise_count(near_dup._folded(x, n) ^ near_dup._folded(y, n)).sum()
        assert far <= len(np.setxor1d(a, b))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(200, 300)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in [100, *range(200, 300)]} == {100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
