import functools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tableproof.llm.packing import Limits, pack, pack_by_dot_product, pack_by_norm, pack_documents
from tableproof.llm.tokens import Tokenizer
from tokenizers import Tokenizer as Original

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizers():
    original = Original.from_file(PATH)
    original.encode_special_tokens = True
    return Tokenizer(PATH), original


words = [" ", "  ", "a", "don't", "\n", "\t", "é", "12", "…", "\u00a0", "\u2003", "x'll", "<|endoftext|>"]
texts = st.lists(st.lists(st.sampled_from(words), max_size=10).map("".join), max_size=8)


@given(texts)
@settings(max_examples=200, deadline=None)
def test_ids_are_the_tokenizers(tokenizers, rows):
    ours, original = tokenizers
    want = [e.ids for e in original.encode_batch(rows, add_special_tokens=False)]
    assert [x.tolist() for x in ours.encode(pa.array(rows, pa.string()))] == want


@given(texts)
@settings(max_examples=200, deadline=None)
def test_ids_are_those_of_the_unmodified_tokenizer(rows):
    ours, original = unmodified()
    want = [e.ids for e in original.encode_batch(rows, add_special_tokens=False)]
    assert [x.tolist() for x in ours.encode(pa.array(rows, pa.string()))] == want


@functools.cache
def unmodified():
    return Tokenizer(PATH, encode_special_tokens=False), Original.from_file(PATH)


def test_documents_that_show_an_added_token(spark):
    text = "a <|endoftext|> b"
    (row,) = pack_documents(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), PATH).collect()
    ids = unmodified()[1].encode(text, add_special_tokens=False).ids + [2]
    assert 50256 in ids and (row["length"], row["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def check_runs(histogram, limits, runs, bins):
    """Every piece has one place, bins have no gaps, and no limit is broken."""
    ranks, places = defaultdict(list), defaultdict(list)
    for length, rank, n, first, offset in runs:
        ranks[length] += range(rank, rank + n)
        for b in range(first, first + n):
            places[b].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in histogram.items() if v}
    assert sorted(places) == list(range(bins))
    for pieces in places.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= limits.max_tokens and len(pieces) <= limits.max_docs
        assert sum(n * n for _, n in pieces) <= limits.max_cost


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20), st.integers(1, 8), st.integers(64, 4096))
@settings(max_examples=200, deadline=None)
def test_all_limits_hold(histogram, docs, cost):
    limits = Limits(max_tokens=64, max_docs=docs, max_cost=max(cost, 64 * 64))
    for rule in (pack_by_norm, pack_by_dot_product):
        check_runs(histogram, limits, *rule(histogram, limits))


def test_close_to_the_bound():
    rng = np.random.default_rng(3)
    lengths, counts = np.unique(np.minimum(rng.lognormal(5, 1.2, 20_000).astype(int) + 1, 1024), return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist()))
    runs, bins = pack(histogram, Limits())
    check_runs(histogram, Limits(), runs, bins)
    bound = -(-sum(k * v for k, v in histogram.items()) // 1024)
    assert bins <= 1.005 * bound


def test_too_long_is_refused():
    with pytest.raises(ValueError):
        pack({65: 1}, Limits(max_tokens=64))


def test_documents(docs, tokenizers):
    out = [r.asDict() for r in pack_documents(docs, PATH).collect()]
    want = []
    for r in docs.collect():
        ids = tokenizers[1].encode(r.text or "", add_special_tokens=False).ids + [2]
        cut, start, piece = len(ids) % 1024 or 1024, 0, 0
        while start < len(ids):
            data = np.array(ids[start:cut], "<u4").tobytes()
            want.append((r.doc_id, piece, start, cut - start, zlib.crc32(data)))
            start, cut, piece = cut, cut + 1024, piece + 1
    cols = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted([tuple(r[c] for c in cols) for r in out], key=str) == sorted(want, key=str)
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in places.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024
    assert pack_documents(docs.limit(0), PATH).count() == 0
