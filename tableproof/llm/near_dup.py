"""Near duplicates by Jaccard similarity of word shingles: a join on parity sketches.

Every shingle of a set is hashed to one bit of a wide sketch, and bits are XOR-ed. Shingles that two
sets share cancel, so the Hamming distance of their sketches is at most the size of their symmetric
difference. For similarity t and the smaller size a that is at most a * (1 - t) / t. The sketch is cut
into more blocks than that, so linked sets agree on a whole block, and sets are joined on equal blocks
(pigeonhole). Candidates are verified on the full sets.

Exactness, case by case:

* Sizes: a size band fixes the number of blocks. A set of n shingles takes part in the band of every
  size from t * n to n, so two linked sets meet in the band of the smaller one.
* Shingles in many sets (``frequent``) are left out of the sketch, which only lowers distances.
* A block without shingles says nothing and gives no key. A set with too few non-empty blocks is
  *sparse* and adds the keys of its sketch over all shingles, and one common key where even these
  are too few. Of a linked pair, either one set has enough blocks or both are sparse.
* Sets with equal keys are first compared with the least of them only. Where that leaves several
  components under one key, members of different components are compared in chunks inside tasks. Compact
  sketches, whose Hamming distance is a lower bound too, sort out most pairs; of the rest, tasks return spanning
  forests between components, nearest pairs first, which are verified on the sets. Rounds repeat with more
  forests, or with all pairs left where they are few, until every pair that the sketches allow is verified or within one component.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tableproof.llm import shingles as sh
from tableproof.llm.graph import components
from tableproof.llm.joins import lookup_join
from tableproof.session import fresh_path, materialize

#: Bits of the filter that keeps unneeded sets out of a shuffle; a full filter costs time, not results.
FILTER_BITS = 1 << 22

#: Bytes of an Arrow batch of texts or packed sets; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


@dataclass(frozen=True)
class Jaccard:
    """What counts as near duplicates, and how it is searched."""

    words: int = 5
    #: Least similarity in hundredths.
    percent: int = 80
    #: Shingles in more than this share of the sampled texts are left out of the sketches.
    frequent_share: float = 0.02
    #: Texts sampled to find them. Any choice of left-out shingles gives the same links.
    frequent_sample: int = 4000
    #: Members of one chunk when sets under one key are compared; a sketch is 16 KB at most.
    chunk_members: int = 2048
    #: Spanning forests a chunk returns in the first round, sixteen times as many in each further one.
    forests: int = 1

    def bands(self) -> np.ndarray:
        """Lower bounds of the size bands, up to the largest int."""
        edges = [1]
        while edges[-1] < 2**31:
            edges.append(max(edges[-1] + 1, edges[-1] * 3 // 2))
        return np.array(edges, np.int64)

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """Per band: largest symmetric difference of linked sets, and number of blocks (more than that)."""
        most = np.append(self.bands()[1:] - 1, 2**33) * (100 - self.percent) // self.percent
        return most, most + 3 + most // 16


def _frequent(texts: DataFrame, p: Jaccard) -> np.ndarray:
    """Sorted shingles of more than ``frequent_share`` of a bounded sample; at most a text's size over that share."""
    n = texts.count()
    if not n:
        return np.zeros(0, np.uint64)
    sample = texts.sample(fraction=min(1.0, p.frequent_sample / n), seed=5)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pw = sh.powers()
        for batch in batches:
            for _, _, flat, _ in sh.each_slice(batch.column(0), p.words, pw):
                token, times = np.unique(flat, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(times)], names=["token", "times"])

    counted = sample.mapInArrow(shingles, "token bigint, times bigint").groupBy("token").agg(F.sum("times").alias("n"))
    rows = counted.where(F.col("n") > max(4.0, p.frequent_share * min(n, p.frequent_sample))).select("token").toPandas()
    return np.sort(rows["token"].to_numpy(np.int64).view(np.uint64))


def _drop(flat: np.ndarray, sizes: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets without the shingles in ``stop`` (sorted)."""
    if not len(stop) or not len(flat):
        return flat, sizes
    at = np.minimum(np.searchsorted(stop, flat), len(stop) - 1)
    keep = stop[at] != flat
    of = np.repeat(np.arange(len(sizes)), sizes)
    return flat[keep], np.bincount(of[keep], minlength=len(sizes)).astype(np.int64)


def _block_keys(flat, sizes, wanted, band, blocks, space: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, key) of every non-empty block of the ``wanted`` sets in their ``band``, and such blocks per set."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    use = wanted[of]
    of, tokens = of[use], flat[use]
    if not len(of):
        return of, tokens, np.zeros(len(sizes), np.int64)
    # Sets are sorted, so cutting the hash range into equal parts leaves each block's shingles adjacent.
    block = ((tokens >> np.uint64(32)) * blocks[band[of]].astype(np.uint64)) >> np.uint64(32)
    start = np.ones(len(of), bool)
    start[1:] = (of[1:] != of[:-1]) | (block[1:] != block[:-1])
    at = np.flatnonzero(start)
    parity = np.bitwise_xor.reduceat(sh.mix(tokens ^ np.uint64(0xA0761D6478BD642F)), at)
    who = of[at]
    place = (band[who].astype(np.uint64) << np.uint64(34)) | (block[at] << np.uint64(2)) | np.uint64(space)
    return who, sh.mix(parity ^ sh.mix(place)), np.bincount(who, minlength=len(sizes)).astype(np.int64)


def sketch_keys(flat: np.ndarray, sizes: np.ndarray, stop: np.ndarray, p: Jaccard) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of all sets: (set, key). Linked sets share a key."""
    edges = p.bands()
    most, blocks = p.blocks()
    low = np.searchsorted(edges, -(-p.percent * sizes // 100), "right") - 1
    high = np.searchsorted(edges, sizes, "right") - 1
    thin, thin_sizes = _drop(flat, sizes, stop)
    sets, keys = [], []
    for step in range(int((high - low)[sizes > 0].max(initial=-1)) + 1):
        band = np.minimum(low + step, high)
        part = (sizes > 0) & (low + step <= high)
        who, key, n = _block_keys(thin, thin_sizes, part, band, blocks, 0)
        sets.append(who), keys.append(key)
        sparse = part & (n <= most[band])
        who, key, n = _block_keys(flat, sizes, sparse, band, blocks, 1)
        sets.append(who), keys.append(key)
        barest = np.flatnonzero(sparse & (n <= most[band]))
        sets.append(barest), keys.append(sh.mix((band[barest].astype(np.uint64) << np.uint64(34)) | np.uint64(2)))
    if not sets:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(sets), np.concatenate(keys)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _numbered(docs: DataFrame, p: Jaccard) -> DataFrame:
    """doc_id, hash, n_shingles and sid, the number of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pw = sh.powers()
        for batch in batches:
            for lo, hi, flat, sizes in sh.each_slice(batch.column(1), p.words, pw):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(sizes), _signed(sh.set_ids(flat, sizes))],
                    names=["doc_id", "hash", "n_shingles", "sid"],
                )

    return docs.mapInArrow(run, "doc_id bigint, hash bigint, n_shingles bigint, sid bigint")


def _keyed(docs: DataFrame, p: Jaccard, stop: np.ndarray) -> DataFrame:
    """(key, sid) of all sets; a set's keys about once per task, not with each of its copies.

    The texts are shingled a second time: stored keys would take about as much disk as the texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pw, seen = sh.powers(), set()
        for batch in batches:
            for lo, hi, flat, sizes in sh.each_slice(batch.column(1), p.words, pw):
                sid = sh.set_ids(flat, sizes)
                first = np.ones(hi - lo, bool)
                for i, s in enumerate(sid.tolist()):
                    first[i] = s not in seen
                    seen.add(s)
                if len(seen) > 1 << 18:
                    seen.clear()
                who, key = sketch_keys(flat, sizes, stop, p)
                keep = first[who]
                yield pa.RecordBatch.from_arrays([_signed(key[keep]), _signed(sid[who[keep]])], names=["key", "sid"])

    return docs.mapInArrow(run, "key bigint, sid bigint")


def _shared(keys: DataFrame) -> DataFrame:
    """(key, center, sid): every set that has a key, beside the least set that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_sid = center = None
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            sid = batch.column(1).to_numpy(zero_copy_only=False)
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            again = np.zeros(len(key), bool)
            again[1:] = ~new[1:] & (sid[1:] == sid[:-1])
            going_on = key[0] == last_key
            new[0], again[0] = not going_on, going_on and sid[0] == last_sid
            run_of = np.cumsum(new)
            first = np.concatenate([[center if going_on else 0], sid[new]])[run_of]
            keep = ~new & ~again
            last_key, last_sid, center = key[-1], sid[-1], first[-1]
            if keep.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[keep]), pa.array(first[keep].astype(np.int64)), pa.array(sid[keep])], names=["key", "center", "sid"]
                )

    # Sorted by the shuffle and read as a stream: a key with very many sets is never held.
    return keys.repartition("key").sortWithinPartitions("key", "sid").mapInArrow(run, "key bigint, center bigint, sid bigint")


def _compact(tokens: np.ndarray) -> np.ndarray:
    """Parity sketch of eight to sixteen bits per shingle, a power of two up to 2**17 bits."""
    width = 1 << min(17, max(6, (8 * len(tokens) - 1).bit_length()))
    odd = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The sketch on fewer bits: halves are XOR-ed, as if it had been made that narrow."""
    while len(bits) > words:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def _wanted_sets(docs: DataFrame, p: Jaccard, wanted: np.ndarray) -> Stored:
    """sid, size, compact sketch and set (packed) of the texts whose sid may be wanted, bucketed by sid."""
    schema = "sid bigint, size bigint, bits binary, tokens binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pw, seen = sh.powers(), set()
        bits = np.unpackbits(wanted).astype(bool)
        for batch in batches:
            for lo, hi, flat, sizes in sh.each_slice(batch.column(1), p.words, pw):
                sid, ends = sh.set_ids(flat, sizes), np.cumsum(sizes)
                hit = bits[(sid & np.uint64(FILTER_BITS - 1)).astype(np.int64)] & (sizes > 0)
                rows = []
                for i in np.flatnonzero(hit):
                    if sid[i] not in seen:
                        seen.add(sid[i])
                        tokens = flat[ends[i] - sizes[i] : ends[i]]
                        rows.append((sid[i], sizes[i], _compact(tokens).tobytes(), tokens.tobytes()))
                if len(seen) > 1 << 18:
                    seen.clear()
                if rows:
                    ids, n, sketch, packed = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [_signed(np.array(ids, np.uint64)), pa.array(n, pa.int64()), pa.array(sketch, pa.binary()), pa.array(packed, pa.binary())],
                        names=["sid", "size", "bits", "tokens"],
                    )

    # Equal sets are equal rows but for their task, so any of them will do.
    return Stored(docs.mapInArrow(run, schema), "sid")


@contextmanager
def bounded_batches(spark) -> Iterator[None]:
    """Arrow batches of at most ``BATCH_BYTES`` for the jobs that run inside, whatever the length of rows; the setting is put back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Stored:
    """A table in the shared folder, bucketed by one key and with one row per key, so that joins on it shuffle only the other side."""

    def __init__(self, rows: DataFrame, key: str):
        self.spark, self.name = rows.sparkSession, f"near_dup_{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        others = [F.first(c).alias(c) for c in rows.columns if c != key]
        rows.repartition(n, key).groupBy(key).agg(*others).write.format("parquet").option(
            "path", fresh_path(self.spark, "sets")
        ).bucketBy(n, key).sortBy(key).saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        """Takes the name out of the catalog; the files stay, as with every intermediate table."""
        self.spark.sql(f"DROP TABLE {self.name}")


def _paired(pairs: DataFrame, sets: Stored, *columns: str) -> DataFrame:
    """``pairs`` (a, b) with these columns of both sets, as ``a_...`` and ``b_...``.

    b is looked up in the bucketed table. a may be the center of very many pairs, so its columns are
    shuffled, those of centers only, and Spark can split the pairs of one center.
    """
    named = lambda side: [F.col("sid").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]]
    centers = pairs.select(F.col("a").alias("sid")).distinct()
    left = sets.rows().select("sid", *columns).join(centers, "sid", "left_semi").select(*named("a"))
    return pairs.join(sets.rows().select(*named("b")), "b").join(left, "a")


def _verified(pairs: DataFrame, sets: Stored, p: Jaccard) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x = np.frombuffer(left[i].as_buffer(), np.uint64)
                y = np.frombuffer(right[i].as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < p.percent * max(len(x), len(y)):
                    continue
                common = len(x) + len(y) - len(np.union1d(x, y))
                ok[i] = 100 * common >= p.percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], names=["a", "b"])

    both = _paired(pairs, sets, "tokens").select("a", "b", "a_tokens", "b_tokens")
    return both.mapInArrow(run, "a bigint, b bigint")


def _far(x: np.ndarray, y: np.ndarray) -> int:
    """Hamming distance of two sketches, on the bits of the narrower."""
    n = min(len(x), len(y))
    return int(np.bitwise_count(_folded(x, n) ^ _folded(y, n)).sum())


def _allowed(pairs: DataFrame, sets: Stored, p: Jaccard) -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow, with ``gap``, their distance in parts of the largest allowed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size_a, size_b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            far = np.array([
                _far(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
                for x, y in zip(batch.column(4), batch.column(5))
            ], np.int64)
            most = (100 - p.percent) * (size_a + size_b)
            ok = ((100 + p.percent) * far <= most) & (100 * np.minimum(size_a, size_b) >= p.percent * np.maximum(size_a, size_b))
            yield pa.RecordBatch.from_arrays(
                [c.filter(pa.array(ok)) for c in batch.columns[:2]] + [pa.array((far / np.maximum(most, 1))[ok])], names=["a", "b", "gap"]
            )

    both = _paired(pairs, sets, "size", "bits").select("a", "b", "a_size", "b_size", "a_bits", "b_bits")
    return both.mapInArrow(run, "a bigint, b bigint, gap double")


def _forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Positions of a spanning forest of the edges (u, v), earlier edges first: every tree takes its first edge outward, in rounds."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = np.arange(len(nodes))
    a, b = ends[: len(u)], ends[len(u) :]
    at = np.arange(len(u))
    taken: list[int] = []
    while len(at):
        both = np.concatenate([label[a[at]], label[b[at]]])
        best = np.full(len(nodes), len(u))
        np.minimum.at(best, both, np.concatenate([at, at]))
        for e in np.unique(best[best < len(u)]).tolist():
            x, y = a[e], b[e]
            while label[x] != x:
                x = label[x]
            while label[y] != y:
                y = label[y]
            if x != y:
                label[max(x, y)] = min(x, y)
                taken.append(e)
        while (deeper := label[label]).tolist() != label.tolist():
            label = deeper
        at = at[label[a[at]] != label[b[at]]]
    return np.array(taken, np.int64)


def _compare(rows: list[tuple], first: int, second: int, p: Jaccard, forests: int) -> Iterator[tuple[int, int, bool]]:
    """Edges of spanning forests between the components of one group, along pairs that the sketches allow.

    (a, b, whether the group has allowed pairs that are in none of the forests)
    """
    sid = np.array([r[0] for r in rows])
    comp = np.array([r[1] for r in rows])
    chunk = np.array([r[2] for r in rows])
    size = np.array([r[3] for r in rows])
    narrow = min(len(r[4]) for r in rows) // 8
    bits = np.stack([_folded(np.frombuffer(r[4], np.uint64), narrow) for r in rows])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    ours = np.flatnonzero(chunk == first)
    theirs = np.flatnonzero(chunk == second)
    for i in ours:
        to = ours[ours > i] if first == second else theirs
        to = to[comp[to] != comp[i]]
        to = to[100 * np.minimum(size[to], size[i]) >= p.percent * np.maximum(size[to], size[i])]
        if not len(to):
            continue
        far = np.bitwise_count(bits[to] ^ bits[i]).sum(axis=1, dtype=np.int64)
        most = (100 - p.percent) * (size[to] + size[i])
        near = (100 + p.percent) * far <= most
        if near.any():
            found.append((np.full(int(near.sum()), i), to[near], (far / np.maximum(most, 1))[near]))
    if not found:
        return
    x, y, gap = (np.concatenate(c) for c in zip(*found))
    low, high = np.minimum(sid[x], sid[y]), np.maximum(sid[x], sid[y])
    # The same order under every key, so that keys with the same sets choose the same pairs.
    order = np.lexsort((high, low, gap))
    low, high, u, v = low[order], high[order], comp[x][order], comp[y][order]
    left = np.arange(len(low))
    if forests > 1 and len(low) <= forests * len(rows):
        # What verified links have not joined by now are mostly pairs just below the threshold.
        for i, j in zip(low.tolist(), high.tolist()):
            yield i, j, False
        return
    for _ in range(forests):
        taken = _forest(u[left], v[left])
        for i, j in zip(low[left[taken]].tolist(), high[left[taken]].tolist()):
            yield i, j, len(taken) < len(left)
        left = np.delete(left, taken)
        if not len(left):
            break


def _cross_candidates(shared: DataFrame, comps: DataFrame, sets: Stored, p: Jaccard, forests: int) -> DataFrame:
    """(a, b, held): pairs under one key in different components, neither of them the key's center."""
    member = shared.join(comps.select(F.col("node").alias("sid"), "component"), "sid", "left").select(
        "key", "sid", F.coalesce("component", "sid").alias("component")
    )
    member = materialize(member, "members")
    open_keys = member.groupBy("key").agg(
        F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("greatest")
    ).where("least <> greatest").select("key", "n")
    rows = member.join(open_keys, "key").join(sets.rows().select("sid", "size", "bits"), "sid")
    rows = rows.withColumn("chunks", F.ceil(F.col("n") / F.lit(p.chunk_members)).cast("int"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select(
        "key", F.least("chunk", "other").alias("first"), F.greatest("chunk", "other").alias("second"),
        "sid", "component", "chunk", "size", "bits",
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows_of = None, []

        def close():
            if len(rows_of) > 1:
                yield from _compare(rows_of, group[1], group[2], p, forests)

        def packed(pairs):
            a, b, held = zip(*pairs)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(held)], names=["a", "b", "held"])

        for batch in batches:
            out = []
            for key, first, second, *rest in zip(*[c.to_pylist() for c in batch.columns]):
                if (key, first, second) != group:
                    out.extend(close())
                    group, rows_of = (key, first, second), []
                rows_of.append(tuple(rest))
            if out:
                yield packed(out)
        out = list(close()) if group else []
        if out:
            yield packed(out)

    dealt = rows.repartition("key", "first", "second").sortWithinPartitions("key", "first", "second", "sid")
    return dealt.mapInArrow(compare, "a bigint, b bigint, held boolean").groupBy("a", "b").agg(F.bool_or("held").alias("held"))


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components so far."""
    of = lambda side: comps.select(F.col("node").alias(side), F.col("component").alias(f"{side}_in"))
    both = pairs.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(~F.coalesce("a_in", "a").eqNullSafe(F.coalesce("b_in", "b"))).select("a", "b")


def _linked(shared: DataFrame, sets: Stored, p: Jaccard) -> DataFrame:
    """(node, component) of all sets that link with another."""
    pairs = shared.select(F.col("center").alias("a"), F.col("sid").alias("b")).distinct()
    near = materialize(_allowed(pairs, sets, p), "near-pairs")
    # One link ties a set to its center's component; further pairs matter only between components.
    best = materialize(near.groupBy("b").agg(F.min_by("a", "gap").alias("a")).select("a", "b"), "nearest-pairs")
    edges = materialize(_verified(best, sets, p), "links")
    comps = components(edges)
    rest = materialize(_apart(near.join(best, ["a", "b"], "left_anti"), comps), "other-pairs")
    edges = edges.unionByName(materialize(_verified(rest, sets, p), "links"))
    # Keys with one set beside their center are settled now.
    several = shared.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    several = materialize(shared.join(several, "key").select("key", "sid"), "several")
    forests = p.forests
    while True:
        comps = components(edges)
        found = materialize(_cross_candidates(several, comps, sets, p, forests), "cross-pairs")
        held = found.agg(F.bool_or("held")).first()[0]
        if held is None:
            return comps
        edges = edges.unionByName(materialize(_verified(found.select("a", "b"), sets, p), "links"))
        if not held:
            return components(edges)
        forests *= 16


def near_duplicates(docs: DataFrame, p: Jaccard = Jaccard(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id.

    Two texts link when their shingle sets have a similarity of ``p.percent`` hundredths or more;
    component_id is the least doc_id that links reach, so equal for all of a component. Null and
    word-less texts have no shingles, link with nothing and are their own component. Null ids
    are ignored in the least id. Repeated rows are rows of one set. An empty table gives no rows.
    """
    return _labelled(docs, p, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def _labelled(docs: DataFrame, p: Jaccard, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, hash of the text, n_shingles, component (a set's number, null without words), component_id."""
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    with bounded_batches(docs.sparkSession):
        return _components_of(docs, p)


def _components_of(docs: DataFrame, p: Jaccard) -> DataFrame:
    """``_labelled`` of (doc_id, text, hash)."""
    stop = _frequent(docs.select("text"), p)
    rows = materialize(_numbered(docs, p), "numbered")
    shared = materialize(_shared(_keyed(docs, p, stop)), "shared")
    slot = lambda c: F.col(c).bitwiseAND(F.lit(FILTER_BITS - 1))
    slots = shared.select(F.explode(F.array(slot("center"), slot("sid"))).alias("slot")).distinct().toPandas()["slot"]
    flags = np.zeros(FILTER_BITS, np.uint8)
    flags[slots.to_numpy(np.int64)] = 1
    sets = _wanted_sets(docs, p, np.packbits(flags))
    try:
        comps = _linked(shared, sets, p)
    finally:
        sets.close()

    own = rows.where("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("weight"))
    own = own.join(comps.select(F.col("node").alias("sid"), "component"), "sid", "left")
    own = materialize(own.withColumn("component", F.coalesce("component", "sid")), "set-components")
    least = own.groupBy("component").agg(F.min("least_id").alias("component_id"), F.sum("weight").alias("rows"))
    total = rows.count()
    named = materialize(lookup_join(own.select("sid", "component", "weight"), least, ["component"], "rows", total), "named")
    with_words = lookup_join(rows.where("n_shingles > 0"), named.drop("rows"), ["sid"], "weight", total)
    columns = ["doc_id", "hash", "n_shingles", "component", "component_id"]
    without = rows.where("n_shingles = 0").select(
        "doc_id", "hash", "n_shingles", F.lit(None).cast("bigint").alias("component"), F.col("doc_id").alias("component_id")
    )
    return with_words.select(*columns).unionByName(without)


def keep_one_per_component(docs: DataFrame, p: Jaccard = Jaccard()) -> DataFrame:
    """The row of ``docs`` with the smallest doc_id of each component, all columns unchanged.

    Rows without words stay. Rows that share id and text (repeated rows) leave one; a component without
    ids (all null) leaves one text. Texts travel once, to meet their verdict.
    """
    rated = materialize(_labelled(docs, p), "near-copies")
    first = rated.where("component IS NOT NULL AND doc_id <=> component_id").groupBy("component", "doc_id").agg(F.min("hash").alias("hash"))
    wordless = rated.where("component IS NULL").select("doc_id", "hash").distinct()
    stays = first.select("doc_id", "hash").unionByName(wordless)
    stays = stays.select(F.col("doc_id").alias("kept_id"), F.col("hash").alias("kept_hash"))
    # The row travels as one struct, so that no column of its can clash with those used here.
    text = F.col("text").cast("string")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(text).alias("hash"))
    rows = rows.join(stays, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("id", "hash").orderBy("id"))
    return rows.withColumn("nth", nth).where("nth = 1").select("row.*")
