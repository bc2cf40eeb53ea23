"""Severity of toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= j) = sigmoid(threshold_j - score): one weight per feature is shared by all ordered
thresholds. Features are the presence of hashed words and word beginnings. An L1 penalty leaves weights
on few of them, so a long text gathers no noise. Fitting takes a bounded sample of labelled rows;
scoring is one pass over the texts, without shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tableproof.llm import shingles as sh
from tableproof.llm.features import feature_rows, labelled_sample
from tableproof.session import materialize


@dataclass(frozen=True)
class OrdinalParams:
    bits: int = 20
    prefixes: tuple[int, ...] = (4, 5, 6)
    #: Labelled rows to fit on, at most.
    sample_rows: int = 12_000
    #: Rows of the sample that must show a feature.
    least_rows: int = 4
    #: Least difference, in standard errors, between a feature's shares in the lowest and the other grades.
    screen: float = 2.5
    l1: float = 1e-3
    steps: int = 400
    rate: float = 0.5
    #: Rows of this expected severity or more are rejected.
    reject_at: float = 0.25


@dataclass(frozen=True)
class OrdinalModel:
    """Weights of the features that have one, and the ordered thresholds."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    @property
    def grades(self) -> int:
        return len(self.thresholds) + 1

    def reached(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ...; non-increasing in j."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(indptr: np.ndarray, features: np.ndarray, grades: np.ndarray, p: OrdinalParams) -> OrdinalModel:
    """Proximal gradient (per-coordinate step sizes, L1) on the likelihood of ``grades`` 0..K-1.

    Row i has the distinct features ``features[indptr[i]:indptr[i+1]]``. With a single grade
    there is nothing to tell apart: no weights, and a threshold that no row reaches.
    """
    n, k = len(grades), int(grades.max(initial=0)) + 1
    if len(np.unique(grades)) < 2:
        return OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.full(max(1, k - 1), 40.0))
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(indptr))
    high = (grades > 0).astype(float)
    shown = np.bincount(features, minlength=1 << p.bits)
    shown_high = np.bincount(features, weights=high[row], minlength=1 << p.bits)
    kept = np.flatnonzero(_screened(shown, shown_high, high.mean(), p))
    place = np.full(1 << p.bits, -1, np.int32)
    place[kept] = np.arange(len(kept))
    col = place[features]
    row, col = row[col >= 0], col[col >= 0]

    w, gw = np.zeros(len(kept)), np.full(len(kept), 1e-8)
    # Thresholds as a first one and positive gaps, so that they stay ordered.
    levels = np.array([np.clip((grades < j).mean(), 1e-3, 1 - 1e-3) for j in range(1, k)])
    start = np.log(levels / (1 - levels))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    gf = np.full(len(free), 1e-8)
    for _ in range(p.steps):
        theta = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        score = np.bincount(row, weights=w[col], minlength=n)
        upper = np.where(grades < k - 1, _sigmoid(theta[np.minimum(grades, k - 2)] - score), 1.0)
        lower = np.where(grades > 0, _sigmoid(theta[np.maximum(grades - 1, 0)] - score), 0.0)
        mass = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper), lower * (1 - lower)
        g = np.bincount(col, weights=((du - dl) / mass / n)[row], minlength=len(kept))
        slope = np.bincount(np.minimum(grades, k - 2), weights=np.where(grades < k - 1, -du / mass, 0), minlength=k - 1)
        slope += np.bincount(np.maximum(grades - 1, 0), weights=np.where(grades > 0, dl / mass, 0), minlength=k - 1)
        tail = np.cumsum(slope[::-1])[::-1] / n
        gt = np.concatenate([tail[:1], tail[1:] * np.exp(free[1:])])
        gw += g * g
        gf += gt * gt
        step = p.rate / np.sqrt(gw)
        w = w - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * p.l1, 0)
        free = free - 0.2 * p.rate / np.sqrt(gf) * gt
    theta = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
    live = np.flatnonzero(w)
    return OrdinalModel(kept[live], w[live], theta)


def _screened(shown: np.ndarray, shown_high: np.ndarray, share: float, p: OrdinalParams) -> np.ndarray:
    """Whether enough rows show a feature and its share in the lowest grade differs from that in the others."""
    error = np.sqrt(np.maximum(shown * share * (1 - share), 1e-9))
    return (shown >= p.least_rows) & (np.abs(shown_high - shown * share) > p.screen * error)


def grades_of(toxic: np.ndarray, marked: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Grades 0, 1, 2 from a yes-or-no label, for tables that record no grades.

    0: not toxic. A toxic row has grade 2 if at least half of the toxic rows have no larger a share of
    ``marked`` features among their ``sizes``, those that several toxic rows and no other sampled row show; else 1.
    """
    share = marked / np.maximum(1, sizes)
    middle = np.median(share[toxic > 0]) if (toxic > 0).any() else 0.0
    return np.where(toxic > 0, 1 + (share >= middle), 0).astype(np.int64)


def _sample_sets(sample: DataFrame, p: OrdinalParams) -> DataFrame:
    """doc_id, target and the distinct features of every sampled row, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = sh.powers()
        for batch in batches:
            for lo, hi, words, counts in feature_rows(batch.column(2), p.bits, p.prefixes, powers):
                ends = np.cumsum(counts)
                sets = [np.unique(words[a:b]).astype(np.int32) for a, b in zip(ends - counts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(sets, pa.list_(pa.int32()))],
                    names=["doc_id", "target", "features"],
                )

    rows = sample.select("doc_id", F.col("target").cast("int").alias("target"), "text")
    return materialize(rows.mapInArrow(run, "doc_id bigint, target int, features array<int>"), "toxicity-sample")


def sample_features(sample: DataFrame, p: OrdinalParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, screened features of each row, and grades of a bounded sample.

    Features are counted and screened on the executors: the driver gets one count per feature that
    ``least_rows`` rows show, and of every row only the features that the fit can use.
    """
    sets = _sample_sets(sample, p)
    n, toxic_rows = sets.agg(F.count("*"), F.coalesce(F.sum("target"), F.lit(0))).first()
    counted = (
        sets.select("target", F.explode("features").alias("feature")).groupBy("feature")
        .agg(F.count("*").alias("shown"), F.sum("target").alias("high")).where(F.col("shown") >= p.least_rows).toArrow()
    )
    feature = counted.column("feature").to_numpy()
    shown, high = counted.column("shown").to_numpy(), counted.column("high").to_numpy().astype(float)
    # Bit 0: the fit can use it; bit 1: only toxic rows show it.
    use = np.zeros(1 << p.bits, np.uint8)
    use[feature] = _screened(shown, high, toxic_rows / max(n, 1), p) + 2 * (high == shown).astype(np.uint8)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            of = np.repeat(np.arange(len(sizes)), sizes)
            kind = use[flat]
            marked = np.bincount(of[kind >= 2], minlength=len(sizes))
            kept = (kind & 1) > 0
            ends = np.concatenate([[0], np.cumsum(np.bincount(of[kept], minlength=len(sizes)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes.astype(np.int64)), pa.array(marked.astype(np.int64)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[kept]))],
                names=["doc_id", "target", "n", "marked", "features"],
            )

    got = sets.mapInArrow(thin, "doc_id bigint, target int, n bigint, marked bigint, features array<int>").toArrow().combine_chunks().sort_by("doc_id")
    lists = got.column("features").combine_chunks()
    grades = grades_of(got.column("target").to_numpy(), got.column("marked").to_numpy(), got.column("n").to_numpy())
    sizes = lists.value_lengths().to_numpy() if len(lists) else np.zeros(0, np.int64)
    features = lists.flatten().to_numpy() if len(lists) else np.zeros(0, np.int32)
    return np.concatenate([[0], np.cumsum(sizes)]), features, grades


def train(docs: DataFrame, labels: DataFrame, p: OrdinalParams = OrdinalParams()) -> OrdinalModel:
    """Model from ``labels`` (doc_id, toxic) and the texts of ``docs``; without labels one that rates all rows 0."""
    indptr, features, grades = sample_features(labelled_sample(docs, labels, F.col("toxic").cast("int"), p.sample_rows), p)
    if not len(grades):
        return OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.full(2, 40.0))
    return fit_ordinal(indptr, features, grades, p)


def severity(text, model: OrdinalModel, p: OrdinalParams = OrdinalParams()):
    """Column of array<double> on a text column: expected severity, then P(grade >= 1), P(grade >= 2), ...

    Rates depend on the text alone, so repeated rows get equal ones. A null or empty text has no
    feature and gets what the thresholds alone say; a very long text is read whole, part by part,
    and counts each feature once. An empty table gives no rows.
    """
    feature, weight = model.features, model.weights

    @F.arrow_udf("array<double>")
    def rate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        powers = sh.powers()
        table = np.zeros(1 << p.bits)
        table[feature] = weight
        for column in batches:
            rows = []
            for lo, hi, words, counts in feature_rows(column, p.bits, p.prefixes, powers):
                of = np.repeat(np.arange(hi - lo), counts)
                hit = np.flatnonzero(table[words].any(axis=1))
                score = _distinct_sums(hi - lo, np.repeat(of[hit], words.shape[1]), words[hit].ravel(), table)
                reached = model.reached(score)
                rows.append(np.column_stack([reached.sum(axis=1), reached]))
            made = np.concatenate(rows) if rows else np.zeros((0, model.grades))
            offsets = np.arange(len(made) + 1, dtype=np.int32) * model.grades
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(made.ravel()))

    return rate(text)


def _distinct_sums(rows: int, row: np.ndarray, feature: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Per row the sum of the weights of its distinct features."""
    use = table[feature] != 0
    pairs = np.unique((row[use].astype(np.int64) << 32) | feature[use])
    return np.bincount(pairs >> 32, weights=table[pairs & 0xFFFFFFFF], minlength=rows)
