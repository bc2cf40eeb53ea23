"""Mixing to target weights with soft memberships: posteriors per document, nonnegative rates by least squares.

A classifier fitted on labelled rows gives every document a posterior over domains, the mean over its
words of one learnt vector per hashed word, through a softmax. A document's rate is how often it
is expected in the mixture; the expected tokens of domain d are the sum of rate * tokens * posterior(d).
Rates minimise the squared relative misfit to target totals, subject to rate >= least; of rates that fit
alike, those nearest to the start are taken. That optimum is max(least, start + posterior . multipliers) with
one multiplier per domain, found by Newton steps: each is one aggregate of the D totals and of the D x D
matrix sum(tokens * posterior * posterior') over rows whose rate is free, for a few step lengths at once.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tableproof.llm import shingles as sh
from tableproof.llm.features import feature_rows, labelled_sample
from tableproof.session import materialize

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class MixParams:
    bits: int = 15
    #: Labelled rows to fit the classifier on, at most.
    sample_rows: int = 6_000
    fit_steps: int = 60
    fit_rate: float = 2.0
    l2: float = 1e-6
    #: Least rate of a document; 0 lets a document be left out.
    least: float = 0.0
    #: Relative misfit from which a target counts as one that cannot be reached.
    tolerance: float = 2e-3
    #: Weight of the distance to the start beside the misfit; a target reached is missed by this times its multiplier.
    ridge: float = 1e-7


@dataclass(frozen=True)
class DomainModel:
    domains: tuple[str, ...]
    #: (2 ** bits, domains), float32
    vectors: np.ndarray
    prior: np.ndarray


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train_domains(docs: DataFrame, labels: DataFrame, domain: Column, p: MixParams = MixParams()) -> DomainModel:
    """Classifier from ``labels`` (doc_id, ...); ``domain`` is a string column on it. Without labels there is one domain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = sh.powers()
        for batch in batches:
            for lo, hi, words, counts in feature_rows(batch.column(2), p.bits, (), powers):
                ends = np.cumsum(counts)
                found = [np.unique(words[a:b, 0], return_counts=True) for a, b in zip(ends - counts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                     pa.array([f.astype(np.int32) for f, _ in found], pa.list_(pa.int32())),
                     pa.array([(n / max(1, n.sum())).astype(np.float32) for _, n in found], pa.list_(pa.float32()))],
                    names=["doc_id", "target", "features", "shares"],
                )

    sample = labelled_sample(docs, labels, domain, p.sample_rows)
    got = sample.select("doc_id", "target", "text").mapInArrow(
        run, "doc_id bigint, target string, features array<int>, shares array<float>"
    ).toArrow().combine_chunks().sort_by("doc_id")
    if not got.num_rows:
        return DomainModel(("all",), np.zeros((1 << p.bits, 1), np.float32), np.zeros(1))
    domains, y = np.unique(np.array(got.column("target").to_pylist()), return_inverse=True)
    lists = got.column("features").combine_chunks()
    row = np.repeat(np.arange(len(y)), [len(x) for x in lists])
    col = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    share = got.column("shares").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    return _fit(row, col, share, y, tuple(domains.tolist()), p)


def _fit(row, col, share, y, domains: tuple[str, ...], p: MixParams) -> DomainModel:
    """Softmax regression by per-coordinate gradient steps."""
    n, k, size = len(y), len(domains), 1 << p.bits
    used, col = np.unique(col, return_inverse=True)
    w, g2 = np.zeros((len(used), k)), np.full((len(used), k), 1e-10)
    freq = np.bincount(y, minlength=k) / n
    prior = np.log(np.maximum(freq, 1e-6))
    hot = np.zeros((n, k))
    hot[np.arange(n), y] = 1.0
    for _ in range(p.fit_steps):
        score = np.stack([np.bincount(row, weights=share * w[col, d], minlength=n) for d in range(k)], axis=1)
        off = (_softmax(score + prior) - hot) / n
        g = np.stack([np.bincount(col, weights=share * off[row, d], minlength=len(used)) for d in range(k)], axis=1) + p.l2 * w
        g2 += g * g
        w -= p.fit_rate * g / np.sqrt(g2)
    vectors = np.zeros((size, k), np.float32)
    vectors[used] = w
    return DomainModel(domains, vectors, prior)


def posteriors_of(column: pa.Array, model: DomainModel, p: MixParams, powers) -> tuple[np.ndarray, np.ndarray]:
    """Words and domain posteriors of every text of a column; a text without words has the prior."""
    tokens, posts = [], []
    for lo, hi, words, counts in feature_rows(column, p.bits, (), powers):
        k = len(model.domains)
        total = np.zeros((hi - lo, k))
        if len(words):
            full = np.flatnonzero(counts)
            starts = (np.cumsum(counts) - counts)[full]
            for d in range(k):
                total[full, d] = np.add.reduceat(model.vectors[words[:, 0], d].astype(np.float64), starts)
        tokens.append(counts)
        posts.append(_softmax(total / np.maximum(counts, 1)[:, None] + model.prior))
    if not tokens:
        return np.zeros(0, np.int64), np.zeros((0, len(model.domains)))
    return np.concatenate(tokens), np.concatenate(posts)


def rates_after(posts: np.ndarray, steps: Sequence[np.ndarray], base: float, least: float) -> np.ndarray:
    """Rates of documents with these posteriors: every step's move, each followed by the projection."""
    rate = np.full(len(posts), max(base, least))
    for direction in steps:
        rate = np.maximum(least, rate - posts @ direction)
    return rate


@dataclass(frozen=True)
class Mixture:
    model: DomainModel
    params: MixParams
    base: float
    steps: tuple[np.ndarray, ...]
    #: Expected tokens per domain, and the targets.
    totals: np.ndarray
    targets: np.ndarray

    @property
    def misfit(self) -> np.ndarray:
        """Expected tokens less target, relative to the target, or to a D-th of all targets where that is zero."""
        return (self.totals - self.targets) / np.maximum(np.where(self.targets > 0, self.targets, self.targets.mean()), 1e-9)

    @property
    def unreached(self) -> tuple[str, ...]:
        """Domains whose targets no rates can reach together with the others."""
        return tuple(d for d, x in zip(self.model.domains, self.misfit) if abs(x) > self.params.tolerance)


def tempered(totals: np.ndarray, power: float = 0.7) -> np.ndarray:
    """Target shares that raise small domains: shares to a power below one, normalised."""
    raised = np.where(totals > 0, totals, 0.0) ** power * (totals > 0)
    return raised / max(raised.sum(), 1e-300)


def fit_rates(docs: DataFrame, model: DomainModel, shares=tempered, budget: float | None = None, p: MixParams = MixParams()) -> Mixture:
    """Rates for the texts of ``docs`` so that expected tokens per domain match ``shares`` of ``budget`` tokens.

    ``shares`` maps the domains' present totals to target shares; ``budget`` is the present total if
    not given, or, where rates have a least value of 1, what keeps every domain's target at its
    present total or above. Distances to the start weigh a rate by the document's tokens, misfits
    are relative to present totals. Steps end on convergence; targets out of reach are logged and
    named by the mixture.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = sh.powers()
        for batch in batches:
            tokens, posts = posteriors_of(batch.column(0), model, p, powers)
            ends = np.arange(len(tokens) + 1, dtype=np.int32) * len(model.domains)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens), pa.ListArray.from_arrays(pa.array(ends), pa.array(posts.ravel()))], names=["tokens", "posts"]
            )

    rows = materialize(docs.select(F.col("text").cast("string")).mapInArrow(run, "tokens bigint, posts array<double>"), "posteriors")
    k = len(model.domains)

    def states(points: Sequence[np.ndarray], base: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """Per vector of multipliers: domain totals, their derivative, and the sum whose gradient they are."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(points), k + k * k + 1))
            for batch in batches:
                if batch.num_rows:
                    tokens = batch.column(0).to_numpy().astype(float)
                    posts = batch.column(1).flatten().to_numpy().reshape(-1, k)
                    for i, point in enumerate(points):
                        wish = max(base, p.least) + posts @ point
                        rate = np.maximum(p.least, wish)
                        free = posts * (tokens * (wish > p.least))[:, None]
                        sums[i, :k] += (tokens * rate) @ posts
                        sums[i, k:-1] += (free.T @ posts).ravel()
                        sums[i, -1] += tokens @ (rate * (wish - rate / 2))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], names=["at", "x"])

        out = np.zeros(len(points) * (k + k * k + 1))
        for r in rows.mapInArrow(add, "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
            out[r["at"]] = r["x"]
        return [(x[:k], x[k:-1].reshape(k, k), float(x[-1])) for x in out.reshape(len(points), -1)]

    zero = np.zeros(k)
    present = states([zero], 1.0)[0][0] / max(1.0, p.least)
    share = np.asarray(shares(present), float)
    size = present.sum() if budget is None else budget
    if budget is None and p.least == 1.0:
        size = max([size, *(present[share > 0] / share[share > 0])])
    target = share * size
    base = size / present.sum() if present.sum() else 1.0
    scale = np.maximum(present, 1e-9 * max(size, 1.0))
    at = zero
    now, slope, height = states([at], base)[0]

    def off(point, totals):
        return totals - target + p.ridge * scale * point

    def value(point, height):
        return height - target @ point + p.ridge / 2 * (scale * point) @ point

    while np.abs(off(at, now)).max() > 1e-9 * max(size, 1e-9):
        step = -np.linalg.solve(slope + p.ridge * np.diag(scale), off(at, now))
        points = [at + step * 0.5**i for i in range(12)]
        tried = states(points, base)
        best = min(range(12), key=lambda i: value(points[i], tried[i][2]))
        if not value(points[best], tried[best][2]) < value(at, height):
            # Near the optimum the values differ by less than doubles tell; the gradient decides.
            best = min(range(12), key=lambda i: np.abs(off(points[i], tried[i][0])).max())
            if not np.abs(off(points[best], tried[best][0])).max() < np.abs(off(at, now)).max():
                break
        at, (now, slope, height) = points[best], tried[best]
    mixture = Mixture(model, p, base, (-at,), now, target)
    if mixture.unreached:
        log.warning("mixing: out of reach: %s", ", ".join(
            f"{d} ({t:.0f} tokens for {g:.0f})" for d, t, g in zip(model.domains, now, target) if d in mixture.unreached
        ))
    return mixture


def mixed(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """``docs`` (doc_id, text and any others) as a struct ``row``, beside a struct ``mix``: tokens, domain, posterior, rate, copies.

    domain is the likeliest one (ties: the first by name); copies is the rate rounded up or down
    by a number in [0, 1) that the doc_id fixes, so that its expectation is the rate. Null texts count
    as empty, null ids share one number. Nothing is shuffled.
    """
    m, p = mixture.model, mixture.params
    steps, base = mixture.steps, mixture.base
    names = pa.array(m.domains)

    @F.arrow_udf("tokens bigint, domain string, posterior double, rate double, copies int")
    def rate(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        powers = sh.powers()
        for text, number in batches:
            tokens, posts = posteriors_of(text, m, p, powers)
            rates = rates_after(posts, steps, base, p.least)
            copies = np.floor(rates + number.to_numpy(zero_copy_only=False)).astype(np.int32)
            best = posts.argmax(axis=1) if len(posts) else np.zeros(0, np.int64)
            yield pa.StructArray.from_arrays(
                [pa.array(tokens), names.take(pa.array(best)), pa.array(posts.max(axis=1) if len(posts) else np.zeros(0)), pa.array(rates), pa.array(copies)],
                names=["tokens", "domain", "posterior", "rate", "copies"],
            )

    number = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(31)), F.lit(1 << 40)) / float(1 << 40)
    return docs.select(F.struct("*").alias("row"), rate(F.col("text").cast("string"), number).alias("mix"))
