import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tableproof.llm import shingles as sh
from tableproof.llm.mixing import DomainModel, MixParams, fit_rates, mixed, posteriors_of, rates_after, tempered, train_domains


def corpus(spark, n=1200):
    rng = np.random.default_rng(0)
    docs, labels = [], []
    for i in range(n):
        domain = "abc"[0 if i % 10 < 6 else 1 if i % 10 < 9 else 2]
        own = [f"{domain}{j}" for j in rng.integers(0, 60, size=int(rng.integers(3, 40)))]
        shared = [f"s{j}" for j in rng.integers(0, 60, size=int(rng.integers(3, 40)))]
        docs.append((i, " ".join(own + shared), "x", 0.5))
        if i % 2:
            labels.append((i, domain))
    return (spark.createDataFrame(docs, "doc_id bigint, text string, domain string, rate double"),
            spark.createDataFrame(labels, "doc_id bigint, d string"))


def test_totals_meet_targets(spark):
    docs, labels = corpus(spark)
    p = MixParams()
    model = train_domains(docs, labels, F.col("d"), p)
    assert model.domains == ("a", "b", "c")
    want = lambda totals: np.array([0.3, 0.3, 0.4])
    mixture = fit_rates(docs, model, shares=want, p=p)
    assert np.abs(mixture.totals / mixture.targets - 1).max() < 0.02
    rows = mixed(docs.select("doc_id", "text"), mixture).select("row.doc_id", "mix.*").collect()
    right = np.mean([r.domain == "abc"[0 if r.doc_id % 10 < 6 else 1 if r.doc_id % 10 < 9 else 2] for r in rows if r.doc_id % 2 == 0])
    assert right > 0.97
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)
    expected = sum(r.rate * r.tokens for r in rows)
    assert abs(sum(r.copies * r.tokens for r in rows) / expected - 1) < 0.1
    assert abs(expected / mixture.targets.sum() - 1) < 0.02


def test_steps_are_projected_gradient_descent():
    """The replayed steps against descent on the rates themselves."""
    rng = np.random.default_rng(1)
    posts = rng.dirichlet([0.4, 0.4, 0.4], size=200)
    tokens = rng.integers(1, 100, size=200)
    present = tokens @ posts
    target = present.sum() * np.array([0.7, 0.05, 0.25])
    rate, steps, misfit = np.ones(200), [], []
    for _ in range(200):
        off = ((tokens * rate) @ posts - target) / present
        misfit.append((off * off * present).sum())
        steps.append(off)
        rate = np.maximum(0, rate - posts @ off)
    assert np.allclose(rates_after(posts, steps, 1.0, 0.0), rate)
    assert all(b <= a + 1e-9 for a, b in zip(misfit, misfit[1:])) and misfit[-1] < 1e-3 * misfit[0]


def test_least_rate_keeps_every_row(spark):
    docs, labels = corpus(spark)
    p = MixParams(least=1.0)
    mixture = fit_rates(docs, train_domains(docs, labels, F.col("d"), p), p=p)
    rows = mixed(docs.select("doc_id", "text"), mixture).select("mix.*").collect()
    assert min(r.copies for r in rows) >= 1 and max(r.copies for r in rows) > 1
    assert np.abs(mixture.totals / mixture.targets - 1).max() < 0.05


def test_nulls_and_empty_tables(spark, docs):
    one = train_domains(docs, spark.createDataFrame([], "doc_id bigint, d string"), F.col("d"))
    assert one.domains == ("all",)
    rows = mixed(docs, fit_rates(docs, one))
    assert rows.select("row.*").columns == docs.columns and rows.count() == docs.count()
    assert all(abs(r.rate - 1) < 1e-9 for r in rows.select("mix.*").collect())
    assert mixed(docs.limit(0), fit_rates(docs.limit(0), one)).count() == 0
    only_empty = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert mixed(only_empty, fit_rates(only_empty, DomainModel(("a", "b"), np.zeros((1 << 15, 2), np.float32), np.zeros(2)))).count() == 2


def test_tempered_shares():
    assert np.allclose(tempered(np.array([1.0, 0.0, 1.0])), [0.5, 0, 0.5]) and tempered(np.zeros(2)).sum() == 0


def soft(prior, seed=3):
    """A model that is sure of nothing, and texts."""
    rng = np.random.default_rng(seed)
    model = DomainModel(("a", "b", "c"), rng.normal(0, 1.5, (1 << 15, 3)).astype(np.float32), np.log(prior))
    return model, [(i, " ".join(f"w{j}" for j in rng.integers(0, 5000, size=int(rng.integers(5, 60))))) for i in range(1500)]


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_small_domains_meet_their_targets(spark, least):
    model, rows = soft([0.6, 0.39, 0.01])
    tokens, posts = posteriors_of(pa.array([t for _, t in rows]), model, MixParams(), sh.powers())
    # Totals that some rates have can be reached.
    rates = 1.0 + 20.0 * (posts[:, 2] > 3 * posts[:, 2].mean())
    want = (tokens * rates) @ posts
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    mixture = fit_rates(docs, model, lambda t: want / want.sum(), budget=want.sum(), p=MixParams(least=least))
    assert np.abs(mixture.totals / mixture.targets - 1).max() < 1e-3 and mixture.unreached == ()
    out = mixed(docs, mixture).select("mix.*").collect()
    assert min(r.rate for r in out) >= least
    assert abs(sum(r.rate * r.tokens for r in out) / mixture.targets.sum() - 1) < 1e-3


def test_targets_out_of_reach_are_named(spark):
    docs = spark.createDataFrame([(1, "x y z"), (2, "u v")], "doc_id bigint, text string")
    flat = DomainModel(("a", "b"), np.zeros((1 << 15, 2), np.float32), np.log([0.9, 0.1]))
    mixture = fit_rates(docs, flat, shares=lambda t: np.array([0.5, 0.5]))
    assert mixture.unreached == ("a", "b") and mixture.targets.tolist() == [2.5, 2.5]
    # The least squares of both relative misfits: totals are 4.5 r and 0.5 r.
    r = (4.5 * 2.5 / 4.5 + 0.5 * 2.5 / 0.5) / (4.5**2 / 4.5 + 0.5**2 / 0.5)
    assert np.allclose(mixture.totals, [4.5 * r, 0.5 * r], rtol=1e-3)
