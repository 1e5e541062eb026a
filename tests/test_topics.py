import math
import random

import numpy as np
import pytest
from pyspark.ml.clustering import LDA

from weftgrid.operators import features, topics

WORDS = ["apple pear plum cherry fig".split(), "iron zinc tin gold lead".split(), "oak ash elm pine fir".split()]


def texts(n=120, seed=3):
    """Each text draws most words from one of three lists."""
    rng = random.Random(seed)
    return [[rng.choice(WORDS[i % 3] if rng.random() < 0.9 else rng.choice(WORDS)) for _ in range(rng.randint(5, 30))] for i in range(n)]


def frame(spark, docs):
    return spark.createDataFrame([(i, d) for i, d in enumerate(docs)] + [(-1, None), (-2, []), (None, ["apple"])], "id int, t array<string>")


def digamma(x):
    return np.vectorize(lambda v: (math.lgamma(v + 1e-5) - math.lgamma(v - 1e-5)) / 2e-5)(x)


def by_hand(n, lam, alpha, eta, rounds):
    """The same updates on dense matrices; ``n`` is documents x words."""
    gam = alpha + n.sum(1, keepdims=True) / lam.shape[0] * np.ones((1, lam.shape[0]))
    bounds, gamma_ln = [], np.vectorize(math.lgamma)
    for _ in range(rounds):
        lt = digamma(gam) - digamma(gam.sum(1, keepdims=True))
        lb = digamma(lam) - digamma(lam.sum(1, keepdims=True))
        norm = np.exp(lt) @ np.exp(lb)
        k, w = lam.shape
        bounds.append(
            (n * np.log(norm)).sum() + ((alpha - gam) * lt + gamma_ln(gam) - math.lgamma(alpha)).sum()
            + (math.lgamma(k * alpha) - gamma_ln(gam.sum(1))).sum() + ((eta - lam) * lb + gamma_ln(lam) - math.lgamma(eta)).sum()
            + (math.lgamma(w * eta) - gamma_ln(lam.sum(1))).sum())
        share = n / norm
        gam, lam = alpha + np.exp(lt) * (share @ np.exp(lb).T), eta + np.exp(lb) * (np.exp(lt).T @ share)
    return gam, lam, bounds


def test_equals_dense_updates_for_any_partitioning(spark):
    docs = texts(40)
    words = sorted({w for d in docs for w in d})
    n = np.array([[d.count(w) for w in words] for d in docs], float)
    df = frame(spark, docs)
    model = topics._Round(3, 0.5, 0.25)
    start = {r["term"]: [r[a] for a in model.names] for r in model.start(topics._cells(df, "id", "t", 7, 1), 7).collect()}
    start.pop("none", None)
    lam = np.array([start[w] for w in words]).T
    gam, lam, bounds = by_hand(n, lam, 0.5, 0.25, 3)
    for parts in (1, 5):
        made = topics.fit_topics(df.repartition(parts), "id", "t", 3, 3, alpha=0.5, eta=0.25, seed=7)
        got = {r["term"]: r["counts"] for r in made.terms.collect()}
        assert sorted(got) == words
        assert np.allclose(np.array([got[w] for w in words]).T + 0.25, lam, rtol=1e-5)
        shares = {r["id"]: r["shares"] for r in made.documents.collect()}
        assert sorted(shares) == list(range(40))
        assert np.allclose(np.array([shares[i] for i in range(40)]), gam / gam.sum(1, keepdims=True), rtol=1e-5)
        assert np.allclose(made.bounds, bounds, rtol=1e-6)


def test_bound_rises_and_topics_are_those_of_the_library(spark):
    docs = texts()
    df = frame(spark, docs)
    made = topics.fit_topics(df, "id", "t", 3, 15)
    assert len(made.bounds) == 15 and all(b >= a - 1e-6 * abs(a) for a, b in zip(made.bounds, made.bounds[1:]))

    def groups(rows):
        found = {}
        for r in rows:
            found.setdefault(r["topic"], set()).add(r["term"])
        return sorted(sorted(g) for g in found.values())

    leading = topics.leading_terms(made.terms, 5).collect()
    assert groups(leading) == sorted(sorted(w) for w in WORDS)
    counted, vocabulary = features.count_vectors(df.where("id >= 0"), "t")
    described = LDA(featuresCol="t", k=3, maxIter=40, optimizer="em", seed=1).fit(counted).describeTopics(5).collect()
    assert sorted(sorted(vocabulary[i] for i in r["termIndices"]) for r in described) == groups(leading)
    best = {r["id"]: r["shares"].index(max(r["shares"])) for r in made.documents.collect()}
    assert len({best[i] for i in range(3)}) == 3 and sum(best[i] == best[i % 3] for i in best) > 0.95 * len(best)


def test_batches_find_the_same_topics(spark):
    made = topics.fit_topics(frame(spark, texts(240)), "id", "t", 3, 24, batches=3)
    assert len({r["id"] for r in made.documents.collect()}) == 240
    assert np.mean(made.bounds[-3:]) > np.mean(made.bounds[:3])
    first = {}
    for r in topics.leading_terms(made.terms, 4).collect():
        first.setdefault(r["topic"], set()).add(r["term"])
    assert all(any(g <= set(w) for w in WORDS) for g in first.values()) and len(first) == 3


def test_counts_add_up_under_skew(spark, forced_skew):
    docs = [["the"] * 50 + [f"w{i % 7}"] for i in range(300)]
    made = topics.fit_topics(frame(spark, docs), "id", "t", 2, 2)
    total = {r["term"]: sum(r["counts"]) for r in made.terms.collect()}
    assert abs(total["the"] - 15000) < 1e-6 and abs(sum(total.values()) - 15300) < 1e-6
    assert all(abs(sum(r["counts"]) - 51) < 1e-9 for r in made.documents.collect())


def test_blocks_and_chunks_do_not_change_the_result(spark, monkeypatch):
    df = frame(spark, texts(60))

    def fitted():
        made = topics.fit_topics(df, "id", "t", 3, 4, seed=7)
        return {r["term"]: r["counts"] for r in made.terms.collect()}, {r["id"]: r["shares"] for r in made.documents.collect()}, made.bounds

    whole = fitted()
    monkeypatch.setattr(topics, "BLOCK_CELLS", 40)
    monkeypatch.setattr(topics, "_CHUNK", 60)
    parts = fitted()
    for a, b in zip(whole[:2], parts[:2]):
        assert a.keys() == b.keys() and all(np.allclose(a[x], b[x], rtol=1e-8) for x in a)
    assert np.allclose(whole[2], parts[2], rtol=1e-10)


def test_count_vectors_and_topics_of_any_vocabulary(spark, monkeypatch):
    docs = texts(60)
    df = frame(spark, docs)
    monkeypatch.setattr(features, "VOCABULARY_LIMIT", 3)
    counted, vocabulary = features.count_vector_tables(df, "t")
    words = {r["place"]: r["term"] for r in vocabulary.collect()}
    every = [w for d in docs for w in d] + ["apple"]
    assert [words[i] for i in range(len(words))] == sorted(set(every), key=lambda w: (-every.count(w), w))
    found = {r["id"]: r["t"] for r in counted.collect()}
    assert found.keys() == {*range(60), -1, -2, None} and counted.columns == ["id", "t"]
    for i, d in enumerate(docs):
        assert {words[j]: n for j, n in zip(found[i].indices, found[i].values)} == {w: d.count(w) for w in d}
    assert found[-1].numNonzeros() == found[-2].numNonzeros() == 0 and found[-1].size == len(words)

    modelled, leading = features.lda(df, "t", 3, 12)
    shares = {r["id"]: r["t"].toArray() for r in modelled.collect()}
    assert shares.keys() == found.keys() and all(abs(shares[i].sum() - (1 if found[i].numNonzeros() else 0)) < 1e-9 for i in shares)
    assert sorted((r["topic"], r["rank"]) for r in leading.collect()) == [(t, r) for t in range(3) for r in range(3)]


def test_nothing_to_learn_from_and_clashing_names(spark):
    empty = topics.fit_topics(frame(spark, []), "id", "t")
    assert empty.bounds == [] and empty.terms.count() == 0 and empty.documents.count() == 0
    clash = spark.createDataFrame([(1, ["x", None, "y"], 5)], "term int, doc array<string>, a0 int")
    made = topics.fit_topics(clash, "term", "doc", 2, 1)
    assert {r["term"] for r in made.terms.collect()} == {"x", "y"} and made.documents.columns == ["term", "counts", "shares"]
    with pytest.raises(ValueError):
        topics.fit_topics(clash, "term", "doc", 0)
