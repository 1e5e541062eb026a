import math
import random
from collections import Counter

import numpy as np

from weftgrid.operators import vectors


def texts(n=150, seed=4):
    rng = random.Random(seed)
    left, right = "abcdefgh", "stuvwxyz"
    return [[rng.choice(left if i % 2 else right) for _ in range(rng.randint(0, 20))] for i in range(n)] + [["a", "s", "once"]]


def frame(spark, docs):
    return spark.createDataFrame([(i, d) for i, d in enumerate(docs)] + [(-1, None)], "k int, t array<string>")


def matrix(docs, window, least):
    n = Counter()
    for d in docs:
        for i in range(len(d)):
            for j in range(i + 1, min(i + window, len(d) - 1) + 1):
                n[d[i], d[j]] += 1
                n[d[j], d[i]] += 1
    c = Counter()
    for (a, _), x in n.items():
        c[a] += x
    n = {p: x for p, x in n.items() if c[p[0]] >= least and c[p[1]] >= least}
    c = Counter()
    for (a, _), x in n.items():
        c[a] += x
    total = sum(c.values())
    return {p: math.log(x * total / (c[p[0]] * c[p[1]])) for p, x in n.items() if x * total > c[p[0]] * c[p[1]]}


def test_associations_equal_brute_force(spark):
    docs = texts()
    expected = matrix(docs, 3, 10)
    got = {(r["term"], r["context"]): r["weight"] for r in vectors.word_associations(frame(spark, docs).repartition(3), "t", 3, 10).collect()}
    assert got.keys() == expected.keys() and all(abs(got[p] - expected[p]) < 1e-9 for p in got)
    assert not any("once" in p for p in got)


def test_vectors_equal_dense_factorisation(spark):
    docs = texts()
    cells = matrix(docs, 3, 10)
    words = sorted({a for a, _ in cells})
    dense = np.zeros((len(words), len(words)))
    for (a, b), w in cells.items():
        dense[words.index(a), words.index(b)] = w
    values, basis = np.linalg.eigh(dense)
    best = np.argsort(-values)[:4]
    expected = basis[:, best] * values[best] @ basis[:, best].T
    for parts in (1, 6):
        made = {r["term"]: r["vector"] for r in vectors.word_vectors(frame(spark, docs).repartition(parts), "t", 4, 3, 10, rounds=4).collect()}
        assert sorted(made) == words and all(len(v) == 4 for v in made.values())
        got = np.array([made[w] for w in words])
        # Vectors are fixed up to a turn; their products are not.
        assert np.abs(got @ got.T - expected).max() < 0.05 * np.abs(expected).max()
    near = lambda a, b: made[a] @ np.array(made[b]) / np.linalg.norm(made[a]) / np.linalg.norm(made[b])
    made = {w: np.array(v) for w, v in made.items()}
    assert min(near("a", x) for x in "bcdefgh") > max(near("a", x) for x in "stuvwxyz")


def test_vectors_of_many_blocks(spark, monkeypatch):
    """The matrix in many blocks of pairs counted in many pieces gives the same vectors; of the thin tables only the last one stays."""
    from weftgrid.session import written_folders
    docs = [*texts(), ["a", None, "b"], None, [], ["rare"]]
    df = spark.createDataFrame([(d,) for d in docs], "t array<string>").repartition(4)
    whole = {r["term"]: r["vector"] for r in vectors.word_vectors(df, "t", 4, 3, 10).collect()}
    monkeypatch.setattr(vectors, "BLOCK_CELLS", 200)
    monkeypatch.setattr(vectors, "CHUNK", 50)
    before = len(written_folders(spark))
    cut = vectors.word_vectors(df, "t", 4, 3, 10)
    made = written_folders(spark)[before:]
    assert len([f for f in made if "/thin-" in f]) == 1 and not [f for f in made if "/associations-" in f]
    assert spark.read.parquet(*[f for f in made if "/pair-blocks-" in f]).count() > 5
    cut = {r["term"]: r["vector"] for r in cut.collect()}
    assert cut.keys() == whole.keys() and all(np.allclose(cut[w], whole[w], atol=1e-8) for w in whole)


def test_nothing_to_learn_from(spark):
    assert vectors.word_vectors(frame(spark, []), "t").count() == 0
    assert vectors.word_vectors(frame(spark, [["one"], ["two"]]), "t").count() == 0


def test_pairs_are_counted_in_one_direction_before_the_shuffle(spark):
    docs = [["b", "a", "a", "b"], ["a", None, "c"]]
    pairs = vectors.word_pairs(spark.createDataFrame([(d,) for d in docs], "t array<string>"), "t", 1)
    got = {(r["term"], r["context"]): r["n"] for r in pairs.where("term IS NOT NULL AND context IS NOT NULL").collect()}
    assert got == {("a", "b"): 2, ("b", "a"): 2, ("a", "a"): 2}
    assert pairs._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
