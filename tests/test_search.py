import math
import random
from collections import Counter

import pytest

from weftgrid.operators import search


def corpus(n=400, seed=7):
    rng = random.Random(seed)
    words = ["de", "la", "le", "x", "y", "z", "rare"]
    docs = {i * 3: [words[min(int(rng.expovariate(.9)), 6)] for _ in range(rng.randint(0, 60))] for i in range(n)}
    docs[3000] = ["de"] * 500 + ["rare"] * 40
    return docs


@pytest.fixture(scope="module")
def index(spark):
    docs = [*corpus().items(), (None, ["de"]), (99999, None)]
    df = spark.createDataFrame(docs, "k bigint, t array<string>").repartition(5)
    return search.position_index(df, "k", "t", 32).cache()


def test_blocks(index):
    docs = corpus()
    seen = Counter()
    for r in index.collect():
        place = 0
        for step in r["places"]:
            place += step
            doc = r["block"] * 32 + (place >> 32)
            assert docs[doc][place & 0xFFFFFFFF] == r["term"]
            seen[doc, r["term"]] += 1
        assert r["docs"] == sorted(r["docs"]) and r["top"] == max(r["tfs"]) and max(r["docs"]) < 32
        for d, tf in zip(r["docs"], r["tfs"]):
            assert docs[r["block"] * 32 + d].count(r["term"]) == tf
    assert sum(seen.values()) == sum(map(len, docs.values()))


@pytest.mark.parametrize("phrase", [["de", "la"], ["de", "de"], ["de", "de", "de"], ["la", "de", "la", "x"], ["rare"], ["none"], ["de", "none"], ["z", "rare"]])
def test_phrases_are_counted_like_in_the_tokens(index, phrase):
    want = {}
    for doc, tokens in corpus().items():
        n = sum(tokens[i:i + len(phrase)] == phrase for i in range(len(tokens) - len(phrase) + 1))
        if n:
            want[doc] = n
    assert {r["doc"]: r["n"] for r in search.phrase_search(index, phrase, 32).collect()} == want


@pytest.mark.parametrize("terms,n", [(["rare"], 1), (["rare"], 5), (["rare", "z"], 10), (["de", "la", "rare", "none"], 3), (["none"], 3), (["y", "z"], 1000)])
def test_ranked_like_scoring_everything(index, terms, n):
    docs = {k: v for k, v in corpus().items()}
    df = {t: sum(t in v for v in docs.values()) for t in terms}
    total = len(docs)
    scores = {}
    for doc, tokens in docs.items():
        if any(t in tokens for t in terms):
            scores[doc] = sum(tokens.count(t) * math.log((total + 1) / (df[t] + 1)) for t in set(terms) if df[t])
    want = sorted(scores.items(), key=lambda s: (-round(s[1], 9), s[0]))[:n]
    got = search.ranked_search(index, terms, total, n, 32, first_blocks=2).collect()
    assert [(r["doc"], pytest.approx(r["score"])) for r in got] == [(d, s) for d, s in want]
    if (terms, n) == (["rare"], 1):  # one document has it forty times
        assert got[0]["blocks_read"] < got[0]["blocks"]


def test_empty(spark):
    none = search.position_index(spark.createDataFrame([], "k bigint, t array<string>"), "k", "t")
    assert none.count() == 0 and search.phrase_search(none, ["a"]).count() == 0 and search.ranked_search(none, ["a"], 0).count() == 0
    with pytest.raises(ValueError):
        search.phrase_search(none, [])


def test_documents_are_shuffled_before_their_tokens_become_rows(spark):
    df = spark.createDataFrame([(i, ["a", "b", "a"]) for i in range(6)] + [(None, ["a"]), (7, None)], "k int, t array<string>")
    index = search.position_index(df, "k", "t", 4)
    assert sorted((r["term"], r["block"], r["docs"], r["tfs"]) for r in index.collect()) == [
        ("a", 0, [0, 1, 2, 3], [2] * 4), ("a", 1, [0, 1], [2] * 2), ("b", 0, [0, 1, 2, 3], [1] * 4), ("b", 1, [0, 1], [1] * 2)]
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block" in plan and "hashpartitioning(term" not in plan
    assert plan.index("Generate posexplode") < plan.index("hashpartitioning(block")
