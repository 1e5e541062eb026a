import itertools
import random

import numpy as np
import pytest

from weftgrid.operators import tagger


def test_viterbi_equals_trying_all_paths():
    rng = np.random.default_rng(3)
    tags = 5
    moves = rng.integers(-3, 4, (tags, tags)) + tagger._allowed_moves(tags)
    lengths = np.array([1, 4, 3, 5])
    scores = rng.integers(-4, 5, (4, 5, tags)).astype(float)
    paths = tagger._viterbi(scores, lengths, moves)
    for s, n, path in zip(scores, lengths, paths):
        def value(p):
            start = tagger._NEVER if p[0] in (2, 4) else 0
            return start + sum(s[i, t] for i, t in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))
        assert value(list(path[:n])) == max(value(p) for p in itertools.product(range(tags), repeat=int(n)))
        assert not path[n:].any()


def test_open_tags():
    may = tagger._open_tags(["The", "New", "York", "sun", "Bob"], [("new york", 1)], 5)
    assert [list(np.flatnonzero(m)) for m in may] == [[0], [3], [4], [0], [0, 1, 2, 3, 4]]


def made(rng, people, towns, n):
    """Sentences where people speak and towns are visited; with the right labels."""
    out = []
    for _ in range(n):
        p, t = rng.choice(people), rng.choice(towns)
        out.append((rng.choice([f"then {p} said it.", f"and {p} spoke of {t} today.", f"we went to {t} at night."]), p, t))
    return out


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(5)
    name = lambda: "".join(rng.choice("abcdefghij") for _ in range(5)).title()
    people, towns = [f"{name()} {name()}" for _ in range(60)], [name() for _ in range(60)]
    texts = [(i, s) for i, (s, _, _) in enumerate(made(rng, people, towns, 900))]
    gazetteer = [(p, "person") for p in people[:40]] + [(t, "town") for t in towns[:40]] + [(None, "town"), ("Nobody", None)]
    held = {p: "person" for p in people[40:]} | {t: "town" for t in towns[40:]}
    docs = spark.createDataFrame([*texts, (9001, None), (9002, "")], "k int, t string")
    return docs, spark.createDataFrame(gazetteer, "name string, label string"), held


def test_names_the_learner_never_saw(spark, world):
    docs, gazetteer, held = world
    model = tagger.train_tagger(docs.repartition(3), "k", "t", gazetteer)
    found = [r for r in tagger.tag_entities(docs, "k", "t", model).collect() if r["mention"] in held]
    expected = sum(s.count(name) for _, s in docs.where("t IS NOT NULL").collect() for name in held)
    assert len(found) >= 0.95 * expected
    assert sum(held[r["mention"]] == r["label"] for r in found) >= 0.95 * expected


def test_same_model_for_any_partitioning(spark, world):
    docs, gazetteer, _ = world
    one = tagger.train_tagger(docs.coalesce(1), "k", "t", gazetteer, rounds=2)
    many = tagger.train_tagger(docs.unionByName(docs).repartition(7), "k", "t", gazetteer, rounds=2)
    assert one.labels == many.labels and (one.weights == many.weights).all() and (one.moves == many.moves).all()


def test_empty_frames_and_long_sentences(spark, world):
    docs, gazetteer, _ = world
    model = tagger.train_tagger(docs.limit(0), "k", "t", gazetteer, rounds=1)
    assert tagger.tag_entities(docs, "k", "t", model).count() == 0
    model = tagger.train_tagger(docs, "k", "t", gazetteer, rounds=2)
    long = spark.createDataFrame([("x", "we went to Abcde at night " * 3000)], "id string, t string")
    assert tagger.tag_entities(long, "id", "t", model).where("mention = 'Abcde'").count() == 3000
    with pytest.raises(ValueError):
        tagger.train_tagger(docs, "k", "t", spark.range(60).selectExpr("'a' AS name", "CAST(id AS string) AS label"))


def test_training_sentences_are_drawn_by_hash_without_shuffling_texts(spark, world):
    docs, gazetteer, _ = world
    docs = docs.unionByName(docs).repartition(4)
    rows = tagger.training_sentences(docs, "k", "t", gazetteer, 100)
    found = rows.collect()
    names = {r["name"].lower(): r["label"] for r in gazetteer.where("label IS NOT NULL AND name IS NOT NULL").collect()}
    drawn = sorted((r["h"], r["t"]) for r in docs.where("t != ''").selectExpr("xxhash64(t) AS h", "t").distinct().collect()
                   if any(n in r["t"].lower() for n in names))[:100]
    assert sorted((r["draw"], r["sentence"]) for r in found) == drawn
    assert all({(n["name"], n["label"]) for n in r["names"]} == {(n, v) for n, v in names.items() if n in r["sentence"].lower()} for r in found)
    assert "hashpartitioning(k#" not in rows._jdf.queryExecution().executedPlan().toString()
