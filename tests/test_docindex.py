import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgrid.operators import docindex


def test_vector_cosine(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [0, 0, 9, 1])], "a array<int>, b array<int>")
    cosine = docindex.vector_cosine(F.col("a"), F.col("b"))
    assert df.select(docindex.truncate2(cosine)).first()[0] == 0.62


def test_indexes(spark, rows):
    df = spark.createDataFrame([("d1", "B a b"), ("d2", "a\n c  b"), ("d3", None)], "doc string, t string")
    assert {r["doc"]: r["words"] for r in docindex.forward_index(df, "doc", "t").collect()}["d1"] == ["B", "a", "b"]
    index = docindex.inverted_index(df, "doc", "t")
    assert rows(index) == sorted([("b", "d1"), ("a", "d1"), ("a", "d2"), ("c", "d2"), ("", "d2"), ("b", "d2"), ("", "d3")], key=repr)


def test_folded_words_are_stripped(spark):
    texts = ["a\n b", "\n\ta\tb \n ", " \n", "", "X\n", "\r\nX Y\x0b", "a \n\n b", "\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    expected = [[w.strip(" \t\n\x0b\f\r").lower() for w in t.split(" ")] for t in texts]
    assert [r[0] for r in df.select(docindex.words_of(F.col("t"))).collect()] == expected


def test_rows_of_one_key_share_their_postings(spark, rows):
    df = spark.createDataFrame([("d", "a b"), ("d", "a c")], "doc string, t string")
    assert rows(docindex.inverted_index(df, "doc", "t")) == [("a", "d"), ("b", "d"), ("c", "d")]
    assert rows(docindex.binary_vectors(df, "doc", "t")) == [("d", "a", 1), ("d", "b", 1), ("d", "c", 1)]


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_posting_blocks_split_frequent_words(spark, kind):
    df = spark.range(500).selectExpr(f"cast(id AS {kind}) AS doc", "if(id % 2 = 0, 'hot even', 'hot') AS t")
    index = docindex.inverted_index(df, "doc", "t")
    blocks = docindex.posting_blocks(index, "doc", 50)
    found = blocks.collect()
    assert sum(r["size"] for r in found if r["word"] == "hot") == 500
    assert sum(r["word"] == "hot" for r in found) == (10 if kind == "bigint" else len({r["block"] for r in found}))
    assert max(r["size"] for r in found) <= (50 if kind == "bigint" else 100)
    assert all(r["docs"] == sorted(r["docs"]) for r in found)


def corpus(seed):
    """Random word sets with frequent words, near copies and a third of exact copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    docs = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(40)], k=rng.randint(1, 14))) for _ in range(30)]
    docs += [" ".join([*d.split(), rng.choice(words)]) for d in docs[:15]]
    docs += [docs[3]] * 20 + [" ".join(reversed(docs[4].split())) + " " + docs[4].upper()] * 3
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
@pytest.mark.parametrize("seed", [1, 2])
def test_similar_documents_against_brute_force(spark, seed, threshold):
    docs = corpus(seed)
    groups = {}
    for i, d in enumerate(docs):
        groups.setdefault(frozenset(w.strip().lower() for w in d.split(" ")), []).append(i)
    heads = sorted((min(ids), len(ids), words) for words, ids in groups.items())
    expected = set()
    for a, (doc1, copies1, words1) in enumerate(heads):
        for doc2, copies2, words2 in heads[a + 1:]:
            similarity = len(words1 & words2) / math.sqrt(len(words1) * len(words2))
            if similarity >= threshold:
                expected.add((doc1, doc2, copies1, copies2, int(similarity * 100) / 100))
    df = spark.createDataFrame(list(enumerate(docs)), "id int, t string").repartition(4)
    assert {tuple(r) for r in docindex.similar_documents(df, "id", "t", threshold).collect()} == expected
    copies = {(r["id"], r["doc"]) for r in docindex.copy_groups(df, "id", "t").collect()}
    assert copies == {(i, min(ids)) for ids in groups.values() for i in ids}


def test_similarity_needs_a_threshold(spark):
    df = spark.createDataFrame([(1, "a")], "id int, t string")
    for bad in (0, 1.1):
        with pytest.raises(ValueError):
            docindex.similar_documents(df, "id", "t", bad)


def test_similarity_matrix(spark, monkeypatch):
    df = spark.createDataFrame([("doc1", "a b c d"), ("doc2", "A e"), ("doc3", "z e")], "doc string, t string")
    matrix = {r["doc"]: r.asDict() for r in docindex.similarity_matrix(df, "doc", "t").collect()}
    assert matrix["doc1"]["doc2"] == matrix["doc2"]["doc1"] == 0.35
    assert matrix["doc1"]["doc3"] == 0.0 and matrix["doc2"]["doc3"] == 0.5 and matrix["doc3"]["doc3"] == 1.0
    with pytest.raises(ValueError):
        docindex.similarity_matrix(df, "doc", "t", limit=2)


def test_term_search(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["b"]), (3, ["c"]), (4, [])], "id int, t array<string>")
    found = {r["id"]: (r["hits"], r["score"]) for r in docindex.term_search(df, "id", "t", ["a", "b", "zz"]).collect()}
    assert found[2] == (1, math.log(5 / 3))
    assert found[1][0] == 2 and math.isclose(found[1][1], 2 * math.log(5 / 2) + math.log(5 / 3))
    assert set(found) == {1, 2}


def test_similarity_tiles_equal_brute_force(spark):
    import math
    import random
    rng = random.Random(2)
    docs = {f"d{i}": [rng.choice("abcdefghijklmno") * rng.randint(1, 2) for _ in range(rng.randint(0, 9))] for i in range(23)}
    rows = [(k, " ".join(w)) for k, w in docs.items()] + [("d3", "extra words"), ("nul", None), (None, "a b")]
    sets = {k: set(w) or {""} for k, w in docs.items()} | {"nul": {""}}
    sets["d3"] |= {"extra", "words"}
    frame = spark.createDataFrame(rows, "k string, t string").repartition(3)
    expected = {}
    for a in sets:
        for b in sets:
            s = math.floor(len(sets[a] & sets[b]) / math.sqrt(len(sets[a]) * len(sets[b])) * 100) / 100
            if s > 0:
                expected[a, b] = s
    for tile, words in ((5, 7), (256, 500_000)):
        tiles = docindex.similarity_tiles(frame, "k", "t", tile, words)
        assert {(r["doc1"], r["doc2"]): r["similarity"] for r in docindex.tile_cells(tiles).collect()} == expected
        assert all(len(r["cells"]) == len(r["docs1"]) * len(r["docs2"]) for r in tiles.collect())
    assert docindex.similarity_tiles(frame.limit(0), "k", "t").count() == 0


def test_similarity_tiles_of_many_strips_write_no_counts(spark, monkeypatch):
    import random
    from weftgrid.session import written_folders
    monkeypatch.setattr(docindex, "STRIP", 6)
    monkeypatch.setattr(docindex, "_DENSE", 3)
    monkeypatch.setattr(docindex, "_COLUMNS", 2)
    monkeypatch.setattr(docindex, "_PAIRS", 5)
    rng = random.Random(4)
    sets = {f"d{i:02d}": {"the"} | {rng.choice("abcdefghijkl") * rng.randint(1, 2) for _ in range(rng.randint(1, 9))} for i in range(32)}
    frame = spark.createDataFrame([(k, " ".join(w)) for k, w in sets.items()], "k string, t string").repartition(3)
    expected = {(a, b): math.floor(len(sets[a] & sets[b]) / math.sqrt(len(sets[a]) * len(sets[b])) * 100) / 100 for a in sets for b in sets}
    before = len(written_folders(spark))
    tiles = docindex.similarity_tiles(frame, "k", "t", 3, 11)
    assert {(r["doc1"], r["doc2"]): r["similarity"] for r in docindex.tile_cells(tiles).collect()} == expected
    assert tiles.count() == 11 * 11
    assert not [f for f in written_folders(spark)[before:] if "/tiles-" in f]


def test_similar_documents_of_many_strips_shuffle_no_shared_words(spark, monkeypatch):
    import random
    import re
    monkeypatch.setattr(docindex, "STRIP", 5)
    monkeypatch.setattr(docindex, "TILE_WORDS", 20)
    rng = random.Random(6)
    sets = [frozenset(rng.sample([f"w{j}" for j in range(25)], rng.randint(1, 20))) for _ in range(60)]
    sets += [s | {"more"} for s in sets[:30]]
    frame = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(sets)], "k long, t string").repartition(3)
    heads = {s: i for i, s in reversed(list(enumerate(sets)))}
    for least in (0.6, 0.8, 1.0):
        expected = {}
        for a, i in heads.items():
            for b, j in heads.items():
                x = len(a & b) / math.sqrt(len(a) * len(b))
                if i < j and x >= least:
                    expected[i, j] = math.floor(x * 100) / 100
        found = docindex.similar_documents(frame, "k", "t", least)
        assert {(r["doc1"], r["doc2"]): r["similarity"] for r in found.collect()} == expected
        assert not re.search(r"hashpartitioning\(doc1#\d+L?, doc2#", found._jdf.queryExecution().executedPlan().toString())
    assert docindex.similar_documents(frame.limit(0), "k", "t", 0.8).count() == 0


def test_strips_that_meet_are_read_and_not_copied(spark, monkeypatch):
    """Documents are written once as strips: what follows shuffles nothing, however many strips meet."""
    monkeypatch.setattr(docindex, "STRIP", 4)
    frame = spark.createDataFrame([(i, f"the w{i % 7} v{i % 3}") for i in range(30)], "k long, t string").repartition(3)
    plans = []
    count = docindex._count_strips

    def planned(met, *rest):
        plans.append(met._jdf.queryExecution().executedPlan().toString())
        return count(met, *rest)
    monkeypatch.setattr(docindex, "_count_strips", planned)
    assert docindex.similar_documents(frame, "k", "t", 0.5).count() > 0 and len(plans) > 0
    assert docindex.similarity_tiles(frame, "k", "t", 2, 11).count() == 15 * 15
    for plan in plans:
        assert "Exchange" not in plan.replace("BroadcastExchange", "")
    assert not any("CartesianProduct" in plan for plan in plans[:-1])


def test_copies_are_counted_over_tasks_and_strips(spark, monkeypatch):
    """Copies in many tasks are one set of its least key; sets without a key are left out; words that hash alike are told apart."""
    monkeypatch.setattr(docindex, "STRIP", 3)
    monkeypatch.setattr(docindex, "_word_hashes", lambda words: np.array([ord(w[:1] or " ") % 2 for w in words.to_pylist()], dtype=np.uint64))
    texts = [f"a b c x{i}" for i in range(6)]
    rows = [(6 * j + i, texts[i]) for j in range(9) for i in range(6)] + [(None, "a b c x9"), (90, "d e f g"), (91, None)]
    frame = spark.createDataFrame(rows, "k long, t string").repartition(5)
    found = sorted(tuple(r) for r in docindex.similar_documents(frame, "k", "t", 0.7).collect())
    assert found == [(i, j, 9, 9, 0.75) for i in range(6) for j in range(i + 1, 6)]


def test_posting_blocks_are_gathered_after_one_shuffle_by_block(spark):
    df = spark.range(50).selectExpr("id AS doc", "concat('hot w', id % 5) AS t")
    index = docindex.inverted_index(df, "doc", "t", unique_key=True)
    blocks = docindex.posting_blocks(index.unionByName(index), "doc", 10)
    assert {(r["word"], r["block"]): r["docs"] for r in blocks.collect() if r["word"] == "hot"} == {
        ("hot", b): list(range(10 * b, 10 * b + 10)) for b in range(5)}
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block" in plan and "hashpartitioning(word" not in plan
