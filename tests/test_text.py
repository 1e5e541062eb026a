import math
from collections import Counter

import pytest
from pyspark.ml.feature import IDF, CountVectorizer, RegexTokenizer, StopWordsRemover, StringIndexer
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from weftgrid.functions.stemming import stem, stem_tokens, stem_word
from weftgrid.functions.stopwords import ENGLISH
from weftgrid.operators import features, text

# Published sample vocabulary of the algorithm.
STEMS = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist
consistency consist consistent consist consistently consist consisting consist consists consist consolation consol
consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid
consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson
consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu
conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir
constable constabl constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead
kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt
knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit
knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker
knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
""".split()


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["The running dogs, and 3 cats: the DOG ran!", "über naïve Café x_1 don't", "", None,
             "relational databases relate relations", "dogs dogs dogs cats"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").persist()


def test_stems(spark):
    words, expected = STEMS[::2], STEMS[1::2]
    assert [stem_word(w) for w in words] == expected
    df = spark.createDataFrame(list(zip(words, expected)), "w string, e string")
    assert df.where(stem(F.col("w")) != F.col("e")).count() == 0


def test_stems_of_short_and_special_words():
    for word in ("", "a", "is", "y", "sky", "news"):
        assert stem_word(word) == word
    assert stem_word("skies") == "sky" and stem_word("dying") == "die" and stem_word("innings") == "inning"


def test_stem_arrays_keep_order_and_nulls(spark):
    df = spark.createDataFrame([(1, ["flies", "running", "flies"]), (2, []), (3, None)], "i int, t array<string>").repartition(2)
    found = {r["i"]: r["s"] for r in df.select("i", stem_tokens(F.col("t")).alias("s")).collect()}
    assert found == {1: ["fli", "run", "fli"], 2: [], 3: None}


def test_stop_words_are_sparks(spark):
    assert sorted(ENGLISH) == sorted(StopWordsRemover.loadDefaultStopWords("english"))


def test_tokens_equal_the_ml_transformers(spark, docs):
    filled = docs.na.fill("")
    expected = RegexTokenizer(inputCol="text", outputCol="t", pattern=r"\w+", gaps=False).transform(filled)
    expected = StopWordsRemover(inputCol="t", outputCol="s").transform(expected)
    found = text.remove_stop_words(text.tokenize(docs.withColumn("s", F.col("text")), "s"), "s")
    tokens = text.tokenize(docs, "text")
    assert {r["doc_id"]: r["text"] for r in tokens.collect()} == {r["doc_id"]: r["t"] for r in expected.collect()}
    assert {r["doc_id"]: r["s"] for r in found.collect()} == {r["doc_id"]: r["s"] for r in expected.collect()}


def test_unicode_tokens(docs):
    assert text.tokenize(docs, "text", unicode=True).where("doc_id = 1").first()["text"] == ["über", "naïve", "café", "x_1", "don", "t"]
    assert text.tokenize(docs, "text").where("doc_id = 1").first()["text"][0] == "ber"


def test_preprocess(docs):
    found = {r["doc_id"]: r["text"] for r in text.preprocess(docs, "text").collect()}
    assert found[0] == ["run", "dog", "cat", "dog", "ran"]
    assert found[2] == found[3] == []
    assert found[4] == ["relat", "databas", "relat", "relat"]


def test_weights_equal_the_ml_vectors(spark, docs):
    tokens = text.preprocess(docs, "text").persist()
    counter = CountVectorizer(inputCol="text", outputCol="c").fit(tokens)
    weighted = IDF(inputCol="c", outputCol="w").fit(counter.transform(tokens)).transform(counter.transform(tokens))
    expected = {(r["doc_id"], counter.vocabulary[i]): v for r in weighted.collect() for i, v in zip(r["w"].indices, r["w"].values)}
    found = {(r["doc_id"], r["term"]): r["weight"] for r in features.tfidf(tokens, "doc_id", "text").collect()}
    assert found.keys() == expected.keys()
    assert all(math.isclose(found[k], expected[k], abs_tol=1e-12) for k in found)


def test_counts_are_computed_once(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "docs"))
    weighted = features.tfidf(text.preprocess(spark.read.parquet(str(tmp_path / "docs")), "text"), "doc_id", "text")
    weighted.collect()
    assert "ReusedExchange" in weighted._jdf.queryExecution().executedPlan().toString()


def test_wide_weights(docs):
    wide = features.tfidf_wide(docs, "text", 2)
    assert wide.columns == ["doc_id", "text", "term_dog", "term_relat"]
    assert {r["doc_id"]: r["term_relat"] for r in wide.collect()}[4] == 3 * math.log(7 / 2)
    with pytest.raises(ValueError):
        features.tfidf_wide(docs, "text", features.WIDE_LIMIT + 1)


def test_token_columns_are_taken_as_they_are(docs):
    tokens = text.preprocess(docs, "text")
    wide = features.tfidf_wide(tokens, "text", 2)
    assert wide.columns == ["doc_id", "text", "term_dog", "term_relat"]
    assert wide.select("term_dog").collect() == features.tfidf_wide(docs, "text", 2).select("term_dog").collect()
    vectors, vocabulary = features.tfidf_vectors(tokens, "text")
    _, same = features.tfidf_vectors(docs, "text")
    assert set(vocabulary) == set(same) and vectors.first()["text"].size == len(vocabulary)


def test_wide_weights_fill_an_existing_column(docs):
    taken = docs.withColumn("term_dog", F.when(F.col("doc_id") == 0, F.lit(9.0)))
    found = {r["doc_id"]: r["term_dog"] for r in features.tfidf_wide(taken, "text", 1).collect()}
    assert found[0] == 9.0 and found[5] == 3 * math.log(7 / 3) and found[1] == 0.0


def test_labels_equal_the_indexer(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "c", "b", "a", "d"]], "v string")
    expected = StringIndexer(inputCol="v", outputCol="v_label").fit(df).transform(df)
    assert {tuple(r) for r in features.label(df, "v").collect()} == {tuple(r) for r in expected.collect()}


def test_null_has_no_label(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "v string, n int")
    found = features.label(df, "v")
    assert found.columns == ["v", "n", "v_label"]
    assert {tuple(r) for r in found.collect()} == {("a", 1, 0.0), (None, 2, None)}


def test_labels_of_many_values(spark, monkeypatch):
    from weftgrid.operators import ranking
    df = spark.range(500).selectExpr("id % 97 AS v")
    expected = {tuple(r) for r in features.label(df, "v").collect()}
    monkeypatch.setattr(ranking.global_rank, "__defaults__", (10,))
    assert {tuple(r) for r in features.label(df, "v").collect()} == expected


def test_join_with_the_dictionary_splits_a_frequent_value(spark, forced_skew):
    """Labels join the data with one row per value: a value in a third of the rows is split."""
    rows = spark.range(0, 30000, 1, 8).selectExpr(
        "id", "if(id % 3 = 0, 0, id) AS v", "concat(md5(string(id)), md5(string(-id))) AS pad")
    labelled = features.label(rows, "v").where("v_label >= 0")
    found = labelled.collect()
    assert len(found) == 30000
    assert sum(r["v_label"] == 0.0 for r in found) == 10000
    assert "skew=true" in labelled._jdf.queryExecution().executedPlan().toString()


def test_word_vectors(docs):
    tokens = text.preprocess(docs, "text")
    vectors = features.word2vec(tokens, "text")
    assert all(len(r["text"]) == 2 for r in vectors.collect())


def test_word_vectors_check_the_vocabulary(docs, monkeypatch):
    monkeypatch.setattr(features, "WORD2VEC_VOCABULARY", 3)
    with pytest.raises(ValueError):
        features.word2vec(text.preprocess(docs, "text"), "text")


def test_word_vectors_of_many_words_leave_the_driver(spark, monkeypatch):
    """Beyond the driver's limit nothing is fitted there; words that keep the same company have near vectors."""
    import random

    import numpy as np
    from weftgrid.operators import skipgram

    def fitted_on_the_driver(**_):
        raise AssertionError("fitted on the driver")
    monkeypatch.setattr(features, "VOCABULARY_LIMIT", 3)
    monkeypatch.setattr(features, "Word2Vec", fitted_on_the_driver)
    monkeypatch.setattr(skipgram, "SHARD_TOKENS", 25_000)
    rng = random.Random(3)
    texts = [[rng.choice("abcdefgh" if i % 2 else "stuvwxyz") for _ in range(30)] for i in range(3000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3000 + i, [w]) for i, w in enumerate("abcdefghstuvwxyz")] + [(4000, []), (4001, None), (4002, ["once"])]
    df = spark.createDataFrame(rows, "k int, t array<string>").repartition(5)
    made = features.word2vec(df, "t", size=4, min_count=2)
    assert made.columns == ["k", "t"] and made.count() == len(rows)
    found = {r["k"]: np.array(r["t"]) for r in made.collect()}
    assert all(len(v) == 4 and np.isfinite(v).all() for v in found.values())
    assert not found[4000].any() and not found[4001].any() and not found[4002].any()
    words = np.stack([found[3000 + i] for i in range(16)])
    words = words / np.linalg.norm(words, axis=1)[:, None]
    near = words @ words.T
    assert near[:8, :8].min() > near[:8, 8:].max() and near[8:, 8:].min() > near[:8, 8:].max()
    texts_mean = np.mean([found[3000 + "abcdefghstuvwxyz".index(w)] for w in texts[0]], axis=0)
    assert np.allclose(found[0], texts_mean)


def test_word_vectors_of_many_words_make_the_tokens_once(spark, monkeypatch):
    monkeypatch.setattr(features, "VOCABULARY_LIMIT", 3)
    made = spark.sparkContext.accumulator(0)

    def tokens(t):
        made.add(1)
        return t.split(" ")
    rows = [(i, f"a{i % 5} b{i % 3} c") for i in range(40)]
    df = spark.createDataFrame(rows, "k int, t string").repartition(3).withColumn("t", F.udf(tokens, "array<string>")("t"))
    found = features.word2vec(df, "t", size=3)
    assert all(len(r["t"]) == 3 for r in found.collect()) and found.count() == 40
    assert made.value == 40


def test_a_training_step_calms_frequent_words():
    import numpy as np
    from weftgrid.operators import skipgram
    rng = np.random.default_rng(5)
    vectors, outer, met = rng.random((9, 3)) - 0.5, rng.random((9, 3)) - 0.5, np.zeros(9, dtype=np.int64)
    words, targets = rng.integers(0, 9, 200), rng.integers(0, 9, (200, 4))
    moves = np.zeros((2, 9, 3))
    for w, ts in zip(words, targets):
        for k, t in enumerate(ts):
            g = -0.1 * (1 / (1 + np.exp(-vectors[w] @ outer[t])) - (k == 0))
            moves[0, w] += g * outer[t]
            moves[1, t] += g * vectors[w]
    calm = [np.minimum(1, skipgram.CALM / np.maximum(np.bincount(x.ravel(), minlength=9), 1))[:, None] for x in (words, targets)]
    expected = vectors + moves[0] * calm[0], outer + moves[1] * calm[1]
    skipgram._descend(vectors, outer, words, targets, 0.1, met)
    assert np.allclose(vectors, expected[0]) and np.allclose(outer, expected[1]) and not met.any()


def test_topics(spark, docs):
    columns = features.topic_columns(docs, "text", k=2, iterations=3)
    topics = [c for c in columns.columns if c.startswith("topic__")]
    assert columns.columns[:2] == ["doc_id", "text"] and len(topics) == 2
    for r in columns.where("doc_id in (0, 4, 5)").collect():
        assert math.isclose(sum(r[t] for t in topics), 1.0, rel_tol=1e-6)
    _, terms = features.lda(docs, "text", k=2, iterations=3)
    assert Counter(r["topic"] for r in terms.collect()) == {0: 3, 1: 3}


def test_sentences_and_mentions(spark):
    df = spark.createDataFrame([(1, "Ada Lovelace met Babbage. They liked London!  Really? yes")], "i int, t string")
    assert text.segment_sentences(df, "t").first()["t"] == [
        "Ada Lovelace met Babbage.", "They liked London!", "Really?", "yes"]
    names = spark.createDataFrame([("ada lovelace", "PERSON"), ("London", "PLACE"), ("LONDON", "CITY")], "name string, label string")
    found = [tuple(r) for r in text.entity_mentions(df, "i", "t", names).orderBy("sentence", "position").collect()]
    assert found == [(1, 0, 0, "Ada Lovelace", "PERSON"), (1, 0, 1, "Babbage", None), (1, 1, 0, "They", None),
                     (1, 1, 1, "London", "CITY"), (1, 2, 0, "Really", None)]


def test_html(spark):
    page = "<p>A &amp; B</p><!-- no --><script>var x;</script>\n<b\nclass='x'>C</b>"
    df = spark.createDataFrame([(page,)], "html string")
    assert text.html_to_text(df, "html").first()[0] == "A  Bvar x;\nC"


def test_word_count_output(spark, tmp_path):
    from weftgrid.sources import sinks
    lines = spark.createDataFrame([("bonjour ah ah",), ("",), ("alors ah alors",), ("bonjour cool cool",)], "value string")
    counted = {r["word"]: r["count"] for r in text.word_count(lines).collect()}
    assert counted == {"ah": 3, "alors": 2, "bonjour": 2, "cool": 2, "": 1}
    assert [tuple(r) for r in text.top_words(lines, k=2).collect()] == [("ah", 3), ("alors", 2)]
    path = sinks.write_word_counts(text.word_count(lines), str(tmp_path / "counts"))
    assert "(ah, 3)" in [r[0] for r in spark.read.text(path).collect()]


def test_wide_tfidf_and_topics_keep_own_columns(spark):
    from weftgrid.operators.features import tfidf_wide, topic_columns

    rows = [(f"apple pear number{i} plum", 1, 2, 3) for i in range(8)]
    df = spark.createDataFrame(rows, "text string, _tokens int, _known int, _topics int")
    for out in (tfidf_wide(df, "text", 3), topic_columns(df, "text", 2)):
        assert out.columns[:4] == df.columns
        assert {tuple(r) for r in out.select("_tokens", "_known", "_topics").collect()} == {(1, 2, 3)}


def murmur3(data, seed=42):
    """MurmurHash3 (x86, 32 bits) of bytes, by its published definition."""
    mask = (1 << 32) - 1
    turn = lambda x, r: (x << r | x >> (32 - r)) & mask
    mix = lambda k: turn(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    h, whole = seed, len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = (turn(h ^ mix(int.from_bytes(data[i:i + 4], "little")), 13) * 5 + 0xE6546B64) & mask
    if data[whole:]:
        h ^= mix(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def test_hashed_counts_fall_into_the_buckets_of_the_hash(spark):
    tokens = [["grid", "of", "weft", "grid", "größe"], ["a", "bb", "ccc", "dddd", "eeeee"] * 3, []]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "id int, t array<string>")
    hashed = features.hashing_tf(df, "t", 16).select("id", features.vector_entries("t").alias("e"))
    got = {r["id"]: {e["place"]: e["value"] for e in r["e"]} for r in hashed.collect()}
    assert got == {i: dict(Counter(murmur3(w.encode()) % 16 for w in t)) for i, t in enumerate(tokens)}


def test_entries_of_sparse_and_dense_vectors(spark):
    df = spark.createDataFrame([(1, Vectors.sparse(5, [1, 4], [2.0, 0.0])), (2, Vectors.dense(0.0, 3.0, -1.0)), (3, None)], ["id", "v"])
    got = {r["id"]: r["e"] and [tuple(e) for e in r["e"]] for r in df.select("id", features.vector_entries("v").alias("e")).collect()}
    assert got == {1: [(1, 2.0)], 2: [(1, 3.0), (2, -1.0)], 3: None}
