from weftgrid.operators import sentences as sent

PLAIN = ["we met dr. Smith today. The road was long.", "Ask dr. Smith. It is late! Go home now.",
         "the road is here. it was late", "dr. Jones left. The home was long. dr. The road"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, t string")


def corpus(spark):
    filler = [f"the road is here and it was late so go home now or today word{i} was here long and late. The road is it" for i in range(40)]
    return frame(spark, PLAIN + filler + [None, "", "  ", "no stop at all", "Hello.  ", "See dr. "])


def test_abbreviation_is_found(spark):
    found = {r["word"] for r in sent.abbreviations(corpus(spark), "t").collect()}
    assert "dr" in found and not found & {"here", "today", "late", "the"}


def test_sentences(spark):
    out = {}
    for r in sent.learned_sentences(corpus(spark), "k", "t").collect():
        out.setdefault(r["k"], {})[r["pos"]] = r["sentence"]
    assert out[0] == {0: "we met dr. Smith today.", 1: "The road was long."}
    assert out[1] == {0: "Ask dr. Smith.", 1: "It is late!", 2: "Go home now."}
    assert out[2] == {0: "the road is here.", 1: "it was late"}
    assert out[3] == {0: "dr. Jones left.", 1: "The home was long.", 2: "dr.", 3: "The road"}
    n = len(PLAIN) + 40
    assert n not in out and n + 1 not in out and out[n + 3] == {0: "no stop at all"}
    assert out[n + 4] == {0: "Hello."} and out[n + 5] == {0: "See dr."}


def test_white_space_inside_a_sentence_stays(spark):
    extra = corpus(spark).union(frame(spark, ["Ask dr.\n  Smith now."]).selectExpr("k + 1000", "t"))
    assert [r["sentence"] for r in sent.learned_sentences(extra, "k", "t").where("k = 1000").collect()] == ["Ask dr.\n  Smith now."]


def test_all_words_with_stops_and_empty_frames(spark):
    only = frame(spark, ["a. b. a.", "b."])
    scores = {r["word"]: r["score"] for r in sent.abbreviation_scores(sent.word_evidence(only, "t")).collect()}
    assert set(scores) == {"a", "b"} and all(s == 0 for s in scores.values())
    assert sent.learned_sentences(frame(spark, []), "k", "t").count() == 0
    assert sent.learned_sentences(frame(spark, [None]), "k", "t").count() == 0


def test_only_words_that_follow_an_abbreviation_are_joined(spark):
    from weftgrid.session import written_folders
    texts = ["He met dr. Smith and dr. Jones today."] * 30 + ["It ends with dr. The cat sat. The dog sat with the cat.", "One more. Cats and cats."]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    made = sorted((r["id"], r["pos"], r["sentence"]) for r in sent.learned_sentences(df, "id", "t").collect() if r["id"] >= 30)
    assert made == [(30, 0, "It ends with dr."), (30, 1, "The cat sat."), (30, 2, "The dog sat with the cat."),
                    (31, 0, "One more."), (31, 1, "Cats and cats.")]
    folder = [f for f in written_folders(spark) if "/starters-" in f][-1]
    assert [r["next"] for r in spark.read.parquet(folder).collect()] == ["the"]
