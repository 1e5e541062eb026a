import os
import zlib

import numpy as np
import pytest

from weftgrid.llm import language

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = language.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int, held_out int")


def test_texts_without_letters_and_labels_without_text(spark):
    rows = [(i, "the house and the tree", "en", 1, 1) for i in range(9)] + [(i, "das haus und der baum", "de", 1, 1) for i in range(9)]
    rows += [(100, None, "en", 1, 1), (101, "12 -- 3", "de", 1, 1), (102, "", None, 1, 1), (None, "der baum", None, 1, 1), (103, "the " * 600_000, None, 1, 1)]
    got = {r["doc_id"]: r for r in language.identify_languages(frame(spark, rows)).collect()}
    assert [got[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3
    assert got[None]["lang_pred"] == "de" and got[103]["lang_pred"] == "en"


def test_one_language_none_and_empty(spark):
    one = language.identify_languages(frame(spark, [(0, "abc", "en", 1, 1), (3, "def", None, 1, 1)])).collect()
    assert {r["lang_pred"] for r in one} == {"en"}
    none = language.identify_languages(frame(spark, [(0, "abc", None, 1, 1)])).collect()
    assert none[0]["lang_pred"] == "und" and none[0]["score"] == 0
    assert language.identify_languages(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        language.train(frame(spark, [(0, "a", "x", 1, 1), (3, "b", "y", 1, 1)]), max_languages=1)


@pytest.mark.parametrize("n", [2, 3, 4, 6, 7, 20, 100])
def test_codewords_are_far_apart(n):
    code = language.codewords(n).astype(int)
    apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(apart) >= code.shape[1] / 5 and all(0 < (bit > 0).sum() < n for bit in code.T)


def test_one_wrong_bit_is_corrected():
    counts = np.random.default_rng(1).integers(1, 100, (4, language.BUCKETS))
    model = language.Codes.fit(list("abcd"), counts)
    model.margins = lambda text: np.tanh(2 * model.code[2] * np.array([-1, *[1] * (model.code.shape[1] - 1)]))
    assert model.decode("text")[0] == "c"
    model.margins = lambda text: np.zeros(model.code.shape[1])
    assert model.decode("text")[2]  # ambiguous


def test_slices_give_the_trigrams_of_the_whole(monkeypatch):
    text = "Some text, with ünïcode" * 20
    whole = np.concatenate(list(language.trigrams(text)))
    monkeypatch.setattr(language, "_SLICE", 7)
    assert (np.concatenate(list(language.trigrams(text))) == whole).all()
