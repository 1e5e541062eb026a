import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgrid.llm import importance

LABELS = "doc_id bigint, quality int, toxic int"


def corpus(n=600):
    """Good prose, symbol junk, repeated words and insults; every other document is labelled."""
    rng = random.Random(4)
    words = [a + b for a in ("ba", "de", "fi", "go", "lu", "mar", "ten", "son") for b in ("ra", "le", "ti", "po", "nu", "s", "n")]
    texts, labels = [], []
    for i in range(n):
        kind = ("good", "good", "good", "junk", "toxic", "again")[i % 6]
        w = [rng.choice(words) for _ in range(rng.randint(40, 120))]
        if kind == "junk":
            w = [x + rng.choice(("%%%", "$$$", "***")) for x in w]
        if kind == "toxic":
            w = [rng.choice(("horrid", "vile", "wretch")) if rng.random() < 0.15 else x for x in w]
        if kind == "again":
            w = [x for x in w[:8] for _ in range(12)]
        texts.append(" ".join(w))
        if (i // 6) % 2 == 0:
            labels.append((i, int(kind in ("good", "toxic")), int(kind == "toxic")))
    return texts, labels


def test_good_documents_stay_and_bad_ones_go(spark, documents):
    texts, labels = corpus()
    docs = documents([*texts, None, ""], extra=("_row", "kept"))
    out = importance.resample(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == len(texts) + 2
    kept = {r["doc_id"] for r in out if r["kept"]}
    good = [i for i in range(len(texts)) if i % 6 < 3]
    bad = [i for i in range(len(texts)) if i % 6 >= 3]
    assert sum(i in kept for i in good) >= 0.98 * len(good)
    assert sum(i in kept for i in bad) <= 0.05 * len(bad)
    assert all(r["log_weight"] == 0 for r in out if not r["text"])


def test_reruns_agree(spark, documents):
    texts, labels = corpus(120)
    docs, frame = documents(texts), spark.createDataFrame(labels, LABELS)
    first, second = ({tuple(r) for r in importance.resample(docs, frame, keep=["doc_id"]).collect()} for _ in range(2))
    assert first == second


@pytest.mark.parametrize("labels", [[], [(0, 1, 0)], [(0, 0, 0), (1, 0, 1)], [(None, 1, 0), (1, None, 0)]])
def test_without_both_kinds_of_labels_all_stay(spark, documents, labels):
    out = importance.resample(documents(["a b", "c", None]), spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == 3 and all(r["kept"] for r in out)


def test_empty_frame(spark, documents):
    assert importance.resample(documents([]), spark.createDataFrame([(1, 1, 0)], LABELS)).count() == 0


def test_conflicting_labels_are_not_good(spark, documents):
    texts, labels = corpus(120)
    doubled = labels + [(i, 0, 0) for i, q, t in labels if q and not t]
    out = importance.resample(documents(texts), spark.createDataFrame(doubled, LABELS)).collect()
    assert all(r["kept"] for r in out)  # nothing is good, so nothing can be told apart


@pytest.mark.parametrize("k", [1, 7, 500, 999])
def test_kth_largest_with_ties(spark, k):
    values = [float(v) for v in np.random.default_rng(k).integers(0, 9, 1000) ** 5]
    frame = spark.createDataFrame(list(zip(values, range(1000))), "v double, r bigint").withColumn("r", F.col("r"))
    want = sorted(zip(values, range(1000)), key=lambda x: (-x[0], x[1]))[k - 1]
    assert importance.kth_largest(frame, "v", "r", k, at_once=30) == want


def test_cut():
    weights, good = np.array([-5.0, -4, 0, 1, 2]), np.array([False, False, True, True, True])
    assert importance.best_cut(weights, good) == -2
    assert importance.best_cut(weights, np.ones(5, bool)) == float("-inf")


def test_features_count_once_and_fit_the_tables():
    assert importance.features(None).shape == (2, 0) and importance.features(" \n").shape == (2, 0)
    one, many = importance.features("ab cd"), importance.features("ab cd " * 50)
    assert one.shape[1] < many.shape[1] < one.shape[1] + 15
    assert many[0].max() < importance.BUCKETS <= many[1].min() and many[1].max() < 2 * importance.BUCKETS


def test_the_draw_depends_on_id_and_text_only(spark, documents, rows):
    docs = documents([(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(20 + i % 30)) + (" spam spam" if i % 3 else " fine prose"), "s") for i in range(300)])
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(0, 300, 2)], "doc_id bigint, quality int, toxic int")
    one = rows(importance.resample(docs.repartition(7, "text"), labels).select("doc_id", "kept"))
    assert one == rows(importance.resample(docs.orderBy("text").coalesce(1), labels).select("doc_id", "kept"))
    assert {k for _, k in one} == {True, False}
