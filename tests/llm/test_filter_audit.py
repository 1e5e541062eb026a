import random
import re
from itertools import permutations

import numpy as np
import pytest

from weftgrid.llm import filter_audit as audit

LABELS = "doc_id bigint, quality int, toxic int"


def brute(docs, labels):
    """Runs all 120 orders over lists of documents."""
    fails = []
    for i, (doc_id, text, _) in enumerate(docs):
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails.append({
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": doc_id is not None and any((o or "") == t and d is not None and d < doc_id for d, o, _ in docs)})
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    out, shapley = {}, {}
    for part in {s or "" for _, _, s in docs}:
        rows = [i for i, d in enumerate(docs) if (d[2] or "") == part]
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [i for i in left if fails[i][f]]
                earlier = [i for i in rows if i not in left and fails[i][f]]
                left = [i for i in left if not fails[i][f]]
                lone = [i for i in rows if [x for x in "ABCDE" if fails[i][x]] == [f]]
                out[part, "".join(order), step] = (
                    len(left), len(gone), len(earlier), len(lone), sum(docs[i][0] in good for i in gone), sum(docs[i][0] in toxic for i in gone))
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def corpus():
    rng = random.Random(5)
    words = ["ab", "Cd", "E", "x#", "é", "same", "日本", "the"] + [f"w{i}" for i in range(300)]
    found = [(1, None, None), (2, "", ""), (3, " \n\t", "s0"), (None, "", "s1"), (2, "", "s1"), (9, "$", None), (9, "$", None)]
    for i in range(120):
        n = rng.choice([3, 150, 199, 200, 201, 400])
        few = rng.random() < .4
        found.append((rng.randrange(80), " ".join(rng.choice(words[:60] if few else words[5:]) for _ in range(n)), rng.choice(["s0", "s1", None])))
    return found + [(100 + i, "copied text " * 120, "s0") for i in range(40)] + [(500, "plain " + "\n".join(f"w{i}" for i in range(199)), "z")]


@pytest.mark.parametrize("labels", [
    [], [(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (100, 1, 1), (101, 1, 0), (101, 1, 0), (10 ** 9, 1, 1)] + [(i, i % 2, i % 3 % 2) for i in range(20, 60)]])
def test_same_numbers_as_running_every_order(spark, documents, labels):
    docs = corpus()
    frame = documents(docs, extra=("digest", "label", "counts", "all", "first", "step", "part", "at"))
    got = audit.audit_filters(frame, spark.createDataFrame(labels, LABELS).selectExpr("*", "1 AS good", "2 AS part")).collect()
    assert len(got) == 4 * 600 == len({(r["part"], r["filter_order"], r["step"]) for r in got})
    want = brute(docs, labels)
    for r in got:
        assert tuple(r[3:]) == want[r["part"], r["filter_order"], r["step"]], r


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 100, 1000, (1 << 18) + 5])
def test_popcounts_by_carry_save_adders(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    assert audit.positional_popcount(words).tolist() == [int((words >> np.uint32(b) & np.uint32(1)).sum()) for b in range(32)]


def test_survival_words():
    assert audit.survival_word(0) == (1 << 32) - 1
    assert audit.survival_word(31) == 1
    assert audit.survival_word(1) == sum(1 << s for s in range(0, 32, 2))


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], LABELS)
    assert audit.audit_filters(documents([]), none).count() == 0
    got = audit.audit_filters(documents([(1, "a", "s")]), none).where("step = 1 AND filter_order = 'ABCDE'").collect()
    assert [tuple(r) for r in got] == [("s", "ABCDE", 1, 0, 1, 0, 1, 0, 0, 120)]


def test_a_very_long_text(documents, spark):
    text = "word other " * 2_000_000
    got = audit.document_failures(documents([(1, text, "s")]), spark.createDataFrame([], LABELS)).collect()
    assert [r["failures"] for r in got] == [2]
