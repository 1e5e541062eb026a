import random
import re

import pytest

from weftgrid.llm import decontamination
from weftgrid.llm.automaton import SuffixAutomaton


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(texts, items, window=13):
    windows = []
    for item, text in items:
        w = words_of(text)
        k = min(window, len(w))
        windows += [(item, tuple(w[i:i + k])) for i in range(len(w) - k + 1)] if w else []
    out = []
    for text in texts:
        w, hit, found = words_of(text), set(), set()
        for item, g in windows:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i:i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found.add("" if item is None else str(item))
        out.append((len(w), len(hit), sorted(found)))
    return out


def case(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c", "Ünder", "d1", "ñ", "e"]
    run = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(run(rng.randint(14, 40)))) for i in range(8)] + [(20, "a B c"), (21, "c-c, c!"), (22, ""), (23, None), (24, "..."), (25, "zz"), (3, "zz yy"), (None, "qq rr")]
    texts = [None, "", "...", "a", "A b\tC", "zz", "x zz yy qq rr"]
    for _ in range(60):
        t = run(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            piece = words_of(rng.choice(items[:8])[1])
            a = rng.randint(0, len(piece) - 10)
            t += piece[a:a + rng.randint(8, 30)] + ["stop"] * rng.randint(0, 2)
        texts.append(" ".join(t))
    return texts, items


@pytest.mark.parametrize("seed, block", [(1, 1 << 20), (2, 60), (3, 200)])
def test_hits_are_those_of_all_windows(spark, documents, seed, block):
    texts, items = case(seed)
    frame = spark.createDataFrame(items, "item_id int, text string")
    marked = decontamination.mark_contamination(documents(texts, extra=("hits", "_pass0")), frame, block_bytes=block)
    got = {r["doc_id"]: r for r in marked.select("doc_id", "hits", decontamination.hit_words(marked["hits"]).alias("n"),
                                                 decontamination.is_contaminated(marked["hits"]).alias("bad")).collect()}
    for i, (n, hit, found) in enumerate(brute(texts, items)):
        r = got[i]
        assert (r["hits"]["n_words"], r["n"], r["hits"]["items"]) == (n, hit, found), texts[i]
        assert r["bad"] == (hit > 0 and 20 * hit >= n)


def test_spans_are_cut_and_contaminated_documents_go(spark, documents):
    item = " ".join(f"w{i}" for i in range(20))
    clean = " ".join(f"k{i}" for i in range(600))
    frame = spark.createDataFrame([(1, item)], "item_id int, text string")
    docs = documents([None, clean, f"{clean} [{item}] {clean}", f"{item} end", ""])
    got = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs, frame).collect()}
    assert got == {0: None, 1: clean, 2: f"{clean} [] {clean}", 4: ""}


def test_one_worker_of_a_task_scans_and_cuts(spark, documents):
    frame = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "item_id int, text string")
    plan = decontamination.decontaminate(documents(["a b"]), frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_text_is_cut_by_the_spans_of_all_passes(spark, documents, block):
    items = [" ".join(f"{c}{i}" for i in range(20)) for c in "vw"]
    frame = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    texts = [None, "", f"a [{items[0]}] b {items[1]}, c", f"a {' '.join(items)} b", "no, hit"]
    marked = decontamination.mark_contamination(documents(texts), frame, block_bytes=block, cut=True)
    got = {r["doc_id"]: (r["hits"]["cut"], r["hits"]["items"]) for r in marked.select("doc_id", "hits").collect()}
    assert got == {0: (None, []), 1: (None, []), 2: ("a [] b , c", ["0", "1"]), 3: ("a  b", ["0", "1"]), 4: (None, [])}


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id int, text string")
    assert decontamination.decontaminate(documents(["a b"]), none).count() == 1
    assert decontamination.decontaminate(documents([]), none).count() == 0


def test_automaton_knows_every_run_and_no_other():
    rng = random.Random(5)
    items = [[rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(15)]
    automaton = SuffixAutomaton(items, 4)
    for _ in range(300):
        text = [rng.choice("abcd") for _ in range(12)]
        spans, hit = automaton.spans(text)
        want, found = set(), set()
        for number, item in enumerate(items):
            k = min(4, len(item))
            for i in range(len(item) - k + 1 if item else 0):
                for j in range(len(text) - k + 1):
                    if text[j:j + k] == item[i:i + k]:
                        want |= set(range(j, j + k))
                        found.add(number)
        assert {p for a, b in spans for p in range(a, b + 1)} == want and hit == found
        assert all(b + 1 < c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_repeated_benchmark_rows_count_once(spark, monkeypatch):
    found = []
    scanner = decontamination._scanner
    monkeypatch.setattr(decontamination, "_scanner", lambda s, items, window: found.append(items) or scanner(s, items, window))
    texts = ["one two three four five six", "seven eight nine ten eleven twelve"]
    items = spark.createDataFrame([("a", texts[0])] * 500 + [("b", texts[1]), (None, texts[1])], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"so {texts[0]} so"), (2, texts[1]), (3, "none")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["hits"]["items"] for r in decontamination.mark_contamination(docs, items, window=5, block_bytes=100).collect()}
    assert got == {1: ["a"], 2: ["", "b"], 3: []}
    assert sorted(i for block in found for i in block) == [("", texts[1]), ("a", texts[0]), ("b", texts[1])]
