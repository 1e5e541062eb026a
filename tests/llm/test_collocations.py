import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from weftgrid.llm import collocations as col

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def brute(rows, support=30, first=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    found = {}
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= support}
    for (lang, w), a in candidates.items():
        cuts = [(2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        covered = any(
            other == lang and len(v) > len(w) and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1)) and 100 * b >= 80 * a
            for (other, v), b in candidates.items())
        if not covered:
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(
        (lang, i, p.decode(), -a, le, r, n[lang], -s)
        for lang, v in found.items() for i, (s, a, p, le, r) in enumerate(sorted(v)[:first], 1))


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["New", "york", "é", "日本", "of", "the", "x.y", "a\xa0b", "q#", "ﬀ"] + [f"w{i}" for i in range(12)]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!", " ? ", "\x0b"]
    rows = [(None, None), ("en", ""), ("en", " \n. "), ("de", "only once here"), ("", "New York of the " * 40), (None, "New York, new york! " * 20)]
    for i in range(400):
        draw = lambda: words[min(int(rng.expovariate(.3)), len(words) - 1)] + rng.choice(ends)
        rows.append((rng.choice(["en", "en", "en", "fr", "de", None]), "".join(draw() for _ in range(rng.randint(1, 200)))))
    return rows + [("en", "the same passage, in every copy of it")] * 45


def frame(spark, rows, parts):
    schema = "lang string, text string, phrase int, n int, a int, shard int"
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], schema).repartition(parts) if rows else spark.createDataFrame([], schema)


@pytest.mark.parametrize("parts", [1, 7, 12])
def test_same_as_counting_everything(spark, parts):
    rows = corpus(parts)
    want = brute(rows)
    assert len(want) > 100 and {w[0] for w in want} >= {"en", "fr", "", "und"}
    assert sorted(map(tuple, col.collocations(frame(spark, rows, parts)).collect())) == want


def test_first_rows_and_other_limits(spark):
    rows = corpus(3)
    got = col.collocations(frame(spark, rows, 3), support=12, first=25)
    assert sorted(map(tuple, got.collect())) == brute(rows, 12, 25)


def test_empty(spark):
    assert col.collocations(frame(spark, [], 1)).count() == 0
    assert col.collocations(frame(spark, [(None, None), ("en", "")], 1)).count() == 0
    assert col.collocations(frame(spark, [("en", "a b")] * 29, 2)).count() == 0
    assert [tuple(r) for r in col.collocations(frame(spark, [("en", "a b")] * 30, 2)).collect()] == [("en", 1, "a b", 30, 30, 30, 60, 1000000)]


def test_a_text_over_many_slices_and_chunks():
    rng = random.Random(2)
    text = "".join(rng.choice(["ab", "Cd", "é", "longer-word"]) + rng.choice([" ", " ", ".", "\t"]) for _ in range(3000))
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "fr", "en"], "text": [text, "x y z", None]})
    flat = [w for part in col.split_words(text.encode(), 50) for w in part]
    assert flat == text.encode().translate(col._TABLE).replace(b"\xff", b" \xff ").split()
    want = {k: Counter(tuple(w[i:i + k]) for w in pieces(text) for i in range(len(w) - k + 1)) for k in (1, 2, 3, 4)}
    for limit in (5, 97, 1000, 10 ** 9):
        found = {k: Counter() for k in (1, 2, 3, 4)}
        for chunk in col.chunks(iter([batch]), limit):
            if chunk.lang == "en":
                names, ids = [w.decode("latin-1") if w == b"\xff" else w.decode() for w in chunk.number], chunk.ids()
                found[1].update((names[i],) for i in ids[chunk.old:] if i)
                for k, (at, _) in col._runs(chunk, None, None).items():
                    found[k].update(tuple(names[ids[i + j]] for j in range(k)) for i in at)
        assert found == want, limit


def test_no_member_is_missed_by_a_full_filter(spark):
    hashes = np.random.default_rng(4).integers(0, 1 << 63, 5000) * 2 - (1 << 62)
    members = spark.createDataFrame([(int(h),) for h in hashes], "hash bigint")
    for most in (1 << 15, 1 << 29):
        held = col.Filter(col.build_filter(members, most))
        assert held(hashes.astype(np.int64).view(np.uint64)).all()
    others = np.random.default_rng(5).integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert held(others).mean() < .05
    empty = col.Filter(col.build_filter(members.where("hash IS NULL")))
    assert not empty(others).any()


def test_mining_leaves_few_candidates(spark, monkeypatch):
    """What the shards find holds every frequent phrase and little else."""
    rows = corpus(9)
    phrases, _ = col.frequent_phrases(frame(spark, rows, 8), 30)
    counts = Counter()
    for lang, text in rows:
        for w in pieces(text):
            for k in range(1, 5):
                counts.update(("und" if lang is None else lang, " ".join(w[i:i + k])) for i in range(len(w) - k + 1))
    assert {(r["lang"], r["phrase"]): r["a"] for r in phrases.collect()} == {p: a for p, a in counts.items() if a >= 30}
