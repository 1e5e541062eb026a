import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftgrid.llm import components, simhash


def brute_print(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows, radius=3):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=repr)


def grouped(df):
    return df.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"), "component_id")


def texts(seed):
    rng = random.Random(seed)
    words = ["Alpha", "béta", "gamma", "delta x", "e", "zeta!", "eta", "theta"]
    base = [[rng.choice(words) + str(rng.randint(0, 40)) for _ in range(rng.randint(150, 300))] for _ in range(6)]
    out = [None, "", " \t\n", "one", "one two", "ONE TWO", "one  two", "x " * 3000]
    for b in base:
        for _ in range(12):
            copy = list(b)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = "changed"
            out.append(" ".join(copy))
    return out + out[8:14] * 4


def test_groups_are_those_of_all_pairs(spark, documents, rows):
    found = [(i if i % 7 else None, t) for i, t in enumerate(texts(1))]
    docs = documents([(d, t, "s") for d, t in found], extra=("fingerprint", "first", "_row"))
    groups = simhash.near_groups(docs)
    assert rows(grouped(groups)) == brute_groups(found)
    assert "_row" in groups.columns
    prints = groups.groupBy("component_id").agg(F.sum(F.col("first").cast("int")).alias("n"))
    # Components without any doc_id share a NULL id but have a first row each.
    assert all(r["n"] == 1 for r in prints.where("component_id IS NOT NULL").collect())


def test_empty_frame(documents):
    assert simhash.near_groups(documents([])).count() == 0


@pytest.mark.parametrize("tile", [1, 3, 1024])
def test_links_join_what_all_pairs_join(spark, tile):
    rng = np.random.default_rng(tile)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = {int(s) for s in seeds} | {0, 1, 7, 15, (1 << 64) - 1}
    for s in seeds:
        for _ in range(6):
            s = int(s) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))
            prints.add(s)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fingerprint bigint")
    stars = {r["node"]: r["root"] for r in components.components(simhash.near_links(frame, 3, tile)).collect()}
    values = np.array(signed)
    i, j = simhash.near(values, values, 3)
    root = {v: v for v in signed}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for a, b in zip(values[i].tolist(), values[j].tolist()):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert {v: stars.get(v, v) for v in signed} == {v: find(v) for v in signed}


def test_steps_cover_all_cells_in_reach():
    steps = set(simhash.neighbour_steps(3))
    assert 0 in steps and len(steps) == 65  # 129 moves, one of each pair, and none
    assert all(-s not in steps for s in steps - {0})


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000)], "a bigint, b bigint")
    found = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert found == {i: 0 for i in range(1, 301)}


def test_own_columns_of_documents_stay(documents, rows):
    names = ("head", "_head", "root", "best", "node", "_row", "cell", "tile", "known")
    docs = documents([(i, f"some words of text {i // 2}", "s") for i in range(12)], extra=names)
    docs = docs.withColumns({name: F.lit(100 + i) for i, name in enumerate(names)})
    got = simhash.near_groups(docs)
    assert rows(got.select(*names).distinct()) == [tuple(range(100, 100 + len(names)))]
    assert rows(got.select("doc_id", "component_id")) == rows(simhash.near_groups(docs.drop(*names)).select("doc_id", "component_id"))
