from pyspark.sql import functions as F
import random

import pytest

from weftgrid.llm import site_spread


def brute(rows, least):
    sites = {}
    for _, text, source in rows:
        for line in (text or "").split("\n"):
            if line.strip(" \t\x0b\x0c\r"):
                sites.setdefault(line, set()).add(source)
    out = []
    for doc, text, _ in rows:
        lines = (text or "").split("\n")
        worded = [x for x in lines if x.strip(" \t\x0b\x0c\r")]
        gone = [x for x in worded if len(sites[x]) >= least]
        kept = None if text is None else "\n".join(x for x in lines if x not in gone or x not in worded)
        out.append((doc, len(worded), len(gone), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [1, 3, 10, 40])
def test_removes_lines_of_many_sites(documents, rows, least):
    rng = random.Random(least)
    found = [(1, None, "a"), (2, "", "a"), (3, "\n \n", None), (None, "common\nown", None), (4, "common", None)]
    for i in range(300):
        lines = [rng.choice(["common", f"line {rng.randint(0, 60)}", f"only {i}", "", " ", "common "]) for _ in range(rng.randint(0, 6))]
        found.append((i % 250, "\n".join(lines), rng.choice([None, "", *(f"s{k}" for k in range(60))])))
    found += [found[10]] * 30
    out = site_spread.remove_boilerplate(documents(found, extra=("n_lines", "h1", "t1")), min_sites=least)
    assert rows(out.select("doc_id", "n_lines", "n_removed", "clean_text")) == brute(found, least)


def test_many_sites_are_sketched(spark):
    """Far from the threshold the sketch decides, near it the exact count does."""
    rows = [(i, f"far\nnear" if i < 1000 else "far", f"s{i}") for i in range(3000)] + [(i, "low", f"s{i}") for i in range(999)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    removed = {r["text"]: r["n_removed"] for r in site_spread.remove_boilerplate(docs, min_sites=1000).collect()}
    assert removed == {"far\nnear": 2, "far": 1, "low": 0}


def test_empty_frame_and_no_python(documents):
    out = site_spread.remove_boilerplate(documents([]))
    assert out.count() == 0 and "Python" not in out._jdf.queryExecution().toString()


def test_own_columns_of_documents_stay(documents, rows):
    names = ("t1", "t2", "_t1", "_text", "_hits", "_line", "h1", "key", "site")
    docs = documents([(i, f"All rights reserved\nown line {i}", f"s{i}") for i in range(12)], extra=names)
    docs = docs.withColumns({name: F.lit(100 + i) for i, name in enumerate(names)})
    got = site_spread.remove_boilerplate(docs)
    assert rows(got.select(*names).distinct()) == [tuple(range(100, 100 + len(names)))]
    assert rows(got.select("doc_id", "clean_text", "n_removed")) == sorted(((i, f"own line {i}", 1) for i in range(12)), key=repr)
