import pytest
from pyspark.sql import functions as F

from weftgrid.llm import mixing


def test_targets_are_shared_again_until_none_is_above():
    assert mixing.share_targets([100, 100, 100], [3, 1, 2]) == [200, 250 / 3, 500 / 3]
    for sizes in ([1000, 3, 5], [0, 0, 0], [7], [0, 10, 1, 500, 2, 2]):
        got = mixing.share_targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))])
        assert sum(got) == pytest.approx(1.5 * sum(sizes)) and all(t <= 2 * s for t, s in zip(got, sizes))
        open_ = [t / (3, 1, 2)[i % 3] for i, (t, s) in enumerate(zip(got, sizes)) if t < 2 * s]
        assert max(open_, default=0) == pytest.approx(min(open_, default=0))


def corpus():
    rows = [(None, None, "a"), (1, "", None), (2, "x " * 9000, "b")]
    for i in range(900):
        rows.append((i % 700, "w " * (i % 90), ("a", "b", "ç", None, "z")[i % 5 if i % 3 else 0]))
    return rows + [(5, "same words here", "a")] * 200


def test_sources_come_near_their_targets(documents, rows):
    docs = documents(corpus(), extra=("size", "taken", "_key"))
    out = mixing.taken_words(docs, block_words=32)
    assert rows(out.select("doc_id", "text", "_key")) == rows(docs.select("doc_id", "text", "_key"))
    assert out.where("taken > 2 * size OR taken < 0").count() == 0
    sums = out.groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t"), F.sum("size").alias("s"), F.first("source_size").alias("z"))
    for r in sums.collect():
        assert abs(r["n"] - r["t"]) < 32 * 8 and r["s"] == r["z"]
    again = mixing.taken_words(docs, block_words=32)
    assert rows(out.select("doc_id", "size", "taken")) == rows(again.select("doc_id", "size", "taken"))


def test_every_prefix_of_the_schedule_is_near_the_weights(documents):
    held, mixed = mixing.mix_plan(documents(corpus()), block_words=32)
    targets = {r["source_no"]: r["target"] for r in held.select("source_no", "target").distinct().collect()}
    slots = mixed.join(held.select("mix_row", "source_no"), "mix_row").select("slot", "source_no").distinct().collect()
    everything = sum(targets.values())
    for upto in (100, 300, 700):
        n = {}
        for r in slots:
            if r["slot"] < upto:
                n[r["source_no"]] = n.get(r["source_no"], 0) + 1
        for no, t in targets.items():
            assert abs(n.get(no, 0) - upto * t / everything) < 6


def test_documents_of_the_mix(documents):
    docs = documents(corpus())
    held, mixed = mixing.mix_plan(docs, block_words=32)
    out = mixing.mix_documents(docs, block_words=32)
    assert out.columns == docs.columns
    count = F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))
    assert out.agg(count).first()[0] == mixed.agg(F.sum("n")).first()[0]
    assert out.where("text IS NULL OR text = ''").count() == 0


def test_empty_frame_and_one_source(documents):
    assert mixing.taken_words(documents([])).count() == 0
    only = mixing.taken_words(documents([(1, "a b c", None)] * 4), block_words=2).collect()
    assert sum(r["taken"] for r in only) == 18
    with pytest.raises(ValueError):
        mixing.taken_words(documents([(1, "a", "x"), (2, "b", "y")]), max_sources=1)


def test_filled_sources_reach_their_targets_and_small_ones_stay(documents, rows):
    found = [(2, "x " * 9000, "big"), (3, "y " * 5000, "wide")] + [(10 + i, "w " * (1 + 5 * i), f"site{i}") for i in range(40)]
    docs = documents(found)
    out = mixing.taken_words(docs, fill=True)
    assert out.where("taken > 2 * size").count() == 0
    sums = out.groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect()
    assert len(sums) == 42 and all(0 <= r["n"] - r["t"] < 1 for r in sums)
    mix = mixing.mix_documents(docs, fill=True)
    count = F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))
    assert mix.select("source").distinct().count() == 42
    assert {r[0]: r[1] for r in mix.groupBy("source").agg(count).collect()} == {r["source"]: r["n"] for r in sums}
    held, mixed = mixing.mix_plan(docs, fill=True)
    assert mixed.groupBy("slot").agg(F.sum("n").alias("n")).where("n > 128").count() == 0


def test_the_pipeline_loses_no_small_source(spark, documents):
    import corpus_pipeline

    docs = documents([(2, "x " * 9000, "big")] + [(10 + i, "w " * 20, f"site{i}") for i in range(40)])
    assert corpus_pipeline.mix(spark, docs, "").select("source").distinct().count() == 41


def test_sources_in_a_table_have_the_same_plan(documents, rows):
    docs = documents(corpus())
    for fill in (False, True):
        plans = [mixing.taken_words(docs, block_words=32, fill=fill, driver_sources=n) for n in (10_000, 1)]
        one, two = (rows(p.select("doc_id", "source", "size", "source_no", "source_size", F.round("target", 6))) for p in plans)
        assert one == two
        one, two = (rows(p.groupBy("source").agg(F.sum("taken"))) for p in plans)
        assert one == two
    schedules = [rows(mixing.mix_plan(docs, block_words=32, driver_sources=n)[1].select("slot", "n")) for n in (10_000, 1)]
    assert schedules[0] == schedules[1]


def test_more_sources_than_the_driver_shares(spark):
    docs = spark.range(10_050).selectExpr(
        "id AS doc_id", "repeat('w ', cast(1 + id % 40 AS int)) AS text", "concat('site', id) AS source")
    out = mixing.taken_words(docs, fill=True)
    assert out.count() == 10_050
    assert out.where("taken NOT BETWEEN target - 0.001 AND target + 1").count() == 0
    n, all_ = out.agg(F.sum("target"), F.sum("size")).first()
    assert n == pytest.approx(1.5 * all_)


def test_a_tiny_source_beside_a_large_one(documents):
    docs = documents([(1, "x " * 10_000, "a"), (2, "y " * 50, "b"), (3, "z " * 20, "c")])
    got = {r["source"]: (r["target"], r["taken"]) for r in mixing.taken_words(docs, fill=True).collect()}
    assert got == {"a": (14965, 14965), "b": (100, 100), "c": (40, 40)}


def test_own_columns_of_documents_stay(documents, rows):
    names = ("known", "size", "source_no", "source_size", "target", "mix_row", "_known", "_key", "_taken", "slot", "block", "epoch", "cell", "n", "taken", "text_aside", "size_aside")
    docs = documents([(i, "a b c " * (1 + i % 7), f"s{i % 4}") for i in range(60)], extra=names)
    docs = docs.withColumns({name: F.lit(100 + i) for i, name in enumerate(names)})
    mix = mixing.mix_documents(docs, fill=True, block_words=8)
    assert mix.columns == docs.columns
    assert rows(mix.select(*names).distinct()) == [tuple(range(100, 100 + len(names)))]
    plain = mixing.mix_documents(docs.drop(*names), fill=True, block_words=8)
    assert rows(mix.drop(*names)) == rows(plain)


def test_no_python_worker_brings_the_sources(documents):
    held, _ = mixing.mix_plan(documents(corpus()))
    assert "ExistingRDD" not in held._jdf.queryExecution().executedPlan().toString()
