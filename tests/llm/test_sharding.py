import numpy as np
from pyspark.sql import functions as F

from weftgrid.llm import sharding


def test_every_row_once_in_shards_of_equal_size(documents, rows):
    texts = [None, "", "same", "x" * 5000] + ["same"] * 500 + [f"t{i}" for i in range(700)]
    docs = documents([(None if i % 5 == 0 else i, t, "s") for i, t in enumerate(texts)], extra=("shard", "_row", "_block"))
    out = sharding.shuffle_to_shards(docs, 40)
    assert rows(out.select("doc_id", "text", "_row", "_block")) == rows(docs.select("doc_id", "text", "_row", "_block"))
    sizes = out.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.count_distinct("slot").alias("d"))
    found = sizes.collect()
    assert sorted(r["shard"] for r in found) == list(range(40))
    assert {r["n"] for r in found} <= {len(texts) // 40, len(texts) // 40 + 1}
    assert all(r["low"] == 0 and r["high"] == r["n"] - 1 and r["d"] == r["n"] for r in found)


def test_fewer_rows_than_shards_and_no_rows(documents):
    assert sorted(r["slot"] for r in sharding.shuffle_to_shards(documents(["a", "b", None]), 40).collect()) == [0, 0, 0]
    assert sharding.shuffle_to_shards(documents([]), 4).count() == 0


def test_matrix_has_the_given_margins():
    sizes = [5, 0, 1000, 37, 3]
    matrix = sharding.communication_matrix(sizes, 7, 3)
    assert matrix.sum(1).tolist() == sizes
    assert sorted(set(matrix.sum(0))) == [149, 150] and matrix.min() >= 0


def test_draws_follow_the_hypergeometric_law():
    rng = np.random.default_rng(1)
    got = np.array([sharding.hypergeometric(30, 70, 20, rng) for _ in range(20000)])
    want = np.random.default_rng(2).hypergeometric(30, 70, 20, 20000)
    assert abs(got.mean() - 6) < 0.06 and abs(got.var() - want.var()) < 0.15
    for k in range(3, 10):
        assert abs((got == k).mean() - (want == k).mean()) < 0.015
    large = [sharding.hypergeometric(10**12, 39 * 10**12, 10**7, rng) for _ in range(50)]
    assert abs(np.mean(large) - 250_000) < 500
    assert sharding.hypergeometric(5, 0, 3, rng) == 3 and sharding.hypergeometric(0, 5, 3, rng) == 0


def test_places_are_uniform(spark):
    out = sharding.shuffle_to_shards(spark.range(4000), 8).collect()
    low = sum(r["shard"] < 4 for r in out if r["id"] < 2000)
    assert abs(low - 1000) < 120
    assert abs(np.corrcoef([r["id"] for r in out], [r["slot"] for r in out])[0, 1]) < 0.06
