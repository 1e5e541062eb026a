import os

import pytest
from test_decontamination import brute as brute_hits
from test_simhash import brute_groups

import corpus_pipeline

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Documents before the first stage and after each."""
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_of_documents(stages):
    for before, after in zip(stages, stages[1:-1]):
        assert after.schema == before.schema
    assert all((stages[k].where("n_chars <> length(text)").count() == 0) for k in range(5))


def test_quality_drops_rejected_documents(spark, stages):
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    before, after = texts(stages[0]), texts(stages[1])
    assert after.items() <= before.items()
    good = [i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(i in after for i in good) >= 0.97 * len(good)


def test_one_document_of_each_group_stays(stages):
    before, after = texts(stages[1]), texts(stages[2])
    assert set(after) == {c for _, _, c in brute_groups(list(before.items()))}


def test_contaminated_documents_go_and_passages_are_cut(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    before, after = texts(stages[2]), texts(stages[3])
    judged = dict(zip(before, brute_hits(before.values(), items)))
    assert set(after) == {i for i, (n, hit, _) in judged.items() if not (hit and 20 * hit >= n)}
    assert all((after[i] == before[i]) == (judged[i][1] == 0) for i in after)


def test_mix_takes_documents_up_to_twice(stages):
    before, after = texts(stages[3]), stages[4].collect()
    counts = {}
    for r in after:
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
        assert before[r["doc_id"]] == r["text"] or " ".join(before[r["doc_id"]].split()).startswith(r["text"])
    assert set(counts.values()) <= {1, 2}
    words = lambda t: len(t.split())
    total = sum(map(words, before.values()))
    assert abs(sum(words(r["text"]) for r in after) - 1.5 * total) < 0.02 * total


def test_all_documents_of_the_mix_are_packed(stages):
    packed = [d for r in stages[5].select("doc_ids", "starts").collect() for d, s in zip(r["doc_ids"], r["starts"]) if s == 0]
    assert sorted(packed) == sorted(r["doc_id"] for r in stages[4].select("doc_id").collect())


def test_run_is_the_chain_of_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF_DIR).columns == stages[5].columns


def test_own_columns_of_documents_stay(spark):
    """Names that the stages use inside are names like others in documents."""
    from pyspark.sql import functions as F

    names = ("head", "known", "kept", "first", "fingerprint", "component_id", "log_weight", "size", "target", "taken", "hits", "_row", "_hits", "_good", "cell", "n", "label", "best", "root")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumns({n: F.lit(100 + i) for i, n in enumerate(names)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns
        assert [tuple(r) for r in out.select(*names).distinct().collect()] == [tuple(range(100, 100 + len(names)))]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() > 0
