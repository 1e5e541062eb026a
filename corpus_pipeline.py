"""Training corpus from raw documents: quality, near-duplicates, benchmark passages, mixture, packed token ids.

Each stage takes the documents that the one before it kept.  All but the last return the columns of documents, with
``n_chars`` following a changed text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgrid.llm import decontamination, importance, mixing, packing, simhash
from weftgrid.llm.common import set_aside
from weftgrid.session import materialize


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns``, with the length of the text as it is now where documents carry one."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance draw keeps."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs, back = set_aside(docs, ("log_weight", "kept"))
    return back(importance.resample(docs, labels).where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints link."""
    docs, back = set_aside(docs, ("fingerprint", "component_id", "first"))
    return back(simhash.near_groups(docs).where("first"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without contaminated ones; shorter benchmark passages are cut from the others."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _measured(decontamination.decontaminate(docs, items), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources, each to its target: documents as often as it takes them, up to twice."""
    return _measured(mixing.mix_documents(docs, fill=True), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of packed token ids."""
    return packing.pack_tokens(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("pack", pack)]

#: SimHash needs XXH64 and the packed rows a tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every result but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
