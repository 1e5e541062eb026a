"""Queries of this subpackage over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontamination, filter_audit, importance, language, line_rules, mixing, packing, sharding, simhash, site_spread, suffixes
from .sql import AUDIT_SQL, COLLOCATIONS_SQL, DECONTAMINATION_SQL, LINE_RULES_SQL, LINE_SPREAD_SQL, MIXING_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.shuffle_to_shards(rows, 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontamination.mark_contamination(docs, table(spark, sf_dir, "benchmark"))
    hits = F.col("hits")
    return marked.select(
        "doc_id", hits["n_words"].alias("n_words"), decontamination.hit_words(hits).alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"), decontamination.digest(hits["items"]).alias("items_sha256"),
        decontamination.is_contaminated(hits).alias("contaminated"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_word_chars")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = site_spread.remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return cleaned.select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("clean_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.taken_words(docs, keep=["doc_id"], fill=True).select("doc_id", "size", "source_size", "target", "taken")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(table(spark, sf_dir, "documents"))


def op10_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_tokens(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_sharding, op3_suffix_array_dedup, op4_benchmark_decontamination, op5_quality_classifier, op6_quality_rules, op7_line_dedup,
    op8_mixing_sources, op9_language_id, op10_token_id_output, op11_phrase_collocations, op12_filter_interaction_audit, op13_bpe_encoding)}
SQL = {
    "op4_benchmark_decontamination": DECONTAMINATION_SQL, "op6_quality_rules": LINE_RULES_SQL,
    "op7_line_dedup": LINE_SPREAD_SQL, "op8_mixing_sources": MIXING_SQL, "op11_phrase_collocations": COLLOCATIONS_SQL, "op12_filter_interaction_audit": AUDIT_SQL}
