"""Cross-site boilerplate lines: sketched and exact counts of the sites that hold a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import SPACE, unused

#: Logarithm of the number of HyperLogLog registers: a standard error of about 6.5 %.
LOG_REGISTERS = 8
#: Estimates within this factor of the threshold are counted exactly: six standard errors.
BAND = 1.4


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """128 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("second"), line).alias("h2"))


def has_word(line: Column) -> Column:
    return F.length(F.regexp_replace(line, SPACE, "")) > 0


def site_lines(docs: DataFrame, site: str) -> DataFrame:
    """``key``, ``site`` of every line with a word; a NULL site is a site of its own."""
    keys = F.transform(F.filter(lines_of(F.col("text")), has_word), line_key)
    return docs.select(
        F.concat(F.lit("s"), F.col(site).cast("string")).alias("site"), F.explode_outer(keys).alias("key")
    ).where("key IS NOT NULL").select("key.h1", "key.h2", F.coalesce("site", F.lit("none")).alias("site"))


def boilerplate_keys(docs: DataFrame, site: str = "source", min_sites: int = 10) -> DataFrame:
    """``h1``, ``h2`` of the lines that stand on at least ``min_sites`` different sites.

    A line on so many sites has at least so many rows: lines are counted first, with partial counts before the shuffle,
    and the others need no sketch.  HyperLogLog sketches of a line's sites are merged by aggregation; an estimate within a
    factor of BAND of the threshold is replaced by the exact number of different sites.
    """
    rows = site_lines(docs, site)
    # Written, so that the join below has a plain shuffle on either side and a very common line's partition can be split.
    frequent = materialize(
        rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("h1", "h2"), "frequent")
    candidates = materialize(rows.join(frequent, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").agg(F.count(F.lit(1)).alias("n")), "spread")
    sketched = candidates.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_REGISTERS)).alias("estimate"))
    sure = sketched.where(F.col("estimate") > BAND * min_sites).select("h1", "h2")
    near = sketched.where(F.col("estimate").between(min_sites / BAND, BAND * min_sites)).select("h1", "h2")
    exact = (
        candidates.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count_distinct("site").alias("sites"))
        .where(F.col("sites") >= min_sites).select("h1", "h2"))
    return sure.unionByName(exact)


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = 10) -> DataFrame:
    """``docs`` with ``clean_text``, ``n_lines`` and ``n_removed``.

    Lines with a word that stand, letter for letter, on at least ``min_sites`` sites of ``docs`` are removed from every
    text; lines without a word stay and are not counted.  NULL texts have no lines and stay NULL; a NULL site is one
    more site; repeated rows change nothing, since only different sites count; an empty frame gives no rows.  Columns
    of the new names are replaced.

    Only hashes of lines are shuffled to find the boilerplate.  Each text's own boilerplate lines come back to it by the
    hash of the text, one row per different text, so a group of copies is an ordinary skewed side of a join.
    """
    plain = docs.drop("clean_text", "n_lines", "n_removed")
    found = materialize(boilerplate_keys(plain, site, min_sites), "boilerplate")
    key, first, second, hit = (unused(plain, n) for n in ("_text", "_t1", "_t2", "_hits"))
    text_key = line_key(F.coalesce("text", F.lit("")))
    keys = F.transform(F.filter(lines_of(F.col("text")), has_word), line_key)
    held = plain.select(text_key.alias("_text"), F.explode_outer(F.array_distinct(keys)).alias("_line")).where("_line IS NOT NULL")
    hits = materialize(
        held.select(F.col("_text.h1").alias(first), F.col("_text.h2").alias(second), "_line.h1", "_line.h2")
        .join(found, ["h1", "h2"], "left_semi").groupBy(first, second).agg(F.collect_set(F.struct("h1", "h2")).alias(hit)), "hits")
    joined = plain.withColumn(key, text_key)
    joined = joined.join(hits, (F.col(key)["h1"] == F.col(first)) & (F.col(key)["h2"] == F.col(second)), "left")
    keep = F.filter(lines_of(F.col("text")), lambda x: ~(F.array_contains(F.col(hit), line_key(x)) & has_word(x)))
    clean = F.when(F.col(hit).isNull(), F.col("text")).otherwise(F.array_join(keep, "\n"))
    counted = lambda text: F.size(F.filter(lines_of(text), has_word)).cast("long")
    return joined.withColumn("clean_text", clean).withColumn("n_lines", counted(F.col("text"))).withColumn(
        "n_removed", F.col("n_lines") - counted(F.col("clean_text"))).drop(key, first, second, hit)
