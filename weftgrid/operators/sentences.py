"""Sentences without a list of abbreviations: the corpus itself shows which words end in a full stop.

A word whose full stop belongs to it is followed by one far more often than words are on
the whole (Kiss and Strunk, 2006).  One grouped count per word gives the evidence; a
full stop after such a word ends a sentence only if the next word looks like a start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgrid.functions.rows import explode_column
from weftgrid.operators.text import SENTENCE_GAP
from weftgrid.session import materialize

WORD = r"\p{L}+(?:\.\p{L}+)*\.?"
LAST_WORD = r"(\p{L}+(?:\.\p{L}+)*)\.$"
FIRST_WORD = r"^\P{L}*(\p{L}+)"
THRESHOLD = 0.3   # least score of an abbreviation
CERTAIN = 0.99    # share of occurrences with a full stop that an abbreviation is taken to have


def _pieces(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), SENTENCE_GAP)


def word_evidence(df: DataFrame, column: str) -> DataFrame:
    """``(word, stopped, plain, lower, inside)``: occurrences of each lower-cased word.

    ``stopped`` are followed by a full stop, ``plain`` are not; ``lower`` begin with a
    lower-case letter, ``inside`` with a capital although something other than a possible
    sentence end stands before them.  Counted before the shuffle.
    """
    def seen(piece: Column) -> Column:
        return F.transform(F.regexp_extract_all(piece, F.lit(WORD), F.lit(0)), lambda w, i: F.struct(
            F.lower(F.rtrim(w, F.lit("."))).alias("word"), w.endswith(".").alias("stop"),
            w.rlike(r"^\p{Ll}").alias("lower"), (w.rlike(r"^\p{Lu}") & (i > 0)).alias("inside")))

    words = explode_column(df, [], F.flatten(F.transform(_pieces(F.col(column)), seen)), "w")
    return words.groupBy("w.word").agg(
        F.count_if("w.stop").alias("stopped"), F.count_if(~F.col("w.stop")).alias("plain"),
        F.count_if("w.lower").alias("lower"), F.count_if("w.inside").alias("inside"))


def abbreviation_scores(evidence: DataFrame) -> DataFrame:
    """``(word, stopped, plain, score)`` of the words seen with a full stop.

    Twice the log of the likelihood ratio (share ``CERTAIN`` against the corpus's share),
    lowered for long words and for occurrences without the stop, raised for inner stops.
    Words no likelier than others to be abbreviations score 0.
    """
    totals = evidence.agg(F.sum("stopped").alias("s"), F.sum(F.col("stopped") + F.col("plain")).alias("n"))
    share = totals.select(F.col("s") / F.col("n")).scalar()
    plain = F.col("plain")
    # Without a plain occurrence its factor is 1, also where every word of the corpus has a stop.
    common = F.col("stopped") * F.ln("_share") + F.when(plain > 0, plain * F.ln(1 - F.col("_share"))).otherwise(0.0)
    certain = F.col("stopped") * F.ln(F.lit(CERTAIN)) + plain * F.ln(F.lit(1 - CERTAIN))
    letters = F.length(F.replace(F.col("word"), F.lit("."), F.lit("")))
    shape = F.exp(-letters) * (F.length("word") - letters + 1) * F.pow(letters.cast("double"), -plain.cast("double"))
    ratio = 2 * (certain - common)
    return (
        evidence.where("stopped > 0").withColumn("_share", share)
        .select("word", "stopped", "plain", F.when(ratio > 0, ratio * shape).otherwise(0.0).alias("score"))
    )


def abbreviations(df: DataFrame, column: str, threshold: float = THRESHOLD) -> DataFrame:
    """The abbreviations of a corpus, ``(word, stopped, plain, score)``."""
    evidence = materialize(word_evidence(df, column), "words")
    return abbreviation_scores(evidence).where(F.col("score") >= threshold)


def learned_sentences(df: DataFrame, key: str, column: str, threshold: float = THRESHOLD) -> DataFrame:
    """Rows ``(key, pos, sentence)``; ``key`` identifies a row, positions count from 0.

    Every gap after ``.``, ``!`` or ``?`` ends a sentence, except after the full stop of an
    abbreviation; that one ends a sentence only before a capitalised word which the corpus
    also has in lower case and never capitalised inside a sentence.  The white space
    inside a sentence stays.  Frequent words can only skew the text side of the joins.  Only starts that follow an abbreviation
    somewhere matter, so the words that texts are joined with are few.
    """
    evidence = materialize(word_evidence(df, column), "words")
    short = abbreviation_scores(evidence).where(F.col("score") >= threshold).select(F.col("word").alias("last"), F.lit(True).alias("short"))
    starters = evidence.where("lower > 0 AND inside = 0").select(F.col("word").alias("next"), F.lit(True).alias("starter"))

    gaps = F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(rf"{SENTENCE_GAP[:-3]}(\s+)"), F.lit(1))
    parts = df.select(F.col(key).alias("key"), _pieces(F.col(column)).alias("p"), gaps.alias("g"))
    parts = parts.withColumn("n", F.arrays_zip("p", "g", F.slice("p", F.lit(2), F.greatest(F.size("p"), F.lit(1))).alias("f")))
    pieces = explode_column(parts, ["key"], F.col("n"), "n", "place").select(
        "key", "place", F.col("n.p").alias("piece"), F.col("n.g").alias("gap"),
        F.lower(F.regexp_extract("n.p", LAST_WORD, 1)).alias("last"), F.regexp_extract("n.f", FIRST_WORD, 1).alias("first")
    ).where(F.length("piece") > 0)
    short = materialize(short, "abbreviations")
    capital = F.col("first").rlike(r"^\p{Lu}")
    asked = pieces.where(capital).select("last", F.lower("first").alias("next")).join(short, "last", "left_semi").select("next").distinct()
    starters = materialize(starters.join(asked, "next", "left_semi"), "starters")
    judged = pieces.withColumn("next", F.lower("first")).join(short, "last", "left").join(starters, "next", "left")
    starts = F.coalesce("starter", F.lit(False)) & capital
    ends = ~F.coalesce("short", F.lit(False)) | starts
    before = Window.partitionBy("key").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    numbered = judged.withColumn("pos", F.coalesce(F.sum(F.coalesce(ends, F.lit(True)).cast("int")).over(before), F.lit(0)).cast("int"))
    whole = numbered.groupBy("key", "pos").agg(F.sort_array(F.collect_list(F.struct("place", "piece", "gap"))).alias("p"))
    inner = F.transform("p", lambda x, i: F.when(i < F.size("p") - 1, F.concat(x["piece"], x["gap"])).otherwise(x["piece"]))
    return whole.select(F.col("key").alias(key), "pos", F.array_join(inner, "").alias("sentence"))
