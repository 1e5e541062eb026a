"""Text operators: tokens, stop words, stems, sentences, entity mentions, HTML and word counts.

Every step up to the stems works inside the row, so it adds no shuffle; all but
the stems are native expressions.  NULL text counts as empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgrid.functions.rows import explode_column
from weftgrid.functions.stemming import stem_tokens
from weftgrid.functions.stopwords import ENGLISH

# Markup removed from a page, tags and comments first, then entities.
TAG_PATTERN = r"(<!--.*?-->|<[^>]*>)"
ENTITY_PATTERN = r"&([^;]+);"

SENTENCE_GAP = r"(?<=[.!?])\s+"
MENTION_PATTERN = r"(\p{Lu}[\p{L}\p{N}]*(?: \p{Lu}[\p{L}\p{N}]*)*)"


# --- token columns: array<string> ------------------------------------------

def tokens_of(text: Column, unicode: bool = False) -> Column:
    """Lower-cased runs of word characters: ASCII by default, any letter or digit with ``unicode``."""
    pattern = r"(?U)(\w+)" if unicode else r"(\w+)"
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(1))


def tokenize(df: DataFrame, column: str, unicode: bool = False) -> DataFrame:
    return df.withColumn(column, tokens_of(F.col(column), unicode))


def keep_alphabetic(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.filter(column, lambda t: t.rlike(r"^\p{L}+$")))


def keep_long(df: DataFrame, column: str, length: int = 3) -> DataFrame:
    return df.withColumn(column, F.filter(column, lambda t: F.length(t) >= length))


def remove_stop_words(df: DataFrame, column: str, words: Sequence[str] = ENGLISH) -> DataFrame:
    """Drop stop words, whatever their case; other tokens keep their order and repeats."""
    listed = [w.lower() for w in words]
    return df.withColumn(column, F.filter(column, lambda t: ~F.lower(t).isin(listed)))


def stem_words(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, stem_tokens(F.col(column)))


def preprocess(df: DataFrame, column: str) -> DataFrame:
    """Tokenize, keep alphabetic tokens of three letters or more, drop stop words, stem."""
    return (
        df.transform(tokenize, column)
        .transform(keep_alphabetic, column)
        .transform(keep_long, column)
        .transform(remove_stop_words, column)
        .transform(stem_words, column)
    )


def explode_tokens(df: DataFrame, key: str, column: str) -> DataFrame:
    """Long form ``(key, pos, token)`` of a token column."""
    return explode_column(df, [key], F.col(column), "token", "pos")


# --- sentences and mentions -------------------------------------------------

def sentences_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SENTENCE_GAP), lambda s: F.length(s) > 0)


def segment_sentences(df: DataFrame, column: str) -> DataFrame:
    """Replace a text column by the array of its sentences."""
    return df.withColumn(column, sentences_of(F.col(column)))


def entity_mentions(df: DataFrame, key: str, column: str, gazetteer: DataFrame) -> DataFrame:
    """Capitalised runs of every sentence, labelled from a ``(name, label)`` gazetteer.

    Rows ``(key, sentence, position, mention, label)``; an unknown mention keeps a NULL
    label.  Names compare without case; of several labels the least wins.  Spark
    broadcasts the gazetteer when it is small and otherwise splits the partitions of
    frequent mentions, which only the mention side can skew.
    """
    names = gazetteer.groupBy(F.lower("name").alias("_name")).agg(F.min("label").alias("label"))
    sentences = explode_column(df, [key], sentences_of(F.col(column)), "_text", "sentence")
    runs = F.regexp_extract_all("_text", F.lit(MENTION_PATTERN), F.lit(1))
    mentions = explode_column(sentences, [key, "sentence"], runs, "mention", "position")
    labelled = mentions.join(names, F.lower("mention") == F.col("_name"), "left")
    return labelled.select(key, "sentence", "position", "mention", "label")


# --- pages ------------------------------------------------------------------

def html_to_text(df: DataFrame, column: str) -> DataFrame:
    """Delete tags and comments, then entities; script and style bodies stay."""
    bare = F.regexp_replace(F.regexp_replace(F.col(column), TAG_PATTERN, ""), ENTITY_PATTERN, "")
    return df.withColumn(column, bare)


# --- word counts ------------------------------------------------------------

def word_count(lines: DataFrame, column: str = "value") -> DataFrame:
    """``(word, count)`` of the words between single spaces; repeats are summed before the shuffle."""
    words = explode_column(lines, [], F.split(column, " "), "word")
    return words.groupBy("word").agg(F.count("*").alias("count"))


def top_words(lines: DataFrame, column: str = "value", k: int = 100) -> DataFrame:
    """The ``k`` most frequent words of the non-empty lines, ties in word order."""
    counts = word_count(lines.where(F.length(column) > 0), column)
    return counts.orderBy(F.desc("count"), F.asc("word")).limit(k)
