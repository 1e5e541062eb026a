"""Line-first cleaning: judge each line, remove the failures, reject documents that lose too much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, words_of

SYMBOLS = r"[#*$%&|<>]"
#: A line with at least this many words and no sentence end in it fails the punctuation rule.
UNPUNCTUATED_WORDS = 40
#: Separators of menus and breadcrumbs.
SEPARATORS = r"[|»›•·>]"
#: Phrases of legal notices and page furniture; a line of at most BOILERPLATE_WORDS words that holds one fails.
BOILERPLATE = (
    r"all rights reserved|licensed under|released under|public license|terms of (use|service)|privacy policy|"
    r"cookie|copyright|sign (in|up)|log ?in|subscribe|newsletter|javascript|click here|read more")
BOILERPLATE_WORDS = 25


def text_counts(text: Column) -> dict[str, Column]:
    """Whole-text counts; NULL counts as the empty text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.length(F.regexp_replace(line, SPACE, "")) > 0)
    return {
        "word_chars": F.length(F.regexp_replace(whole, SPACE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(whole, SYMBOLS.replace("[", "[^") + "+", "")).cast("long"),
        "n_dup_lines": let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"),
    }


def repeated_words(words: Column, width: int = 5) -> Column:
    """Number of words inside a window of ``width`` words that occurs twice or more, first occurrence included."""
    def windows(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - width)
        return F.transform(places, lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(width)]))

    def covered(grams: Column) -> Column:
        # Sorted by text, equal windows are neighbours; their starts, sorted, cover min(width, gap) words each.
        numbered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def starts(s: Column) -> Column:
            equal = lambda x, j: j.between(0, F.size(s) - 1) & (F.get(s, j)["g"] == x["g"])
            hits = F.filter(s, lambda x, i: F.coalesce(equal(x, i - 1), F.lit(False)) | F.coalesce(equal(x, i + 1), F.lit(False)))
            return F.sort_array(F.transform(hits, lambda x: x["i"]))

        def width_of(a: Column) -> Column:
            steps = F.transform(a, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(a, i + 1) - x, F.lit(width))))
            return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

        return let(let(numbered, starts), width_of)

    def count(grams: Column) -> Column:
        # Most texts repeat no window: comparing two counts is all they cost.
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(covered(grams))

    return F.when(F.size(words) <= width, F.lit(0)).otherwise(let(windows(words), count)).cast("long")


def line_fails(line: Column) -> Column:
    """Whether a line breaks a rule; a line without words never does."""
    n = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    marks = F.regexp_count(line, F.lit(SEPARATORS))
    symbols = F.regexp_count(line, F.lit(SYMBOLS))
    shouts = F.regexp_count(line, F.lit(r"[!?]{2}"))
    return (n > 0) & (
        ((n >= UNPUNCTUATED_WORDS) & ~line.rlike(r"[.!?…。]"))       # punctuation: long and without a sentence end
        | (symbols >= n) | (shouts * 3 >= n)                            # punctuation: symbols or shouting instead of text
        | ((marks >= 3) & (marks * 4 >= n))                             # navigation
        | ((n <= BOILERPLATE_WORDS) & F.lower(line).rlike(BOILERPLATE)))


def clean_lines(text: Column) -> Column:
    """The text without its failing lines; NULL stays NULL."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line_fails(line)), "\n")


def quality_rules(docs: DataFrame, max_loss: float = 0.5) -> DataFrame:
    """One row per document: ``doc_id``, the whole-text counts, ``clean_text``, ``base_failed`` and ``kept``.

    Lines that break a rule go first; a document is kept when it passes the base rules and loses at most
    ``max_loss`` of its word characters with those lines.  NULL and empty texts have no words and fail the base
    rules.  Equal rows give equal rows; other columns of ``docs`` are not read.  Each row is judged on its own,
    without a shuffle; the work grows with the length of a text (times its logarithm where windows repeat).
    """
    clean = docs.select("doc_id", "text", words_of(F.col("text")).alias("_words"))
    counted = clean.select(
        "doc_id", F.size("_words").cast("long").alias("n_words"), repeated_words(F.col("_words")).alias("n_repeat_words"),
        *[c.alias(name) for name, c in text_counts(F.col("text")).items()], clean_lines(F.col("text")).alias("clean_text"))
    left = F.length(F.regexp_replace(F.coalesce("clean_text", F.lit("")), SPACE, "")).cast("long")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumns({
        "clean_word_chars": left,
        "base_failed": failed,
        "kept": ~failed & (left >= F.lit(1 - max_loss) * F.col("word_chars")),
    })
