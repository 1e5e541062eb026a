"""Search in a positional index: phrases, and ranked search that skips blocks which can't matter.

An index has a row for every term and block of ``block_size`` document numbers, so no frequent term fills a row, and blocks
of different terms meet by their number:

* ``docs`` and ``tfs``: places of the documents in the block, in order, and how often each has the term;
* ``top``: the greatest of ``tfs``, the bound by which ranked search leaves blocks out;
* ``places``: document and position of every occurrence in one number, as differences.

Written out sorted by term, a search reads its own terms' rows and of those only the columns it needs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgrid.functions.rows import bound
from weftgrid.operators.features import idf_weight

BLOCK_DOCUMENTS = 1024
_POSITION_BITS = 32


def position_index(df: DataFrame, key: str, column: str, block_size: int = BLOCK_DOCUMENTS) -> DataFrame:
    """``(term, block, docs, tfs, top, places)`` of a column of tokens; ``key`` is a whole number, unique and not negative.

    Documents are shuffled once, by block and before their tokens become rows: a block is a bounded number of documents.
    """
    doc = F.col(key).cast("bigint")
    blocks = df.where(F.col(key).isNotNull()).select(
        F.floor(doc / block_size).cast("bigint").alias("block"), F.pmod(doc, F.lit(block_size)).cast("int").alias("doc"), F.col(column).alias("tokens")
    ).repartition("block")
    dealt = blocks.select("block", "doc", F.posexplode("tokens").alias("position", "term"))
    inside = dealt.groupBy("term", "block", "doc").agg(F.sort_array(F.collect_list("position")).alias("positions"))
    lists = inside.groupBy("term", "block").agg(F.sort_array(F.collect_list(F.struct("doc", "positions"))).alias("found"))
    place = lambda d, p: F.shiftleft(d.cast("bigint"), _POSITION_BITS) + p
    places = F.flatten(F.transform("found", lambda f: F.transform(f["positions"], lambda p: place(f["doc"], p))))
    steps = bound(places, lambda all_: F.transform(all_, lambda p, i: p - F.when(i > 0, F.get(all_, i - 1)).otherwise(0)))
    tfs = F.transform("found", lambda f: F.size(f["positions"]))
    return lists.select(
        "term", "block", F.col("found.doc").alias("docs"), tfs.alias("tfs"), F.array_max(tfs).alias("top"), steps.alias("places"))


def _running(steps: Column, back: Column) -> Column:
    """Numbers from their differences, each less ``back``."""
    @F.arrow_udf("array<bigint>")
    def summed(lists: pa.Array, backs: pa.Array) -> pa.Array:
        values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        total = np.concatenate([[0], np.cumsum(values)])
        counts = np.diff(ends)
        out = total[1:] - np.repeat(total[ends[:-1]] + backs.to_numpy(zero_copy_only=False), counts)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.int64()))

    return summed(steps, back)


def phrase_search(index: DataFrame, phrase: Sequence[str], block_size: int = BLOCK_DOCUMENTS) -> DataFrame:
    """``(doc, n)``: documents that hold the terms one after the other, and at how many places; overlaps count.

    The words' blocks meet by number.  Each word's places, less its place in the phrase, are starts of the phrase; those of all
    words are intersected inside the row.  Blocks that lack a word are left out before anything is decoded.
    """
    if not phrase:
        raise ValueError("a phrase has at least one term")
    at = F.create_map(*[c for t in dict.fromkeys(phrase) for c in (F.lit(t), F.array(*[F.lit(i) for i, p in enumerate(phrase) if p == t]))])
    terms = sorted(set(phrase))
    rows = index.where(F.col("term").isin(terms)).select("term", "block", "places")
    # As many rows a block as the phrase has different terms.
    blocks = rows.groupBy("block").agg(F.collect_list(F.struct("term", "places")).alias("rows")).where(F.size("rows") == len(terms))
    starts = (
        blocks.select("block", F.explode("rows").alias("row"))
        .select("block", F.explode(at[F.col("row.term")]).alias("place"), F.col("row.places").alias("places"))
        .select("block", _running(F.col("places"), F.col("place")).alias("starts")))
    met = starts.groupBy("block").agg(F.collect_list("starts").alias("all")).select(
        "block", F.aggregate(F.slice("all", 2, len(phrase)), F.col("all")[0], lambda a, b: F.array_intersect(a, b)).alias("starts"))
    found = met.select("block", F.explode("starts").alias("start"))
    doc = F.col("block") * block_size + F.shiftright("start", _POSITION_BITS)
    return found.groupBy(doc.alias("doc")).agg(F.count(F.lit(1)).alias("n"))


def ranked_search(index: DataFrame, terms: Sequence[str], documents: int, n: int = 10, block_size: int = BLOCK_DOCUMENTS,
                  first_blocks: int = 8) -> DataFrame:
    """The ``n`` documents with the highest sum of tf-idf over the query's terms: ``doc``, ``score``, ``blocks``, ``blocks_read``.

    No document scores above its block's bound, the sum of each term's ``top`` times its weight.  The ``first_blocks``
    with the highest bounds are scored first; the n-th best score there is a threshold, and of the other blocks
    only those whose bound reaches it are read.  The result is that of scoring every document, whose ties go to the lower
    document number.  ``documents`` is the number of all documents.
    """
    wanted = index.where(F.col("term").isin(sorted(set(terms))))
    # One number per query term.
    frequency = {r["term"]: r["df"] for r in wanted.groupBy("term").agg(F.sum(F.size("docs")).alias("df")).collect()}
    if not frequency:
        return wanted.select(F.lit(0).cast("bigint").alias("doc"), F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("blocks"),
                             F.lit(0).cast("bigint").alias("blocks_read")).where("false")
    weights = F.create_map(*[c for t, df in sorted(frequency.items()) for c in (F.lit(t), idf_weight(F.lit(float(df)), F.lit(documents)))])
    weight = weights[F.col("term")]
    # Rounded up a little, since sums of doubles depend on their order.
    bounds = wanted.groupBy("block").agg((F.sum(F.col("top") * F.greatest(weight, F.lit(0.0))) * (1 + 1e-12)).alias("bound"))

    def scored(blocks: DataFrame) -> DataFrame:
        read = wanted.join(blocks, "block", "left_semi").select("block", weight.alias("w"), F.explode(F.arrays_zip("docs", "tfs")).alias("p"))
        doc = F.col("block") * block_size + F.col("p.docs")
        return read.groupBy(doc.alias("doc")).agg(F.sum(F.col("p.tfs") * F.col("w")).alias("score"))

    head = bounds.orderBy(F.desc("bound"), "block").limit(first_blocks)
    best = [r["score"] for r in scored(head).orderBy(F.desc("score"), "doc").limit(n).collect()]
    threshold = best[-1] * (1 - 1e-12) if len(best) == n and best[-1] > 0 else float("-inf")
    open_ = bounds.where(F.col("bound") >= threshold)
    sizes = bounds.agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("bound") >= threshold).alias("blocks_read"))
    return scored(open_).orderBy(F.desc("score"), "doc").limit(n).select(
        "doc", "score", sizes.select("blocks").scalar().alias("blocks"), sizes.select("blocks_read").scalar().alias("blocks_read"))
