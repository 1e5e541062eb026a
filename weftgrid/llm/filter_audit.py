"""Interaction of text filters: truth-table survival words, summed by carry-save positional popcounts.

Bit S of a document's 32-bit word says that it survives when the filters of subset S are applied.  The sums of these bits
over a part give every number about every order of the filters; no order is run.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words_of

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Words summed at once.
_BLOCK = 1 << 18


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: the text has under 200 words; fewer than half its words are different; over 2 % of its characters are
    A-Z; it holds one of ``#$%&*|``.  NULL is an empty text."""
    text = F.coalesce(text, F.lit(""))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    words = let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    bits = [
        lambda w: w["n"] < 200,
        lambda w: 100 * w["d"].cast("long") < 50 * w["n"].cast("long"),
        lambda w: 100 * capitals.cast("long") > 2 * F.length(text).cast("long"),
        lambda w: text.rlike("[#$%&*|]"),
    ]
    return let(words, lambda w: sum((F.when(b(w), 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0)))


def survival_word(failures: int) -> int:
    """Bit S is set when no filter of subset S is among the failures."""
    return sum(1 << s for s in range(SUBSETS) if not s & failures)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of ``words`` (unsigned, 32 bits) have each bit set.

    Full adders turn three words of one weight into a word of that weight and a carry of twice the weight, 32 columns
    at once, until at most two words of each weight are left; only those are taken apart.
    """
    total = np.zeros(SUBSETS, np.int64)
    for at in range(0, len(words), _BLOCK):
        level, weight = words[at:at + _BLOCK].astype(np.uint32), 1
        while len(level):
            carries = []
            while len(level) > 2:
                third = len(level) // 3
                a, b, c = level[:third], level[third:2 * third], level[2 * third:3 * third]
                half = a ^ b
                carries.append((a & b) | (half & c))
                level = np.concatenate([half ^ c, level[3 * third:]])
            bits = np.unpackbits(level.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
            total += weight * bits.sum(0, dtype=np.int64)
            level, weight = np.concatenate(carries) if carries else level[:0], 2 * weight
    return total


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Survivors of each subset by part and label, summed over a batch."""
    table = np.array([survival_word(f) for f in range(SUBSETS)], np.uint32)
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch.column(0).dictionary_encode()
        names = parts.dictionary.to_pylist()
        # Label in the lowest two bits.
        key = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4 + batch.column(1).to_numpy(zero_copy_only=False)
        order = np.argsort(key, kind="stable")
        words, key = table[batch.column(2).to_numpy(zero_copy_only=False)[order]], key[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        counts = [positional_popcount(w) for w in np.split(words, starts[1:])]
        yield pa.RecordBatch.from_arrays([
            pa.array([names[k // 4] for k in key[starts]], pa.string()), pa.array(key[starts] % 4, pa.int32()),
            pa.array([c.tolist() for c in counts], pa.list_(pa.int64()))], ["part", "label", "counts"])


def document_failures(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``doc_id``, ``part``, ``label`` (1: good, 2: toxic, 3: both) and ``failures`` (bits of A to E) of every row of ``docs``.

    A row fails E if its text, NULL being empty, is that of a smaller doc_id.  Texts are told apart by SHA-256.  The
    smallest doc_id of each text is found by aggregation and joined back by id and text, not by text, so a group of
    copies, however large, has no hot key.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        text_failures(F.col("text")).alias("plain"))
    firsts = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    named = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 2).otherwise(0)).alias("toxic"))
    label = F.coalesce(F.col("good") + F.col("toxic"), F.lit(0))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(firsts, ["digest", "doc_id"], "left").join(named, "doc_id", "left").select(
        "doc_id", "part", label.alias("label"), (F.col("plain") + F.when(copy, 1 << 4).otherwise(0)).alias("failures"))


def subset_survivors(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``part``, ``all``, ``good``, ``toxic``: arrays of 32 numbers, the survivors of each subset of filters.

    Each batch is summed where it is; only a row per part, label and batch is shuffled.
    """
    counted = document_failures(docs, labels, part).select("part", "label", "failures").mapInArrow(
        _counted, "part string, label int, counts array<bigint>")
    cells = counted.select("part", "label", F.posexplode("counts").alias("subset", "n"))
    among = lambda has: F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0))
    sums = cells.groupBy("part", "subset").agg(
        F.sum("n").alias("all"), among(F.col("label").isin(1, 3)).alias("good"), among(F.col("label") >= 2).alias("toxic"))
    # 32 rows a part.
    ordered = F.array_sort(F.collect_list(F.struct("subset", "all", "good", "toxic")))
    return sums.groupBy("part").agg(ordered.alias("cells")).select("part", "cells.all", "cells.good", "cells.toxic")


def order_steps() -> list[dict]:
    """Order, step, number of its filter, subsets before and after it, for each step of each order."""
    found = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            found.append({
                "filter_order": "".join(FILTERS[i] for i in order), "step": step, "filter": f, "before": before, "after": before | 1 << f})
            before |= 1 << f
    return found


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """What each filter removes at each step of each order, by part.

    One row per value of ``part`` (NULL as the empty string), ``filter_order`` and ``step``: ``kept``, ``removed``,
    ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost`` and ``shapley`` (removals by the step's filter summed over
    all orders).

    NULL texts are empty.  A row without doc_id is no one's copy and has no label; a doc_id with several labels is good or
    toxic if one of them says so; repeated rows of one doc_id are not copies of each other.  An empty frame has no parts and so no rows; an
    empty table of labels loses nothing.  Other columns of either frame are not read.
    """
    survivors = subset_survivors(docs, labels, part)
    at = lambda name, subset: F.element_at(name, subset + 1)
    lost = lambda name: at(name, F.col("before")) - at(name, F.col("after"))

    def over_orders(f: int) -> Column:
        """Orders in which exactly the filters of a subset come before ``f``, times what ``f`` then removes."""
        found = []
        for s in range(SUBSETS):
            if not s >> f & 1:
                k = s.bit_count()
                ways = factorial(k) * factorial(len(FILTERS) - 1 - k)
                found.append(f"{ways} * (`all`[{s}] - `all`[{s | 1 << f}])")
        return F.expr(" + ".join(found))

    full = SUBSETS - 1
    bit = F.expr("shiftleft(1, filter)")
    counted = survivors.withColumns({
        "shapleys": F.array(*[over_orders(f) for f in range(len(FILTERS))])})
    schema = "array<struct<filter_order string, step int, filter int, before int, after int>>"
    steps = F.from_json(F.lit(json.dumps(order_steps())), schema)
    rows = counted.withColumn("at", F.explode(steps)).select("*", "at.*")
    return rows.select(
        "part", "filter_order", "step", at("all", F.col("after")).alias("kept"), lost("all").alias("removed"),
        (at("all", F.lit(0)) - at("all", bit) - lost("all")).alias("redundant"),
        (at("all", F.lit(full) - bit) - at("all", F.lit(full))).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.element_at("shapleys", F.col("filter") + 1).alias("shapley"))
