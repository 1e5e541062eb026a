"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_rank
from ..session import materialize
from .common import amount_before, count_words, set_aside, unused, words_of

#: Golden-ratio points on a ring of 2**31: the odd multiplier next to 2**31 / golden ratio visits every point once.
RING, STEP = 1 << 31, 1327217885
#: Sources whose targets are shared on the driver; more are shared by sums over a table with one row per source.
DRIVER_SOURCES = 10_000


def share_targets(sizes: list[int], weights: list[int], share: float = 1.5, cap: float = 2.0) -> list[float]:
    """Targets in proportion to the weights, together ``share`` of all sizes, none above ``cap`` times its size.

    What a cap cuts off is shared again by weight among the others until none is above.
    """
    targets, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = share * sum(sizes)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * left / weight > cap * sizes[i]}
        if not full:
            for i in open_:
                targets[i] = weights[i] * left / weight
            break
        for i in full:
            targets[i] = float(cap * sizes[i])
        left -= sum(targets[i] for i in full)
        open_ -= full
    return targets


def _point(slot: Column) -> Column:
    return F.pmod(slot, F.lit(RING)) * F.lit(STEP).cast("long") % F.lit(RING)


def _shared_table(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> tuple[DataFrame, float]:
    """``sizes`` (source, n) with ``source_no``, ``target`` and the stretch [``low``, ``high``) of the ring; the sum of targets.

    The targets are those of ``share_targets``.  Stretches are whole-number sums of targets in steps of 1/1024 word, so they
    don't depend on the order in which they are added up.
    """
    ranked = global_rank(sizes, [F.col("source").isNull(), F.col("source")], "source_no")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    table = materialize(
        ranked.withColumn("source_no", F.col("source_no") - 1).withColumn("weight", weight), "sources")
    limit = F.col("n") * cap
    words, weighed = table.agg(F.sum("n"), F.sum("weight")).first()
    left, known = share * words, 0
    while True:  # the level rises from round to round, and with it the set of sources at their cap
        wanted = F.col("weight") * F.lit(float(left)) / F.lit(float(weighed or 1))
        full = F.lit(weighed == 0) | (wanted > limit)
        count, at_cap, open_ = table.agg(F.count_if(full), F.sum(F.when(full, F.col("n"))), F.sum(F.when(~full, F.col("weight")))).first()
        if count == known:
            break
        left, weighed, known = share * words - cap * (at_cap or 0), open_ or 0, count
    table = table.withColumn("target", F.when(full, limit.cast("double")).otherwise(wanted))
    fine = F.floor(F.col("target") * 1024 + 0.5)
    total, fine_total = table.agg(F.sum("target"), F.sum(fine)).first()
    # Tasks of 65,536 sources each add up what lies before.
    placed = amount_before(
        table.withColumns({"_one": F.lit(0), "_cells": F.shiftright("source_no", 16)}), "_one", "_cells", ["source_no"], fine, "_before")
    on_ring = lambda c: F.floor(c / F.lit(float(fine_total or 1)) * RING)
    return materialize(placed.select(
        "source", "source_no", "n", "target", on_ring(F.col("_before")).alias("low"),
        on_ring(F.col("_before") + fine).alias("high")), "sources"), total


def _slots_of(spark, table: DataFrame, slots: int) -> DataFrame:
    """``slot`` and ``source_no`` for all slots, by the stretches of ``table``.

    Both sides meet in equal cells of the ring.  A stretch is in one cell more than it has borders in it, and a cell has
    about 64 slots, so the work is in proportion to slots and sources.
    """
    bits = 31 - max(0, min(31, (slots // 64).bit_length()))
    cells = table.where("low < high").select(
        F.col("source_no").cast("int").alias("source_no"), "low", "high",
        F.explode(F.sequence(F.shiftright("low", bits), F.shiftright(F.col("high") - 1, bits))).alias("_ring"))
    points = spark.range(slots).select(F.col("id").alias("slot"), _point(F.col("id")).alias("_at"))
    points = points.withColumn("_ring", F.shiftright("_at", bits))
    return points.join(cells, "_ring").where("low <= _at AND _at < high").select("slot", "source_no")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, block_words: int = 128,
             seed: int = 11, max_sources: int | None = None, keep: list[str] | None = None, fill: bool = False,
             driver_sources: int = DRIVER_SOURCES) -> tuple[DataFrame, DataFrame]:
    """Documents and the pieces of them that a mix takes.

    The first frame is ``docs`` (all columns, or those in ``keep``) with ``size`` (words), ``source_no``, ``source_size``,
    ``target`` and a row number ``mix_row``; it is written once.  The second has one row per piece and slot: ``slot``,
    ``mix_row``, ``epoch``, ``first_word``, ``n``.

    Sources in code-point order, NULL last, have the weights in turn.  Each source's documents, in an order drawn by a
    hash of id and text, form a stream of up to ``cap`` epochs that is cut into blocks of ``block_words`` words.  Slot t of
    the schedule belongs to the source whose stretch of the ring holds the t-th golden-ratio point; the r-th slot of
    a source takes its block r.  So every prefix of the mix is close to the target weights, and a document is never
    taken more than ``cap`` times.

    Whole slots leave a source up to a few blocks off its target, and one of a few blocks or less may get none.  With ``fill`` each
    source gets its target, rounded up to a word: blocks it is short of come after the schedule, those above are not
    taken, and the last one is cut.

    Streams and ranks are sums over cells of bounded size, not one order per source.

    NULL and empty texts have no words and are not taken; repeated rows are documents of their own; an empty frame
    gives empty frames.  Any number of sources will do, unless ``max_sources`` asks for a ValueError beyond it.  The driver
    and a broadcast table hold one row per source for up to ``driver_sources``; more sources stay in a table.  Columns with the names above are replaced.
    """
    spark = docs.sparkSession
    added = ("size", "source_no", "source_size", "target", "mix_row")
    plain = docs.drop(*[a for a in added if a in docs.columns])
    key, known_as = unused(plain, "_key"), unused(plain, "_known")
    name = lambda: F.md5(F.concat_ws(
        "|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    carried = [c for c in (keep or plain.columns) if c != "source"]
    held = materialize(plain.select(
        "source", *carried, count_words(F.col("text")).alias("size"), name().alias(key),
        F.monotonically_increasing_id().alias("mix_row")), "mix")

    counted = held.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("rows"))
    bound = driver_sources if max_sources is None else max(driver_sources, max_sources)
    found = counted.limit(bound + 1).collect()
    if max_sources is not None and len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    if len(found) > driver_sources:
        sized = materialize(counted, "sizes")
        n_sources, n_rows = sized.agg(F.count(F.lit(1)), F.sum("rows")).first()
        table, total = _shared_table(sized, weights, share, cap)
        slots = int(total / block_words + 0.5)
        known = table.select(
            F.col("source").alias(known_as), F.col("source_no").cast("int").alias("source_no"), F.col("n").alias("source_size"), "target")
        by_slot = _slots_of(spark, table, slots)
    else:
        n_sources, n_rows = len(found), sum(r["rows"] for r in found)
        found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [r["n"] for r in found]
        targets = share_targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, cap)
        total = sum(targets)
        slots = int(total / block_words + 0.5)
        # As in _shared_table: sums of whole steps.
        fine = [int(t * 1024 + 0.5) for t in targets]
        cuts, reached = [], 0
        for f in fine[:-1]:
            reached += f
            cuts.append(int(reached / float(sum(fine) or 1) * RING))
        # As an Arrow table: rows of Python objects would start Python workers on the executors, which stay for a while.
        known = F.broadcast(spark.createDataFrame(pa.table(
            [pa.array([r["source"] for r in found], pa.string()), pa.array(range(len(found)), pa.int32()),
             pa.array(sizes, pa.int64()), pa.array(targets, pa.float64())], [known_as, "source_no", "source_size", "target"])))
        ends = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
        point = _point(F.col("slot"))
        by_slot = spark.range(slots).select(
            F.col("id").alias("slot"), F.size(F.filter(ends, lambda c: c <= point)).cast("int").alias("source_no"))
    held = held.join(known, held["source"].eqNullSafe(F.col(known_as))).drop(known_as)
    # About as many cells as rows in a cell, in the schedule and in the streams.
    schedule = by_slot.withColumn("cell", F.shiftright("slot", max(6, slots.bit_length() // 2)))
    stream_bits = min(20, max(4, (n_rows or 0).bit_length() // 2))
    ranked = amount_before(schedule, "source_no", "cell", ["slot"], F.lit(1), "block").drop("cell")

    stream = held.where("size > 0").select("source_no", "mix_row", "size", "source_size", "target", F.col(key).alias("key"),
                                           F.shiftright(F.conv(F.substring(key, 1, 5), 16, 10).cast("int"), 20 - stream_bits).alias("cell"))
    placed = amount_before(stream, "source_no", "cell", ["key", "mix_row"], F.col("size"), "start")
    epochs = placed.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(cap)]))).withColumn(
        "start", F.col("start") + F.col("epoch") * F.col("source_size"))
    end = F.col("start") + F.col("size")
    if fill:
        goal = F.ceil("target")
        near = epochs.where(F.col("start") < goal)
        end = F.least(end, goal)
    else:  # blocks far beyond the target have no slot: golden-ratio points stay much closer to it than this
        near = epochs.where(F.col("start") <= F.col("target") * 1.05 + 64 * block_words)
    first, last = F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words)
    blocks = near.withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    begin = F.greatest(F.col("start"), F.col("block") * block_words)
    pieces = blocks.select(
        "source_no", "block", "mix_row", "epoch", (begin - F.col("start")).alias("first_word"),
        (F.least(end, (F.col("block") + 1) * block_words) - begin).alias("n"))
    mixed = pieces.join(ranked, ["source_no", "block"], "left" if fill else "inner")
    late = F.lit(slots).cast("long") + F.col("block") * n_sources + F.col("source_no")  # one number per block, the first blocks first
    mixed = mixed.select(F.coalesce("slot", late).alias("slot"), "mix_row", "epoch", "first_word", "n")
    return held.drop(key), mixed


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Documents of ``mix_plan`` with ``taken``: how many of their words the mix takes, repeats counted."""
    held, mixed = mix_plan(docs.drop("taken"), **options)
    sums = mixed.groupBy("mix_row").agg(F.sum("n").alias("taken"))
    return held.join(sums, "mix_row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).drop("mix_row")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for each epoch in which a document is taken, with the columns of ``docs``.

    A document that the last block of its source cuts through keeps its first words, joined by spaces.
    """
    docs, back = set_aside(docs, ("size", "source_no", "source_size", "target", "mix_row"))
    held, mixed = mix_plan(docs, **options)
    # A source's slots take its blocks from the first one without a gap, so a document's pieces are its first words.
    taken = unused(held, "_taken")
    sums = mixed.groupBy("mix_row", "epoch").agg(F.sum("n").alias(taken)).drop("epoch")
    part = F.array_join(F.slice(words_of(F.col("text")), 1, F.col(taken).cast("int")), " ")
    return back(held.join(sums, "mix_row").withColumn(
        "text", F.when(F.col(taken) == F.col("size"), F.col("text")).otherwise(part)))


