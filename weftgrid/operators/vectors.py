"""Word vectors without a vocabulary on the driver: association of words, then a randomised factorisation.

The matrix of positive pointwise mutual information lies in blocks of bounded size, written once; it
is multiplied with thin tables of one row per word.  The driver only sees matrices of
dimension times dimension (Halko, Martinsson and Tropp, 2011).
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgrid.functions.rows import explode_column
from weftgrid.operators.ranking import global_rank
from weftgrid.session import delete_written, materialize, written_folders

# The functions of this module travel with the query; executors need not have the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 5        # words to each side that count as context
MIN_COUNT = 5     # least number of contexts of a word
EXTRA = 8         # dimensions carried beyond those asked for
ROUNDS = 3        # power iterations
BLOCK_CELLS = 1 << 21  # cells of a block of the matrix, about
CHUNK = 1 << 20   # tokens whose pairs are counted at once
_TINY = 1e-10     # directions with a smaller share of the greatest one are nothing but rounding


def _half_pairs(df: DataFrame, column: str, window: int) -> DataFrame:
    """``(a, b, n)``, the lesser word first: how often two tokens stand at most ``window`` apart; a word beside itself counts twice.

    Pairs are made inside the row and counted before the shuffle.
    """
    t = F.coalesce(F.col(column), F.array().cast("array<string>"))

    def apart(step: Column) -> Column:
        n = F.greatest(F.size(t) - step, F.lit(0))
        return F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, step + 1, n), lambda a, b: F.struct(
            F.when(a <= b, a).otherwise(b).alias("a"), F.when(a <= b, b).otherwise(a).alias("b")))

    pairs = explode_column(df, [], F.flatten(F.transform(F.sequence(F.lit(1), F.lit(window)), apart)), "p")
    times = F.when(F.col("a") == F.col("b"), 2).otherwise(1)
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n")).withColumn("n", F.col("n") * times)


def _both_ways(half: DataFrame) -> DataFrame:
    """``(term, context, ...)`` of ``(a, b, ...)``: no shuffle, since no pair is there twice."""
    rest = [c for c in half.columns if c not in ("a", "b")]
    turned = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = explode_column(half, rest, F.when(F.col("a") == F.col("b"), F.slice(turned, 1, 1)).otherwise(turned), "p")
    return both.select(F.col("p.a").alias("term"), F.col("p.b").alias("context"), *rest)


def word_pairs(df: DataFrame, column: str, window: int = WINDOW) -> DataFrame:
    """``(term, context, n)``: how often two tokens stand at most ``window`` apart, in both directions."""
    return _both_ways(_half_pairs(df, column, window))


def _contexts(df: DataFrame, column: str, window: int) -> DataFrame:
    """``(term, c)``: how many tokens stand at most ``window`` apart from one of the word, by the places of its tokens."""
    own = F.transform(F.col(column), lambda w, i: F.struct(
        w.alias("term"), (F.least(i, F.lit(window)) + F.least(F.size(column) - 1 - i, F.lit(window))).cast("long").alias("c")))
    return explode_column(df, [], own, "w").groupBy("w.term").agg(F.sum("w.c").alias("c"))


def word_associations(df: DataFrame, column: str, window: int = WINDOW, min_count: int = MIN_COUNT) -> DataFrame:
    """``(term, context, n, weight)`` with a positive weight: the log of how much more often than by chance.

    Words with fewer than ``min_count`` contexts are left out, of the totals too; a token's contexts follow from its place
    in the row, before any pair is made.  A frequent word has one row per context, and only the pairs, shuffled in
    one direction, can be skewed in the joins.
    """
    contexts = _contexts(df, column, window)
    kept = materialize(contexts.where(F.col("c") >= min_count).select("term"), "words-kept")
    half = _half_pairs(df, column, window).join(kept.toDF("a"), "a").join(kept.toDF("b"), "b")
    half = materialize(half.select("a", "b", "n"), "word-pairs")
    sums = materialize(_both_ways(half).groupBy("term").agg(F.sum("n").cast("double").alias("c")), "word-sums")
    total = sums.agg(F.sum("c")).scalar()
    met = half.join(sums.toDF("a", "c1"), "a").join(sums.toDF("b", "c2"), "b")
    weighted = met.withColumn("weight", F.ln(F.col("n") * total / (F.col("c1") * F.col("c2")))).where("weight > 0")
    return _both_ways(weighted.select("a", "b", "n", "weight"))


def _names(width: int) -> list[str]:
    return [f"y{i}" for i in range(width)]


def _numbered(df: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """``(row, pos, id)`` of every token, the rows in one piece; ``id`` is -1 for a token that ``words`` does not have."""
    tokens = explode_column(
        df.withColumn("_row", F.monotonically_increasing_id()), ["_row"], F.transform(F.col(column), lambda w: F.struct(w.alias("term"))), "w", "pos")
    met = tokens.select(F.col("_row").alias("row"), "pos", "w.term").join(words.select("term", "id"), "term", "left")
    return met.select("row", "pos", F.coalesce("id", F.lit(-1)).alias("id")).repartition("row").sortWithinPartitions("row", "pos")


def _pair_blocks(tokens: DataFrame, window: int, number: int) -> DataFrame:
    """``(block, ids, c, left, right, n)``, one row per block: how often its pairs of words stand at most ``window`` apart, as for
    ``word_pairs`` but once for both directions; the words of a block are its places in ``ids``, ``c`` are their contexts in it.

    A pair lies in the block of its rarer word, the one of the greater id, so that the many rare words are each in few
    blocks and only frequent ones in most.  Pairs are counted over many rows before the shuffle.
    """
    chunk = CHUNK

    def counted(row: np.ndarray, word: np.ndarray) -> pa.RecordBatch:
        found = []
        for step in range(1, min(window, len(row) - 1) + 1):
            a, b = word[:-step], word[step:]
            met = (row[:-step] == row[step:]) & (a >= 0) & (b >= 0)
            a, b = a[met], b[met]
            found.append((np.maximum(a, b) << 32) | np.minimum(a, b))
        pairs, n = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *found]), return_counts=True)
        n[pairs >> 32 == pairs & 0xFFFFFFFF] *= 2
        block = ((pairs >> 32) * 2654435761 & 0xFFFFFFFF) * number >> 32
        order = np.argsort(block.astype(np.uint16) if number <= 1 << 16 else block, kind="stable")
        found, starts = np.unique(block[order], return_index=True)
        # Whole runs of pairs are a row each: they cost far less than rows of their own.
        parts = [order[i:j] for i, j in zip(starts, [*starts[1:], len(order)])]
        return pa.RecordBatch.from_arrays([
            pa.array(found.astype(np.int32)), pa.array([pairs[x].tobytes() for x in parts], pa.binary()),
            pa.array([n[x].astype(np.int32).tobytes() for x in parts], pa.binary())], ["block", "pairs", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, words, held = [], [], 0
        for batch in batches:
            rows.append(batch.column("row").to_numpy())
            words.append(batch.column("id").to_numpy().astype(np.int64))
            held += len(rows[-1])
            if held >= chunk:
                row, word = np.concatenate(rows), np.concatenate(words)
                cut = int(np.searchsorted(row, row[-1]))  # the last row may go on in the next batch
                if cut:
                    yield counted(row[:cut], word[:cut])
                rows, words, held = [row[cut:]], [word[cut:]], len(row) - cut
        if held:
            yield counted(np.concatenate(rows), np.concatenate(words))

    def pack(pairs: pa.Table) -> pa.Table:
        held, times = (np.concatenate([np.frombuffer(x, kind) for x in pairs.column(c).to_pylist()]) for c, kind in (("pairs", np.int64), ("n", np.int32)))
        order = np.argsort(held, kind="stable")  # merges the sorted runs
        held = held[order]
        starts = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
        keys, n = held[starts], np.add.reduceat(times[order].astype(np.float64), starts)  # whole numbers, exact up to 2^53
        high, low = keys >> 32, keys & 0xFFFFFFFF
        ids = np.unique(np.concatenate([high, low]))
        left, right = (np.searchsorted(ids, x).astype(np.int32) for x in (high, low))
        contexts = np.bincount(left, n, len(ids)) + np.bincount(right, np.where(left == right, 0, n), len(ids))
        return pa.table({
            "block": pa.array([pairs.column("block")[0].as_py()], pa.int32()), "ids": pa.array([ids.astype(np.int32)], pa.list_(pa.int32())),
            "c": pa.array([contexts], pa.list_(pa.float64())),
            **{c: pa.array([x.tobytes()], pa.binary()) for c, x in (("left", left), ("right", right), ("n", n))}})

    pairs = tokens.mapInArrow(count, "block int, pairs binary, n binary")
    return materialize(pairs.groupBy("block").applyInArrow(
        pack, "block int, ids array<int>, c array<double>, left binary, right binary, n binary"), "pair-blocks")


def _times(blocks: DataFrame, held: DataFrame, width: int, total: float) -> DataFrame:
    """The association matrix times a thin table, given by block and place: each block is multiplied in one task, its sums are added by word.

    Words without an association have no row.
    """
    names = _names(width)

    def multiply(thin: pa.Table, cells: pa.Table) -> pa.Table:
        place = thin.column("place").to_numpy()
        left, right, n = (np.frombuffer(cells.column(c)[0].as_buffer(), kind) for c, kind in (("left", np.int32), ("right", np.int32), ("n", np.float64)))
        x = np.full(max(left.max(), right.max()) + 1, np.inf)  # words that are not held have no association
        x[place] = thin.column("c").to_numpy()
        ratio = n * total / (x[left] * x[right])
        left, right, weight = left[ratio > 1], right[ratio > 1], np.log(ratio[ratio > 1])
        turned = np.where(left == right, 0.0, weight)  # a word beside itself is one cell
        met = np.zeros(len(x), dtype=bool)
        met[left] = met[right] = True
        met, out = met[place], {}
        for name in names:
            x[:] = 0
            x[place] = thin.column(name).to_numpy()
            y = np.bincount(left, weight * x[right], len(x)) + np.bincount(right, turned * x[left], len(x))
            out[name] = y[place][met]
        return pa.table({"id": thin.column("id").filter(pa.array(met)), **out})

    kinds = ", ".join(["id int", *[f"{y} double" for y in names]])
    cells, met = blocks.select("block", "left", "right", "n"), held.select("block", "place", "id", "c", *names)
    sums = met.groupBy("block").cogroup(cells.groupBy("block")).applyInArrow(multiply, kinds)
    return sums.groupBy("id").agg(*[F.sum(y).alias(y) for y in names])


def _inner(left: list[str], right: list[str], thin: DataFrame) -> np.ndarray:
    """Matrix of the sums of products of the columns: one part per partition, added up by place."""
    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(left), len(right)))
        for batch in batches:
            total += batch[left].to_numpy().T @ batch[right].to_numpy()
        yield pd.DataFrame({"place": np.arange(total.size), "x": total.ravel()})

    sums = thin.select(*left, *[c for c in right if c not in left]).mapInPandas(products, "place int, x double")
    out = np.zeros(len(left) * len(right))
    for place, x in sums.groupBy("place").agg(F.sum("x")).collect():  # dimension times dimension rows
        out[place] = x
    return out.reshape(len(left), len(right))


def _turned(thin: DataFrame, by: np.ndarray) -> DataFrame:
    names, made = _names(by.shape[0]), _names(by.shape[1])

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame(batch[names].to_numpy() @ by, columns=made)
            out.insert(0, "id", batch["id"].to_numpy())
            yield out

    return thin.mapInPandas(turn, ", ".join(["id int", *[f"{y} double" for y in made]]))


def _orthogonal(thin: DataFrame, width: int) -> tuple[DataFrame, int]:
    """The same span with columns of length one at right angles; empty directions go."""
    names = _names(width)
    values, vectors = np.linalg.eigh(_inner(names, names, thin))
    real = values > _TINY * max(values.max(), 0)
    by = vectors[:, real] / np.sqrt(values[real])
    return _turned(thin, by), by.shape[1]


def word_vectors(df: DataFrame, column: str, size: int = 16, window: int = WINDOW, min_count: int = MIN_COUNT,
                 rounds: int = ROUNDS, seed: int = 42) -> DataFrame:
    """``(term, vector)``: words that keep the same company get similar vectors of ``size`` numbers.

    ``column`` holds tokens.  Any number of words; but for rounding the result does not
    depend on the partitioning.  A corpus without associations has no vectors; where there
    are fewer positive directions than ``size``, zeros follow.
    """
    contexts = materialize(_contexts(df, column, window).where((F.col("c") >= min_count) & F.col("term").isNotNull()), "words-kept")
    ranked = global_rank(contexts, [F.desc("c"), F.asc("term")], "rank")
    names = materialize(ranked.select("term", (F.col("rank") - 1).cast("int").alias("id")), "word-numbers")
    # Every pair is counted with either word, and some half of them are repeats.
    pairs = (contexts.agg(F.sum("c")).first()[0] or 0) / 2
    blocks = _pair_blocks(_numbered(df, column, names), window, max(1, math.ceil(pairs / (2 * BLOCK_CELLS))))
    words = explode_column(blocks, ["block"], F.arrays_zip("ids", "c"), "w", "place").select("block", "place", "w.ids", "w.c").toDF("block", "place", "id", "part")
    sums = materialize(words.groupBy("id").agg(F.sum("part").alias("c")), "word-sums")
    total = sums.agg(F.sum("c")).first()[0] or 0.0
    words = materialize(words.drop("part").join(sums, "id"), "block-words")

    width = size + EXTRA
    signs = [F.when(F.xxhash64("term", F.lit(seed + i)) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0)).alias(y) for i, y in enumerate(_names(width))]
    thin = materialize(_times(blocks, words.join(names.select("id", *signs), "id"), width, total), "thin")
    if thin.isEmpty():
        return names.limit(0).select("term", F.array().cast("array<double>").alias("vector"))
    for _ in range(rounds):
        last = written_folders(df.sparkSession)[-1]
        basis, width = _orthogonal(thin, width)
        thin = materialize(_times(blocks, words.join(basis, "id"), width, total), "thin")
        delete_written(df.sparkSession, [last])  # the table that this one was made from is not read again
    basis, width = _orthogonal(thin, width)
    image = _times(blocks, words.join(basis, "id"), width, total).toDF("id", *[f"z{i}" for i in range(width)])
    core = _inner(_names(width), [f"z{i}" for i in range(width)], basis.join(image, "id"))
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    best = [i for i in np.argsort(-values)[:size] if values[i] > _TINY * abs(values).max()]
    vectors = vectors[:, best] * np.sign(vectors[np.abs(vectors[:, best]).argmax(axis=0), best])
    made = _turned(basis, vectors * np.sqrt(values[best]))
    rest = [F.lit(0.0)] * (size - len(best))
    return made.join(names, "id").select("term", F.array(*[F.col(f"y{i}") for i in range(len(best))], *rest).alias("vector"))
