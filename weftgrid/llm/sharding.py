"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import amount_before, unused


def hypergeometric(marked: int, others: int, drawn: int, rng: np.random.Generator) -> int:
    """How many of ``drawn`` items taken without replacement are marked, for populations of any size.

    Inversion of the distribution within 14 standard deviations of its mode; the mass beyond is under 1e-40.
    """
    least, most = max(0, drawn - others), min(marked, drawn)
    if least == most:
        return least
    everything = marked + others
    mode = (drawn + 1) * (marked + 1) // (everything + 2)
    spread = math.sqrt(drawn * (marked / everything) * (others / everything)) + 2
    least, most = max(least, int(mode - 14 * spread)), min(most, int(mode + 14 * spread))
    k = np.arange(least, most, dtype=np.float64)
    steps = np.log(marked - k) + np.log(drawn - k) - np.log(k + 1) - np.log(others - drawn + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return least + int(np.searchsorted(mass, rng.random() * mass[-1], side="right").clip(0, len(mass) - 1))


def communication_matrix(sizes: list[int], shards: int, seed: int) -> np.ndarray:
    """Row i, column j: how many items of block i a uniform permutation sends to shard j.

    Columns sum to the shard sizes (at most one apart), rows to ``sizes``.
    """
    total = sum(sizes)
    left = [total // shards + (j < total % shards) for j in range(shards)]
    rng = np.random.default_rng(seed)
    matrix = np.zeros((len(sizes), shards), dtype=np.int64)
    for i, need in enumerate(sizes):
        after = sum(left)
        for j in range(shards):
            after -= left[j]
            matrix[i, j] = take = hypergeometric(left[j], after, need, rng) if need else 0
            left[j] -= take
            need -= take
        # ``after`` is 0 for the last shard, which takes the rest exactly.
    return matrix


def shuffle_to_shards(df: DataFrame, shards: int, seed: int = 17, blocks: int = 1024, cells: int = 64) -> DataFrame:
    """Every row of ``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    Shard sizes are at most one apart and every arrangement of the rows is meant to be equally likely.  Input
    partitions are gathered in at most ``blocks`` blocks; the driver draws the matrix of ``blocks`` x ``shards``
    counts from the block sizes; each block is permuted and dealt out by its row of the matrix; each shard is
    permuted again, in ``cells`` cells so that no task holds a whole shard.  All keys are hashes of a row number
    that is written with the rows first, so a lost executor recomputes the same shards.

    Rows are never looked into: NULLs, equal rows and very long values are dealt like any other; an empty frame
    gives no rows.  Columns named ``shard`` or ``slot`` are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    plain = df.drop("shard", "slot")
    row, block, rank, bounds, cell = (unused(plain, n) for n in ("_row", "_block", "_rank", "_bounds", "_cell"))
    held = materialize(plain.withColumn(row, F.monotonically_increasing_id()), "rows")
    # The upper bits of the row number are the partition that it was read in.
    held = held.withColumn(block, F.pmod(F.shiftright(row, 33), F.lit(blocks)).cast("int"))
    sizes = {r[0]: r[1] for r in held.groupBy(block).count().collect()}  # at most ``blocks`` rows
    matrix = communication_matrix([sizes[b] for b in sorted(sizes)], shards, seed)
    dealt = df.sparkSession.createDataFrame(
        [(int(b), [int(x) for x in counts.cumsum()]) for b, counts in zip(sorted(sizes), matrix)],
        f"{block} int, {bounds} array<bigint>")
    permuted = Window.partitionBy(block).orderBy(F.xxhash64(F.lit(seed), row), row)
    placed = (
        held.withColumn(rank, F.row_number().over(permuted))
        .join(F.broadcast(dealt), block)  # blocks x shards numbers
        .withColumn("shard", F.size(F.filter(bounds, lambda b: b < F.col(rank))).cast("int"))
        .withColumn(cell, F.pmod(F.xxhash64(F.lit(seed + 1), row), F.lit(cells)).cast("int"))
        .drop(block, rank, bounds))
    order = [F.xxhash64(F.lit(seed + 2), row), F.col(row)]
    return amount_before(placed, "shard", cell, order, F.lit(1), "slot").drop(row, cell)
