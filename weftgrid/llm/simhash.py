"""SimHash near-dedup by tiled exact comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import small_batches, unused
from .components import components

#: Shingles hashed at once, and fingerprint pairs compared at once.
_SHINGLES, _PAIRS = 1 << 16, 1 << 21
#: Words of a fingerprint whose set bits are counted for its cell, and their width in bits.
_PARTS, _WIDTH = 4, 16
#: Fingerprints in one tile.
TILE = 1024


def fingerprint_of(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Majority of the bits of the XXH64 of every ``width``-word shingle; 0 for a text without words."""
    words = (text or "").encode().lower().split()  # bytes.lower and bytes.split know ASCII only, as asked
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1:]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), _SHINGLES):
        spans = zip(starts[at:at + _SHINGLES].tolist(), ends[at:at + _SHINGLES].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, width: int = 3, seed: int = 42) -> Column:
    """SimHash of a text as a signed 64-bit number."""
    @F.arrow_udf(T.LongType())
    def hashed(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint_of(t.as_py(), width, seed) for t in texts), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return hashed(text)


def _cell(number: Column) -> Column:
    """Counts of set bits in each part of the fingerprint, as one number."""
    counts = [F.bit_count(F.shiftright(number, _WIDTH * i).bitwiseAND(F.lit((1 << _WIDTH) - 1))) for i in range(_PARTS)]
    packed = counts[0].cast("int")
    for c in counts[1:]:
        packed = packed * 32 + c.cast("int")
    return packed


def neighbour_steps(radius: int) -> list[int]:
    """Differences between packed cells whose counts differ by at most ``radius`` in total; one of each pair +d, -d.

    A flipped bit changes one count by one, so fingerprints in cells further apart differ in more than ``radius`` bits.
    """
    steps = []
    for move in product(range(-radius, radius + 1), repeat=_PARTS):
        if sum(map(abs, move)) <= radius and move >= (0,) * _PARTS:
            packed = 0
            for m in move:
                packed = packed * 32 + m
            steps.append(packed)
    return steps


def _tiles(size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by cell become tiles of one cell with at most ``size`` fingerprints."""
        held, cell, chunk = np.empty(0, np.int64), None, 0

        def tile(values: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "cell": pa.array([cell], pa.int32()), "chunk": pa.array([chunk], pa.int32()),
                "tile": pa.array([values.tobytes()], pa.binary())})

        for batch in batches:
            cells, values = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            bounds = np.flatnonzero(np.diff(cells)) + 1
            for a, b in zip([0, *bounds], [*bounds, len(cells)]):
                if a == b:
                    continue
                if cells[a] != cell:
                    if len(held):
                        yield tile(held)
                    held, cell, chunk = np.empty(0, np.int64), int(cells[a]), 0
                held = np.concatenate([held, values[a:b]])
                while len(held) > size:
                    yield tile(held[:size])
                    held, chunk = held[size:], chunk + 1
        if len(held):
            yield tile(held)

    return cut


def near(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``left`` and ``right`` of all pairs that differ in at most ``radius`` bits."""
    left, right = left.view(np.uint64), right.view(np.uint64)  # bits are counted of the absolute value
    rows, columns, step = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], max(1, _PAIRS // max(1, len(left)))
    for at in range(0, len(right), step):
        i, j = np.nonzero(np.bitwise_count(left[:, None] ^ right[None, at:at + step]) <= radius)
        rows.append(i)
        columns.append(j + at)
    return np.concatenate(rows), np.concatenate(columns)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between ``a`` and ``b`` as (node, smallest node of its group): the same groups, fewer links."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        root = root[root]
        if (root == before).all():
            break
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _compare(radius: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of tiles to links; neighbouring rows with the same left tile are compared at once."""
        for batch in batches:
            cells, chunks, same = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            lefts, rights = batch.column(3), batch.column(4)
            bounds = np.flatnonzero((np.diff(cells) != 0) | (np.diff(chunks) != 0)) + 1
            found = []
            for a, b in zip([0, *bounds], [*bounds, len(cells)]):
                if a == b:
                    continue
                left = np.frombuffer(lefts[int(a)].as_buffer(), np.int64)
                right = np.concatenate([np.frombuffer(rights[r].as_buffer(), np.int64) for r in range(a, b) if not same[r]] or [left[:0]])
                i, j = near(left, right, radius)
                x, y = left[i], right[j]
                if same[a:b].any():
                    i, j = near(left, left, radius)
                    x, y = np.concatenate([x, left[i[i < j]]]), np.concatenate([y, left[j[i < j]]])
                if len(x):
                    found.append(forest(x, y))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], ["a", "b"])

    return links


def near_links(prints: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` whose groups are those of all fingerprints at most ``radius`` bits apart.

    ``prints`` has one row per distinct ``fingerprint``.  Fingerprints are dealt into cells by the counts of set bits in
    four 16-bit parts and cut into tiles; only tiles of cells whose counts differ by at most ``radius`` meet.  Tiles of
    one cell are rows of an inner join, so a crowded cell is split by adaptive execution.
    """
    tiles = materialize(
        prints.select(_cell(F.col("fingerprint")).alias("cell"), "fingerprint")
        .repartition("cell").sortWithinPartitions("cell")
        .mapInArrow(_tiles(tile), "cell int, chunk int, tile binary"), "tiles")
    steps = F.array(*[F.lit(s) for s in neighbour_steps(radius)])
    moved = tiles.select(
        F.explode(F.transform(steps, lambda s: F.col("cell") + s)).alias("cell"), F.col("cell").alias("home"),
        F.col("chunk").alias("other"), F.col("tile").alias("right"))
    met = tiles.join(moved, "cell").where("home <> cell OR chunk <= other").select(
        "cell", "chunk", F.expr("home = cell AND chunk = other").alias("same"), "tile", "right")
    return met.mapInArrow(_compare(radius), "a bigint, b bigint")


def near_groups(docs: DataFrame, width: int = 3, radius: int = 3, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (all columns, or those in ``keep``) with ``fingerprint`` (signed 64 bits), ``component_id`` and ``first``.

    Documents link when their fingerprints differ in at most ``radius`` bits; ``component_id`` is the smallest doc_id in
    reach, and ``first`` is true for exactly one row of each component, one that has that doc_id.  Equal
    texts are one fingerprint before any comparison, so groups of copies cost nothing more.  NULL and empty texts have fingerprint 0, which links like any
    other; a component without a doc_id has NULL.  An empty frame gives no rows.  Columns of these names are replaced.
    """
    small_batches(docs.sparkSession)
    plain = docs.drop("fingerprint", "component_id", "first")
    row = unused(plain, "_row")
    held = materialize(plain.select(
        *(keep or plain.columns), fingerprint(F.col("text"), width, seed).alias("fingerprint"),
        F.monotonically_increasing_id().alias(row)), "prints")
    return group_prints(held, row, radius)


def group_prints(held: DataFrame, row: str, radius: int = 3) -> DataFrame:
    """``held`` (``doc_id``, ``fingerprint``, a unique row number) with ``component_id`` and ``first``; drops the number."""
    # A doc_id comes before NULL, and the row number settles the rest.
    head = unused(held, "_head")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("doc_id"), F.col(row).alias("row"))).alias("best")
    classes = materialize(held.groupBy("fingerprint").agg(best), "classes")
    stars = components(near_links(classes.select("fingerprint"), radius))
    rooted = classes.join(stars, classes["fingerprint"] == stars["node"], "left").select(
        "fingerprint", "best", F.coalesce("root", "fingerprint").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("best").alias(head))
    known = rooted.select("fingerprint", "root").join(heads, "root").select("fingerprint", head)
    return held.join(known, "fingerprint").withColumns({
        "component_id": F.col(head)["doc_id"], "first": F.col(row) == F.col(head)["row"]}).drop(head, row)
