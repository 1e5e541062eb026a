"""Removal of repeated passages by blockwise suffix sorting over a difference cover.

Whether the ``length`` bytes at a place start anywhere else is a question about ties in the order of all suffixes cut to
``length`` bytes.  A difference cover D modulo ``PERIOD`` answers it with a tenth of the suffixes: for any two places
some step of less than ``PERIOD`` bytes leads from both to places of the cover.  So

1. the suffixes at cover places are ranked by their first ``length - PERIOD + 1`` bytes, one bucket of suffixes at a
   time; the rank comes with what stands up to ``PERIOD - 1`` bytes left and right of those bytes;
2. cover suffixes of equal rank and equal surroundings settle all suffixes up to ``PERIOD - 1`` bytes before them at once;
3. where suffixes of equal rank have different surroundings, one suffix per surrounding stands for the rest, and only
   the suffixes before these are sorted to their full ``length``, again one bucket at a time.

Only ties matter, not which of two different suffixes is the smaller, so suffixes are ordered by 64-bit polynomial
hashes of their bytes instead of the bytes: a bucket holds a few bytes per suffix, not the text.

Texts are gathered in chunks of a few megabytes and written once in buckets by chunk.  A chunk sends each bucket its
sorted hashes as one packed row and gets one bit per hash back; both passes over the texts read them where they lie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shared_folder

#: A perfect difference set; every number modulo 91 but 0 is a difference of exactly one pair.
PERIOD = 91
COVER = (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)
#: Text in a chunk and hashes in a bucket; a rank and its surroundings are two hashes.
CHUNK_BYTES, BUCKET_HASHES = 8 << 20, 1 << 20

_BASE = 0x9E3779B97F4A7C15
_RANDOM = np.random.default_rng(91).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))

_TEXTS = "chunk bigint, seq int, doc_id bigint, body binary"
_SENT = "bucket int, chunk bigint, body binary, many binary"
_FLAGS = "chunk bigint, kind int, bucket int, one binary, two binary"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX[0]
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return h ^ (h >> np.uint64(32))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of hashes, in the order of the hashes."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base & (2**64 - 1), np.uint64)
    powers[:1] = 1
    return np.cumprod(powers, dtype=np.uint64)


class Chunk:
    """Texts of one chunk side by side, with hashes of any stretch of them."""

    def __init__(self, table: pa.Table, length: int) -> None:
        order = np.argsort(table["seq"].to_numpy(), kind="stable")
        self.number = table["chunk"][0].as_py()
        self.ids = table["doc_id"].take(pa.array(order)).to_pylist()
        bodies = [table["body"][int(i)].as_buffer() for i in order]
        self.sizes = np.array([len(b) for b in bodies], np.int64)
        self.bytes = np.frombuffer(b"".join(bodies), np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.length, self.rank_length = length, length - PERIOD + 1
        n = len(self.bytes) + 1
        self._sums = np.zeros(n, np.uint64)
        np.cumsum(_RANDOM[self.bytes] * _powers(_BASE, n - 1), out=self._sums[1:])
        self._inverse = _powers(pow(_BASE, -1, 2**64), n)

    def hash(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the stretches from ``first`` up to ``last``."""
        return (self._sums[last] - self._sums[first]) * self._inverse[first]

    def cover(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the cover that have a rank, and the number of their text."""
        text = np.repeat(np.arange(len(self.sizes)), np.where(self.sizes >= self.length, self.sizes - self.rank_length + 1, 0))
        if not len(text):
            return text, text
        counts = np.bincount(text, minlength=len(self.sizes))
        inside = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        in_cover = np.zeros(PERIOD, bool)
        in_cover[list(COVER)] = True
        chosen = in_cover[inside % PERIOD]
        return (inside + self.starts[text])[chosen], text[chosen]

    def ranked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per place of the cover: the place, its text, and its key: rank and surroundings, 64 bits each."""
        place, text = self.cover()
        first = np.maximum(self.starts[text], place - (PERIOD - 1)) if len(place) else place
        last = np.minimum(self.ends[text], place + self.length) if len(place) else place
        rank = _mixed(self.hash(place, place + self.rank_length))
        around = _mixed(self.hash(first, last) ^ _mixed(((place - first) * 1024 + (last - place)).astype(np.uint64)))
        return place, text, np.stack([rank, around])

    def windows_before(self, place: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Marks of all places up to ``PERIOD - 1`` bytes before, where ``length`` bytes fit in the text."""
        marks = np.zeros(len(self.bytes) + 1, np.int32)
        if len(place):
            first = np.maximum(self.starts[text], place - (PERIOD - 1))
            last = np.minimum(place, self.ends[text] - self.length)
            fits = first <= last
            np.add.at(marks, first[fits], 1)
            np.add.at(marks, last[fits] + 1, -1)
        return np.cumsum(marks[:-1]) > 0


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys (a column each) by their first hash, then the next, and marks in that order where a new one begins."""
    order = np.lexsort(key[::-1])
    ranked = key[:, order]
    new = np.ones(len(order), bool)
    new[1:] = (ranked[:, 1:] != ranked[:, :-1]).any(axis=0)
    return order, new


def _send(chunk: int, buckets: int, key: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per bucket: the distinct keys in order, hash after hash, and a bit for each that the chunk has more than once."""
    order, new = _sorted(key)
    at = np.flatnonzero(new)
    many = np.diff(np.append(at, len(order))) > 1
    key = key[:, order[at]]
    bucket = _bucket(key[0], buckets)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    rows = [(int(bucket[a]), chunk, key[:, a:b].tobytes(), np.packbits(many[a:b]).tobytes())
            for a, b in zip([0, *cuts], [*cuts, len(bucket)]) if a < b]
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "chunk", "body", "many"])


def _answers(flags: pa.Table, kind: int, buckets: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits that came back for each key, in the order of ``key``."""
    n = key.shape[1]
    one, two = np.zeros(n, bool), np.zeros(n, bool)
    order, new = _sorted(key)
    index = np.cumsum(new) - 1  # of the distinct keys
    heads = _bucket(key[0, order[new]], buckets)
    a, b = np.zeros(len(heads), bool), np.zeros(len(heads), bool)
    for row in flags.to_pylist():
        if row["kind"] == kind:
            low, high = np.searchsorted(heads, [row["bucket"], row["bucket"] + 1])
            a[low:high] = np.unpackbits(np.frombuffer(row["one"], np.uint8), count=high - low)
            b[low:high] = np.unpackbits(np.frombuffer(row["two"], np.uint8), count=high - low)
    if n:
        one[order], two[order] = a[index], b[index]
        # Of equal keys only the first place stands for the others.
        first = np.zeros(n, bool)
        first[order[new]] = True
        two &= first
    return one, two


def _sort_bucket(kind: int):
    def sort(table: pa.Table) -> pa.Table:
        """Sorts one bucket of suffixes and tells each chunk about its own.

        Kind 0, ranks (two hashes each): bit one says that rank and surroundings both occur twice; bit two that the rank has several
        surroundings and that this is the suffix which stands for its own.  Kind 1, whole suffixes (one hash): bit one
        says that the suffix occurs twice.
        """
        bodies = [np.frombuffer(b.as_buffer(), np.uint64).reshape(2 - kind, -1) for b in table["body"]]
        sizes = np.array([b.shape[1] for b in bodies])
        many = np.concatenate([np.unpackbits(np.frombuffer(m.as_buffer(), np.uint8), count=n) for m, n in zip(table["many"], sizes)]).astype(bool)
        key = np.concatenate(bodies, axis=1)
        order, new = _sorted(key)
        group = np.cumsum(new) - 1
        twice = (np.bincount(group) + np.bincount(group, many[order])) > 1
        one, two = np.zeros(len(order), bool), np.zeros(len(order), bool)
        one[order] = twice[group]
        if kind == 0:
            heads = key[0, order[new]]
            tied = np.zeros(len(heads), bool)
            tied[1:] = heads[1:] == heads[:-1]
            tied[:-1] |= tied[1:].copy()
            two[order] = tied[group] & new
        rows = []
        at = 0
        for chunk, bucket, n in zip(table["chunk"].to_pylist(), table["bucket"].to_pylist(), sizes):
            if one[at:at + n].any() or two[at:at + n].any():
                rows.append((chunk, kind, bucket, np.packbits(one[at:at + n]).tobytes(), np.packbits(two[at:at + n]).tobytes()))
            at += n
        types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.Table.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["chunk", "kind", "bucket", "one", "two"])

    return sort


def _gather(chunk_bytes: int):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers the texts of a partition by chunk."""
        from pyspark import TaskContext

        chunk, seq, held = TaskContext.get().partitionId() << 24, 0, 0
        for batch in batches:
            sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(1)]
            chunks, seqs = [], []
            for size in sizes:
                if held and held + size > chunk_bytes:
                    chunk, seq, held = chunk + 1, 0, 0
                chunks.append(chunk)
                seqs.append(seq)
                seq, held = seq + 1, held + size
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunks, pa.int64()), pa.array(seqs, pa.int32()), batch.column(0), batch.column(1)], ["chunk", "seq", "doc_id", "body"])

    return gather


def _sent(batches: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(batches, pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("body", pa.binary()), ("many", pa.binary())]))


def _emit_ranks(length: int, buckets: int):
    def emit(texts: pa.Table) -> pa.Table:
        chunk = Chunk(texts, length)
        return _sent(list(_send(chunk.number, buckets, chunk.ranked()[2])))

    return emit


def _emit_windows(length: int, buckets: int):
    def emit(texts: pa.Table, flags: pa.Table) -> pa.Table:
        rows: list[pa.RecordBatch] = []
        if texts.num_rows and flags.num_rows:
            chunk = Chunk(texts, length)
            place, text, key = chunk.ranked()
            _, stands = _answers(flags, 0, buckets, key)
            at = np.flatnonzero(chunk.windows_before(place[stands], text[stands]))
            whole = _mixed(chunk.hash(at, at + length))
            rows = list(_send(chunk.number, buckets, whole[None]))
        return _sent(rows)

    return emit


def _remove(length: int, buckets: int, keep: bool):
    def remove(texts: pa.Table, flags: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        if not texts.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in types], names)
        chunk = Chunk(texts, length)
        covered = np.zeros(len(chunk.bytes) + 1, bool)
        if flags.num_rows:
            place, text, key = chunk.ranked()
            settled, stands = _answers(flags, 0, buckets, key)
            repeated = chunk.windows_before(place[settled], text[settled])
            at = np.flatnonzero(chunk.windows_before(place[stands], text[stands]))
            whole = _mixed(chunk.hash(at, at + length))
            repeated[at] |= _answers(flags, 1, buckets, whole[None])[0]
            begins = np.zeros(len(covered), np.int32)
            hit = np.flatnonzero(repeated)
            np.add.at(begins, hit, 1)
            np.add.at(begins, hit + length, -1)
            covered = np.cumsum(begins) > 0
        rows = []
        for doc, first, last in zip(chunk.ids, chunk.starts.tolist(), chunk.ends.tolist()):
            gone = covered[first:last]
            edges = np.diff(gone.astype(np.int8))
            body = chunk.bytes[first:last][~gone].tobytes()
            rows.append((doc, last - first, int(gone.sum()), int((edges == 1).sum()) + bool(len(gone) and gone[0]),
                         hashlib.sha256(body).hexdigest(), body if keep else None))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return remove


def remove_repeats(docs: DataFrame, length: int = 200, keep: bool = False, chunk_bytes: int = CHUNK_BYTES,
                   bucket_hashes: int = BUCKET_HASHES) -> DataFrame:
    """Per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if asked, ``kept`` (bytes).

    Removed is every byte inside ``length`` bytes that also start anywhere else, in the same or another text (UTF-8; NULL
    is empty); matches end with their text, overlapping matches count, and all is judged on the input.  Whole copies
    of a text of ``length`` bytes or more therefore lose everything.  Repeated rows are texts of their own, so they
    remove each other; an empty frame gives no rows; other columns are not read.  ``length`` must be over ``PERIOD`` + 16.

    Memory: a task holds one chunk (``chunk_bytes`` of text, or one longer text) or one bucket (about ``bucket_hashes``
    hashes).  The number of buckets follows the amount of text.  A hash repeated in a chunk is sent once, so copies of
    one text, however many, put at most one entry per chunk into a bucket.  Ranks tie by 64 bits of hash, surroundings
    of equal rank by another 64, whole suffixes by 64 of their own.  Intermediate tables lie in the shared folder; the text is written there once.
    """
    if length <= PERIOD + 16:
        raise ValueError(f"length must be over {PERIOD + 16}")
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, -(-2 * size * len(COVER) // (PERIOD * bucket_hashes)))
    scan = plain.mapInArrow(_gather(chunk_bytes), _TEXTS)
    name = f"texts_{uuid4().hex}"
    parts = max(8, min(4096, -(-size // (2 * chunk_bytes))))
    scan.write.bucketBy(parts, "chunk").option("compression", "zstd").option("path", shared_folder(spark, "texts")).saveAsTable(name)
    texts = spark.table(name)

    by_chunk = texts.groupBy("chunk")
    sent = by_chunk.applyInArrow(_emit_ranks(length, buckets), _SENT)
    ranks = materialize(sent.groupBy("bucket").applyInArrow(_sort_bucket(0), _FLAGS), "ranks")
    windows = by_chunk.cogroup(ranks.groupBy("chunk")).applyInArrow(_emit_windows(length, buckets), _SENT)
    ties = materialize(windows.groupBy("bucket").applyInArrow(_sort_bucket(1), _FLAGS), "ties")
    flags = ranks.unionByName(ties)
    out = by_chunk.cogroup(flags.groupBy("chunk")).applyInArrow(
        _remove(length, buckets, keep), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    spark.sql(f"DROP TABLE {name}")  # the plan keeps reading the files
    return out if keep else out.drop("kept")
