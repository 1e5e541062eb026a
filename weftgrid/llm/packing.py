"""Token ids packed into rows of fixed length by best fit decreasing."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Remembered pieces per task.
_REMEMBERED = 300_000

SCHEMA = ("input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<bigint>, rows array<bigint>, "
          "starts array<int>, n_tokens int")


class Encoder:
    """Byte-pair encoder that remembers the ids of what stands between single spaces.

    The pattern starts a new piece at a space between two characters that are not white space, whatever stands around
    it, so such parts of a text can be encoded one by one.
    """

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN) -> None:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()

    def __call__(self, text: str) -> np.ndarray:
        parts = text.split(" ")
        # White space beside a space belongs to one piece with it: then the text is encoded as it is.
        if any(not p or p[0].isspace() or p[-1].isspace() for p in parts):
            return np.frombuffer(self.whole(text), "<u4")
        known, out = self.known, [self.whole(parts[0])]
        for part in parts[1:]:
            ids = known.get(part)
            if ids is None:
                ids = self.whole(" " + part)
                if len(known) < _REMEMBERED and len(part) < 64:
                    known[part] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), "<u4")


class CapacityTree:
    """Rows by free space, in a segment tree over the capacities 0 to ``most``."""

    def __init__(self, most: int) -> None:
        self.base = 1 << most.bit_length()
        self.some = bytearray(2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        at = self.base + capacity
        while at and not self.some[at]:
            self.some[at] = 1
            at //= 2

    def take(self, size: int) -> tuple[int, int] | None:
        """Capacity and number of a row with the least free space of at least ``size``; None if no row has it."""
        at = self.base + size
        if not self.some[at]:
            # Up to the first ancestor with a non-empty right sibling, then down its left edge.
            while at > 1 and (at & 1 or not self.some[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.base:
                at = 2 * at if self.some[2 * at] else 2 * at + 1
        capacity = at - self.base
        row = self.rows[capacity].pop()
        if not self.rows[capacity]:
            self.some[at] = 0
            at //= 2
            while at and not (self.some[2 * at] or self.some[2 * at + 1]):
                self.some[at] = 0
                at //= 2
        return capacity, row


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Places of ``sizes`` (1 to ``length``) by row: largest first, each in the fullest row that still takes it."""
    tree, rows = CapacityTree(length), []
    for place in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[place])
        if found is None:
            rows.append([])
            found = length, len(rows) - 1
        rows[found[1]].append(place)
        tree.add(found[0] - sizes[place], found[1])
    return rows


def _pack(vocabulary: Callable[[], bytes], length: int, end_id: int | None, pad_id: int, window: int, id_type: str):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary())
        pieces: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, row, first token, ids
        held = 0

        def flush() -> pa.RecordBatch:
            columns: dict[str, list] = {name.split()[0]: [] for name in SCHEMA.split(", ")}
            for places in best_fit_decreasing([len(p[3]) for p in pieces], length):
                ids, positions, cuts = np.full(length, pad_id, id_type), np.zeros(length, "<u2"), [0]
                for place in places:
                    values = pieces[place][3]
                    ids[cuts[-1]:cuts[-1] + len(values)] = values
                    positions[cuts[-1]:cuts[-1] + len(values)] = np.arange(len(values))
                    cuts.append(cuts[-1] + len(values))
                columns["input_ids"].append(ids.tobytes())
                columns["position_ids"].append(positions.tobytes())
                columns["cu_seqlens"].append(cuts)
                columns["doc_ids"].append([pieces[p][0] for p in places])
                columns["rows"].append([pieces[p][1] for p in places])
                columns["starts"].append([pieces[p][2] for p in places])
                columns["n_tokens"].append(cuts[-1])
            pieces.clear()
            types = (pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns.values(), types)], list(columns))

        for batch in batches:
            for doc, text, row in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                ids = encode(text.as_py() or "")
                if not len(ids):
                    continue
                if end_id is not None:
                    ids = np.append(ids, np.uint32(end_id))
                for at in range(0, len(ids), length):
                    pieces.append((doc, row, at, ids[at:at + length].astype(id_type)))
                    held += len(pieces[-1][3])
                    if held >= window:
                        yield flush()
                        held = 0
        if pieces:
            yield flush()
        encode.known.clear()
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    return packed


def pack_tokens(docs: DataFrame, length: int = 2048, tokenizer: str = TOKENIZER, end_id: int | None = 50256, pad_id: int = 50256,
                window: int = 2 << 20) -> DataFrame:
    """Packed rows of ``length`` token ids.

    ``input_ids`` holds little-endian ids, two bytes each where the vocabulary and the two extra ids fit, else four,
    padded with ``pad_id`` beyond ``n_tokens``; ``cu_seqlens`` the cumulative segment lengths from 0; ``position_ids`` two
    bytes each, starting again from 0 in each segment.  ``doc_ids``, ``rows`` (a number per document row) and
    ``starts`` (place in the document's ids) name each segment, so every document can be put together again.

    Longer documents are cut every ``length`` ids; all ids are kept.  Every document ends in ``end_id`` unless None.
    Texts without ids (NULL, empty) have no segment; repeated rows are packed like others; other columns are not
    read.  Each task packs its own rows, ``window`` ids at a time, so nothing is shuffled and a lost task is redone alone.
    """
    if not 0 < length <= 65536:
        raise ValueError("length must be 1 to 65536: positions have two bytes")
    small_batches(docs.sparkSession)
    vocabulary = _vocabulary(docs.sparkSession, tokenizer)
    largest = max(vocabulary.value.count(b"\n") + 1, pad_id, end_id or 0)
    pack = _pack(lambda: vocabulary.value, length, end_id, pad_id, window, "<u2" if largest < 65536 else "<u4")
    numbered = docs.select("doc_id", "text", _row_number())
    return numbered.mapInArrow(pack, SCHEMA)


def _row_number():
    from pyspark.sql import functions as F

    return F.monotonically_increasing_id().alias("row")


def _vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, read once by the driver; a few hundred thousand tokens at most."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet, committed task by task."""
    packed.write.option("compression", "zstd").parquet(path)
