"""Document index and similarity."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgrid.functions.rows import explode_column
from weftgrid.operators.features import document_frequency, idf_weight
from weftgrid.operators.ranking import global_rank
from weftgrid.session import materialize

# The functions of this module travel with the query; executors need not have the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_SIZE = 1000     # documents per posting block
MATRIX_LIMIT = 200    # most documents of a similarity matrix
WORD_EDGE = r"(?<=^| )[\s&&[^ ]]+|[\s&&[^ ]]+(?= |\z)"
TILE = 256            # documents on a side of a matrix tile
TILE_WORDS = 500_000  # half the words of a strip of documents, about
STRIP = 4096          # documents on a side of the blocks that tasks count
_TOGETHER = 8         # strips that a task reads of either side, about, or that are broadcast at once
_COLUMNS = 1024       # words multiplied as dense columns at once
_PAIRS = 1 << 22      # pairs of documents that share rarer words, counted at once
_DENSE = 400          # a word is a dense column when one pair of its documents in so many cells has it
_BUCKETS = 1 << 20   # hashes that the documents of a word are counted by
_SLACK = 1e-9         # widens the filters against rounding; the similarity itself is exact


def words_of(text: Column, fold: bool = True) -> Column:
    """Words between single spaces; folded words are stripped and lower-cased."""
    text = F.coalesce(text, F.lit(""))
    if fold:
        # Strip all words at once: other white space next to a space or an end of the text.
        text = F.regexp_replace(F.lower(text), WORD_EDGE, "")
    return F.split(text, " ")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def forward_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, words)``: the sorted distinct words of each document, case kept; computed in the row."""
    return df.select(key, F.sort_array(F.array_distinct(words_of(F.col(text), fold=False))).alias("words"))


def inverted_index(df: DataFrame, key: str, text: str, unique_key: bool = False) -> DataFrame:
    """``(word, key)`` pairs: the posting lists in long form, which no frequent word can overfill.

    Repeats are removed inside the row; with ``unique_key`` that is all and nothing is
    shuffled, otherwise rows of the same key are merged too.  Order by ``word, key`` to
    lay the lists out one after the other.
    """
    words = F.array_distinct(words_of(F.col(text)))
    pairs = explode_column(df, [key], words, "word").select("word", key)
    return pairs if unique_key else pairs.distinct()


def binary_vectors(df: DataFrame, key: str, text: str, unique_key: bool = False) -> DataFrame:
    """``(key, word, present)``: document vectors over the vocabulary, the ones only; ``unique_key`` as for the index."""
    return inverted_index(df, key, text, unique_key).withColumn("present", F.lit(1)).select(key, "word", "present")


def posting_blocks(index: DataFrame, key: str, block_size: int = BLOCK_SIZE) -> DataFrame:
    """``(word, block, size, docs)``: posting lists cut into blocks of sorted documents.

    A word in a third of all documents has many blocks instead of one huge row.
    Whole-number keys are blocked by range, ``block_size`` keys each; other keys by
    hash into as many blocks as the document count asks for.  The pairs are shuffled once, by block,
    and gathered there: few pairs of a word and a block meet before the shuffle.
    """
    if isinstance(index.schema[key].dataType, T.IntegralType):
        block = F.floor(F.col(key) / block_size)
    else:
        documents = index.agg(F.approx_count_distinct(key).alias("n"))
        blocks = documents.select(F.ceil(F.col("n") / block_size).cast("bigint")).scalar()
        block = F.pmod(F.xxhash64(key), F.greatest(blocks, F.lit(1)))
    dealt = index.withColumn("block", block.cast("bigint")).repartition("block")
    return dealt.groupBy("word", "block").agg(F.sort_array(F.collect_set(key)).alias("docs")).select(
        "word", "block", F.size("docs").cast("bigint").alias("size"), "docs")


def term_search(df: DataFrame, key: str, column: str, terms: Sequence[str]) -> DataFrame:
    """``(key, hits, score)`` of the documents holding any query term; score is the sum of tf-idf.

    ``column`` holds tokens.  Only the query's terms leave the scan.
    """
    documents = df.agg(F.count("*").alias("n")).scalar()
    wanted = explode_column(df, [key], F.col(column), "term").where(F.col("term").isin(sorted(set(terms))))
    counts = wanted.groupBy(key, "term").agg(F.count("*").alias("tf"))
    frequency = document_frequency(counts)  # one row per query term
    scored = counts.join(F.broadcast(frequency), "term").withColumn(
        "w", F.col("tf") * idf_weight(F.col("df").cast("double"), documents))
    return scored.groupBy(key).agg(F.count("*").alias("hits"), F.sum("w").alias("score"))


# --- similarity -------------------------------------------------------------

def vector_cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays."""
    return _dot(a, b) / F.sqrt(_dot(a, a) * _dot(b, b))


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def truncate2(similarity: Column) -> Column:
    """Two decimals, cut off."""
    number = similarity * 100
    return F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)) / 100.0


def word_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, words, signature)``: distinct folded words and a digest of the set."""
    words = F.sort_array(F.array_distinct(words_of(F.col(text))))
    return df.select(key, words.alias("words")).withColumn(
        "signature", F.sha2(F.to_json("words"), 256))  # quoted, so that no word can look like two


def copy_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, doc)``: the representative (least key) of the documents with the same word set."""
    # The texts are read once; the signatures twice.
    sets = materialize(word_sets(df, key, text).select(key, "signature"), "signatures")
    heads = sets.groupBy("signature").agg(F.min(key).alias("doc"))
    return sets.join(heads, "signature").select(key, "doc")


def _word_numbers(pairs: DataFrame) -> DataFrame:
    """``(word, number)``: the words of ``(word, document)`` pairs, numbered from 1, rarest first, ties in word order."""
    counts = materialize(pairs.groupBy("word").agg(F.count("*").alias("df")), "word-counts")
    return global_rank(counts, [F.col("df"), F.col("word")], "number").select("word", F.col("number").cast("int").alias("number"))


def _places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``counts[i]`` places from ``starts[i]`` on, one run after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _runs(rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(rows, words, starts, counts)`` of entries sorted by word: its different words and the run of rows of each."""
    starts = np.flatnonzero(np.concatenate([np.ones(min(len(words), 1), dtype=bool), words[1:] != words[:-1]]))
    return rows, words[starts], starts, np.diff(starts, append=len(words))


def _count_shared(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], out: np.ndarray) -> None:
    """Add to ``out`` how many words each row of one side shares with each of the other; a side is given by ``_runs``.

    Words in many rows of both sides are multiplied as dense 0/1 columns, the others add one per pair of rows.
    """
    (r1, u1, s1, c1), (r2, u2, s2, c2) = left, right
    if not len(u1) or not len(u2):
        return
    i1 = np.minimum(np.searchsorted(u1, u2), len(u1) - 1)
    i2 = np.flatnonzero(u1[i1] == u2)
    i1 = i1[i2]
    s1, c1, s2, c2 = s1[i1], c1[i1], s2[i2], c2[i2]
    often = c1 * c2 * _DENSE > out.size
    for at in range(0, int(often.sum()), _COLUMNS):
        strips = []
        for r, s, c, n in ((r1, s1, c1, out.shape[0]), (r2, s2, c2, out.shape[1])):
            s, c = s[often][at:at + _COLUMNS], c[often][at:at + _COLUMNS]
            strip = np.zeros((n, len(s)), dtype=np.float32)
            strip[r[_places(s, c)], np.repeat(np.arange(len(s)), c)] = 1
            strips.append(strip)
        out += (strips[0] @ strips[1].T).astype(out.dtype)
    s1, c1, s2, c2 = s1[~often], c1[~often], s2[~often], c2[~often]
    flat, width = out.reshape(-1), out.shape[1]
    parts = np.cumsum(c1 * c2) // _PAIRS
    for at, end in zip(*(np.searchsorted(parts, np.unique(parts), side) for side in ("left", "right"))):
        a, b, c, d = s1[at:end], c1[at:end], s2[at:end], c2[at:end]
        times = np.repeat(d, b)
        np.add.at(flat, np.repeat(r1[_places(a, b)], times) * width + r2[_places(np.repeat(c, b), times)], 1)


_STRIP = "strip int, last int, entries binary, heads binary"


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _unpacked(packed: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(packed.as_buffer()).read_all()


def _strip_row(strip: int, last: int, rows: np.ndarray, words: np.ndarray, heads: pa.Table) -> pa.Table:
    """A strip of documents as one row: its entries ``(row, word)`` by word, and ``heads`` with a line per row."""
    order = np.argsort(words, kind="stable")
    entries = pa.table({"row": rows[order].astype(np.int32), "word": words[order]})
    return pa.table({"strip": pa.array([strip], pa.int32()), "last": pa.array([last], pa.int32()),
                     "entries": pa.array([_packed(entries)], pa.binary()), "heads": pa.array([_packed(heads)], pa.binary())})


def _every_two(strips: DataFrame, number: int) -> DataFrame:
    """Every two strips that meet, read by each task where they were written."""
    cores = strips.sparkSession.sparkContext.defaultParallelism
    strips = strips.coalesce(max(-(-number // _TOGETHER), math.ceil(2 * math.sqrt(cores))))
    others = strips.select(*[F.col(c).alias(f"{c}2") for c in strips.columns])
    met = strips.hint("shuffle_replicate_nl").join(others, F.expr("strip <= strip2 AND strip2 <= last"))
    return met.drop("last", "last2")


def _some_at_a_time(strips: DataFrame, number: int) -> Iterator[DataFrame]:
    """The same in parts, for results that can be written: ``_TOGETHER`` strips are broadcast to those that meet them."""
    for low in range(0, number, _TOGETHER):
        high = low + _TOGETHER - 1
        some = strips.where(F.col("strip").between(low, high)).select(*[F.col(c).alias(f"{c}2") for c in strips.columns if c != "last"])
        others = strips.where((F.col("strip") <= high) & (F.col("last") >= low))
        reach = F.sequence(F.greatest("strip", F.lit(low)), F.least("last", F.lit(high)))
        met = explode_column(others, ["strip", "entries", "heads"], reach, "other")
        yield met.join(F.broadcast(some), F.col("other") == F.col("strip2")).drop("other")


def _count_strips(met: DataFrame, result: Callable[[int, int, pa.Table, pa.Table, np.ndarray], Iterator[pa.RecordBatch]],
                  schema: str) -> DataFrame:
    """``result(lo, hi, heads, heads, counts)`` of every two strips of documents that meet: shared words by row of both.

    Strips (``_strip_row``) have to be written out; one meets itself and those behind it up to ``last``.  Nothing is copied once
    per pair of strips, neither shuffled nor to disk; a task holds the counts of two strips at a time.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = np.zeros(0, dtype=np.int32), {}

        def read(pair: pa.RecordBatch, i: int, side: str) -> tuple[int, pa.Table, tuple[np.ndarray, ...]]:
            strip = pair.column(f"strip{side}")[i].as_py()
            if known.get(side, (None,))[0] != strip:
                entries, heads = (_unpacked(pair.column(f"{c}{side}")[i]) for c in ("entries", "heads"))
                known[side] = strip, heads, _runs(entries.column("row").to_numpy().astype(np.int64), entries.column("word").to_numpy())
            return known[side]

        for batch in batches:
            for i in range(batch.num_rows):
                (lo, left, runs1), (hi, right, runs2) = read(batch, i, ""), read(batch, i, "2")
                size = len(left) * len(right)
                held = held if len(held) >= size else np.zeros(size, dtype=np.int32)
                counts = held[:size].reshape(len(left), len(right))
                counts.fill(0)
                _count_shared(runs1, runs2, counts)
                yield from result(lo, hi, left, right, counts)

    return met.mapInArrow(count, schema)


def _word_hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def _first_copies(sets: DataFrame) -> DataFrame:
    """``(doc, copies, n, signature, words)`` of word sets: copies next to each other are one row, and only the first row of a set in a task has its words."""
    kind = sets.schema["doc"].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch, [("doc", "ascending")], null_placement="at_end"))
            signatures = batch.column("signature").to_pylist()
            places: dict[bytes, int] = {}
            copies = np.bincount([places.setdefault(x, len(places)) for x in signatures], minlength=len(places)).astype(np.int64)
            firsts = np.unique([places[x] for x in signatures], return_index=True)[1] if places else np.zeros(0, dtype=np.int64)
            found = batch.take(pa.array(firsts))
            known = pa.array([x in seen for x in places], pa.bool_())
            seen.update(places)
            words = pc.if_else(known, pa.scalar(None, found.column("words").type), found.column("words"))
            yield pa.RecordBatch.from_arrays(
                [found.column("doc"), pa.array(copies), found.column("n"), found.column("signature"), words], ["doc", "copies", "n", "signature", "words"])

    return sets.mapInArrow(gather, f"doc {kind}, copies bigint, n bigint, signature binary, words array<string>")


def _word_sketch(sets: DataFrame) -> np.ndarray:
    """At least in how many sets the words of each hash occur: ``_BUCKETS`` numbers, whatever the vocabulary."""
    buckets = _BUCKETS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            words = batch.column("words").flatten().dictionary_encode()
            hashes = _word_hashes(words.dictionary)
            times = np.bincount(words.indices.to_numpy(), minlength=len(hashes))
            np.add.at(total, (hashes % np.uint64(buckets)).astype(np.int64), times)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["bucket", "n"])

    parts = sets.where("words IS NOT NULL").select("words").mapInArrow(add, "bucket int, n bigint")
    found = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    sketch = np.zeros(buckets, dtype=np.int64)
    sketch[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return np.minimum(sketch, (1 << 31) - 1).astype(np.int32)


def _size_strips(sizes: Sequence[tuple[int, int]], least: float) -> list[tuple[int, int, int, int]]:
    """``(n, strip, parts, last)``: sets of ``n`` words lie in ``parts`` strips from ``strip`` on, which meet the strips up to ``last``.

    ``sizes`` has how many sets there are of each size.  Similar sizes share a strip, of some ``STRIP`` documents and
    twice ``TILE_WORDS`` words at most; many sets of one size are dealt to several.
    """
    most = 2 * TILE_WORDS
    ranges: list[list] = []  # sizes, documents, words, parts
    for n, sets in sorted(sizes):
        parts = max(math.ceil(sets / STRIP), math.ceil(sets * n / most))
        if parts == 1 and ranges and ranges[-1][3] == 1 and ranges[-1][1] + sets <= STRIP and ranges[-1][2] + sets * n <= most:
            ranges[-1] = [[*ranges[-1][0], n], ranges[-1][1] + sets, ranges[-1][2] + sets * n, 1]
        else:
            ranges.append([[n], sets, sets * n, max(parts, 1)])
    first = np.cumsum([0, *[r[3] for r in ranges]]).tolist()
    lows = np.array([r[0][0] for r in ranges], dtype=np.float64)
    ends = [int(np.searchsorted(least * lows - _SLACK, r[0][-1], "right")) for r in ranges]
    return [(n, first[i], r[3], first[ends[i]] - 1) for i, r in enumerate(ranges) for n in r[0]]


def _word_codes(heads: pa.Table, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Places of ``rows`` among the different ones, and of these the ends of their words, the words as numbers and what the numbers stand for."""
    rows, places = np.unique(rows, return_inverse=True)
    held = heads.column("words").take(pa.array(rows)).combine_chunks()
    codes, words = held.flatten().indices.to_numpy(), held.flatten().dictionary
    used = np.zeros(len(words), dtype=bool)
    used[codes] = True
    return places, held.offsets.to_numpy(), (np.cumsum(used) - 1)[codes], words.take(pa.array(np.flatnonzero(used)))


def _similar_pairs(sets: DataFrame, min_similarity: float) -> DataFrame:
    """``(a, b, copies_a, copies_b, n_a, n_b, overlap)`` of all sets that may be similar (``_first_copies``)."""
    least, slack, kind = min_similarity * min_similarity, _SLACK, sets.schema["doc"].dataType.simpleString()
    sketch, buckets = _word_sketch(sets), _BUCKETS
    # One row per size of a set.
    sizes = [(r["n"], r["c"]) for r in sets.where("words IS NOT NULL").groupBy("n").agg(F.count("*").alias("c")).collect()]
    dealing = _size_strips(sizes, least)
    places = sets.sparkSession.createDataFrame(dealing, "n bigint, first int, parts int, last int")
    strip = (F.col("first") + F.pmod(F.xxhash64("signature"), F.col("parts"))).cast("int")
    dealt = sets.join(F.broadcast(places), "n").select(strip.alias("strip"), "last", "doc", "copies", "n", "signature", "words")

    def pack(rows: pa.Table) -> pa.Table:
        """The different sets of a strip; of each, the words that come first are its entries: rarest first, then by hash."""
        rows = rows.sort_by([("signature", "ascending"), ("doc", "ascending")])
        signatures = rows.column("signature").combine_chunks().dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], signatures[1:] != signatures[:-1]]))
        holds = np.where(rows.column("words").is_valid().to_numpy(), np.arange(len(rows)), -1)
        words = rows.column("words").take(pa.array(np.maximum.reduceat(holds, starts))).combine_chunks()
        n = rows.column("n").to_numpy()[starts]
        codes = words.flatten().dictionary_encode()
        terms = codes.dictionary
        hashes = _word_hashes(terms)
        often = sketch[(hashes % np.uint64(buckets)).astype(np.int64)].astype(np.int64)
        keys = (often << 32) | (hashes >> np.uint64(32)).astype(np.int64)
        # A word that is counted once is no other set's: it keeps its place in the order and is not written.
        codes, shared, row = codes.indices.to_numpy(), often > 1, np.repeat(np.arange(len(n)), n)
        ends = np.cumsum([0, *np.bincount(row[shared[codes]], minlength=len(n))]).astype(np.int32)
        held = pa.DictionaryArray.from_arrays(pa.array((np.cumsum(shared) - 1)[codes[shared[codes]]].astype(np.int32)), terms.filter(pa.array(shared)))
        key = keys[codes]
        order = np.lexsort((key, row))
        key, row = key[order], row[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])  # words of one hash count once
        key, row = key[new], row[new]
        begin = np.searchsorted(row, np.arange(len(n)))
        kept = n - np.ceil(least * n - slack).astype(np.int64) + 1
        inside = (np.arange(len(row)) - begin[row] < kept[row]) & (key >> 32 > 1)
        heads = pa.table({
            "doc": rows.column("doc").take(pa.array(starts)), "copies": np.add.reduceat(rows.column("copies").to_numpy(), starts),
            "n": n, "rest": n - kept, "end": key[begin + np.minimum(kept, np.diff(begin, append=len(row))) - 1],
            "words": pa.ListArray.from_arrays(pa.array(ends), held)})
        return _strip_row(rows.column("strip")[0].as_py(), rows.column("last")[0].as_py(), row[inside], key[inside], heads)

    strips = materialize(dealt.groupBy("strip").applyInArrow(pack, _STRIP), "size-strips")

    def similar(lo: int, hi: int, one: pa.Table, two: pa.Table, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        (n1, rest1, end1), (n2, rest2, end2) = ([t.column(c).to_numpy() for c in ("n", "rest", "end")] for t in (one, two))
        found = []
        for at in range(0, len(one), 256):
            a, b = np.divmod(np.flatnonzero(counts[at:at + 256]), len(two))
            shared, a = counts[at:at + 256][a, b], a + at
            # A shared word outside both prefixes lies behind the prefix that ends first.
            at_most = shared + np.where(end1[a] <= end2[b], rest1[a], rest2[b])
            fits = at_most >= min_similarity * np.sqrt((n1[a] * n2[b]).astype(np.float64)) - slack
            fits &= (least * n1[a] - slack <= n2[b]) & (least * n2[b] - slack <= n1[a]) & ((lo < hi) | (a < b))
            found.append((a[fits], b[fits]))
        a, b = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in zip(*found))
        if not len(a):
            return
        # The words themselves are compared: numbers of the one dictionary for the words of both.
        (a2, ends1, codes1, words1), (b2, ends2, codes2, words2) = _word_codes(one, a), _word_codes(two, b)
        codes2 = pc.fill_null(pc.index_in(words2, value_set=words1), len(words1)).to_numpy()[codes2]
        own, overlap, last = np.zeros(len(words1) + 1, dtype=bool), np.zeros(len(a), dtype=np.int64), -1
        for i, (x, y) in enumerate(zip(a2.tolist(), b2.tolist())):
            if x != last:
                own[codes1[ends1[last]:ends1[last + 1]] if last >= 0 else []] = False
                own[codes1[ends1[x]:ends1[x + 1]]] = True
                last = x
            overlap[i] = np.count_nonzero(own[codes2[ends2[y]:ends2[y + 1]]])
        sides = [t.select(["doc", "copies", "n"]).take(pa.array(x)) for t, x in ((one, a), (two, b))]
        columns = [sides[i].column(c) for c in ("doc", "copies", "n") for i in (0, 1)]
        yield from pa.table([*columns, pa.array(overlap)], ["a", "b", "copies_a", "copies_b", "n_a", "n_b", "overlap"]).to_batches()

    schema = f"a {kind}, b {kind}, copies_a bigint, copies_b bigint, n_a bigint, n_b bigint, overlap bigint"
    parts = _some_at_a_time(strips, max([last for *_, last in dealing], default=-1) + 1)
    found = [materialize(_count_strips(met, similar, schema), "similar-sets") for met in parts]
    return reduce(DataFrame.unionByName, found) if found else sets.sparkSession.createDataFrame([], schema)


def similar_documents(df: DataFrame, key: str, text: str, min_similarity: float) -> DataFrame:
    """All pairs of distinct word sets whose cosine is at least ``min_similarity``; ``key`` must be unique.

    Rows ``(doc1, doc2, copies1, copies2, similarity)``, ``doc1 < doc2``, similarity cut to two
    decimals.  The result is exact and complete:

    * documents with the same word set are similar to the same documents, so one
      representative stands for all of them (``copies`` says how many,
      ``copy_groups`` which); pairs inside such a group are never listed;
    * with words ordered from rare to frequent, two sets this similar share a word
      among the first ``n - ceil(t^2 n) + 1`` of each, so only those words are counted
      and frequent words hardly ever are; any order would do, and this one comes from counts by hash;
    * pairs whose sizes, or whose count of shared rare words, rule the similarity out
      are dropped before their word sets are compared: the documents lie in strips by size, each
      written once and some of them broadcast at a time, so neither words nor pairs are shuffled
      for the strips that meet.
    """
    if not 0 < min_similarity <= 1:
        raise ValueError("min_similarity must be in (0, 1]")
    sets = word_sets(df.select(F.col(key).alias("doc"), F.col(text).alias("text")), "doc", "text")
    # Read several times below, by different columns.
    sets = materialize(_first_copies(sets.select(
        "doc", F.size("words").cast("bigint").alias("n"), F.unhex("signature").alias("signature"), "words")), "word-sets")
    pairs = _similar_pairs(sets, min_similarity)
    similarity = F.col("overlap") / F.sqrt((F.col("n_a") * F.col("n_b")).cast("double"))
    turned = F.col("a") > F.col("b")
    listed = pairs.where("a IS NOT NULL AND b IS NOT NULL").withColumn("similarity", similarity)
    return listed.where(F.col("similarity") >= min_similarity).select(
        F.least("a", "b").alias("doc1"), F.greatest("a", "b").alias("doc2"),
        F.when(turned, F.col("copies_b")).otherwise(F.col("copies_a")).alias("copies1"),
        F.when(turned, F.col("copies_a")).otherwise(F.col("copies_b")).alias("copies2"),
        truncate2(F.col("similarity")).alias("similarity"))


def similarity_matrix(df: DataFrame, key: str, text: str, limit: int = MATRIX_LIMIT) -> DataFrame:
    """Cosine of every pair of keys as a table: one row and one column per key.

    Rows of the same key form one document.  The keys are counted first and must
    not exceed ``limit``, so a word links at most ``limit`` documents.
    """
    names = [r["k"] for r in df.select(F.col(key).cast("string").alias("k")).distinct().limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"more than {limit} documents: use similar_documents")
    pairs = df.select(F.col(key).cast("string").alias("doc"), text).transform(inverted_index, "doc", text)
    sizes = F.broadcast(pairs.groupBy("doc").agg(F.count("*").alias("n")))  # at most ``limit`` rows
    shared = (
        pairs.select("word", F.col("doc").alias("doc1"))
        .join(pairs.select("word", F.col("doc").alias("doc2")), "word")
        .groupBy("doc1", "doc2").agg(F.count("*").alias("overlap"))
        .join(sizes.toDF("doc1", "n1"), "doc1").join(sizes.toDF("doc2", "n2"), "doc2")
    )
    similarity = truncate2(F.col("overlap") / F.sqrt((F.col("n1") * F.col("n2")).cast("double")))
    return (
        shared.select(F.col("doc1").alias("doc"), "doc2", similarity.alias("s"))
        .groupBy("doc").pivot("doc2", sorted(names)).agg(F.max("s")).na.fill(0.0)
    )


def similarity_tiles(df: DataFrame, key: str, text: str, tile: int = TILE, tile_words: int = TILE_WORDS) -> DataFrame:
    """The whole matrix of cosines between documents, as tiles: any number of documents.

    One row ``(tile1, tile2, docs1, docs2, cells)`` per tile, ``cells`` row by row.  Rows of
    the same key form one document, rows without a key are left out.  Documents are
    numbered in key order without sorting them in one task.  Strips of tiles are written once, each
    as a row of at most twice ``tile_words`` words or of one tile, and every two meet in a task that
    reads them and returns their tiles: neither words nor counts are shuffled or written per pair.  Reading
    the frame twice counts twice.  The work and the result are quadratic in the documents by their
    nature: ``similar_documents`` lists the pairs above a threshold only.
    """
    named = df.select(F.col(key).cast("string").alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL")
    pairs = materialize(inverted_index(named, "doc", "text"), "tile-words")
    ranked = materialize(global_rank(pairs.groupBy("doc").agg(F.count("*").alias("n")), [F.col("doc")], "rank"), "tile-places")
    most, tiles = ranked.groupBy(F.expr(f"(rank - 1) DIV {tile}").alias("tile")).agg(F.sum("n").alias("n")).agg(F.max("n"), F.count("*")).first()
    wide = max(1, min(STRIP // tile, 2 * tile_words // (most or 1)))  # tiles of a strip
    number = F.expr(f"CAST((rank - 1) DIV {wide * tile} AS INT)")
    places = ranked.select("doc", "n", number.alias("strip"), ((F.col("rank") - 1) % (wide * tile)).cast("int").alias("row"))

    numbered = pairs.join(_word_numbers(pairs.select("word")), "word")
    words = numbered.groupBy("doc").agg(F.collect_list("number").alias("words"))
    parts = words.join(places, "doc").select("strip", "row", "words", "doc", "n")

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        words = rows.column("words").combine_chunks()
        return _strip_row(rows.column("strip")[0].as_py(), (1 << 31) - 1, np.repeat(np.arange(len(rows)), words.value_lengths().to_numpy()),
                          words.flatten().to_numpy(), rows.select(["doc", "n"]))

    strips = materialize(parts.groupBy("strip").applyInArrow(pack, _STRIP), "tile-strips")

    def cut(lo: int, hi: int, left: pa.Table, right: pa.Table, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        (docs1, n1), (docs2, n2) = ((t.column("doc").to_pylist(), t.column("n").to_numpy()) for t in (left, right))
        for a in range(0, len(n1), tile):
            tiles = []
            for b in range(0, len(n2), tile):
                sizes = np.multiply.outer(n1[a:a + tile], n2[b:b + tile]).astype(np.float64)
                shared = counts[a:a + tile, b:b + tile][:sizes.shape[0], :sizes.shape[1]]
                cells = np.floor(shared / np.sqrt(sizes) * 100) / 100
                names, at = (docs1[a:a + tile], docs2[b:b + tile]), (lo * wide + a // tile, hi * wide + b // tile)
                tiles.append((*at, *names, cells.ravel()))
                if lo < hi:
                    tiles.append((*at[::-1], *names[::-1], cells.T.ravel()))
            ends = np.cumsum([0, *[len(t[4]) for t in tiles]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                *[pa.array([t[i] for t in tiles], pa.int32()) for i in (0, 1)],
                *[pa.array([t[i] for t in tiles], pa.list_(pa.string())) for i in (2, 3)],
                pa.ListArray.from_arrays(ends, np.concatenate([t[4] for t in tiles]))], ["tile1", "tile2", "docs1", "docs2", "cells"])

    return _count_strips(_every_two(strips, -(-(tiles or 1) // wide)), cut, "tile1 int, tile2 int, docs1 array<string>, docs2 array<string>, cells array<double>")


def tile_cells(tiles: DataFrame) -> DataFrame:
    """The entries of a matrix in tiles that are not 0: ``(tile1, tile2, doc1, doc2, similarity)``."""
    cells = explode_column(tiles, ["tile1", "tile2", "docs1", "docs2"], F.col("cells"), "similarity", "i").where("similarity > 0")
    width = F.size("docs2")
    return cells.select(
        "tile1", "tile2", F.get("docs1", F.floor(F.col("i") / width).cast("int")).alias("doc1"),
        F.get("docs2", F.col("i") % width).alias("doc2"), "similarity")
