"""Collocations by partitioned mining: shards are mined at lowered support, what is frequent in one is counted everywhere.

A phrase with ``support`` occurrences has, in at least one shard, ``support`` times that shard's share of the words.  So
each shard, a fixed share of the input's partitions, is mined completely for phrases of that local support, from words to longer phrases;
the union of what is found holds every frequent phrase.  A member whose counts, with the most that the shards without it can
hold, stay below ``support`` is dropped; the others are then counted exactly over all documents.

Mining works on 64-bit hashes of phrases.  Two phrases of one hash can only add a candidate, never lose one; the last count
is of the phrases themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import small_batches

#: Longest phrase in words.
LONGEST = 4
#: Shards that are mined at lowered support; each grows with the data, so that a local support stays well above 1.
SHARDS = 3
#: Words counted together in a task, and bytes of a text split at once.
CHUNK_WORDS, SLICE_BYTES = 1 << 19, 1 << 20
#: A filter has 16 bits per member, and at most so many bits (64 MB); beyond, more words pass it and are counted for nothing.
FILTER_BITS, BITS_EACH = 1 << 29, 16
#: Bits in one row of a filter's table.
_ROW_BITS = 1 << 15
#: Rows of a batch that goes to the JVM, and parts of a language that are ranked apart first.
_BATCH, _RANKED_APART = 1 << 16, 64

_MARK = b"\xff"  # in no UTF-8 text: stands for the end of a piece


def _translation() -> bytes:
    """Lower-case A-Z, blanks as spaces, ends of pieces as the mark."""
    table = bytearray(range(256))
    for c in range(ord("A"), ord("Z") + 1):
        table[c] = c + 32
    for c in b".,;:!?\n\x0b\x0c\r":
        table[c] = _MARK[0]
    table[ord("\t")] = ord(" ")
    return bytes(table)


_TABLE = _translation()


def split_words(text: bytes, size: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """Words of a text and marks between its pieces, a slice of about ``size`` bytes at a time."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            # On to the next blank or end of a piece, so that no word is cut.
            while end < len(text) and _TABLE[text[end]] not in (32, 255):
                end += 1
        yield text[at:end].translate(_TABLE).replace(_MARK, b" \xff ").split()
        at = end


class Numbers(dict):
    """A number for each different word, in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Chunk:
    """Words of one language as numbers, 0 at the end of a piece; ``old`` words at the start were counted before."""

    def __init__(self, lang: str, start: list[bytes] = ()) -> None:
        self.lang, self.number, self.parts, self.size = lang, Numbers({_MARK: 0}), [], 0
        self.add(list(start))
        self.old = self.size

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def ids(self) -> np.ndarray:
        return np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)

    def hashes(self) -> np.ndarray:
        """64 bits for each different word and the language, by number."""
        seed = xxhash.xxh64_intdigest(self.lang.encode())
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.number), np.uint64, len(self.number))

    def rest(self) -> list[bytes]:
        """The last words of an unfinished piece, for the chunk after this one."""
        words = list(self.number)
        tail = self.ids()[-(LONGEST - 1):].tolist()
        return [words[i] for i in tail]


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_WORDS) -> Iterator[Chunk]:
    """Chunks, together about ``limit`` words at a time, of batches of (lang, text); a piece may go on in its language's next chunk."""
    open_: dict[str, Chunk] = {}
    held = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if held >= limit:
                yield from open_.values()
                open_.clear()
                held = 0
            if lang not in open_:
                open_[lang] = Chunk(lang)
            for words in split_words(text.as_buffer().to_pybytes() if text.is_valid else b""):
                open_[lang].add(words)
                held += len(words)
                if open_[lang].size >= limit:
                    full = open_[lang]
                    yield full
                    open_[lang] = Chunk(lang, full.rest())
                    held -= full.size
            open_[lang].add([_MARK])
            held += 1
    yield from open_.values()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in this order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class Filter:
    """Bits of the members' hashes, two each: no member is ever missed."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in (hashes & self.mask, (hashes >> np.uint64(32)) & self.mask):
            found &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
        return found


def build_filter(members: DataFrame, most: int = FILTER_BITS) -> np.ndarray:
    """Filter over ``hash`` (written rows, repeats allowed); its bits are set by aggregation, a row of 4 KB for 32,768 bits."""
    count = members.count()
    size = min(most, max(_ROW_BITS, 1 << (BITS_EACH * count).bit_length()))
    places = [F.col("hash").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(size - 1))]
    at = members.select(F.explode(F.array(*places)).alias("at"))
    rows = at.groupBy(F.shiftright("at", 15).alias("row")).agg(
        F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(_ROW_BITS - 1))).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for r in rows.toLocalIterator():
        part = np.frombuffer(r["bits"], np.uint8)
        out[r["row"] * (_ROW_BITS // 8):][:len(part)] = part
    return out


def _batches(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    """One batch as several of bounded size."""
    whole = pa.RecordBatch.from_pydict(columns)
    for at in range(0, whole.num_rows, _BATCH):
        yield whole.slice(at, _BATCH)


def _sums(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard of the total or NULL, lang, word, n): word counts, and the number of words as the row without a word."""
    shard = _shard()
    for chunk in chunks(batches):
        counts = np.bincount(chunk.ids()[chunk.old:], minlength=len(chunk.number))
        words, counts = list(chunk.number)[1:], counts[1:]
        held = [w for w, n in zip(words, counts) if n]
        n = np.append(counts[counts > 0], counts.sum())
        yield from _batches({
            "shard": pa.array([None] * len(held) + [shard], pa.int32()), "lang": pa.array([chunk.lang] * len(n), pa.string()),
            "word": pa.array([w.decode() for w in held] + [None], pa.string()), "n": pa.array(n, pa.int64())})


def _shard(shards: int = SHARDS) -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId() % shards


def _runs(chunk: Chunk, words: Filter | None, pairs: Filter | None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places where phrases of each length start that could be frequent, and the hashes of all phrases by place.

    A phrase is left out where one of its words or pairs of words is not in its filter, where a piece ends in it, and where it
    was counted with the chunk before.
    """
    ids, hashes = chunk.ids(), chunk.hashes()
    usable = words(hashes) if words else np.ones(len(hashes), bool)
    usable[0] = False
    ok, h = usable[ids], hashes[ids]
    found = {}
    live = ok
    for k in range(2, LONGEST + 1):
        if len(ids) < k:
            break
        if k == 2:
            live = ok[:-1] & ok[1:]
            h2 = mixed = _mix(h[:-1], h[1:])
            if pairs:
                at = np.flatnonzero(live)
                live[at] = pairs(mixed[at])
            both = live
        else:
            # The first k-1 words and the last two.
            live = live[:-1] & both[k - 2:]
            mixed = _mix(mixed[:-1], h2[k - 2:])
        at = np.flatnonzero(live)
        found[k] = at[at + k > chunk.old], mixed
    return found


def _mine(words: Callable[[], Filter], pairs: Callable[[], Filter] | None, lengths: tuple[int, ...]):
    def mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, shard, hash, n) of the phrases of the given lengths."""
        shard, frequent, joined = _shard(), words(), pairs() if pairs else None
        for chunk in chunks(batches):
            runs = _runs(chunk, frequent, joined)
            kept = [runs[k][1][runs[k][0]] for k in lengths if k in runs]
            if not kept or not sum(map(len, kept)):
                continue
            hashes, n = _sums(np.concatenate(kept))
            yield from _batches({
                "lang": pa.array([chunk.lang] * len(n), pa.string()), "shard": pa.array(np.full(len(n), shard, np.int32)),
                "hash": pa.array(hashes.view(np.int64)), "n": pa.array(n, pa.int64())})

    return mined


def _exact(words: Callable[[], Filter], candidates: Callable[[], Filter]):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, phrase, words, n) of the candidates, counted by the numbers of their words and not by hashes."""
        frequent, wanted = words(), candidates()
        for chunk in chunks(batches):
            ids = chunk.ids()
            names = np.array([w.decode("utf-8") if w != _MARK else "" for w in chunk.number], object)
            runs = _runs(chunk, frequent, wanted)
            for k, (at, mixed) in runs.items():
                at = at if k == 2 else at[wanted(mixed[at])]
                if not len(at):
                    continue
                # One number for each different phrase so far, then with its next word.
                key = ids[at].astype(np.int64)
                for j in range(1, k):
                    key = np.unique(key, return_inverse=True)[1].astype(np.int64) << 32 | ids[at + j]
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                first = at[first]
                phrases = names[ids[first]]
                for j in range(1, k):
                    phrases = phrases + " " + names[ids[first + j]]
                yield from _batches({
                    "lang": pa.array([chunk.lang] * len(n), pa.string()), "phrase": pa.array(phrases, pa.string()),
                    "k": pa.array(np.full(len(n), k, np.int32)), "n": pa.array(n, pa.int64())})

    return counted


def frequent_phrases(docs: DataFrame, support: int = 30) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to 4 words with at least ``support`` occurrences: (lang, phrase, k, a), and (lang, n): all words.

    Words are counted first.  Then each shard is mined: pairs of frequent words, and from the pairs that are locally frequent
    somewhere the longer phrases.  What reaches its shard's local support is a candidate of the last, exact count.
    Counts are made where the text is and shuffled by phrase, never by language.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    counts = materialize(
        texts.mapInArrow(_count_words, "shard int, lang string, word string, n bigint")
        .groupBy("shard", "lang", "word").agg(F.sum("n").alias("n")), "words")
    words = counts.where("word IS NOT NULL").where(F.col("n") >= support).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("k"), F.col("n").alias("a"))
    sizes = counts.where("word IS NULL AND n > 0").select("lang", "shard", "n")
    totals = sizes.groupBy("lang").agg(F.sum("n").alias("n"))
    # A shard's share of the support, rounded up: those less one add up to less than the support.
    least = F.ceil(F.col("held").cast("decimal(20,0)") * support / F.col("n")).cast("long")
    local = sizes.withColumnRenamed("n", "held").join(totals, "lang").select("lang", "shard", least.alias("least"))
    local = materialize(local, "supports")
    # At most so many occurrences are in the shards that don't report a phrase, if none does.
    unseen = materialize(local.groupBy("lang").agg(F.sum(F.col("least") - 1).alias("unseen")), "unseen")

    def share(members: DataFrame) -> Callable[[], Filter]:
        sent = spark.sparkContext.broadcast(build_filter(members))
        return lambda: Filter(sent.value)

    frequent = share(materialize(words.select("lang", "phrase").mapInArrow(_word_hashes, "hash bigint"), "filter"))

    def mine(pairs: Callable[[], Filter] | None, lengths: tuple[int, ...]) -> DataFrame:
        sums = texts.mapInArrow(_mine(frequent, pairs, lengths), "lang string, shard int, hash bigint, n bigint").groupBy(
            "lang", "shard", "hash").agg(F.sum("n").alias("n"))
        # A shard that no word was counted in has no local support: all is kept.
        found = sums.join(local, ["lang", "shard"], "left").withColumn("least", F.coalesce("least", F.lit(1))).where(F.col("n") >= F.col("least"))
        # What was counted, and the most that the other shards can hold, must reach the support.
        seen = found.groupBy("lang", "hash").agg(F.sum("n").alias("n"), F.sum(F.col("least") - 1).alias("seen"))
        kept = seen.join(unseen, "lang", "left").where(F.col("n") + F.coalesce(F.col("unseen") - F.col("seen"), F.lit(0)) >= support)
        return materialize(kept.select("hash"), "mined")

    pairs = mine(None, (2,))
    longer = mine(share(pairs), tuple(range(3, LONGEST + 1)))
    candidates = share(materialize(pairs.unionByName(longer).distinct(), "candidates"))
    phrases = texts.mapInArrow(_exact(frequent, candidates), "lang string, phrase string, k int, n bigint").groupBy(
        "lang", "phrase", "k").agg(F.sum("n").alias("a")).where(F.col("a") >= support)
    return materialize(phrases.unionByName(words.select("lang", "phrase", "k", "a")), "phrases"), totals


def _word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of (lang, word), as chunks have it."""
    seeds: dict[str, int] = {}
    for batch in batches:
        found = []
        for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if lang not in seeds:
                seeds[lang] = xxhash.xxh64_intdigest(lang.encode())
            found.append(xxhash.xxh64_intdigest(word.encode(), seeds[lang]))
        yield pa.RecordBatch.from_arrays([pa.array(np.array(found, np.uint64).view(np.int64))], ["hash"])


def collocations(docs: DataFrame, support: int = 30, covered_percent: int = 80, first: int = 2000) -> DataFrame:
    """Each language's ``first`` phrases of 2 to 4 words: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Texts are lower-cased (A-Z) and split into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs.  ``n``
    counts a language's words, ``a`` the phrase's places within pieces, ``l`` and ``r`` those of its two parts at the cut with the lowest
    score, ``floor(2000000 a / (l + r))``, the first one of equal cuts.  A phrase inside a longer one that has at least
    ``covered_percent`` of its occurrences is left out.  Order: score and ``a`` from the highest, then the phrase's bytes.

    NULL texts are empty and a NULL language is ``und``; repeated rows count again; languages without a phrase, and an empty
    frame, give no rows.  Other columns are not read.  All numbers are exact.
    """
    phrases, totals = frequent_phrases(docs, support)
    words = F.split("phrase", " ")
    cut = phrases.where("k > 1").select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    cut = cut.select(
        "*", F.expr("substring_index(phrase, ' ', at)").alias("left"), F.expr("substring_index(phrase, ' ', at - k)").alias("right"))
    parts = phrases.select("lang", "phrase", "a")
    scored = (
        cut.join(parts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
        .join(parts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
        .withColumn("score", F.expr("(CAST(a AS DECIMAL(20,0)) * 2000000BD) div (CAST(l AS DECIMAL(20,0)) + r)"))
        .groupBy("lang", "phrase").agg(F.min(F.struct("score", "at", "a", "l", "r")).alias("best")).select("lang", "phrase", "best.*"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: F.array_join(F.slice(words, at, size), " "))))
    inside = phrases.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    hundred = F.lit(100).cast("decimal(3,0)")
    kept = scored.join(inside, ["lang", "phrase"], "left").where(
        F.col("longest").isNull() | (F.col("longest").cast("decimal(20,0)") * hundred < F.col("a").cast("decimal(20,0)") * F.lit(covered_percent).cast("decimal(3,0)")))
    order = F.desc("score"), F.desc("a"), F.col("phrase")
    # The first of each part of a language hold the first of the language: a bounded number of rows meets in the last task.
    part = F.pmod(F.xxhash64("phrase"), F.lit(_RANKED_APART))
    best = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= first)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
