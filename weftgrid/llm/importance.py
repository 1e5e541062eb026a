"""Importance resampling: hashed n-gram models of target and raw text, and a Gumbel top-k draw."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import small_batches, unused

#: Buckets of one hash table; every feature has a bucket in each of two tables.
BUCKETS = 1 << 17
#: Added to every bucket of both models, at the size of the target model.
SMOOTHING = 2.0
#: Log ratios closer to 0 than this say nothing, and so do those within that many standard deviations of chance.
DEAD_ZONE, CHANCE = 0.3, 4.0
#: A text with more n-grams weighs as much as this many of its average n-grams do: small errors add up over long texts.
SPAN = 2000
#: Losing one share of the good documents is as bad as keeping this many shares of the bad ones.
LOSS = 5.0
#: A word, or a run of other characters.
_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^\s0-9a-z\x80-\xff]+")
_WIDTH = 5
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD))


def features(text: str | None) -> np.ndarray:
    """Buckets of the n-grams of a text, one row per hash table.

    n-grams are single words, runs of five bytes of the words joined by spaces, and doublings of the number of words
    that follow themselves.  Each counts once per text, so that a text which says a word a thousand times speaks for
    one text only.
    """
    tokens = _TOKEN.findall((text or "").lower().encode())
    if not tokens:
        return np.zeros((2, 0), np.int64)
    data = np.frombuffer(b" " + b" ".join(tokens) + b" ", np.uint8).astype(np.uint64)
    grams = np.zeros(max(0, len(data) - _WIDTH + 1), np.uint64)
    for i in range(_WIDTH if len(grams) else 0):
        grams |= data[i:i + len(grams)] << np.uint64(8 * i)
    words = np.fromiter(map(crc32, tokens), np.uint64, len(tokens))
    again = int((words[1:] == words[:-1]).sum())
    doublings = np.arange(again.bit_length(), dtype=np.uint64)
    # Bits above those of a five-byte run tell the three kinds apart.
    found = np.unique(np.concatenate([grams, words | np.uint64(1 << 50), doublings | np.uint64(1 << 60)]))
    mixed = (found ^ (found >> np.uint64(29))) * _MIX[0]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX[1]
    bits = np.uint64(BUCKETS - 1)
    return np.stack([(mixed >> np.uint64(47)) & bits, ((mixed >> np.uint64(8)) & bits) + np.uint64(BUCKETS)]).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64)
    for batch in batches:
        for text, good in zip(batch.column(0), batch.column(1).to_pylist()):
            for buckets in features(text.as_py()):
                raw[buckets] += 1  # once for each distinct bucket
                if good:
                    target[buckets] += 1
    seen = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(raw[seen]), pa.array(target[seen])], ["bucket", "raw", "target"])


def log_ratios(raw: np.ndarray, target: np.ndarray, scale: float) -> np.ndarray:
    """Log of target over raw probability of buckets with these counts, shrunk where the counts don't prove it.

    ``scale`` is the target's usual share of a bucket.  Of a ratio only what exceeds the dead zone counts, times a
    factor that falls to 0 as the difference comes down to what chance alone would give.
    """
    expected = raw * scale
    ratio = np.log(target + SMOOTHING) - np.log(expected + SMOOTHING)
    distance = (target - expected) ** 2 / (expected * (1 - scale) + 1)
    trust = np.maximum(0.0, 1 - CHANCE ** 2 / np.maximum(distance, 1e-9))
    return np.sign(ratio) * np.maximum(0.0, np.abs(ratio) - DEAD_ZONE) * trust


def usual_share(raw: np.ndarray, target: np.ndarray) -> float:
    """Median share of the target over the occurrences in a bucket: buckets that only bad text fills don't move it."""
    seen = raw > 0
    if not target.any():
        return 0.0
    shares, n = target[seen] / raw[seen], raw[seen]
    order = np.argsort(shares)
    return float(min(0.999, shares[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)]))


def log_weight(spark, raw: np.ndarray, target: np.ndarray, text: Column, good: Column) -> Column:
    """Log of target probability over raw probability of a text of SPAN n-grams at most, its own counts left out of both models.

    Without that, words that only one document has would count for or against it by whether it is labelled.
    """
    scale = usual_share(raw, target)
    shared = spark.sparkContext.broadcast((raw.astype(np.float64), target.astype(np.float64)))

    @F.arrow_udf(T.DoubleType())
    def weigh(texts: pa.Array, goods: pa.Array) -> pa.Array:
        everything, wanted = shared.value
        out = []
        for text, own in zip(texts, goods.to_pylist()):
            buckets = features(text.as_py())
            one, two = log_ratios(everything[buckets] - 1, wanted[buckets] - bool(own), scale)
            # A feature that shares a bucket with a telling one seldom does so in both tables.
            ratios = np.where(np.abs(one) < np.abs(two), one, two) * (one * two > 0)
            out.append(float(ratios.sum()) * min(1.0, SPAN / max(1, len(ratios))) if scale else 0.0)
        return pa.array(out, pa.float64())

    return weigh(text, good)


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """Cut with the largest share of bad documents below it, less LOSS times that of good ones; minus infinity if one kind is missing."""
    if not good.any() or good.all():
        return float("-inf")
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    lost = np.concatenate([[0], np.cumsum(g)]) / g.sum()
    caught = np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    possible = np.concatenate([[True], w[1:] > w[:-1], [True]])
    i = int(np.argmax(np.where(possible, caught - LOSS * lost, -np.inf)))
    return float("-inf") if i == 0 else float("inf") if i == len(w) else float((w[i - 1] + w[i]) / 2)


def kth_largest(frame: DataFrame, key: str, row: str, k: int, at_once: int = 20_000) -> tuple[float, int]:
    """The k-th row by descending ``key``, then ``row``: its key and row number.

    Counts over 1,024 equal steps narrow the range until at most ``at_once`` rows are left to look at.  ``key`` is finite
    and ``row`` unique.
    """
    left, column = frame, key
    while True:
        low, high, n = left.agg(F.min(column), F.max(column), F.count(F.lit(1))).first()
        if n <= at_once:
            r = sorted(((r[0], -r[1]) for r in left.select(key, row).collect()), reverse=True)[k - 1]
            return r[0], -r[1]
        if low == high:  # equal keys: go on by row number, the smallest first
            left, column = left.withColumn("_turned", -F.col(row)), "_turned"
            continue
        step = F.least(F.lit(1023), F.floor((F.col(column) - low) / ((high - low) / 1024))).cast("int")
        counts = {r[0]: r[1] for r in left.groupBy(step).count().collect()}
        for s in sorted(counts, reverse=True):
            if k <= counts[s]:
                left = left.where(step == s)
                break
            k -= counts[s]


def resample(docs: DataFrame, labels: DataFrame, seed: int = 23, temperature: float = 0.1, max_labelled: int = 200_000,
             keep: list[str] | None = None) -> DataFrame:
    """``docs`` (all columns, or those in ``keep``) with ``log_weight`` and ``kept``.

    The target model counts the n-grams of documents labelled good (quality 1, not toxic), the raw model those of all
    documents; ``log_weight`` is the log of their ratio.  The cut that best parts good from bad labelled documents
    says how many documents, k, the corpus has above it; k documents are then drawn without replacement: the k largest
    sums of ``log_weight`` and a Gumbel number times ``temperature`` (1 draws in proportion to the weights, less draws
    the better documents more surely).

    At most ``max_labelled`` labelled ids are used, those with the lowest hashes, so the broadcast table of ids and
    the driver's list of labelled weights are bounded; counts, weights and the draw cover all documents.  An id with
    several labels is good only if all of them are.  NULL and empty texts weigh 0.  Without good and bad labels all
    documents are kept.  The draw depends on id and text only; repeated rows have one number and are told apart where k ends
    among them.  Empty frames give no rows.  Columns of these names are
    replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.drop("log_weight", "kept")
    row, good, known, number, name = (unused(plain, n) for n in ("_row", "_good", "_known", "_number", "_name"))
    sample = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
        .agg((F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0))).alias(good))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
        .select(F.col("doc_id").alias(known), good))
    marked = plain.join(F.broadcast(sample), plain["doc_id"] == F.col(known), "left").drop(known)  # max_labelled rows
    raw, target = np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64)
    counted = marked.select("text", F.coalesce(good, F.lit(False))).mapInArrow(_count, "bucket int, raw bigint, target bigint")
    sums = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # 2 * BUCKETS rows at most
    places = sums["bucket"].to_numpy()
    raw[places], target[places] = sums["raw"].to_numpy(), sums["target"].to_numpy()

    weight = log_weight(spark, raw, target, F.col("text"), F.coalesce(good, F.lit(False)))
    held = materialize(marked.select(
        *(keep or plain.columns), good, weight.alias("log_weight"), F.xxhash64(F.lit(seed), "doc_id", "text").alias(name),
        F.monotonically_increasing_id().alias(row)), "weighed")
    seen = held.where(F.col(good).isNotNull()).orderBy(F.xxhash64("doc_id"), row).limit(max_labelled).select("log_weight", good).collect()
    cut = best_cut(np.array([r[0] for r in seen]), np.array([r[1] for r in seen], bool))
    # A uniform number strictly between 0 and 1 from id and text, whatever files they lie in, and from it a Gumbel number.
    uniform = (F.shiftrightunsigned(name, 11).cast("double") + 0.5) / float(1 << 53)
    drawn = held.withColumn(number, F.col("log_weight") - temperature * F.log(-F.log(uniform)))
    everything, k = held.agg(F.count(F.lit(1)), F.count_if(F.col("log_weight") >= cut)).first()
    if k in (0, everything):
        return held.withColumn("kept", F.lit(k == everything)).drop(good, row, name)
    key, last = kth_largest(drawn.select(number, row), number, row, k)
    taken = (F.col(number) > key) | ((F.col(number) == key) & (F.col(row) <= last))
    return drawn.withColumn("kept", taken).drop(good, row, number, name)
