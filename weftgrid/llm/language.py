"""Language identification by error-correcting output codes over byte trigrams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 15
#: Bytes looked at in one go, so that very long texts need no more memory.
_SLICE = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")

GUESS = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the byte trigrams of the lower-cased text between two spaces, slice by slice."""
    data = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    for at in range(0, len(data) - 2, _SLICE):
        part = data[at:at + _SLICE + 2]
        grams = part[:-2] | part[1:-1] << 8 | part[2:] << 16
        yield (grams * np.uint32(2654435769)) >> np.uint32(17)


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """One row of +1 and -1 per language.

    Up to six languages have every split into two sides, so any two codewords differ in half the bits or more; beyond,
    the best of some random codes of 8 bits per doubling of the languages, by least distance.
    """
    if languages <= 6:
        splits = (1 << max(0, languages - 1)) - 1
        bits = [[1 if i == 0 or (split >> (i - 1)) & 1 else -1 for split in range(splits)] for i in range(languages)]
        return np.array(bits, np.int8).reshape(languages, splits)
    rng, best, width = np.random.default_rng(seed), None, 8 * int(np.ceil(np.log2(languages)))
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (languages, width))
        code = code[:, np.abs(code.sum(0)) < languages]
        apart = (code.shape[1] - code.astype(np.int32) @ code.T) // 2 + np.eye(languages, dtype=np.int32) * width
        if best is None or apart.min() > best[0]:
            best = apart.min(), code
    return best[1]


class Codes:
    """A trained model: bit classifiers, codewords and the weight of each bit for each language."""

    def __init__(self, names: list[str], code: np.ndarray, odds: np.ndarray, weights: np.ndarray) -> None:
        self.names, self.code, self.odds, self.weights = names, code, odds, weights

    @classmethod
    def fit(cls, names: list[str], counts: np.ndarray) -> Codes:
        """Bit classifiers from trigram counts by language; every bit counts alike until ``weigh``."""
        code = codewords(len(names)).astype(np.float64)
        share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * counts.shape[1])
        # Per bucket and bit: log odds of the +1 languages against the -1 languages, every language counted alike.
        odds = [np.log(share[bit > 0].mean(0)) - np.log(share[bit < 0].mean(0)) for bit in code.T]
        return cls(names, code, np.stack(odds, 1).astype(np.float32) if odds else np.zeros((counts.shape[1], 0), np.float32), np.ones_like(code))

    def parts(self) -> tuple:
        """What a worker needs to build the model again."""
        return self.names, self.code, self.odds, self.weights

    def margins(self, text: str) -> np.ndarray:
        """Mean log odds per trigram for each bit, from -1 to 1 after squashing."""
        total, n = np.zeros(self.odds.shape[1]), 0
        for grams in trigrams(text):
            total += self.odds[grams].sum(0, dtype=np.float64)
            n += len(grams)
        return np.tanh(total / max(1, n) * 2)

    def weigh(self, right: np.ndarray) -> None:
        """Bits count for a language as often as they were right on its training texts, in sum 1."""
        sums = right.sum(1, keepdims=True)
        self.weights = np.where(sums > 0, right / np.where(sums > 0, sums, 1), 1 / max(1, right.shape[1]))

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        """Language of the nearest codeword, how sure it is, and whether the next one is about as near."""
        if text is None or not _LETTER.search(text) or not self.names:
            return "und", 0.0, True
        if len(self.names) == 1:
            return self.names[0], 1.0, False
        # Logistic loss of each bit against each codeword.
        losses = (self.weights * np.log1p(np.exp(-4 * self.code * self.margins(text)))).sum(1)
        sure = np.exp(-8 * (losses - losses.min()))
        sure /= sure.sum()
        best = int(np.argmin(losses))
        second = np.partition(losses, 1)[1]
        return self.names[best], float(sure[best]), bool(second - losses[best] < 0.05 * second)


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
            mine = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for grams in trigrams(text.as_py()):
                mine += np.bincount(grams, minlength=BUCKETS)
    for lang, mine in counts.items():
        seen = np.flatnonzero(mine)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(mine[seen], pa.int64())], ["lang", "bucket", "n"])


def train(texts: DataFrame, max_languages: int = 256) -> Codes:
    """Model from all rows of ``texts`` (``text``, ``lang``); rows with a NULL in either teach nothing.

    Two passes: trigram counts per language, then how often each bit is right.  Both are summed by Spark; the driver
    gets at most ``max_languages`` x 32,768 counts (more languages: ValueError).
    """
    spark = texts.sparkSession
    known = texts.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    names = sorted(r["lang"] for r in known.select("lang").distinct().limit(max_languages + 1).collect())
    if len(names) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    place = {name: i for i, name in enumerate(names)}
    counts = np.zeros((len(names), BUCKETS), np.int64)
    for r in known.mapInArrow(_count_trigrams, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[place[r["lang"]], r["bucket"]] = r["n"]
    model = Codes.fit(names, counts)
    if len(names) < 2:
        return model
    shared = spark.sparkContext.broadcast(model.parts())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Codes(*shared.value)
        right, seen = np.zeros(bits.code.shape), np.zeros(len(names), np.int64)
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                i = place[lang]
                right[i] += bits.code[i] * bits.margins(text.as_py()) > 0
                seen[i] += 1
        yield pa.RecordBatch.from_pydict({"lang": pa.array(range(len(names)), pa.int32()), "right": pa.array(right.tolist(), pa.list_(pa.float64())),
                                          "seen": pa.array(seen)})

    rates = np.zeros_like(model.code)
    judged = known.mapInArrow(judge, "lang int, right array<double>, seen bigint").groupBy("lang").agg(
        F.array(*[F.sum(F.get("right", F.lit(b))) for b in range(model.code.shape[1])]).alias("right"), F.sum("seen").alias("seen"))
    for r in judged.collect():
        rates[r["lang"]] = np.array(r["right"]) / max(1, r["seen"])
    model.weigh(rates)
    return model


def identify(spark, model: Codes, text: Column) -> Column:
    """``lang``, ``score`` (0 to 1) and ``ambiguous`` for a text; ``und`` and 0 if it is NULL or has no letter."""
    shared = spark.sparkContext.broadcast(model.parts())

    @F.arrow_udf(GUESS)
    def guess(texts: pa.Array) -> pa.Array:
        trained = Codes(*shared.value)
        found = [trained.decode(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
            ["lang", "score", "ambiguous"])

    return guess(text)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify_languages(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``ambiguous``.

    Learns from text and non-NULL lang of the documents that are not held out; predictions see the text alone.  Without
    any such document every prediction is ``und``.  Repeated rows teach as often as they occur; empty tables give no
    rows; other columns are not read.
    """
    marked = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = train(marked.where("NOT held_out"))
    return marked.select("doc_id", "held_out", identify(docs.sparkSession, model, F.col("text")).alias("guess")).select(
        "doc_id", "held_out", F.col("guess.lang").alias("lang_pred"), "guess.score", "guess.ambiguous")
