"""Word vectors by skip-grams with negative sampling, without a vocabulary on the driver or in a task.

Shards of documents train side by side from start vectors that follow from the word, each for
its own words only; a word's vector is the mean over the shards that met it (Mikolov et al., 2013).
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgrid.functions.rows import explode_column
from weftgrid.session import materialize

# The functions of this module travel with the query; executors need not have the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARD_TOKENS = 1 << 21   # tokens of a shard, about
WINDOW = 5               # most words to each side that count as context
NEGATIVES = 5
RATE, LEAST_RATE = 0.025, 0.0000025
BATCH = 512              # pairs between two updates
CALM = 16                # a vector moves by as many steps of its mean at most in an update
_PAIRS = 1 << 18         # tokens whose pairs are held at once
_DRAWS = 1 << 20         # places of the table that negative words are drawn from
_STEPS = 1 << 20         # start values of a word


def _tokens(docs: pa.Table, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of every known token and of its document; other tokens are left out."""
    lists = docs.column("tokens").combine_chunks()
    codes = pc.index_in(lists.flatten(), value_set=words)
    doc = np.repeat(np.arange(len(docs)), lists.value_lengths().to_numpy())
    known = codes.is_valid().to_numpy(zero_copy_only=False)
    return codes.drop_null().to_numpy().astype(np.int64), doc[known]


def _pairs(codes: np.ndarray, doc: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Words and the words in their windows of a random width, in random order."""
    reach = rng.integers(1, WINDOW + 1, len(codes))
    one, two = [], []
    for step in range(1, min(WINDOW, len(codes) - 1) + 1):
        same = doc[:-step] == doc[step:]
        for met, a, b in ((same & (reach[:-step] >= step), codes[:-step], codes[step:]), (same & (reach[step:] >= step), codes[step:], codes[:-step])):
            one.append(a[met])
            two.append(b[met])
    one, two = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (one, two))
    order = rng.permutation(len(one))
    return one[order], two[order]


def _descend(vectors: np.ndarray, outer: np.ndarray, words: np.ndarray, targets: np.ndarray, rate: float, met: np.ndarray) -> None:
    """One step: each word's vector moves towards its first target and away from the others; ``met`` has a 0 for each word.

    Numbers are read and added one by one at their places in the whole: NumPy adds to rows many times slower.
    """
    size = vectors.shape[1]
    at1, at2 = (x[..., None] * size + np.arange(size) for x in (words, targets))
    v, u = vectors.reshape(-1)[at1], outer.reshape(-1)[at2]
    g = np.einsum("bd,bkd->bk", v, u)
    np.negative(np.clip(g, -30, 30, out=g), out=g)
    np.exp(g, out=g)
    g += 1
    np.divide(-rate, g, out=g)
    g[:, 0] += rate
    for held, at, places, moves in ((vectors, at1, words, np.einsum("bk,bkd->bd", g, u)), (outer, at2, targets, g[:, :, None] * v[:, None, :])):
        # All steps of an update start from the same vectors: many of them for one word would overshoot.
        np.add.at(met, places.reshape(-1), 1)
        times = met[places]
        met[places] = 0
        if times.max(initial=0) > CALM:
            moves *= np.minimum(1, CALM / times)[..., None]
        np.add.at(held.reshape(-1), at.reshape(-1), moves.reshape(-1))


def _train(docs: pa.Table, terms: pa.Table, names: list[str], seed: int) -> pa.Table:
    """Vectors of a shard's words after one pass over its documents."""
    docs, terms = docs.sort_by("row"), terms.sort_by("term")
    words = terms.column("term").combine_chunks()
    vectors = np.stack([terms.column(c).to_numpy() for c in names], axis=1)
    codes, doc = _tokens(docs, words)
    outer, met, rng = np.zeros_like(vectors), np.zeros(len(words), dtype=np.int64), np.random.default_rng(seed)
    times = np.bincount(codes, minlength=len(words))
    often = np.cumsum(times ** 0.75)
    draws = np.searchsorted(often, (np.arange(_DRAWS) + 0.5) / _DRAWS * often[-1]) if len(codes) else np.zeros(0, dtype=np.int64)
    # Frequent words lie side by side while they are trained, so that most numbers are read from a processor's cache.
    order = np.argsort(-times, kind="stable")
    place = np.argsort(order)
    codes, draws, vectors = place[codes], place[draws], vectors[order]
    for start in range(0, len(codes), _PAIRS):
        one, two = _pairs(codes[start:start + _PAIRS], doc[start:start + _PAIRS], rng)
        rate = max(RATE * (1 - start / len(codes)), LEAST_RATE)
        for at in range(0, len(one), BATCH):
            a = one[at:at + BATCH]
            targets = np.column_stack([two[at:at + BATCH], draws[rng.integers(0, len(draws), (len(a), NEGATIVES))]])
            _descend(vectors, outer, a, targets, rate, met)
    return pa.table({"shard": terms.column("shard"), "term": words, **{c: vectors[place, i] for i, c in enumerate(names)}})


def _means(docs: pa.Table, terms: pa.Table, names: list[str]) -> pa.Table:
    """Mean vector of each document's tokens; one without a vector counts as zeros."""
    codes, doc = _tokens(docs, terms.column("term").combine_chunks())
    sizes = pc.list_value_length(docs.column("tokens")).to_numpy()
    sums = [np.bincount(doc, terms.column(c).to_numpy()[codes], len(docs)) / np.maximum(sizes, 1) for c in names]
    return pa.table({"row": docs.column("row"), **dict(zip(names, sums))})


def skip_gram_means(df: DataFrame, row: str, column: str, words: DataFrame, size: int, seed: int, shards: int) -> DataFrame:
    """``(row, v0, v1, ...)``: the mean word vector of each row with tokens; ``words`` has the words ``w`` that get one.

    ``row`` tells the rows apart.  At least ``shards`` shards, more for a larger corpus; a task holds
    one shard and the vectors of its words.
    """
    tokens = df.select(F.col(row).alias("row"), F.col(column).alias("tokens")).where(F.size("tokens") > 0)
    shards = max(shards, math.ceil((tokens.agg(F.sum(F.size("tokens")).alias("n")).first()["n"] or 0) / SHARD_TOKENS))
    docs = tokens.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(shards)).cast("int"))
    names = [f"v{i}" for i in range(size)]
    # The start follows from the word, so shards agree on it.
    first = [((F.pmod(F.xxhash64("term", F.lit(seed + i)), F.lit(_STEPS)) + 0.5) / _STEPS - 0.5) / size for i in range(size)]
    met = explode_column(docs.select("shard", F.array_distinct("tokens").alias("tokens")), ["shard"], F.col("tokens"), "term").distinct()
    terms = materialize(met.join(words.select(F.col("w").alias("term")), "term").select("shard", "term"), "shard-words")
    start = terms.select("shard", "term", *[f.alias(c) for f, c in zip(first, names)])
    kinds = ", ".join(f"{c} double" for c in names)

    def train(docs: pa.Table, terms: pa.Table) -> pa.Table:
        return _train(docs, terms, names, seed)

    def means(docs: pa.Table, terms: pa.Table) -> pa.Table:
        return _means(docs, terms, names)

    docs = docs.select("shard", "row", "tokens")
    trained = materialize(docs.groupBy("shard").cogroup(start.groupBy("shard")).applyInArrow(train, f"shard int, term string, {kinds}"), "shard-vectors")
    mean = trained.groupBy("term").agg(*[F.avg(c).alias(c) for c in names])
    vectors = trained.select("shard", "term").join(mean, "term")
    return docs.groupBy("shard").cogroup(vectors.groupBy("shard")).applyInArrow(means, f"row bigint, {kinds}")
