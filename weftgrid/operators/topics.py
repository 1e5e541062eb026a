"""Topics without a vocabulary on the driver: variational inference of latent Dirichlet allocation.

The topic-word table has one row per term.  Counts and the documents' topic weights lie in blocks of
documents, a row each of bounded size; a block needs each of its different terms once a round,
so far fewer rows move than there are counts.  The driver only sees sums of one number per
topic (Blei, Ng and Jordan, 2003; for batches, Hoffman, Blei and Bach, 2010).
"""

from __future__ import annotations

import math
import sys
from functools import reduce
from operator import add, mul
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgrid.operators.features import term_counts
from weftgrid.session import materialize

# The functions of this module travel with the query; executors need not have the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROUNDS = 20
BLOCK_CELLS = 1 << 21          # counts of a block of documents, about
_CHUNK = 1 << 20               # numbers of one kind held at once inside a block
DELAY, FORGETTING = 1.0, 0.7   # step of the t-th batch: (DELAY + t) ** -FORGETTING
_SHIFT = 6                     # the series below are summed this far to the right, where they are exact to ten digits


class Topics(NamedTuple):
    """A fitted model, as tables.

    ``terms`` has ``(term, counts, weights)``: how many of a term's occurrences each topic is expected to
    have made, and the share of the term in each topic.  ``documents`` has ``(key, counts, shares)`` alike,
    for documents with a term.  ``bounds`` are lower bounds of the log likelihood, one before each round.
    """

    terms: DataFrame
    documents: DataFrame
    bounds: list[float]


def _digamma(x: Any, ln=F.ln) -> Any:
    """Derivative of the log of the gamma function, of a column or (with ``math.log``) of a number."""
    y = x + _SHIFT
    z = 1.0 / (y * y)
    series = z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132))))
    return ln(y) - 0.5 / y - series - reduce(add, [1.0 / (x + i) for i in range(_SHIFT)])


def _log_gamma(x: Any, ln=F.ln) -> Any:
    y = x + _SHIFT
    z = 1.0 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * ln(y) - y + 0.5 * math.log(2 * math.pi) + series - ln(reduce(mul, [x + i for i in range(_SHIFT)]))


def _cells(df: DataFrame, key: str, column: str, seed: int, batches: int) -> DataFrame:
    """``(doc, term, tf, batch)``, written once."""
    named = df.select(F.col(key).alias("doc"), F.col(column).alias("tokens")).where("doc IS NOT NULL")
    counted = term_counts(named, "doc", "tokens").withColumn("tf", F.col("tf").cast("double"))
    return materialize(counted.withColumn("batch", F.pmod(F.xxhash64("doc", F.lit(seed)), F.lit(batches))), "term-counts")


def _numbers(part: pa.Table, name: str) -> np.ndarray:
    """The array of a table's only row."""
    return part.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _lists(values: np.ndarray | pa.Array) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


class _Round:
    """The sums and expectations of one model size; columns ``a0, a1, ...`` hold the parameters of a row."""

    def __init__(self, k: int, alpha: float, eta: float):
        self.k, self.alpha, self.eta = k, alpha, eta
        self.names = [f"a{i}" for i in range(k)]

    def start(self, cells: DataFrame, seed: int) -> DataFrame:
        """A term's occurrences are dealt to the topics unevenly, by the term and not by where it is read."""
        n = F.sum("tf") / self.k

        def uneven(i: int) -> Any:
            return -F.ln((F.pmod(F.xxhash64("term", F.lit(seed + i)), F.lit(1 << 20)) + 0.5) / (1 << 20))

        return materialize(cells.groupBy("term").agg(n.alias("n")).select(
            "term", *[(self.eta + F.col("n") * uneven(i)).alias(a) for i, a in enumerate(self.names)]), "topic-terms")

    def packed(self, cells: DataFrame, count: int, seed: int) -> DataFrame:
        """``(block, batch, docs, sizes, terms, at, tf)``: whole documents in blocks of some ``BLOCK_CELLS`` counts, written once.

        ``sizes`` counts the terms of each document, ``at`` is the place of each among the block's ``terms``.
        """
        blocks = math.ceil(count / BLOCK_CELLS)
        kind = cells.schema["doc"].dataType
        made = T.StructType([
            T.StructField("block", T.LongType()), T.StructField("batch", T.LongType()), T.StructField("docs", T.ArrayType(kind)),
            T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("terms", T.ArrayType(T.StringType())),
            T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.DoubleType()))])

        def pack(part: pa.Table) -> pa.Table:
            docs, terms = (part.column(c).combine_chunks().dictionary_encode() for c in ("doc", "term"))
            place = docs.indices.to_numpy()
            order = np.argsort(place, kind="stable")
            return pa.table({
                "block": part.column("block")[:1], "batch": part.column("batch")[:1], "docs": _lists(docs.dictionary),
                "sizes": _lists(np.bincount(place, minlength=len(docs.dictionary)).astype(np.int32)), "terms": _lists(terms.dictionary),
                "at": _lists(terms.indices.to_numpy()[order].astype(np.int32)), "tf": _lists(part.column("tf").to_numpy()[order])})

        # Batches share no block.
        block = F.col("batch") * blocks + F.pmod(F.xxhash64("doc", F.lit(seed + 1)), F.lit(blocks))
        return materialize(cells.select("doc", "term", "tf", "batch", block.alias("block")).groupBy("block").applyInArrow(pack, made), "topic-blocks")

    def documents(self, blocks: DataFrame) -> DataFrame:
        """``(block, weights)``: the documents' parameters before the first round, one document after the other."""
        k, alpha = self.k, self.alpha

        def even(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = pa.Table.from_batches([batch.slice(i, 1)])
                    sizes, tf = _numbers(row, "sizes"), _numbers(row, "tf")
                    total = np.add.reduceat(tf, np.cumsum(sizes) - sizes)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, 1), _lists(np.repeat(alpha + total / k, k))], names=["block", "weights"])

        return blocks.select("block", "sizes", "tf").mapInArrow(even, "block long, weights array<double>")

    def topic_totals(self, terms: DataFrame) -> tuple[list[float], float]:
        """Sum of each topic's parameters, and the topics' part of the bound."""
        part = reduce(add, [(self.eta - F.col(a)) * _digamma(F.col(a)) + _log_gamma(F.col(a)) for a in self.names])
        got = terms.agg(*[F.sum(a).alias(a) for a in self.names], F.sum(part).alias("part"), F.count("*").alias("w")).first()
        totals, whole = [got[a] for a in self.names], got["w"] * self.eta
        bound = got["part"] + sum(
            math.lgamma(whole) - got["w"] * math.lgamma(self.eta) - math.lgamma(t) - (whole - t) * _digamma(t, math.log) for t in totals)
        return totals, bound

    def sums(self, blocks: DataFrame, documents: DataFrame, terms: DataFrame, totals: list[float], steps: int = 1) -> DataFrame:
        """A visit of the documents, one row a block: new ``weights`` after ``steps`` updates, and by its ``terms`` the expected
        occurrences ``a0, ...``.  ``bound`` adds up the documents' and the data's part of the bound at the last update.
        """
        of_terms = terms.select("term", *[
            F.exp(_digamma(F.col(a)) - _digamma(t, math.log)).alias(f"b{i}") for i, (a, t) in enumerate(zip(self.names, totals, strict=True))])
        links = blocks.select(F.col("block").alias("of"), F.posexplode("terms").alias("place", "term"))
        met = links.join(of_terms, "term").drop("term")
        k, alpha, names = self.k, self.alpha, self.names
        start = math.lgamma(k * alpha) - k * math.lgamma(alpha)

        def visit(left: pa.Table, right: pa.Table) -> pa.Table:
            sizes, at, tf = (_numbers(left, c) for c in ("sizes", "at", "tf"))
            topics = np.empty((right.num_rows, k))
            topics[right.column("place").to_numpy()] = np.stack([right.column(f"b{i}").to_numpy() for i in range(k)], axis=1)
            weights = _numbers(left, "weights").reshape(-1, k).copy()
            found, bound = np.zeros((k, len(topics))), 0.0
            ends = np.cumsum(sizes, dtype=np.int64)
            # Whole documents, as many as the chunk holds.
            first = 0
            while first < len(sizes):
                low = ends[first] - sizes[first]
                last = max(first + 1, int(np.searchsorted(ends, low + _CHUNK // k, "right")))
                cells = slice(low, ends[last - 1])
                own, n, begin = topics[at[cells]], tf[cells], ends[first:last] - sizes[first:last] - low
                for step in range(steps):
                    now = weights[first:last].copy()
                    whole = now.sum(axis=1, keepdims=True)
                    expected = _digamma(now, np.log) - _digamma(whole, np.log)
                    spread = np.exp(expected)
                    products = own * np.repeat(spread, sizes[first:last], axis=0)
                    norm = products.sum(axis=1)
                    products *= (n / norm)[:, None]
                    weights[first:last] = alpha + np.add.reduceat(products, begin, axis=0)
                bound += float((n * np.log(norm)).sum() + ((alpha - now) * expected + _log_gamma(now, np.log)).sum()
                               + (start - _log_gamma(whole, np.log)).sum())
                for i in range(k):
                    found[i] += np.bincount(at[cells], products[:, i], len(topics))
                first = last
            return pa.table({"block": left.column("block"), "weights": _lists(weights.ravel()), "bound": [bound], "terms": left.column("terms"),
                             **{a: _lists(f) for a, f in zip(names, found)}})

        made = ", ".join(["block long, weights array<double>, bound double, terms array<string>", *[f"{a} array<double>" for a in names]])
        left = blocks.select("block", "sizes", "terms", "at", "tf").join(documents, "block")
        return materialize(left.groupBy("block").cogroup(met.groupBy("of")).applyInArrow(visit, made), "topic-sums")

    def updated(self, sums: DataFrame, times: float = 1.0) -> DataFrame:
        """The terms' parameters from the occurrences that a visit expects."""
        each = sums.select(F.inline(F.arrays_zip("terms", *self.names))).withColumnRenamed("terms", "term")
        return each.groupBy("term").agg(*[(self.eta + times * F.sum(a)).alias(a) for a in self.names])

    def mixed(self, old: DataFrame, new: DataFrame, step: float) -> DataFrame:
        """The old topics moved a step towards those of a batch; terms the batch lacks only have the prior there."""
        there = new.select("term", *[F.col(a).alias(f"n{i}") for i, a in enumerate(self.names)])
        moved = [((1 - step) * F.col(a) + step * F.coalesce(f"n{i}", F.lit(self.eta))).alias(a) for i, a in enumerate(self.names)]
        return materialize(old.join(there, "term", "left").select("term", *moved), "topic-terms")

    def by_document(self, blocks: DataFrame, documents: DataFrame) -> DataFrame:
        """``(doc, a)``: the parameters of each document as an array."""
        each = blocks.select("block", "docs").join(documents, "block").select(F.posexplode("docs").alias("i", "doc"), "weights")
        return each.select("doc", F.slice("weights", F.col("i") * self.k + 1, self.k).alias("a"))


def fit_topics(df: DataFrame, key: str, column: str, k: int = 5, rounds: int = ROUNDS, batches: int = 1,
               alpha: float | None = None, eta: float | None = None, seed: int = 42, steps: int = 1, settle: int = 0) -> Topics:
    """Topics of a token column, for any number of words and documents.

    ``key`` is unique per row; rows without a key, and documents without a term, take no part.  With one
    batch a round updates all documents and topics, and the bound never falls but for rounding.  With
    more, a round is one batch of documents (chosen by a hash of the key), the topics move a falling
    step towards it, and bounds are estimates from the batch.  A visit updates a document ``steps`` times; ``settle``
    more updates of all documents follow the last round.  Neither the partitioning nor the
    order of rows matters but for rounding.  ``alpha`` and ``eta`` default to ``1 / k``.
    """
    if k < 1 or rounds < 1 or batches < 1 or steps < 1:
        raise ValueError("at least one topic, one round, one batch and one step")
    alpha, eta = (1.0 / k if x is None else float(x) for x in (alpha, eta))
    model = _Round(k, alpha, eta)
    cells = _cells(df, key, column, seed, batches)
    # One row a batch.
    found = cells.groupBy("batch").agg(F.sum("tf").alias("n"), F.count("*").alias("cells")).collect()
    amounts, count = {r["batch"]: r["n"] for r in found}, max([r["cells"] for r in found], default=1)
    terms = model.start(cells, seed)
    blocks = model.packed(cells, count, seed)
    parts = sorted(amounts)
    read = {p: blocks.where(F.col("batch") == p) for p in parts}
    documents = {p: model.documents(read[p]) for p in parts}
    bounds = []
    for t in range(rounds if parts else 0):
        p = parts[t % len(parts)]
        scale = sum(amounts.values()) / amounts[p]
        totals, bound = model.topic_totals(terms)
        sums = model.sums(read[p], documents[p], terms, totals, steps)
        bounds.append(bound + scale * sums.agg(F.sum("bound")).first()[0])
        documents[p] = sums.select("block", "weights")
        made = model.updated(sums, scale)
        terms = materialize(made, "topic-terms") if len(parts) == 1 else model.mixed(terms, made, (DELAY + t) ** -FORGETTING)
    totals = model.topic_totals(terms)[0] if parts else [1.0] * k
    every = reduce(DataFrame.unionByName, documents.values()) if parts else model.documents(blocks)
    if parts and settle:
        every = model.sums(blocks, every, terms, totals, settle).select("block", "weights")
    every = model.by_document(blocks, every)
    whole = F.aggregate("a", F.lit(0.0), lambda x, y: x + y)
    return Topics(
        terms.select("term", F.array(*[F.col(a) - eta for a in model.names]).alias("counts"),
                     F.array(*[F.col(a) / s for a, s in zip(model.names, totals, strict=True)]).alias("weights")),
        every.select(F.col("doc").alias(key), F.transform("a", lambda x: x - alpha).alias("counts"),
                     F.transform("a", lambda x: x / whole).alias("shares")),
        bounds)


def leading_terms(terms: DataFrame, n: int = 3) -> DataFrame:
    """``(topic, rank, term, weight)``: the ``n`` weightiest terms of each topic, ties in term order.

    Each partition keeps only its own first ``n`` terms of a topic before the shuffle (Spark's limit on ranks).
    """
    each = terms.select("term", F.posexplode("weights").alias("topic", "weight"))
    order = Window.partitionBy("topic").orderBy(F.desc("weight"), "term")
    return each.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < n).select("topic", "rank", "term", "weight")
