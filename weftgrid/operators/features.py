"""Feature operators: term counts, TF-IDF, hashing, word vectors, topics and labels.

The canonical form of a feature is long, ``(key, term, weight)``: it grows with the data and
not with the schema.  Wide forms take a bounded number of columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.ml.clustering import LDA
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgrid.functions.rows import explode_column, free_name
from weftgrid.operators.ranking import global_rank
from weftgrid.operators.text import preprocess
from weftgrid.session import materialize
from weftgrid.sources.names import clean_names

VOCABULARY_LIMIT = 1 << 18   # most terms of a vocabulary that the driver is asked to hold
HASH_BUCKETS = 1 << 18
WIDE_LIMIT = 1000            # most term columns of a wide form
WORD2VEC_VOCABULARY = 1_000_000_000  # most words that get a vector
LDA_STEPS = 20               # updates of a document's topics at a visit
WORD2VEC_PARTITIONS = 8      # training tasks, whatever the data and the cluster: the vectors depend on it


# --- term counts ------------------------------------------------------------

def term_counts(df: DataFrame, key: str, column: str) -> DataFrame:
    """Long ``(key, term, tf)`` of a token column.

    All tokens of a row are counted where the row is read, so the shuffle moves one
    number per distinct term of a row, and none at all if the rows are already
    partitioned by ``key``.  ``(key, term)`` spreads frequent terms and long texts alike.
    """
    terms = explode_column(df, [key], F.col(column), "term")
    return terms.groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    """``(term, df)`` of term counts: the number of rows a term occurs in."""
    # The condition always holds. It keeps ``tf`` in this branch, so that a join with the
    # counts reads the same shuffle instead of computing the terms again.
    return counts.where("tf > 0").groupBy("term").agg(F.count("*").alias("df"))


def idf_weight(frequency: Column, documents: Column) -> Column:
    return F.log((documents + 1) / (frequency + 1))


def tfidf(df: DataFrame, key: str, column: str) -> DataFrame:
    """Long ``(key, term, tf, df, weight)`` with weight = tf * ln((N + 1) / (df + 1)).

    ``column`` holds tokens.  The document frequencies come from the same counts and
    are a dictionary with one row per term: the join broadcasts it while it is small,
    else only the counts side can be skewed and is split.
    """
    documents = df.agg(F.count("*").alias("n")).scalar()
    counts = term_counts(df, key, column)
    weighted = counts.join(document_frequency(counts), "term")
    return weighted.select(
        key, "term", "tf", "df",
        (F.col("tf") * idf_weight(F.col("df").cast("double"), documents)).alias("weight"),
    )


def top_terms(df: DataFrame, column: str, n: int) -> dict[str, int]:
    """The ``n`` most frequent terms (at most ``WIDE_LIMIT``) with their document frequency."""
    if n > WIDE_LIMIT:
        raise ValueError(f"at most {WIDE_LIMIT} term columns: use the long form")
    # Every token once, and every distinct token of a row once more: one pass counts both.
    told = F.concat(
        F.transform(column, lambda t: F.struct(t.alias("term"), F.lit(0).alias("first"))),
        F.transform(F.array_distinct(column), lambda t: F.struct(t.alias("term"), F.lit(1).alias("first"))))
    totals = explode_column(df, [], told, "t").groupBy("t.term").agg(
        F.count_if(F.col("t.first") == 0).alias("tf"), F.count_if(F.col("t.first") == 1).alias("df"))
    return {r["term"]: r["df"] for r in totals.orderBy(F.desc("tf"), F.asc("term")).limit(n).collect()}


def _prepared(df: DataFrame, column: str) -> DataFrame:
    """Text is preprocessed; a column of tokens is taken as it is."""
    return df if isinstance(df.schema[column].dataType, T.ArrayType) else preprocess(df, column)


def tfidf_wide(df: DataFrame, column: str, n: int) -> DataFrame:
    """Add ``term_<word>`` TF-IDF columns for the ``n`` most frequent terms; absent terms weigh 0.

    The column, text or tokens, is kept.  The dictionary is small, so the weights are
    computed inside the row.  An existing column of that name is only filled where NULL.
    """
    tokens, known = free_name(df, "_tokens"), free_name(df, "_known")
    prepared = _prepared(df.withColumn(tokens, F.col(column)), tokens)
    chosen = top_terms(prepared, tokens, n)
    documents = prepared.count()
    counted = prepared.withColumn(known, F.filter(tokens, lambda t: t.isin(list(chosen))))
    columns = {}
    for term, frequency in chosen.items():
        name = f"term_{term}"
        tf = F.size(known) - F.size(F.array_remove(known, term))
        weight = tf * idf_weight(F.lit(float(frequency)), F.lit(documents))
        columns[name] = F.coalesce(F.col(name), weight) if name in df.columns else weight
    return counted.withColumns(columns).drop(tokens, known)


def _in_place(df: DataFrame, column: str, estimator: Any, train: DataFrame | None = None) -> tuple[DataFrame, Any]:
    """Fit an estimator on a column (of ``train``, else of ``df``) and put its output where the column stands.

    Spark's feature transformers add a column; the added one gets a name no column has, so frames of any layout do.
    """
    made = f"{column}_made"
    while made.lower() in {c.lower() for c in df.columns}:
        made += "_"
    stage = estimator(made)
    model = stage.fit(df if train is None else train) if hasattr(stage, "fit") else stage
    output = model.transform(df)
    return output.select(*[F.col(made).alias(c) if c == column else F.col(c) for c in df.columns]), model


def vocabulary_counts(df: DataFrame, column: str) -> DataFrame:
    """``(w, n)``: the words of a token column and how often each occurs."""
    return explode_column(df, [], F.col(column), "w").groupBy("w").agg(F.count("*").alias("n"))


def _vocabulary_size(df: DataFrame, column: str, asked: int | None) -> int:
    """The number asked for, or that of all words; too many for the driver is an error, not a cut."""
    if asked is not None:
        return asked
    found = vocabulary_counts(df, column).count()
    if found > VOCABULARY_LIMIT:
        raise ValueError(f"{found} words: use count_vector_tables, or choose a vocabulary_size; the rarest words beyond it are left out")
    return max(1, found)


def count_vector_tables(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Replace tokens by a count vector over all words; also the vocabulary as a table ``(place, term)``, of any size.

    Words are numbered from the most frequent to the rarest, ties in word order.  A word has one row in the
    vocabulary, so only the counts can be skewed in the join; a vector holds the words of its own row.
    """
    row, held = free_name(df, "_row"), free_name(df, "_counts")
    # The numbers of the rows must stay as they are.
    kept = materialize(df.withColumn(row, F.monotonically_increasing_id()), "tokens")
    counts = term_counts(kept, row, column)
    ranked = global_rank(
        materialize(vocabulary_counts(kept, column), "vocabulary-counts"), [F.desc("n"), F.asc("w")], "rank")
    vocabulary = materialize(ranked.select((F.col("rank") - 1).cast("int").alias("place"), F.col("w").alias("term")), "vocabulary")
    size = vocabulary.count()

    @F.udf(VectorUDT())
    def vector(entries):
        return Vectors.sparse(size, [e[0] for e in entries or ()], [e[1] for e in entries or ()])

    found = counts.join(vocabulary, "term").groupBy(row).agg(
        F.sort_array(F.collect_list(F.struct("place", F.col("tf").cast("double").alias("tf")))).alias(held))
    counted = kept.join(found, row, "left").withColumn(held, vector(held))
    return counted.select(*[F.col(held).alias(c) if c == column else F.col(c) for c in df.columns]), vocabulary


def count_vectors(df: DataFrame, column: str, vocabulary_size: int | None = None) -> tuple[DataFrame, list[str]]:
    """Replace tokens by a count vector; also the vocabulary, as a list.

    All words are in the vocabulary, and more than ``VOCABULARY_LIMIT`` of them are an error, unless
    ``vocabulary_size`` asks for that many of the most frequent ones (``vocabulary_counts`` tells which);
    ``count_vector_tables`` has no such limit.
    """
    size = _vocabulary_size(df, column, vocabulary_size)
    counted, model = _in_place(df, column, lambda made: CountVectorizer(inputCol=column, outputCol=made, vocabSize=size))
    return counted, model.vocabulary


def tfidf_vectors(df: DataFrame, column: str, vocabulary_size: int | None = None) -> tuple[DataFrame, list[str]]:
    """Replace a text or token column by its TF-IDF vector; also the vocabulary (see ``count_vectors``)."""
    counted, vocabulary = count_vectors(_prepared(df, column), column, vocabulary_size)
    weighted, _ = _in_place(counted, column, lambda made: IDF(inputCol=column, outputCol=made))
    return weighted, vocabulary


def vector_entries(column: str) -> Column:
    """The numbers other than zero of a vector column, as an array of ``(place, value)``.

    A sparse vector is read as it is stored, so that a text costs its own words and not the whole vocabulary.
    """
    vector = F.unwrap_udt(F.col(column))
    sparse = F.zip_with(vector["indices"], vector["values"], lambda i, x: F.struct(i.alias("place"), x.alias("value")))
    dense = F.transform(vector["values"], lambda x, i: F.struct(i.alias("place"), x.alias("value")))
    return F.filter(F.when(vector["type"] == 0, sparse).otherwise(dense), lambda e: e["value"] != 0)


def hashing_tf(df: DataFrame, column: str, buckets: int = HASH_BUCKETS) -> DataFrame:
    """Replace tokens by a hashed term-frequency vector: no vocabulary, no fit."""
    return _in_place(df, column, lambda made: HashingTF(inputCol=column, outputCol=made, numFeatures=buckets))[0]


def word2vec(df: DataFrame, column: str, size: int = 2, min_count: int = 0, seed: int = 42,
             partitions: int = WORD2VEC_PARTITIONS) -> DataFrame:
    """Replace tokens by the mean of their word vectors.

    Up to ``VOCABULARY_LIMIT`` words Spark's model, which lives on the driver, is fitted by ``partitions``
    tasks; the vectors depend on that number, so it is a fixed default and not taken from the
    data or the cluster.  Beyond, all words are trained over tables (``skipgram``), by at least so many shards.
    """
    row = free_name(df, "_row")
    # The tokens are made once for counting and training; the numbers of the rows must stay as they are.
    kept = materialize(df.withColumn(row, F.monotonically_increasing_id()), "tokens")
    counts = materialize(vocabulary_counts(kept, column).where(F.col("n") >= min_count), "words")
    words = counts.count()
    if words > WORD2VEC_VOCABULARY:
        raise ValueError(f"more than {WORD2VEC_VOCABULARY} words occur {min_count} times: raise min_count")
    if words > VOCABULARY_LIMIT:
        return _word2vec_tables(kept, row, column, counts, size, seed, partitions).select(*df.columns)
    return _in_place(df, column, lambda made: Word2Vec(
        vectorSize=size, minCount=min_count, seed=seed, numPartitions=partitions, inputCol=column, outputCol=made))[0]


def _word2vec_tables(kept: DataFrame, row: str, column: str, words: DataFrame, size: int, seed: int, partitions: int) -> DataFrame:
    """``word2vec`` with any number of ``words``; ``row`` numbers the rows."""
    from weftgrid.operators import skipgram

    held = free_name(kept, "_vector")
    # Read again by whoever asks for the size of the vectors.
    means = materialize(skipgram.skip_gram_means(kept, row, column, words, size, seed, partitions), "row-vectors")
    made = means.select(F.col("row").alias(row), F.array(*[f"v{i}" for i in range(size)]).alias(held))
    none = F.array_repeat(F.lit(0.0), size)
    modelled = kept.join(made, row, "left").withColumn(held, array_to_vector(F.coalesce(held, none)))
    return modelled.select(*[F.col(held).alias(c) if c == column else F.col(c) for c in kept.columns])


# --- topics -----------------------------------------------------------------

def lda(df: DataFrame, column: str, k: int = 5, iterations: int = 20, seed: int = 42,
        vocabulary_size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Topic distribution of a text or token column and the topics' leading terms.

    Returns the frame with the column replaced by its distribution vector, and rows
    ``(topic, rank, term, weight)`` with three terms per topic.  The driver holds Spark's model, ``k``
    weights per vocabulary entry, up to ``VOCABULARY_LIMIT`` words or for a size asked for; beyond, all words are modelled
    over tables (``topics.fit_topics``).  Every iteration reads the count
    vectors again and the result needs them once more, so the counted frame is written out once.
    """
    prepared = materialize(_prepared(df, column), "prepared")
    if vocabulary_size is None and vocabulary_counts(prepared, column).count() > VOCABULARY_LIMIT:
        return _lda_tables(prepared, column, k, iterations, seed)
    counted, vocabulary = count_vectors(prepared, column, vocabulary_size)
    held = materialize(counted, "count-vectors")
    shares, model = _in_place(
        held, column, lambda made: LDA(featuresCol=column, topicDistributionCol=made, k=k, maxIter=iterations, seed=seed),
        held.select(column))
    return shares, _describe_topics(model, vocabulary)


def _lda_tables(df: DataFrame, column: str, k: int, iterations: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``lda`` of a token column with any number of words: as many batches as iterations, so that each document is learned from once."""
    from weftgrid.operators import topics  # it uses this module

    row, shares = free_name(df, "_row"), free_name(df, "_shares")
    # The numbers of the rows must stay as they are.
    kept = materialize(df.withColumn(row, F.monotonically_increasing_id()), "tokens")
    model = topics.fit_topics(kept, row, column, k, iterations, iterations, seed=seed, steps=LDA_STEPS, settle=LDA_STEPS)
    made = model.documents.select(row, F.col("shares").alias(shares))
    none = F.array_repeat(F.lit(0.0), k)
    modelled = kept.join(made, row, "left").withColumn(shares, array_to_vector(F.coalesce(shares, none)))
    # k topics of three terms each.
    leading = df.sparkSession.createDataFrame(topics.leading_terms(model.terms).collect(), "topic int, rank int, term string, weight double")
    return modelled.select(*[F.col(shares).alias(c) if c == column else F.col(c) for c in df.columns]), leading


def _describe_topics(model, vocabulary: Sequence[str], terms: int = 3) -> DataFrame:
    described = model.describeTopics(terms)
    # k topics of three terms each: the described topics are a handful of rows.
    rows = [
        (r["topic"], rank, vocabulary[index], weight)
        for r in described.collect()
        for rank, (index, weight) in enumerate(zip(r["termIndices"], r["termWeights"], strict=True))
    ]
    return described.sparkSession.createDataFrame(rows, "topic int, rank int, term string, weight double")


def topic_columns(df: DataFrame, column: str, k: int = 5, **options) -> DataFrame:
    """Add one ``topic__w1_w2_w3`` column per topic, numbered if topics share their words; the text is kept."""
    held = free_name(df, "_topics")
    modelled, topics = lda(df.withColumn(held, F.col(column)), held, k, **options)
    named = topics.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("terms"))
    rows = sorted(named.collect(), key=lambda r: r["topic"])
    names = clean_names(["topic__" + "_".join(t["term"] for t in r["terms"]) for r in rows])
    shares = vector_to_array(F.col(held))
    return modelled.withColumns({name: shares[r["topic"]] for r, name in zip(rows, names, strict=True)}).drop(held)


# --- labels -----------------------------------------------------------------

def label_dictionary(df: DataFrame, column: str) -> DataFrame:
    """``(column, <column>_label)``: 0.0 for the most frequent value, ties in value order."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    # Ranking reads the counts more than once; the data should be counted only once.
    ranked = global_rank(materialize(counts, "label-counts"), [F.desc("_n"), F.asc(column)], "_rank")
    return ranked.select(column, (F.col("_rank") - 1).cast("double").alias(f"{column}_label"))


def label(df: DataFrame, column: str) -> DataFrame:
    """Add ``<column>_label``, the frequency rank of the value; NULL stays NULL.

    The dictionary has one row per value, so only the data side of the join can be
    skewed; Spark broadcasts the dictionary or splits those partitions.
    """
    return df.join(label_dictionary(df, column), column, "left").select(*df.columns, f"{column}_label")
