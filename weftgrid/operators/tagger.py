"""Entities by a sequence model: averaged-perceptron weights, Viterbi decoding.

The model learns from sentences in which a gazetteer names some capitalised runs; other
capitalised runs are left open there, so the best path that agrees with the names is
the one to learn.  Shards train side by side from common weights, which are averaged
after every round (McDonald, Hall and Mann, 2010).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgrid.functions.rows import explode_column
from weftgrid.operators.text import entity_mentions, sentences_of
from weftgrid.session import materialize

# The functions of this module travel with the query; executors need not have the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKEN = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]"
BUCKETS = 1 << 16        # hashed features
TRAIN_SENTENCES = 20_000  # most sentences to learn from
TRAIN_TOKENS = 200       # of a longer training sentence the tokens in front; tagging reads all
MAX_LABELS = 50
SHARDS = 8
ROUNDS = 5
BATCH = 32               # sentences between two updates
CELLS = 1 << 14          # padded tokens decoded at once, few enough for a processor's cache
_NEVER = -1e9


@dataclass(frozen=True)
class Tagger:
    """``weights[bucket, tag]`` and ``moves[tag, next tag]``; tag 0 is outside, then begin and inside of each label."""

    labels: tuple[str, ...]
    weights: np.ndarray
    moves: np.ndarray


def _allowed_moves(tags: int) -> np.ndarray:
    """0 where a tag may follow another, else very low: inside only after begin or inside of its label."""
    moves = np.zeros((tags, tags))
    for inside in range(2, tags, 2):
        moves[:, inside] = _NEVER
        moves[[inside - 1, inside], inside] = 0
    return moves


def _shape(word: str) -> str:
    kinds = ["X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else "-" for c in word[:8]]
    return "".join(k for i, k in enumerate(kinds) if i == 0 or kinds[i - 1] != k)


def _word_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of different words: their own five features, then those they are as the word on the left and on the right.

    The last line of the neighbours stands for the end of the sentence.
    """
    low = [w.lower() for w in words]

    def bucket(kind: str, values: list[str]) -> np.ndarray:
        named = np.array([f"{kind}={v}" for v in values], dtype=object)
        return (pd.util.hash_array(named, categorize=False) % BUCKETS).astype(np.int64)

    own = [bucket("w", low), bucket("p", [w[:3] for w in low]), bucket("s", [w[-3:] for w in low]),
           bucket("t", [w[-2:] for w in low]), bucket("h", [_shape(w) for w in words])]
    return np.stack(own, axis=1), bucket("l", [*low, ""]), bucket("r", [*low, ""])


def _neighbours(codes: np.ndarray, lengths: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """The word before and behind each token, ``none`` at the ends of its sentence."""
    ends = np.cumsum(lengths)
    left, right = np.roll(codes, 1), np.roll(codes, -1)
    left[ends - lengths], right[ends - 1] = none, none
    return left, right


def _features(sentences: list[list[str]]) -> np.ndarray:
    """Bucket of every feature of every token, sentences one after the other."""
    codes, words = pd.factorize(np.array([w for s in sentences for w in s], dtype=object))
    own, before, behind = _word_buckets(list(words))
    left, right = _neighbours(codes, np.array([len(s) for s in sentences]), len(words))
    return np.column_stack([own[codes], before[left], behind[right]])


def _viterbi(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tag path of each padded sentence; ``scores`` is sentence x place x tag, ties to the smaller tag."""
    count, width, tags = scores.shape
    best = scores[:, 0].copy()
    best[:, 2::2] = _NEVER
    back = np.empty((count, width, tags), dtype=np.int16)
    for i in range(1, width):
        reached = best[:, :, None] + moves
        back[:, i] = reached.argmax(axis=1)
        best = np.where((i < lengths)[:, None], reached.max(axis=1) + scores[:, i], best)
    path = np.zeros((count, width), dtype=np.int64)
    at, every = best.argmax(axis=1), np.arange(count)
    for i in range(width - 1, -1, -1):
        path[:, i] = np.where(i < lengths, at, 0)
        at = np.where((i < lengths) & (i > 0), back[every, i, at], at)
    return path


def _padded(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows of tokens laid out as sentence x place, zeros behind the end."""
    out = np.zeros((len(lengths), int(lengths.max()), *flat.shape[1:]), dtype=flat.dtype)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def _open_tags(tokens: list[str], names: list[tuple[str, int]], tags: int) -> np.ndarray:
    """Which tags each token may have, given the names of the sentence and their labels.

    A capitalised token that is no name is open, except at the front; all others are outside.
    """
    may = np.zeros((len(tokens), tags), dtype=bool)
    may[:, 0] = True
    for i, word in enumerate(tokens):
        may[i] |= i > 0 and word[0].isupper()
    low = [w.lower() for w in tokens]
    for name, label in names:
        parts = name.split()
        for i in range(len(low) - len(parts) + 1):
            if low[i:i + len(parts)] == parts and all(w[0].isupper() for w in tokens[i:i + len(parts)]):
                may[i:i + len(parts)] = False
                may[i, 1 + 2 * label] = True
                may[i + 1:i + len(parts), 2 + 2 * label] = True
    return may


def _learn(rows: pd.DataFrame, labels: tuple[str, ...], start: np.ndarray) -> pd.DataFrame:
    """One pass over a shard: changes of the weights at its end and of their average, by place.

    ``start`` holds the weights and behind them the moves.
    """
    tags = 1 + 2 * len(labels)
    size = BUCKETS * tags
    now, late, step, allowed = start.copy(), np.zeros_like(start), 0, _allowed_moves(tags)
    weights, moves = now[:size].reshape(BUCKETS, tags), now[size:].reshape(tags, tags)
    rows = rows.sort_values(["draw", "sentence"])
    for at in range(0, len(rows), BATCH):
        part = rows.iloc[at:at + BATCH]
        sentences = [list(t) for t in part["tokens"]]
        names = [[(n["name"], labels.index(n["label"])) for n in found] for found in part["names"]]
        lengths = np.array([len(s) for s in sentences])
        features = _features(sentences)
        scores = _padded(weights[features].sum(axis=1), lengths)
        may = _padded(np.concatenate([_open_tags(s, n, tags) for s, n in zip(sentences, names)]), lengths)
        right = _viterbi(np.where(may, scores, 10 * _NEVER), lengths, moves + allowed)
        guess = _viterbi(scores, lengths, moves + allowed)
        inside = np.arange(scores.shape[1]) < lengths[:, None]
        for path, sign in ((right, 1.0), (guess, -1.0)):
            used = (features * tags + path[inside][:, None])[right[inside] != guess[inside]].ravel()
            turns = size + (path[:, :-1] * tags + path[:, 1:])[inside[:, 1:]]
            for places in (used, turns):
                np.add.at(now, places, sign)
                np.add.at(late, places, sign * step)
        step += 1
    # Whole 1024ths add up to the same sum in any order.
    change = now - start
    mean = np.round((change - late / max(step, 1)) * 1024) / 1024
    places = np.flatnonzero((change != 0) | (mean != 0))
    return pd.DataFrame({"place": places, "change": change[places], "mean": mean[places]})


def training_sentences(df: DataFrame, key: str, column: str, gazetteer: DataFrame, limit: int = TRAIN_SENTENCES) -> DataFrame:
    """``(draw, sentence, tokens, names)``: different sentences that hold a name of the ``(name, label)`` gazetteer.

    Beyond ``limit`` the sentences whose hash comes first, the same however the frame is
    partitioned.
    """
    read = df.where(F.col(key).isNotNull()).select(F.col(column).alias("_text"))
    texts = explode_column(read, [], sentences_of(F.col("_text")), "sentence")
    # A sentence goes by its hash until the hashes are drawn: no text is shuffled but that of the sentences learned from.
    hashed = texts.select(F.xxhash64("sentence").alias("draw"), "sentence")
    named = entity_mentions(hashed, "draw", "sentence", gazetteer).where(F.col("label").isNotNull()).select(
        "draw", F.struct(F.lower("mention").alias("name"), "label").alias("name"))
    named = materialize(named.distinct(), "tagger-names")
    drawn = materialize(named.select("draw").distinct().orderBy("draw").limit(limit), "tagger-draws")
    found = hashed.join(F.broadcast(drawn), "draw").distinct()  # at most ``limit`` hashes
    names = named.join(F.broadcast(drawn), "draw").groupBy("draw").agg(F.sort_array(F.collect_set("name")).alias("names"))
    drawn = found.join(names, "draw").orderBy("draw", "sentence").limit(limit)
    tokens = F.slice(F.regexp_extract_all("sentence", F.lit(TOKEN), F.lit(0)), 1, TRAIN_TOKENS)
    return drawn.select("draw", "sentence", tokens.alias("tokens"), "names")


def train_tagger(df: DataFrame, key: str, column: str, gazetteer: DataFrame, limit: int = TRAIN_SENTENCES, rounds: int = ROUNDS) -> Tagger:
    """Learn a tagger from at most ``limit`` sentences with names of the gazetteer.

    A round trains ``SHARDS`` groups of at most a bounded number of sentences; the driver
    holds one number per bucket and tag.  The outcome does not depend on the
    partitioning of the frame.
    """
    spark = df.sparkSession
    found = gazetteer.where("label IS NOT NULL").select(F.col("label").cast("string")).distinct().limit(MAX_LABELS + 1).collect()
    if len(found) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    labels = tuple(sorted(r[0] for r in found))
    tags = 1 + 2 * len(labels)
    rows = training_sentences(df, key, column, gazetteer.withColumn("label", F.col("label").cast("string")), limit)
    rows = materialize(rows.withColumn("shard", F.pmod("draw", F.lit(SHARDS))), "tagger")
    size = BUCKETS * tags
    weights, total = np.zeros(size + tags * tags), np.zeros(size + tags * tags)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def learn(part: pd.DataFrame) -> pd.DataFrame:
            return _learn(part, labels, shared.value)

        # A stated number of partitions, so that small shards do not end up in one task.
        learned = rows.repartition(8 * SHARDS, "shard").groupBy("shard").applyInPandas(learn, "place bigint, change double, mean double")
        mixed = learned.groupBy("place").agg(F.sum("change").alias("change"), F.sum("mean").alias("mean")).toArrow()
        places = mixed["place"].to_numpy()
        total += weights
        total[places] += mixed["mean"].to_numpy() / SHARDS
        weights = weights.copy()
        weights[places] += mixed["change"].to_numpy() / SHARDS
        shared.unpersist()
    total /= max(rounds, 1)
    return Tagger(labels, total[:size].reshape(BUCKETS, tags), total[size:].reshape(tags, tags))


def _tagged(batch: pa.RecordBatch, texts: pa.DictionaryArray, lengths: np.ndarray, path: np.ndarray, labels: tuple[str, ...]) -> pa.RecordBatch:
    """A row for each run of tags: a begin tag, or an inside tag without one, and the inside tags of its label behind it."""
    starts = np.cumsum(lengths) - lengths
    first = np.zeros(len(path), dtype=bool)
    first[starts] = True
    goes_on = np.zeros(len(path), dtype=bool)
    # A run goes on with the inside tag behind its first tag.
    marked = np.flatnonzero(path)
    run = -1
    for i in marked.tolist():
        if not first[i] and run >= 0 and path[i] == path[run] + 1 and (goes_on[i - 1] or i - 1 == run):
            goes_on[i] = True
        else:
            run = i
    begins = marked[~goes_on[marked]]
    inside = np.flatnonzero(goes_on)
    sizes = 1 + np.bincount(np.searchsorted(begins, inside, side="right") - 1, minlength=len(begins)) if len(begins) else np.zeros(0, dtype=np.int64)
    tokens = texts.take(pa.array(np.sort(np.concatenate([begins, inside])))).cast(pa.string())
    lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), tokens)
    sentence = np.searchsorted(starts, begins, side="right") - 1
    names = pa.array([*labels, None], pa.string()).take(pa.array((path[begins] - 1) // 2))
    return pa.RecordBatch.from_arrays([
        batch.column("key").take(pa.array(sentence)), batch.column("sentence").take(pa.array(sentence)),
        pa.array(begins - starts[sentence], pa.int32()), pc.binary_join(lists, " "), names],
        ["key", "sentence", "token", "mention", "label"])


def tag_entities(df: DataFrame, key: str, column: str, tagger: Tagger) -> DataFrame:
    """Rows ``(key, sentence, token, mention, label)`` of the mentions that the tagger finds in whole texts.

    Sentences become rows before Python sees them, so a long text is not one value there.
    NULL and empty texts have no mentions.
    """
    model = df.sparkSession.sparkContext.broadcast((tagger.labels, tagger.weights, tagger.moves))
    sentences = explode_column(df, [key], sentences_of(F.col(column)), "_text", "sentence")
    tokens = sentences.select(F.col(key).alias("key"), "sentence", F.regexp_extract_all("_text", F.lit(TOKEN), F.lit(0)).alias("tokens"))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, weights, moves = model.value
        moves = moves + _allowed_moves(len(moves))
        for batch in batches:
            held = batch.column("tokens")
            lengths, texts = held.value_lengths().to_numpy().astype(np.int64), held.flatten().dictionary_encode()
            codes, words = texts.indices.to_numpy().astype(np.int64), texts.dictionary
            # Scores of words, looked up by their tokens: every word of a batch is hashed and weighed once.
            own, before, behind = _word_buckets(words.to_pylist())
            own, before, behind = weights[own].sum(axis=1), weights[before], weights[behind]
            left, right = _neighbours(codes, lengths, len(words))
            starts, path = np.cumsum(lengths) - lengths, np.zeros(len(codes), dtype=np.int64)
            order = np.argsort(lengths, kind="stable")
            at = 0
            while at < len(order):
                # Sentences of similar length share a block; a very long one is a block of its own.
                fit = np.arange(1, len(order) - at + 1) * lengths[order[at:]] <= CELLS
                end = at + max(1, int(fit.argmin()) if not fit.all() else len(fit))
                part = order[at:end]
                at = end
                n = lengths[part]
                places = np.repeat(starts[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                scores = _padded(own[codes[places]] + before[left[places]] + behind[right[places]], n)
                best = _viterbi(scores, n, moves)
                path[places] = best[np.arange(best.shape[1]) < n[:, None]]
            yield _tagged(batch, texts, lengths, path, labels)

    kind = tokens.schema["key"].dataType.simpleString()
    tagged = tokens.where(F.size("tokens") > 0).mapInArrow(tag, f"key {kind}, sentence int, token int, mention string, label string")
    return tagged.withColumnRenamed("key", key)
