"""Benchmark decontamination: stream texts past a suffix automaton of the benchmark's items."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .automaton import SuffixAutomaton
from .common import small_batches, unused

#: Words of lower-cased text, as bytes: digits, letters a to z and everything beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of item text in one automaton; a larger benchmark takes several passes over the documents.
BLOCK_BYTES = 2 << 20

HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("starts", T.ArrayType(T.IntegerType())),  # first and last word of each span
    T.StructField("ends", T.ArrayType(T.IntegerType())),
    T.StructField("items", T.ArrayType(T.StringType())),
])
#: With the text without the spans; NULL where there are none.
CUT = T.StructType([*HITS, T.StructField("cut", T.StringType())])
_ARROW_HITS = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def tokens(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


def _reader(spark: SparkSession, items: list[tuple[str, str]], window: int) -> Callable[[str | None], dict]:
    """From a text to a row of HITS, for items that fit one automaton; a task builds it once."""
    shared = spark.sparkContext.broadcast(items)
    built: list[tuple[list[str], SuffixAutomaton]] = []

    def read(text: str | None) -> dict:
        if not built:
            built.append(([name for name, _ in shared.value], SuffixAutomaton([tokens(t) for _, t in shared.value], window)))
        names, automaton = built[0]
        words = tokens(text or "")
        spans, hit = automaton.spans(words)
        return {"n_words": len(words), "starts": [a for a, _ in spans], "ends": [b for _, b in spans],
                "items": sorted({names[i] for i in hit})}

    return read


def _scanner(spark: SparkSession, items: list[tuple[str, str]], window: int):
    """Arrow UDF from texts to HITS for items that fit one automaton."""
    read = _reader(spark, items, window)

    @F.arrow_udf(HITS)
    def scan(texts: pa.Array) -> pa.Array:
        return pa.array([read(t.as_py()) for t in texts], _ARROW_HITS)

    return scan


def _cutter(spark: SparkSession, items: list[tuple[str, str]], window: int):
    """Arrow UDF from texts and HITS of earlier passes to CUT: one worker of a task scans, unites and cuts."""
    read = _reader(spark, items, window)

    @F.arrow_udf(CUT)
    def cut(texts: pa.Array, *earlier: pa.Array) -> pa.Array:
        rows = []
        for text, *parts in zip((t.as_py() for t in texts), *[e.to_pylist() for e in earlier]):
            hits = united([*parts, read(text)])
            rows.append(hits | {"cut": without_spans(text, hits["starts"], hits["ends"]) if hits["starts"] else None})
        return pa.array(rows, pa.struct([*_ARROW_HITS, ("cut", pa.string())]))

    return cut.asNondeterministic()  # else a filter on the result scans all texts once more


def united(parts: list[dict]) -> dict:
    """Rows of HITS of one text as one: spans united, items united."""
    if len(parts) == 1:
        return parts[0]
    merged: list[list[int]] = []
    for a, b in sorted(s for p in parts for s in zip(p["starts"], p["ends"])):
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return {"n_words": parts[0]["n_words"], "starts": [a for a, _ in merged], "ends": [b for _, b in merged],
            "items": sorted({i for p in parts for i in p["items"]})}


def _merge(passes: list[Column]) -> Column:
    """HITS of several passes as one."""
    if len(passes) == 1:
        return passes[0]

    @F.arrow_udf(HITS)
    def union(*batches: pa.Array) -> pa.Array:
        return pa.array([united(list(parts)) for parts in zip(*[b.to_pylist() for b in batches])], _ARROW_HITS)

    return union(*passes)


def mark_contamination(docs: DataFrame, items: DataFrame, text: str = "text", window: int = 13,
                       block_bytes: int = BLOCK_BYTES, out: str = "hits", cut: bool = False) -> DataFrame:
    """``docs`` with ``out``: the number of words, the merged spans of words inside an occurrence, and the items hit.

    An occurrence is any ``window`` consecutive words of an item, or a whole item of fewer words.  ``items`` has
    ``item_id`` and ``text``; items without words match nothing, a NULL id is named by the empty text, and repeated
    rows count once.  The
    benchmark is cut into blocks of at most ``block_bytes`` of text (one item may exceed it); each block is one
    broadcast automaton and one pass over the documents, so memory is bounded whatever the benchmark's size.  NULL
    texts have no words; an empty benchmark hits nothing.  A column named ``out`` is replaced.  With ``cut`` it also
    has the text without the spans (NULL where there are none), made by the worker that scans the text last.
    """
    spark = docs.sparkSession
    small_batches(spark)
    weighed = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text",
        F.octet_length("text").cast("long").alias("bytes")).where("bytes > 0").distinct()
    total = weighed.agg(F.sum("bytes"), F.max("bytes")).first()
    blocks = -(-(total[0] or 0) // block_bytes) or 1
    if blocks > 1:
        weighed = materialize(weighed, "items")
    frame, passes = docs.drop(out), []
    for block in range(blocks):
        dealt = weighed if blocks == 1 else weighed.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == block)
        found = [(r["name"], r["text"]) for r in dealt.select("name", "text").collect()]
        if cut and block == blocks - 1:
            return frame.withColumn(out, _cutter(spark, found, window)(F.col(text), *map(F.col, passes))).drop(*passes)
        passes.append(unused(frame, f"_pass{block}"))
        frame = frame.withColumn(passes[-1], _scanner(spark, found, window)(F.col(text)))
        if blocks > 1:
            frame = materialize(frame, "pass")  # a worker holds one automaton at a time
    return frame.withColumn(out, _merge([F.col(p) for p in passes])).drop(*passes)


def hit_words(hits: Column) -> Column:
    """Number of words inside spans."""
    return F.aggregate(
        F.zip_with(hits["starts"], hits["ends"], lambda a, b: (b - a + 1).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def is_contaminated(hits: Column, least_share: int = 20) -> Column:
    """At least one word in ``least_share`` is inside an occurrence."""
    n = hit_words(hits)
    return (n > 0) & (least_share * n >= hits["n_words"])


def without_spans(text: str, starts: list[int], ends: list[int]) -> str:
    """A text without the words of the spans and what stands between those words."""
    whole = text.encode()
    places = [m.span() for m in _WORD.finditer(whole.lower())]
    pieces, at = [], 0
    for a, b in zip(starts, ends):
        pieces.append(whole[at:places[a][0]])
        at = places[b][1]
    return b"".join([*pieces, whole[at:]]).decode()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, least_share: int = 20) -> DataFrame:
    """``docs`` without contaminated documents and, in the others, without the spans that repeat an item.

    A document goes when one word in ``least_share`` or more is inside an occurrence (coverage limit); spans of
    ``window`` words or whole short items are cut from the rest (length limit).  NULL texts stay.
    """
    hits = unused(docs, "_hits")
    marked = mark_contamination(docs, items, window=window, out=hits, cut=True)
    return marked.where(~is_contaminated(F.col(hits), least_share)).withColumn("text", F.coalesce(F.col(hits)["cut"], "text")).drop(hits)


def digest(names: Column) -> Column:
    """SHA-256 of sorted item names, joined by commas."""
    return F.sha2(F.array_join(names, ","), 256)
