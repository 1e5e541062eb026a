"""The data grid: a base frame and a recipe of named steps, with linear undo and redo.

A grid is immutable: the history is a list of frames, and no step ever replaces the
data by a sample.  Most steps only extend a plan.  Four need to look at the data when
they are added and run jobs then: ``join`` (frequent keys), ``label`` (value counts),
``tf_idf`` (the chosen terms) and the models ``word2vec`` and ``lda``; a replay runs them again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from functools import reduce
from threading import Lock
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgrid.functions.rows import free_name
from weftgrid.operators import columns, docindex, features, pivot, profile, text
from weftgrid.operators.ujoin import ujoin
from weftgrid.session import materialize
from weftgrid.sources import sinks
from weftgrid.sources.readers import empty_frame, load_source

Step = tuple[str, Callable[[DataFrame], DataFrame]]
SAMPLE_ROWS = 1000
PREVIEW_MIN = 100
VIEW = "DataGrid"
_BINDING = Lock()  # held while a query is read, since the session has one view of that name


@dataclass(frozen=True)
class Grid:
    """``frames[i]`` is the lazy frame after ``i`` steps; ``frames[0]`` is the base."""

    frames: tuple[DataFrame, ...]
    steps: tuple[Step, ...] = ()
    cursor: int = 0

    # --- sources ---------------------------------------------------------------

    @classmethod
    def empty(cls, spark: SparkSession) -> Grid:
        return cls((empty_frame(spark),))

    @classmethod
    def load(cls, source: DataFrame | Mapping[str, Any], spark: SparkSession | None = None) -> Grid:
        """A new grid of one source; history starts here."""
        return cls((_frame(source, spark),))

    def join(self, source: DataFrame | Mapping[str, Any], **options: Any) -> Grid:
        """u-join another source. After expensive steps, ``cut()`` first: the join looks at the keys beforehand."""
        other = _frame(source, self.spark)
        return self.step("join", lambda df: ujoin(df, other, **options))

    @property
    def spark(self) -> SparkSession:
        return self.base.sparkSession

    # --- recipe ------------------------------------------------------------------

    @property
    def base(self) -> DataFrame:
        return self.frames[0]

    @property
    def df(self) -> DataFrame:
        """The current frame."""
        return self.frames[self.cursor]

    def step(self, name: str, function: Callable[[DataFrame], DataFrame]) -> Grid:
        """Append a step; steps undone before are forgotten."""
        done = self.cursor
        return Grid(
            (*self.frames[: done + 1], function(self.df)),
            (*self.steps[:done], (name, function)),
            done + 1,
        )

    def undo(self) -> Grid:
        return replace(self, cursor=max(self.cursor - 1, 0))

    def redo(self) -> Grid:
        return replace(self, cursor=min(self.cursor + 1, len(self.steps)))

    def reset(self) -> Grid:
        """Back to the base, without history."""
        return Grid((self.base,))

    def clear(self) -> Grid:
        return Grid.empty(self.spark)

    def history(self) -> list[str]:
        return [name for name, _ in self.steps[: self.cursor]]

    def replay(self, base: DataFrame) -> Grid:
        """The current recipe on other data."""
        return reduce(lambda grid, step: grid.step(*step), self.steps[: self.cursor], Grid((base,)))

    def cut(self, label: str = "grid") -> Grid:
        """Write the current frame to the shared folder and go on from the copy, without history."""
        return Grid((materialize(self.df, label),))

    # --- column steps --------------------------------------------------------------

    def add_column(self, name: str, value: Any) -> Grid:
        return self.step("add_column", lambda df: columns.add_column(df, name, value))

    def rename(self, column: str, name: str) -> Grid:
        return self.step("rename", lambda df: columns.rename(df, column, name))

    def drop(self, *names: str) -> Grid:
        return self.step("drop", lambda df: columns.drop(df, *names))

    def apply(self, column: str, function: Callable[[Column], Column]) -> Grid:
        return self.step("apply", lambda df: columns.apply(df, column, function))

    def convert(self, column: str) -> Grid:
        return self.step("convert", lambda df: columns.to_text(df, column))

    def expand(self, column: str, size: int | None = None) -> Grid:
        return self.step("expand", lambda df: columns.expand_vector(df, column, size))

    def split(self, column: str, pieces: int, start: str, method: str, info: str | int) -> Grid:
        return self.step("split", lambda df: columns.split_column(df, column, pieces, start, method, info))

    def filter(self, column: str, op: str, value: Any = None) -> Grid:
        return self.step("filter", lambda df: columns.filter_rows(df, column, op, value))

    def exclude(self, column: str, values: list[str] | DataFrame) -> Grid:
        return self.step("exclude", lambda df: columns.exclude_values(df, column, values))

    def keep(self, column: str, values: list[str] | DataFrame) -> Grid:
        return self.step("keep", lambda df: columns.keep_values(df, column, values))

    def where(self, condition: str | Column) -> Grid:
        return self.step("where", lambda df: df.where(condition))

    def sort(self, column: str, ascending: bool = True) -> Grid:
        return self.step("sort", lambda df: columns.sort(df, column, ascending))

    def index(self, name: str = "GridID") -> Grid:
        return self.step("index", lambda df: columns.add_row_id(df, name))

    # --- text and feature steps -----------------------------------------------------

    def tokenize(self, column: str) -> Grid:
        return self.step("tokenize", lambda df: text.tokenize(df, column))

    def preprocess(self, column: str) -> Grid:
        return self.step("preprocess", lambda df: text.preprocess(df, column))

    def keep_alphabetic(self, column: str) -> Grid:
        return self.step("keep_alphabetic", lambda df: text.keep_alphabetic(df, column))

    def keep_long(self, column: str, length: int = 3) -> Grid:
        return self.step("keep_long", lambda df: text.keep_long(df, column, length))

    def remove_stop_words(self, column: str, **options: Any) -> Grid:
        return self.step("remove_stop_words", lambda df: text.remove_stop_words(df, column, **options))

    def stem(self, column: str) -> Grid:
        return self.step("stem", lambda df: text.stem_words(df, column))

    def sentences(self, column: str) -> Grid:
        return self.step("sentences", lambda df: text.segment_sentences(df, column))

    def tf_idf(self, column: str, n: int) -> Grid:
        return self.step("tf_idf", lambda df: features.tfidf_wide(df, column, n))

    def word2vec(self, column: str, **options: Any) -> Grid:
        return self.step("word2vec", lambda df: features.word2vec(df, column, **options))

    def lda(self, column: str, **options: Any) -> Grid:
        return self.step("lda", lambda df: features.topic_columns(df, column, **options))

    def label(self, column: str) -> Grid:
        return self.step("label", lambda df: features.label(df, column))

    # --- reading the grid --------------------------------------------------------------

    def schema(self) -> DataFrame:
        return columns.schema_listing(self.df)

    def preview(self, n: int = 100) -> DataFrame:
        return self.df.limit(n)

    def sample(self, rows: int = SAMPLE_ROWS, seed: int = 42) -> DataFrame:
        """About ``rows`` rows without replacement; the grid itself stays whole."""
        return sample(self.df, rows, seed)

    def sampled_preview(self, rows: int = SAMPLE_ROWS, at_least: int = PREVIEW_MIN, seed: int = 42) -> DataFrame:
        """The recipe on a sample of the base, or a sample of the result when too few of its rows are left."""
        quick = self.replay(sample(self.base, rows, seed)).df
        return quick if quick.limit(at_least).count() >= at_least else self.sample(rows, seed)

    def describe(self, column: str) -> DataFrame:
        return profile.describe(self.df, column)

    def histogram(self, column: str) -> DataFrame:
        return profile.histogram(self.df, column)

    def pivot(self, rows: list[str], cols: list[str], aggregator: str = "Count", values: tuple[str, ...] = ()) -> DataFrame:
        return pivot.pivot(self.df, rows, cols, aggregator, values)

    def entities(self, key: str, column: str, gazetteer: DataFrame) -> DataFrame:
        return text.entity_mentions(self.df, key, column, gazetteer)

    def search(self, key: str, column: str, terms: list[str]) -> DataFrame:
        return docindex.term_search(self.df, key, column, terms)

    def sql(self, query: str = f"SELECT * FROM {VIEW}", n: int | None = None, **args: Any) -> DataFrame:
        """Run Spark SQL over the view ``DataGrid``; all rows come back unless ``n`` caps what is shown.

        Values go in as ``:name`` parameters.  The name is bound while the query is read, so grids of
        one session can be asked from many threads, and a frame keeps reading its own grid.
        """
        with _BINDING:
            self.df.createOrReplaceTempView(VIEW)
            result = self.spark.sql(query, args=args or None)
        return result if n is None else result.limit(n)

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
        """Cache the current frame; the caller unpersists it."""
        return self.df.persist(level)

    def save(self, path: str, fmt: str = "parquet", overwrite: bool = False) -> str:
        return sinks.save(self.df, path, fmt, overwrite)


def _frame(source: DataFrame | Mapping[str, Any], spark: SparkSession | None) -> DataFrame:
    return source if isinstance(source, DataFrame) else load_source(spark, source)


def sample(df: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """About ``rows`` rows: fraction ``min(1, rows / count)``, without replacement."""
    count = df.count()
    return df if count <= rows else df.sample(False, rows / count, seed)


def sample_exact(df: DataFrame, key: list[str], rows: int = SAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """The ``rows`` rows whose key digests come first: the same rows however the data is partitioned."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    return df.orderBy(digest, *key).limit(rows)


def sample_strata(df: DataFrame, strata: list[str], key: list[str], rows: int, seed: int = 42) -> DataFrame:
    """Of every stratum the ``rows`` rows whose key digests come first (all rows of a smaller one), in one scan.

    The same rows however the data is partitioned.  Up to 1,000 rows (Spark's
    ``windowGroupLimitThreshold``) each partition keeps only its first ``rows`` of a stratum before
    the shuffle, so a stratum of a third of all rows costs no more than others.  Rows with
    equal keys are drawn together; NULL is a stratum.
    """
    rank = free_name(df, "_rank")
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    first = Window.partitionBy(*strata).orderBy(digest, *key)
    return df.withColumn(rank, F.row_number().over(first)).where(F.col(rank) <= rows).drop(rank)


def list_views(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())
