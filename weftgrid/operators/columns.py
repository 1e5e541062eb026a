"""Column, filter and sort operators: each is a pure ``DataFrame -> DataFrame`` function."""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgrid.functions.rows import explode_column

COMPARISONS: dict[str, Callable[[Column, Any], Column]] = {
    "<=": operator.le, "<": operator.lt, "=": operator.eq,
    "!=": operator.ne, ">=": operator.ge, ">": operator.gt,
}
LONG_LIST = 500  # an exclusion list beyond this joins instead of becoming literals
MOST_DIMENSIONS = 4096  # columns a vector may be spread over
RUN = 10_000     # copies of a row that are sorted as one


# --- projection -------------------------------------------------------------

def project(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns)


def add_column(df: DataFrame, name: str, value: Any) -> DataFrame:
    """Add a constant column, typed by the Python value."""
    return df.withColumn(name, value if isinstance(value, Column) else F.lit(value))


def rename(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumnRenamed(column, name)


def drop(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def _known(df: DataFrame, column: str) -> str:
    """The column's name; a name the frame lacks is an error, since leaving the step out would change the result."""
    if column not in df.columns:
        raise ValueError(f"no column {column} among {', '.join(df.columns)}")
    return column


def apply(df: DataFrame, column: str, function: Callable[[Column], Column]) -> DataFrame:
    """Replace a column by ``function(column)``: a native expression or a pandas UDF."""
    return df.withColumn(_known(df, column), function(F.col(column)))


def to_text(df: DataFrame, column: str) -> DataFrame:
    """Convert a column to string; NULL becomes the empty string."""
    _known(df, column)
    value = F.col(column)
    if _is_vector(df, column):
        value = F.to_json(vector_to_array(value))
    elif isinstance(df.schema[column].dataType, T.StructType | T.ArrayType | T.MapType):
        value = F.to_json(value)
    return df.withColumn(column, F.coalesce(value.cast("string"), F.lit("")))


def _is_vector(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() == "vectorudt"


def vector_element(df: DataFrame, column: str, index: int) -> Column:
    """Value of a vector (dense or sparse) or array column at an index."""
    array = vector_to_array(F.col(column)) if _is_vector(df, column) else F.col(column)
    return F.get(array, F.lit(index)).cast("double")


def expand_vector(df: DataFrame, column: str, size: int | None = None, prefix: str = "dim") -> DataFrame:
    """Spread a vector over columns ``dim0 … `` and drop the source: all dimensions, or the first ``size``.

    Without ``size`` the greatest dimension is looked up first (one pass over the column's sizes, at most
    ``MOST_DIMENSIONS``); shorter vectors have NULL in the rest.
    """
    _known(df, column)
    if size is None:
        array = vector_to_array(F.col(column)) if _is_vector(df, column) else F.col(column)
        size = df.agg(F.max(F.size(array))).first()[0] or 0
        if size > MOST_DIMENSIONS:
            raise ValueError(f"{size} dimensions: keep the vector, or expand the first ones by size")
    names = {f"{prefix}{i}": vector_element(df, column, i) for i in range(size)}
    return df.withColumns(names).drop(column)


def add_row_id(df: DataFrame, name: str = "GridID") -> DataFrame:
    """Unique increasing id; valid within one execution only."""
    return df.withColumn(name, F.monotonically_increasing_id())


def add_row_hash(df: DataFrame, name: str = "row_hash") -> DataFrame:
    """Repeatable 64-bit id computed from the row's content."""
    return df.withColumn(name, F.xxhash64(*_hashable(df)))


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]


def schema_listing(df: DataFrame) -> DataFrame:
    """Rows ``(name, type)`` in case-insensitive name order."""
    rows = sorted(df.dtypes, key=lambda field: field[0].lower())
    return df.sparkSession.createDataFrame(rows, "name string, type string")


# --- split ------------------------------------------------------------------

def split_column(df: DataFrame, column: str, pieces: int, start: str, method: str, info: str | int) -> DataFrame:
    """Split a text column into ``pieces`` new columns and drop it.

    ``method="char"`` cuts at the literal separator ``info``, ``method="length"``
    every ``info`` characters; ``start`` is ``"begin"`` (from the left) or ``"end"``
    (from the right).  A missing piece is NULL.  New columns take the source name
    and the next free numbers.
    """
    _known(df, column)
    cutters = {
        ("char", "begin"): _cut_left, ("char", "end"): _cut_right,
        ("length", "begin"): _chunk_left, ("length", "end"): _chunk_right,
    }
    if (method, start) not in cutters:
        raise ValueError(f"unknown split: method={method!r}, start={start!r}")
    if pieces < 1:
        raise ValueError("pieces must be at least 1")
    text = F.col(column).cast("string")
    made = cutters[method, start](text, pieces, info)
    names = free_names(df.columns, column, pieces)
    return df.withColumns(dict(zip(names, made, strict=True))).drop(column)


def free_names(taken: Iterable[str], base: str, count: int) -> list[str]:
    """``base1 … base<count>``, skipping names already taken."""
    used = set(taken)
    names: list[str] = []
    number = 0
    while len(names) < count:
        number += 1
        if f"{base}{number}" not in used:
            names.append(f"{base}{number}")
    return names


def _cut_left(text: Column, pieces: int, separator: str) -> list[Column]:
    parts = F.split(text, re.escape(separator), pieces)
    return [F.get(parts, F.lit(i)) for i in range(pieces)]


def _cut_right(text: Column, pieces: int, separator: str) -> list[Column]:
    parts = F.split(text, re.escape(separator), -1)
    surplus = F.greatest(F.size(parts) - pieces, F.lit(0))
    head = F.array_join(F.slice(parts, F.lit(1), surplus + 1), separator)
    return [F.when(text.isNotNull(), head)] + [F.get(parts, surplus + i) for i in range(1, pieces)]


def _chunk_left(text: Column, pieces: int, width: str | int) -> list[Column]:
    n = int(width)
    return [F.when(F.length(text) > i * n, F.substring(text, i * n + 1, n)) for i in range(pieces)]


def _chunk_right(text: Column, pieces: int, width: str | int) -> list[Column]:
    n = int(width)
    chunks = []
    for i in range(pieces):
        end = F.length(text) - i * n
        first = F.greatest(end - n, F.lit(0))
        chunks.append(F.when(end > 0, F.substring(text, first + 1, end - first)))
    return chunks


# --- filters ----------------------------------------------------------------

def filter_rows(df: DataFrame, column: str, op: str, value: Any = None) -> DataFrame:
    """Keep rows where ``column op value`` holds; NULL never satisfies a comparison.

    ``op`` is a comparison, ``like`` (text contains the pattern; ``%`` and ``_`` are
    wildcards), ``is null`` or ``is not null``.  The value is a typed literal,
    never SQL text.
    """
    _known(df, column)
    subject, dtype = F.col(column), df.schema[column].dataType
    if op == "is null":
        return df.where(subject.isNull())
    if op == "is not null":
        return df.where(subject.isNotNull())
    if op == "like":
        if not isinstance(dtype, T.StringType):
            raise ValueError("like needs a text column")
        return df.where(subject.like(f"%{value}%"))
    if op not in COMPARISONS:
        raise ValueError(f"unknown operator {op!r}")
    return df.where(COMPARISONS[op](subject, _literal(value, dtype)))


def _literal(value: Any, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return F.lit(str(value))
    if isinstance(dtype, T.NumericType) and isinstance(value, str):
        try:
            value = int(value)
        except ValueError:
            value = float(value)
    return F.lit(value) if isinstance(dtype, T.NumericType) else F.lit(value).cast(dtype)


def filter_interval(df: DataFrame, column: str, low: Any, high: Any, closed: bool = False) -> DataFrame:
    """Keep ``low <= column < high``; ``closed`` includes the upper end."""
    return filter_rows(filter_rows(df, column, ">=", low), column, "<=" if closed else "<", high)


def exclude_values(df: DataFrame, column: str, values: Sequence[str] | DataFrame) -> DataFrame:
    """Drop rows whose text value is listed; NULL reads ``"null"``.

    A list beyond ``LONG_LIST`` values, or a one-column DataFrame, is removed by an
    anti join, which Spark broadcasts when it turns out small.
    """
    text = F.coalesce(F.col(column).cast("string"), F.lit("null"))
    if not isinstance(values, DataFrame):
        if len(values) <= LONG_LIST:
            return df.where(~text.isin(list(values)))
        values = df.sparkSession.createDataFrame([(v,) for v in values], "value string")
    listed = values.toDF("_listed").select(F.coalesce("_listed", F.lit("null")).alias("_listed")).distinct()
    return df.join(listed, text == F.col("_listed"), "left_anti")


def keep_values(df: DataFrame, column: str, values: Sequence[str] | DataFrame) -> DataFrame:
    """The complement of ``exclude_values``, by a semi join where that takes an anti join."""
    text = F.coalesce(F.col(column).cast("string"), F.lit("null"))
    if not isinstance(values, DataFrame):
        if len(values) <= LONG_LIST:
            return df.where(text.isin(list(values)))
        values = df.sparkSession.createDataFrame([(v,) for v in values], "value string")
    listed = values.toDF("_listed").select(F.coalesce("_listed", F.lit("null")).alias("_listed")).distinct()
    return df.join(listed, text == F.col("_listed"), "left_semi")


def non_empty(df: DataFrame, column: str = "value") -> DataFrame:
    return df.where(F.length(column) > 0)


# --- sort, limit, group ------------------------------------------------------

def sort(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Sort the whole frame by a column; NULLs first ascending, last descending.

    Equal values would all land in one range partition, however many they are, so
    a hash of the row breaks ties: a frequent value then spreads over several.
    Whole rows that repeat stay together; ``sort_copies`` is for frames of such rows.
    """
    _known(df, column)
    return df.orderBy(_direction(column, ascending), F.xxhash64(*_hashable(df)))


def sort_copies(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """``sort`` for a frame in which few distinct rows repeat often.

    Copies are counted before the shuffle and travel as runs of at most ``RUN``
    rows, which are written out again after the sort.
    """
    run, size = F.col("_run"), F.col("_size")
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    runs = counted.withColumn("_run", F.explode(F.expr(f"sequence(0, (_copies - 1) div {RUN})")))
    sized = runs.withColumn("_size", F.least(F.lit(RUN), F.col("_copies") - run * RUN))
    ordered = sized.orderBy(_direction(column, ascending), F.xxhash64(*_hashable(df)), run)
    return ordered.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), size))).select(*df.columns)


def _direction(column: str, ascending: bool) -> Column:
    return F.col(column).asc() if ascending else F.col(column).desc()


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows of an order: each task keeps ``k``, no full sort."""
    return df.orderBy(*order).limit(k)


def take(df: DataFrame, n: int = 100) -> DataFrame:
    return df.limit(n)


def group_count(df: DataFrame, *columns: str, name: str = "count") -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias(name))


def group_aggregate(df: DataFrame, columns: Sequence[str], **aggregates: Column) -> DataFrame:
    """Group similar values and aggregate other dimensions, named by keyword."""
    return df.groupBy(*columns).agg(*[expr.alias(name) for name, expr in aggregates.items()])


# --- cells ------------------------------------------------------------------

def to_cells(df: DataFrame, row: str, family: str = "f1", columns: Sequence[str] | None = None) -> DataFrame:
    """Wide rows to ``(row, family, qualifier, value)`` cells, all text; NULL cells are not stored."""
    columns = list(columns) if columns is not None else [c for c in df.columns if c != row]
    texts = df.select(F.col(row).cast("string").alias("row"), *[F.col(c).cast("string").alias(c) for c in columns])
    cells = texts.unpivot("row", columns, "qualifier", "value").where("value is not null")
    return cells.select("row", F.lit(family).alias("family"), "qualifier", "value")


def from_cells(cells: DataFrame, qualifiers: Sequence[str]) -> DataFrame:
    """Cells back to one wide row per ``row`` key; of several values of a cell the greatest stays.

    A cell whose qualifier is not listed makes the job fail.
    """
    names, found = list(qualifiers), F.col("qualifier")
    strange = F.raise_error(F.concat(F.lit("qualifier not listed: "), F.coalesce(found, F.lit("null"))))
    return (
        cells.withColumn("qualifier", F.when(found.isin(names), found).otherwise(strange))
        .groupBy("row").pivot("qualifier", names).agg(F.max("value")))


def explode_lines(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row per line of a ``(key, value)`` frame."""
    return explode_column(df, [key], F.split(F.col(value), "\n"), value)
