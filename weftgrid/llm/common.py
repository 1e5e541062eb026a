"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, even where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words of a text as an array; NULL has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def count_words(text: Column) -> Column:
    """Number of words; NULL has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows from now on: texts are long, and a worker and its executor hold whole batches.

    Results do not depend on it.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= rows:
        spark.conf.set(setting, str(rows))


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of the frame has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with its columns of the given names renamed, and a function that gives a result of it the columns of ``df`` again.

    An operator that adds columns of these names then leaves those of the caller alone.
    """
    given, taken, renamed = df.columns, {n.lower() for n in names}, {}
    for c in given:
        if c.lower() in taken:
            renamed[c] = new = unused(df, f"{c}_aside")
            df = df.withColumnRenamed(c, new)
    return df, lambda out: out.select(*[F.col(f"`{renamed.get(c, c)}`").alias(c) for c in given])


def amount_before(df: DataFrame, group: str, cell: str, order: list[str | Column], amount: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over the rows of the same group that come earlier by ``(cell, *order)``.

    ``group`` and ``cell`` are whole numbers without NULL.  Only the rows of one cell meet in a task; what lies
    before a cell is a sum over per-cell totals.  ``df`` is read twice and must give the same rows both times.
    """
    value, total, start = (unused(df, n) for n in ("_value", "_total", "_start"))
    valued = df.withColumn(value, amount)
    earlier = Window.partitionBy(group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        valued.groupBy(group, cell).agg(F.sum(value).alias(total))
        .select(group, cell, F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(start)))
    inside = Window.partitionBy(group, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        valued.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, [group, cell]).withColumn(out, F.col(out) + F.col(start)).drop(value, start))
