"""Turning array columns into rows, binding values, names that are free."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_column(df: DataFrame, keep: list[str], array: Column, name: str, position: str | None = None) -> DataFrame:
    """``keep`` and one row per element of ``array``, with its 0-based place when ``position`` is named.

    A plain ``explode`` makes Spark infer a filter on the array's size and evaluate the
    array twice, once for the filter and once for the rows; the outer form evaluates
    it once.  Elements must not be NULL.
    """
    generated = F.posexplode_outer(array).alias(position, name) if position else F.explode_outer(array).alias(name)
    return df.select(*keep, generated).where(F.col(name).isNotNull())


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of the frame has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
