"""Sinks. Every write is a distributed Spark job; failures surface as Spark raises them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgrid.operators.pivot import pivot_wide, sort_keys
from weftgrid.sources.readers import load_source


def write_parquet(df: DataFrame, path: str) -> str:
    """Overwrite a Parquet folder."""
    df.write.mode("overwrite").parquet(path)
    return path


def save(df: DataFrame, path: str, fmt: str = "parquet", overwrite: bool = False, **options: str) -> str:
    """Write a frame; an existing target is an error unless ``overwrite``."""
    df.write.format(fmt).options(**options).mode("overwrite" if overwrite else "error").save(path)
    return path


def transfer(spark: SparkSession, item: Mapping[str, Any], path: str) -> dict[str, Any]:
    """Read any source, write it as Parquet and return the new source's descriptor."""
    write_parquet(load_source(spark, item), path)
    return {"name": item.get("name", path.rstrip("/").rpartition("/")[2]), "format": "parquet", "source": path}


def write_word_counts(counts: DataFrame, path: str) -> str:
    """``(word, count)`` rows as text lines ``(word, count)``."""
    counts.select(F.format_string("(%s, %d)", "word", "count").alias("value")).write.mode("overwrite").text(path)
    return path


def write_pivot_tsv(df: DataFrame, path: str, rows: Sequence[str], cols: Sequence[str], aggregator: str = "Count",
                    values: Sequence[str] = ()) -> str:
    """Pivot cells as tab-separated text in natural row order: row attributes, then one column per column key.

    Without column attributes the value column is named after the aggregator.  A
    missing cell is empty.
    """
    wide = pivot_wide(df, rows, cols, aggregator, values, totals=not (rows or cols))
    sort_keys(wide, rows).write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="", nullValue="")
    return path


def json_records(df: DataFrame, n: int | None = None) -> DataFrame:
    """One JSON text per row: all rows, or ``n`` at most where a viewer asks for that."""
    rows = df if n is None else df.limit(n)
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
