"""Readers: one DataFrame per declared format, any path scheme Spark knows.

Inference reads the data once more; at scale pass ``schema``.  ``load_source`` also
normalises the column names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgrid.operators.text import html_to_text
from weftgrid.sources.names import clean_columns

Schema = T.StructType | str | None

# JDBC drivers by database name.
JDBC_DRIVERS = {
    "mysql": "com.mysql.cj.jdbc.Driver",
    "mariadb": "org.mariadb.jdbc.Driver",
    "postgresql": "org.postgresql.Driver",
    "derby": "org.apache.derby.jdbc.EmbeddedDriver",
}


def read_json(spark: SparkSession, path: str, schema: Schema = None, multi_line: bool = False) -> DataFrame:
    """JSON lines; a line may hold an array of records. ``multi_line`` reads one document per file."""
    return _with_schema(spark, schema).option("multiLine", multi_line).json(path)


def read_xml(spark: SparkSession, path: str, row_tag: str = "doc", schema: Schema = None) -> DataFrame:
    return _with_schema(spark, schema).format("xml").option("rowTag", row_tag).load(path)


def read_csv(spark: SparkSession, path: str, schema: Schema = None, header: bool = True, sep: str = ",") -> DataFrame:
    return _with_schema(spark, schema).csv(path, header=header, sep=sep, inferSchema=schema is None)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(file, text)``: one row per file."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``: one row per line."""
    return spark.read.text(path)


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """``(file, text)`` of pages without their tags and entities."""
    return html_to_text(read_texts(spark, path), "text")


def read_table(spark: SparkSession, dbms: str, host: str, port: str | int, database: str, table: str,
               username: str, password: str, key: str | None = None, partitions: int = 32, **options: Any) -> DataFrame:
    """A database table; with a numeric ``key`` it is read in ``partitions`` parts between the key's least and greatest value.

    Without a key one task reads it all, which only suits small tables.
    """
    settings = jdbc_options(dbms, host, port, database, table, username, password, **options)
    reader = spark.read.format("jdbc")
    if key is not None:
        ends = reader.options(**settings | {"dbtable": key_range_query(table, key)}).load().first()
        settings |= key_ranges(key, ends[0], ends[1], partitions)
    return spark.read.format("jdbc").options(**settings).load()


def key_range_query(table: str, key: str) -> str:
    return f"(SELECT min({key}) AS low, max({key}) AS high FROM {table}) key_range"


def key_ranges(key: str, low: Any, high: Any, partitions: int) -> dict[str, str]:
    """Reader options that cut a table by a numeric key; none for a table without keys."""
    if low is None:
        return {}
    low, high = math.floor(low), math.ceil(high)
    return {
        "partitionColumn": key, "lowerBound": str(low), "upperBound": str(high + 1),
        "numPartitions": str(max(1, min(partitions, high - low + 1))),
    }


def jdbc_options(dbms: str, host: str, port: str | int, database: str, table: str,
                 username: str, password: str, **options: Any) -> dict[str, str]:
    settings = {
        "url": f"jdbc:{dbms.lower()}://{host}:{port}/{database}",
        "dbtable": table, "user": username, "password": password,
    }
    if dbms.lower() in JDBC_DRIVERS:
        settings["driver"] = JDBC_DRIVERS[dbms.lower()]
    return settings | {key: str(value) for key, value in options.items()}


def read_view(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def rows_frame(spark: SparkSession, rows: Sequence[Any], schema: Schema = None) -> DataFrame:
    """A frame of rows at hand."""
    return spark.createDataFrame(rows, schema)


def empty_frame(spark: SparkSession) -> DataFrame:
    """No rows, no columns: the grid before the first source."""
    return spark.createDataFrame([], T.StructType([]))


def typed_fields(lines: DataFrame, fields: Mapping[str, str], column: str = "value", sep: str = ",") -> DataFrame:
    """Split delimited lines into named, typed columns; a bad or missing field is NULL."""
    parts = F.split(F.col(column), re.escape(sep))
    return lines.select(*[
        F.get(parts, F.lit(i)).try_cast(dtype).alias(name) for i, (name, dtype) in enumerate(fields.items())
    ])


def load_source(spark: SparkSession, item: Mapping[str, Any], schema: Schema = None) -> DataFrame:
    """Read a source descriptor ``{format, source | path, …}`` with normalised column names.

    A landed file (``path``) is read instead of its origin (``source``).
    """
    fmt = item["format"]
    if fmt == "table":
        keys = ("dbms", "host", "port", "database", "table", "username", "password")
        return clean_columns(read_table(spark, **{k: item[k] for k in keys}, **item.get("options", {})))
    path = item.get("path", item.get("source"))
    if fmt == "json":
        df = read_json(spark, path, schema)
    elif fmt == "xml":
        df = read_xml(spark, path, item.get("row_tag", "doc"), schema)
    elif fmt == "csv":
        df = read_csv(spark, path, schema)
    elif fmt in ("parquet", "binary"):
        df = read_parquet(spark, path)
    elif fmt == "html":
        df = read_html(spark, path)
    else:
        df = read_texts(spark, path)
    return clean_columns(df)


def _with_schema(spark: SparkSession, schema: Schema):
    return spark.read.schema(schema) if schema is not None else spark.read
