"""Source inventory: one Spark job over file metadata, no file content is read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Formats by extension, accepted extensions, size units.
FORMATS = {
    "csv": "csv", "json": "json", "html": "html", "htm": "html", "xml": "xml", "txt": "text",
    "parquet": "binary",
}
ALLOWED_EXTENSIONS = ["csv", "json", "parquet", "txt", "html", "xml"]
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]


def extension(name: Column) -> Column:
    """Text after the last dot; NULL without a dot."""
    return F.when(name.contains("."), F.element_at(F.split(name, r"\."), -1))


def infer_format(name: Column) -> Column:
    """Format by file extension; ``binary`` when unknown."""
    known = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(extension(name))), F.lit("binary"))


def allowed(name: Column) -> Column:
    return F.coalesce(extension(name).isin(ALLOWED_EXTENSIONS), F.lit(False))


def readable_size(size: Column) -> tuple[Column, Column]:
    """``(measure, unit)``: whole units of 1024; more than 1000 of a unit reads 1 of the next."""
    size = size.cast("bigint")
    power, shrunk = F.lit(0), size
    for k in range(1, len(SIZE_UNITS) + 1):
        power = F.when(size >= 1 << 10 * k, k).otherwise(power)
        shrunk = F.when(size >= 1 << 10 * k, F.shiftright(size, 10 * k)).otherwise(shrunk)
    next_unit = shrunk > 1000
    units = F.array(*map(F.lit, SIZE_UNITS))
    unit = F.coalesce(F.get(units, power + next_unit.cast("int")), F.lit(""))
    return F.when(next_unit, F.lit(1).cast("bigint")).otherwise(shrunk), unit


def source_order() -> list[Column]:
    return [F.lower("type"), F.lower("format"), F.lower("name")]


def source_inventory(spark: SparkSession, path: str | Sequence[str], kind: str = "File") -> DataFrame:
    """Accepted files below a path: ``name, type, format, source, bytes, measure, unit, modified``, listed in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(
        path if isinstance(path, str) else list(path))
    return describe_files(files.select("path", "length", "modificationTime"), kind)


def describe_files(files: DataFrame, kind: str = "File") -> DataFrame:
    """The inventory of ``(path, length, modificationTime)`` rows."""
    name = F.element_at(F.split("path", "/"), -1)
    measure, unit = readable_size(F.col("length"))
    return files.where(allowed(name)).select(
        name.alias("name"), F.lit(kind).alias("type"), infer_format(name).alias("format"),
        F.col("path").alias("source"), F.col("length").alias("bytes"), measure.alias("measure"), unit.alias("unit"),
        F.col("modificationTime").alias("modified"),
    ).orderBy(*source_order())
