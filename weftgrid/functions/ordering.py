"""Sort keys for pivot-grid labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(value: Column) -> Column:
    """Sortable key: case-insensitive, runs of digits compared as numbers.

    A run that starts with 0 reads as a fraction (``007`` as ``.007``).  Where a text run
    is a prefix of the other text, the shorter run comes first; comparing pair by
    pair, as browsers do, is not transitive there and so cannot be a sort key.
    """
    chunks = F.regexp_extract_all(F.lower(value.cast("string")), F.lit(r"(\d+|\D+)"), F.lit(1))

    def part(chunk: Column) -> Column:
        digits = chunk.rlike(r"^\d")
        number = F.when(chunk.startswith("0"), F.concat(F.lit("."), F.substring(chunk, 2, 1 << 30), F.lit("0"))).otherwise(chunk)
        return F.struct(
            F.when(digits, 0).otherwise(1).alias("kind"),
            F.when(digits, number).try_cast("double").alias("number"),
            F.when(~digits, chunk).alias("text"),
        )

    return F.transform(chunks, part)


def natural_order(value: Column) -> list[Column]:
    """Total order: natural key, then the text itself."""
    return [natural_key(value).asc(), value.cast("string").asc()]


def listed_order(value: Column, listed: Sequence[str]) -> list[Column]:
    """Listed values first, in list order; the rest in natural order."""
    place = F.array_position(F.array(*map(F.lit, listed)), value.cast("string"))
    return [F.coalesce(F.nullif(place, F.lit(0)), F.lit(len(listed) + 1)).asc(), *natural_order(value)]
