"""Ranks over a whole table without sorting it inside one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgrid.session import materialize

SMALL_ROWS = 50_000
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in the lower 33 bits


def global_rank(df: DataFrame, order: Sequence[Column], name: str, small_rows: int = SMALL_ROWS) -> DataFrame:
    """Add the 1-based position of every row in the total order given by ``order``.

    A frame of at most ``small_rows`` rows (counted first) is ranked by one
    window.  A larger one is range-partitioned by the order and written out with the
    partition and row number of every row, which then stay fixed; a position is the
    row number plus the row counts of the partitions before.
    ``order`` must not leave ties.
    """
    if df.limit(small_rows + 1).count() <= small_rows:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))

    placed = materialize(df.orderBy(*order).withColumn("_pos", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumns({
        "_part": F.shiftright("_pos", _LOCAL_BITS),
        "_row": F.col("_pos").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)),
    })
    # One row per partition: bounded by the partition count, whatever the data size.
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_row") + 1)
        .drop("_part", "_pos", "_row", "_offset")
    )
