"""Connected components of a graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _lowest(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("low"))


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node that is not the smallest of its component.

    Links ``(a, b)`` of whole numbers are turned into stars by alternating steps: larger neighbours are hung on a node's
    lowest neighbour, then smaller ones.  Both steps are a minimum per node, which Spark combines before its shuffle,
    and a join; each round is written, and rounds end when the links no longer change.
    """
    now = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = _state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = _lowest(both).select("u", F.least("u", "low").alias("low"))
        large = both.where("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        # Now every link points from a larger node to a smaller one.
        small = large.join(_lowest(large), "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("link"))
        now = materialize(small.select("link.*").where("u <> v").distinct(), "links")
        state = _state(now)
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
