"""Column profiles: summary statistics and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BUCKETS = 20
_SPAN = "decimal(24,0)"


def describe(df: DataFrame, column: str) -> DataFrame:
    """One row ``count, mean, stddev, min, max`` in one pass; mean and stddev of text that is not a number are NULL."""
    value = F.col(column)
    number = value if isinstance(df.schema[column].dataType, T.NumericType) else value.cast("string").try_cast("double")
    return df.agg(
        F.count(value).alias("count"),
        F.avg(number).cast("double").alias("mean"),
        F.stddev_samp(number).alias("stddev"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def describe_all(df: DataFrame, *columns: str) -> DataFrame:
    """One row per column, all columns in one pass; min and max as text."""
    columns = columns or tuple(df.columns)
    stats = []
    for c in columns:
        value = F.col(c)
        number = value if isinstance(df.schema[c].dataType, T.NumericType) else value.cast("string").try_cast("double")
        stats.append(F.struct(
            F.lit(c).alias("column"),
            F.count(value).alias("count"),
            F.avg(number).cast("double").alias("mean"),
            F.stddev_samp(number).alias("stddev"),
            F.min(value).cast("string").alias("min"),
            F.max(value).cast("string").alias("max"),
        ))
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def histogram(df: DataFrame, column: str, max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """Rows ``bucket, low, high, label, n``; intervals are half open, the last one closed.

    Whole numbers, decimals and text are bucketed by their own rule.  -Infinity, Infinity
    and NaN, where they occur, have a bucket of their own after the finite ones, without
    edges.  The counts always sum to the number of non-null values.  An empty column has
    no buckets.
    """
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.IntegralType):
        return _whole_histogram(df, column, max_buckets)
    if isinstance(dtype, T.NumericType):
        return _decimal_histogram(df, column, max_buckets)
    if isinstance(dtype, T.StringType):
        return _text_histogram(df, column, max_buckets)
    raise ValueError(f"no histogram for {dtype.simpleString()}")


def _whole_histogram(df: DataFrame, column: str, max_buckets: int) -> DataFrame:
    values = df.select(F.col(column).cast("bigint").alias("v")).where("v is not null")
    stats = (
        values.agg(F.min("v").alias("mn"), F.max("v").alias("mx"), F.count("*").alias("rows"))
        .where("rows > 0")
        # The span of two bigints needs a bit more than a bigint.
        .withColumns({"mn": F.col("mn").cast(_SPAN), "mx": F.col("mx").cast(_SPAN)})
        .withColumn("step", F.expr(f"greatest((mx - mn + 2) div least({max_buckets}, rows), 1)").cast(_SPAN))
        .select(F.expr("mn - 1").cast(_SPAN).alias("origin"), "step", F.col("mx").alias("top"))
    )
    edges = _stepped_edges(stats)
    label = F.concat(F.col("low").cast("string"), F.lit(", "), F.col("high").cast("string"))
    slot = F.expr("(cast(v as decimal(20,0)) - g.origin) div g.step")
    counted = _count_buckets(values, edges, slot, label)
    # Edges that a bigint cannot hold are those of the outermost buckets: they read as its limits.
    within = lambda c: F.least(F.greatest(F.col(c), F.lit(-(1 << 63)).cast(_SPAN)), F.lit((1 << 63) - 1).cast(_SPAN)).cast("bigint")
    return counted.withColumns({"low": within("low"), "high": within("high")})


def _text_histogram(df: DataFrame, column: str, max_buckets: int) -> DataFrame:
    values = df.select(F.col(column).alias("v")).where("v is not null")
    stats = (
        values.agg(F.min("v").alias("mn"), F.max("v").alias("mx"), F.count("*").alias("rows"))
        .where("rows > 0")
        .withColumn("shorter", F.least(F.length("mn"), F.length("mx")))
        # Length of the common prefix of the extremes, which every value shares.
        .withColumn("plen", F.expr(
            "if(shorter = 0, 0, size(filter(sequence(1, greatest(shorter, 1)), i -> left(mn, i) = left(mx, i))))"))
        .withColumns({
            "prefix": F.expr("left(mn, plen)"),
            "origin": _code_after("mn").cast("bigint"),
            "top": _code_after("mx").cast("bigint"),
        })
        .withColumn("step", F.expr(f"greatest((top - origin) div least({max_buckets}, rows), 1)"))
        .select("origin", "step", "top", "prefix", "plen")
    )
    edges = _stepped_edges(stats, "prefix", "plen")
    slot = _slot(F.expr("ascii(substring(v, g.plen + 1, 1))").cast("bigint"), F.col("g.origin"), F.col("g.step"))
    label = F.concat("g.prefix", _character("low"), F.lit(", "), "g.prefix", _character("high"))
    return _count_buckets(values, edges, slot, label)


def _code_after(text: str) -> Column:
    """Code point of the character after the common prefix; 0 when there is none."""
    return F.expr(f"ascii(substring({text}, plen + 1, 1))")


def _character(code: str) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(F.col(code)), 8, "0")), "UTF-32")


def _stepped_edges(stats: DataFrame, *extra: str) -> DataFrame:
    """Regular edges from ``origin`` up to ``top``; one more bucket when they stop short of it."""
    steps = F.expr("(top - origin) div step")
    short = F.expr("origin + steps * step < top or steps = 0")
    return stats.withColumn("steps", steps).withColumn("buckets", F.col("steps") + short.cast("bigint")).select(
        F.struct("origin", "step", "buckets", *extra).alias("g"))


def _slot(value: Column, origin: Column, step: Column) -> Column:
    return F.floor((value - origin) / step)


def _decimal_histogram(df: DataFrame, column: str, max_buckets: int) -> DataFrame:
    everything = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    special = F.when(F.isnan("v"), 2).when(F.col("v") == float("inf"), 1).when(F.col("v") == float("-inf"), 0)
    values = everything.where(special.isNull())
    stats = (
        values.agg(F.min("v").alias("mn"), F.max("v").alias("mx"), F.count("*").alias("rows"))
        .where("rows > 0")
        .withColumn("buckets", F.expr(f"least({max_buckets}, rows)"))
        # Near the largest numbers the range is measured in units of 2^64, in which it can't overflow.
        .withColumn("unit", F.expr("CASE WHEN greatest(abs(mn), abs(mx)) > 1e300D THEN 18446744073709551616D ELSE 1D END"))
        .withColumns({"mn": F.expr("mn / unit"), "mx": F.expr("mx / unit")})
        # One beyond the values, or as much as it takes for edges that differ: a double has 52 bits after the first.
        .withColumn("pad", F.expr("greatest(1D, greatest(abs(mn), abs(mx)) * buckets / 4503599627370496D)"))
        .withColumn("origin", F.expr("mn - pad"))
        .withColumn("step", F.expr("((mx + pad) - origin) / buckets"))
        .select(F.struct("origin", "step", "buckets", "unit").alias("g"))
    )
    # Division may land next to an edge it should be on; compare with the edge itself.
    guess = _slot(F.col("v"), F.col("g.origin"), F.col("g.step"))
    slot = F.expr("case when v < g.origin + s * g.step then s - 1 "
                  "when v >= g.origin + (s + 1) * g.step then s + 1 else s end")
    label = F.format_string("%.4f, %.4f", "low", "high")
    finite = _count_buckets(values, stats, slot, label, guess, "g.unit")
    after = F.coalesce(stats.select("g.buckets").scalar(), F.lit(0)).cast("bigint")
    # At most three rows, numbered after the finite buckets.
    others = everything.where(special.isNotNull()).groupBy(special.alias("kind")).agg(F.count("*").alias("n"))
    names = F.element_at(F.array(F.lit("-Infinity"), F.lit("Infinity"), F.lit("NaN")), F.col("kind") + 1)
    nothing = F.lit(None).cast("double")
    return finite.unionByName(others.select(
        (after + F.row_number().over(Window.orderBy("kind")) - 1).alias("bucket"), nothing.alias("low"), nothing.alias("high"),
        names.alias("label"), "n"))


def _count_buckets(values: DataFrame, geometry: DataFrame, slot: Column, label: Column,
                   guess: Column | None = None, unit: str | None = None) -> DataFrame:
    """Count values per bucket and list every bucket, empty ones included.

    Edges are given in units of ``unit``, where one is named; an edge beyond the largest number is that number.

    The geometry is one row, used by the scan as a scalar subquery, so values are
    bucketed and partially counted where they are read.
    """
    placed = values.withColumn("g", geometry.scalar())
    if unit is not None:
        placed = placed.withColumn("v", F.col("v") / F.col(unit))
    if guess is not None:
        placed = placed.withColumn("s", guess)
    counts = (
        placed.select(F.least(slot, F.expr("g.buckets - 1")).cast("bigint").alias("bucket"))
        .groupBy("bucket").agg(F.count("*").alias("n"))
    )
    buckets = geometry.select("g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("g.buckets - 1"))).alias("bucket"))
    closed = F.when(F.expr("bucket = g.buckets - 1"), "]").otherwise(")")
    largest = "1.7976931348623157E308D"
    bounded = lambda edge: F.expr(f"greatest(least(({edge}) * {unit}, {largest}), -{largest})" if unit else edge)
    return (
        buckets.withColumns({"low": bounded("g.origin + bucket * g.step"), "high": bounded("g.origin + (bucket + 1) * g.step")})
        .withColumn("label", F.concat(F.lit("["), label, closed))
        .join(counts, "bucket", "left")
        .select("bucket", "low", "high", "label", F.coalesce("n", F.lit(0)).alias("n"))
    )
