"""Statistics and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgrid.catalog import query, table
from weftgrid.functions.rows import explode_column
from weftgrid.operators.profile import describe, describe_all, histogram


@query("""
    SELECT count(l_extendedprice) AS count, round(avg(l_extendedprice), 4) AS mean,
           round(stddev_samp(l_extendedprice), 4) AS stddev, min(l_extendedprice) AS min, max(l_extendedprice) AS max
    FROM lineitem
""")
def describe_column(spark, sf):
    stats = describe(table(spark, sf, "lineitem"), "l_extendedprice")
    return stats.withColumns({c: F.round(c, 4) for c in ("mean", "stddev")})


@query("""
    SELECT count(o_orderpriority) AS count, NULL::DOUBLE AS mean, NULL::DOUBLE AS stddev,
           min(o_orderpriority) AS min, max(o_orderpriority) AS max FROM orders
""")
def describe_text_column(spark, sf):
    return describe(table(spark, sf, "orders"), "o_orderpriority")


@query("""
    SELECT 'o_custkey' AS "column", count(o_custkey) AS count, round(avg(o_custkey), 4) AS mean,
           round(stddev_samp(o_custkey), 4) AS stddev, min(o_custkey)::VARCHAR AS min, max(o_custkey)::VARCHAR AS max FROM orders
    UNION ALL
    SELECT 'o_totalprice', count(o_totalprice), round(avg(o_totalprice), 4), round(stddev_samp(o_totalprice), 4),
           min(o_totalprice)::VARCHAR, max(o_totalprice)::VARCHAR FROM orders
    UNION ALL
    SELECT 'o_orderstatus', count(o_orderstatus), NULL, NULL, min(o_orderstatus), max(o_orderstatus) FROM orders
""")
def describe_columns(spark, sf):
    stats = describe_all(table(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderstatus")
    return stats.withColumns({c: F.round(c, 4) for c in ("mean", "stddev")})


def _stepped_sql(stats: str, value: str, label: str) -> str:
    """Histogram with regular whole edges; ``stats`` gives one row ``origin, step, top[, prefix, plen]``."""
    return f"""
    WITH s AS ({stats}),
         g AS (SELECT *, (top - origin) // step + CASE WHEN origin + ((top - origin) // step) * step < top
                                                        OR (top - origin) // step = 0 THEN 1 ELSE 0 END AS nb FROM s),
         b AS (SELECT unnest(range(0, nb)) AS bucket, g.* FROM g),
         c AS (SELECT least(({value} - origin) // step, nb - 1) AS bucket, count(*) AS n FROM vals, g GROUP BY 1)
    SELECT b.bucket, origin + b.bucket * step AS low, origin + (b.bucket + 1) * step AS high,
           '[' || {label} || CASE WHEN b.bucket = nb - 1 THEN ']' ELSE ')' END AS label, coalesce(c.n, 0) AS n
    FROM b LEFT JOIN c ON b.bucket = c.bucket
    """


def _whole_sql(column: str, source: str) -> str:
    stats = (f"SELECT min({column})::BIGINT - 1 AS origin, max({column})::BIGINT AS top, "
             f"greatest((max({column})::BIGINT - min({column}) + 2) // least(20, count({column})), 1) AS step FROM {source}")
    label = "(origin + b.bucket * step) || ', ' || (origin + (b.bucket + 1) * step)"
    sql = _stepped_sql(stats, column, label)
    return sql.replace("FROM vals", f"FROM {source}")


def _text_sql(column: str, source: str) -> str:
    stats = f"""
        SELECT *, greatest((top - origin) // least(20, n_rows), 1) AS step FROM (
            SELECT *, left(mn, plen) AS prefix, n_rows,
                   CASE WHEN length(mn) > plen THEN unicode(substr(mn, plen + 1, 1)) ELSE 0 END::BIGINT AS origin,
                   CASE WHEN length(mx) > plen THEN unicode(substr(mx, plen + 1, 1)) ELSE 0 END::BIGINT AS top FROM (
                SELECT mn, mx, n_rows, len(list_filter(range(1, least(length(mn), length(mx)) + 1),
                                                 lambda i: left(mn, i) = left(mx, i))) AS plen FROM (
                    SELECT min({column}) AS mn, max({column}) AS mx, count({column}) AS n_rows FROM {source})))"""
    label = "prefix || chr((origin + b.bucket * step)::INTEGER) || ', ' || prefix || chr((origin + (b.bucket + 1) * step)::INTEGER)"
    value = f"CASE WHEN length({column}) > plen THEN unicode(substr({column}, plen + 1, 1)) ELSE 0 END"
    sql = _stepped_sql(stats, value, label)
    return sql.replace("FROM vals", f"FROM {source}")


@query(_whole_sql("p_size", "part"))
def hist_int(spark, sf):
    return histogram(table(spark, sf, "part"), "p_size")


@query(_whole_sql("n_chars", "documents"))
def hist_int_wide(spark, sf):
    return histogram(table(spark, sf, "documents"), "n_chars")


@query("""
    WITH s AS (SELECT min(l_extendedprice) - 1 AS origin, max(l_extendedprice) + 1 AS fin,
                      least(20, count(l_extendedprice)) AS nb FROM lineitem),
         g AS (SELECT origin, (fin - origin) / nb AS step, nb FROM s),
         e AS (SELECT unnest(range(0, nb)) AS bucket, origin, step, nb FROM g),
         b AS (SELECT bucket, origin + bucket * step AS low, origin + (bucket + 1) * step AS high, nb FROM e),
         c AS (SELECT bucket, count(*) AS n FROM lineitem JOIN b
               ON l_extendedprice >= low AND (l_extendedprice < high OR bucket = nb - 1) GROUP BY 1)
    SELECT b.bucket, round(low, 6) AS low, round(high, 6) AS high,
           '[' || printf('%.4f', low) || ', ' || printf('%.4f', high) || CASE WHEN b.bucket = nb - 1 THEN ']' ELSE ')' END AS label,
           coalesce(c.n, 0) AS n
    FROM b LEFT JOIN c ON b.bucket = c.bucket
""")
def hist_decimal(spark, sf):
    found = histogram(table(spark, sf, "lineitem"), "l_extendedprice")
    return found.withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query("""
    WITH v AS (SELECT l_extendedprice * 1e13::DOUBLE AS v FROM lineitem),
         s AS (SELECT min(v) AS mn, max(v) AS mx, least(20, count(v)) AS nb, greatest(abs(min(v)), abs(max(v))) AS big FROM v),
         p AS (SELECT *, greatest(1.0::DOUBLE, big * nb / 4503599627370496.0::DOUBLE) AS pad FROM s),
         g AS (SELECT mn - pad AS origin, ((mx + pad) - (mn - pad)) / nb AS step, nb FROM p),
         b AS (SELECT bucket, origin + bucket * step AS low, origin + (bucket + 1) * step AS high, nb
               FROM (SELECT unnest(range(0, nb)) AS bucket, origin, step, nb FROM g)),
         c AS (SELECT bucket, count(*) AS n FROM v JOIN b ON v >= low AND (v < high OR bucket = nb - 1) GROUP BY 1)
    SELECT b.bucket, low, high, coalesce(c.n, 0) AS n FROM b LEFT JOIN c ON b.bucket = c.bucket
""")
def hist_decimal_huge(spark, sf):
    """Numbers so large that one more is the same number."""
    items = table(spark, sf, "lineitem").select((F.col("l_extendedprice") * 1e13).alias("v"))
    return histogram(items, "v").select("bucket", "low", "high", "n")


@query("""
    WITH v AS (SELECT CASE WHEN l_linenumber = 7 THEN 1.7e308::DOUBLE WHEN l_linenumber = 6 THEN -1.7e308::DOUBLE ELSE l_extendedprice END AS v FROM lineitem)
    SELECT count(*) FILTER (WHERE v < 0) AS first, count(*) FILTER (WHERE v > 1e300) AS last, count(*) AS rows, 20::BIGINT AS buckets, true AS ordered FROM v
""")
def hist_decimal_range(spark, sf):
    """The whole range of numbers: every value is in a bucket and all edges are numbers."""
    price = F.when(F.col("l_linenumber") == 7, 1.7e308).when(F.col("l_linenumber") == 6, -1.7e308).otherwise(F.col("l_extendedprice"))
    found = histogram(table(spark, sf, "lineitem").select(price.alias("v")), "v")
    at = lambda b: F.sum(F.when(F.col("bucket") == b, F.col("n")).otherwise(0))
    return found.agg(
        at(0).alias("first"), at(19).alias("last"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("buckets"),
        F.every((F.col("low") < F.col("high")) & (F.col("high") <= 1.7976931348623157e308)).alias("ordered"))


@query(_text_sql("o_orderpriority", "orders"))
def hist_string(spark, sf):
    return histogram(table(spark, sf, "orders"), "o_orderpriority")


@query(_text_sql("c_name", "customer"))
def hist_string_prefix(spark, sf):
    """Names that share a long prefix."""
    return histogram(table(spark, sf, "customer"), "c_name")


@query(_text_sql("line", "(SELECT unnest(string_split(text, chr(10))) AS line FROM documents)"))
def hist_string_lines(spark, sf):
    """Lines of text: empty values and letters beyond ASCII."""
    lines = explode_column(table(spark, sf, "documents"), [], F.split("text", "\n"), "line")
    return histogram(lines, "line")


@query("""SELECT count(*) AS n, count(*) AS counted, true AS few, true AS closed FROM orders""")
def hist_hash_column(spark, sf):
    """Whole numbers over the whole range of a bigint: every value is in one of a few joined buckets."""
    orders = table(spark, sf, "orders").select(F.xxhash64("o_orderkey").alias("h"))
    found = histogram(orders, "h").agg(
        F.sum("n").alias("counted"), F.count(F.lit(1)).between(20, 21).alias("few"),
        F.sort_array(F.collect_list(F.struct("bucket", "low", "high"))).alias("b"))
    joined = F.forall(F.sequence(F.lit(1), F.size("b") - 1), lambda i: F.get("b", i)["low"] == F.get("b", i - 1)["high"])
    return found.select(F.lit(orders.count()).alias("n"), "counted", "few", joined.alias("closed"))


@query("""
    SELECT label, n FROM (
        SELECT 'NaN' AS label, count(*) AS n FROM events WHERE event_id % 10 = 0
        UNION ALL SELECT 'Infinity', count(*) FROM events WHERE event_id % 10 = 1
        UNION ALL SELECT '-Infinity', count(*) FROM events WHERE event_id % 10 = 2
        UNION ALL SELECT 'finite', count(value) FROM events WHERE event_id % 10 > 2) WHERE n > 0
""")
def hist_special_values(spark, sf):
    """Infinity and NaN are counted beside the finite buckets."""
    tenth = F.col("event_id") % 10
    value = (F.when(tenth == 0, float("nan")).when(tenth == 1, float("inf")).when(tenth == 2, float("-inf"))
             .otherwise(F.col("value").cast("double")))
    found = histogram(table(spark, sf, "events").select(value.alias("v")), "v")
    label = F.when(F.col("low").isNull(), F.col("label")).otherwise("finite")
    return found.groupBy(label.alias("label")).agg(F.sum("n").alias("n"))
