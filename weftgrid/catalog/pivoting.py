"""Pivot grids: aggregators, fractions, layouts, derived attributes, key order and display."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgrid.catalog import query, table
from weftgrid.functions.numbers import bin_down, date_text, integer_text, number_text, percent_text
from weftgrid.functions.ordering import listed_order, natural_order
from weftgrid.operators import pivot as pv
from weftgrid.operators.ranking import global_rank

ROWS, COLS = ["l_returnflag"], ["l_linestatus"]
LEVEL = """CASE WHEN grouping({r}) = 0 AND grouping({c}) = 0 THEN 'cell' WHEN grouping({r}) = 0 THEN 'row'
           WHEN grouping({c}) = 0 THEN 'col' ELSE 'total' END AS level"""


def _grid_sql(value: str, source: str = "lineitem", r: str = "l_returnflag", c: str = "l_linestatus") -> str:
    return f"""SELECT {r}, {c}, {LEVEL.format(r=r, c=c)}, {value} AS value
    FROM {source} GROUP BY GROUPING SETS (({r}, {c}), ({r}), ({c}), ())"""


def _rounded(grid, digits: int):
    return grid.withColumn("value", F.round("value", digits))


def _pivot(spark, sf, aggregator, values=()):
    return pv.pivot(table(spark, sf, "lineitem"), ROWS, COLS, aggregator, values)


@query(_grid_sql("count(*)"))
def pivot_count(spark, sf):
    return _pivot(spark, sf, "Count")


_LABELLED = """(SELECT lang, coalesce(CAST(quality AS VARCHAR), 'null') AS quality, toxic
                FROM documents LEFT JOIN labels USING (doc_id))"""


def _labelled(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return docs.join(table(spark, sf, "labels"), "doc_id", "left")


@query(_grid_sql("count(DISTINCT toxic) + max(CASE WHEN toxic IS NULL THEN 1 ELSE 0 END)", _LABELLED, "lang", "quality"))
def pivot_count_unique(spark, sf):
    """NULL keys read "null" and a NULL value counts once."""
    return pv.pivot(_labelled(spark, sf), ["lang"], ["quality"], "Count Unique Values", ["toxic"])


@query(_grid_sql("count(DISTINCT l_orderkey)"))
def pivot_count_unique_keys(spark, sf):
    return _pivot(spark, sf, "Count Unique Values", ["l_orderkey"])


@query(_grid_sql("string_agg(DISTINCT coalesce(CAST(toxic AS VARCHAR), ''), ', ' ORDER BY coalesce(CAST(toxic AS VARCHAR), ''))",
                 _LABELLED, "lang", "quality"))
def pivot_list_unique(spark, sf):
    return pv.pivot(_labelled(spark, sf), ["lang"], ["quality"], "List Unique Values", ["toxic"])


@query("""
    SELECT DISTINCT l_returnflag, l_linestatus, level, l_partkey AS value FROM (
        SELECT l_returnflag, l_linestatus, 'cell' AS level, l_partkey FROM lineitem
        UNION ALL SELECT l_returnflag, NULL, 'row', l_partkey FROM lineitem
        UNION ALL SELECT NULL, l_linestatus, 'col', l_partkey FROM lineitem
        UNION ALL SELECT NULL, NULL, 'total', l_partkey FROM lineitem)
""")
def pivot_unique_values(spark, sf):
    """The distinct values of each cell as rows."""
    return pv.unique_values(table(spark, sf, "lineitem"), ROWS, COLS, "l_partkey")


_LISTED = """
    v AS (SELECT DISTINCT o_orderstatus, o_orderpriority, level, o_orderkey::VARCHAR AS value FROM (
        SELECT o_orderstatus, o_orderpriority, 'cell' AS level, o_orderkey FROM orders
        UNION ALL SELECT o_orderstatus, NULL, 'row', o_orderkey FROM orders
        UNION ALL SELECT NULL, o_orderpriority, 'col', o_orderkey FROM orders
        UNION ALL SELECT NULL, NULL, 'total', o_orderkey FROM orders)),
    b AS (SELECT *, (row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority, level ORDER BY value) - 1) // 1000 AS block FROM v)"""


@query(f"""
    WITH {_LISTED} SELECT o_orderstatus, o_orderpriority, level, block, count(*) AS n, string_agg(value, ',' ORDER BY value) AS values FROM b
    GROUP BY ALL
""")
def pivot_list_blocks(spark, sf):
    """The orders of each cell and total, in sorted blocks of a thousand."""
    blocks = pv.unique_blocks(table(spark, sf, "orders"), ["o_orderstatus"], ["o_orderpriority"], "o_orderkey")
    return blocks.select("o_orderstatus", "o_orderpriority", "level", "block", F.size("values").cast("bigint").alias("n"),
                         F.array_join("values", ",").alias("values"))


@query(f"WITH {_LISTED} SELECT o_orderstatus, o_orderpriority, level, string_agg(value, ', ' ORDER BY value) AS value FROM b GROUP BY ALL")
def pivot_list_long(spark, sf):
    """Lists of more values than the small path takes."""
    return pv.pivot(table(spark, sf, "orders"), ["o_orderstatus"], ["o_orderpriority"], "List Unique Values", ["o_orderkey"])


@query(_grid_sql("round(coalesce(sum(l_quantity), 0), 2)"))
def pivot_sum(spark, sf):
    return _rounded(_pivot(spark, sf, "Sum", ["l_quantity"]), 2)


@query(_grid_sql("round(coalesce(sum(l_quantity), 0), 0)"))
def pivot_integer_sum(spark, sf):
    return _pivot(spark, sf, "Integer Sum", ["l_quantity"])


@query(_grid_sql("round(avg(l_extendedprice), 4)"))
def pivot_avg(spark, sf):
    return _rounded(_pivot(spark, sf, "Average", ["l_extendedprice"]), 4)


@query(f"""
    SELECT 'Minimum' AS aggregator, * FROM ({_grid_sql("min(l_extendedprice)")})
    UNION ALL SELECT 'Maximum', * FROM ({_grid_sql("max(l_extendedprice)")})
""")
def pivot_min_max(spark, sf):
    grids = [_pivot(spark, sf, a, ["l_extendedprice"]).select(F.lit(a).alias("aggregator"), "*") for a in ("Minimum", "Maximum")]
    return grids[0].unionByName(grids[1])


@query(_grid_sql("round(sum(l_extendedprice) / sum(l_quantity), 6)"))
def pivot_sum_over_sum(spark, sf):
    return _rounded(_pivot(spark, sf, "Sum over Sum", ["l_extendedprice", "l_quantity"]), 6)


_Z = "1.2815515655446004"


def _bound_sql(sign: str) -> str:
    a, b, z2 = "sum(l_discount)", "sum(l_quantity)", f"({_Z} * {_Z})"
    return (f"round(({z2} / 2 / {b} + {a} / {b} {sign} {_Z} * sqrt({z2} / 4 / ({b} * {b}) + {a} * (1 - {a} / {b}) / ({b} * {b})))"
            f" / (1 + {z2} / {b}), 9)")


@query(f"""
    SELECT 'Upper' AS bound, * FROM ({_grid_sql(_bound_sql('+'))})
    UNION ALL SELECT 'Lower', * FROM ({_grid_sql(_bound_sql('-'))})
""")
def pivot_bound80(spark, sf):
    grids = [_rounded(_pivot(spark, sf, f"80% {b} Bound", ["l_discount", "l_quantity"]), 9).select(F.lit(b).alias("bound"), "*")
             for b in ("Upper", "Lower")]
    return grids[0].unionByName(grids[1])


def _fraction_sql(value: str) -> str:
    return f"""
    WITH g AS ({_grid_sql(value)})
    SELECT 'Total' AS scope, l_returnflag, l_linestatus, level, round(value / (SELECT value FROM g WHERE level = 'total'), 9) AS value FROM g
    UNION ALL
    SELECT 'Rows', g.l_returnflag, g.l_linestatus, g.level, round(g.value / t.value, 9)
    FROM g JOIN g t ON t.level IN ('row', 'total') AND g.l_returnflag IS NOT DISTINCT FROM t.l_returnflag
    UNION ALL
    SELECT 'Columns', g.l_returnflag, g.l_linestatus, g.level, round(g.value / t.value, 9)
    FROM g JOIN g t ON t.level IN ('col', 'total') AND g.l_linestatus IS NOT DISTINCT FROM t.l_linestatus
    """


def _fractions(spark, sf, base, values=()):
    grids = [
        _rounded(_pivot(spark, sf, f"{base} as Fraction of {scope}", values), 9).select(F.lit(scope).alias("scope"), "*")
        for scope in ("Total", "Rows", "Columns")
    ]
    return grids[0].unionByName(grids[1]).unionByName(grids[2])


@query(_fraction_sql("sum(l_extendedprice)"))
def pivot_frac_sum(spark, sf):
    return _fractions(spark, sf, "Sum", ["l_extendedprice"])


@query(_fraction_sql("count(*)::DOUBLE"))
def pivot_frac_count(spark, sf):
    return _fractions(spark, sf, "Count")


@query("""
    SELECT coalesce(l_returnflag, 'Totals') AS l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS F,
           round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS O, round(sum(l_quantity), 2) AS Totals
    FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())
""")
def pivot_wide(spark, sf):
    wide = pv.pivot_wide(table(spark, sf, "lineitem"), ROWS, COLS, "Sum", ["l_quantity"])
    return wide.withColumns({c: F.round(c, 2) for c in ("F", "O", "Totals")})


_EVENTS = ["click", "error", "purchase", "signup", "view"]


@query(f"""
    SELECT user_id::VARCHAR AS user_id, {", ".join(f"count(*) FILTER (event_type = '{e}') AS {e}" for e in _EVENTS)}
    FROM events GROUP BY user_id
""")
def pivot_wide_many_rows(spark, sf):
    """A wide grid of many rows over given column keys, cells only."""
    wide = pv.pivot_wide(table(spark, sf, "events"), ["user_id"], ["event_type"], "Count", column_values=_EVENTS, totals=False)
    return wide.na.fill(0)


_PAIRS = [(status, str(line)) for status in ("F", "O") for line in range(1, 8)]


@query(f"""
    SELECT coalesce(l_returnflag, 'Totals') AS l_returnflag,
           {", ".join(f"nullif(count(*) FILTER (l_linestatus = '{a}' AND l_linenumber = {b}), 0) AS \"{a}-{b}\"" for a, b in _PAIRS)},
           count(*) AS "Totals"
    FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())
""")
def pivot_wide_two_columns(spark, sf):
    """A wide grid with two column attributes; the keys are looked up."""
    wide = pv.pivot_wide(table(spark, sf, "lineitem"), ROWS, ["l_linestatus", "l_linenumber"], "Count")
    return wide.select("l_returnflag", *[f"`{a}-{b}`" for a, b in _PAIRS], "Totals")


@query(_grid_sql("round(sum(value), 2)", "(SELECT event_type, strftime(ts, '%a') AS day, value FROM events)", "event_type", "day"))
def pivot_derived(spark, sf):
    """A grid whose column key is derived from a time stamp."""
    events = table(spark, sf, "events").withColumn("day", date_text(F.col("ts"), "%w"))
    return _rounded(pv.pivot(events, ["event_type"], ["day"], "Sum", ["value"]), 2)


@query("""
    SELECT p_brand, p_type, CASE WHEN grouping(p_brand) = 0 AND grouping(p_type) = 0 THEN 'cell' WHEN grouping(p_brand) = 0 THEN 'row'
           WHEN grouping(p_type) = 0 THEN 'col' ELSE 'total' END AS level, max(p_size)::DOUBLE AS value
    FROM part GROUP BY GROUPING SETS ((p_brand, p_type), (p_brand), (p_type), ())
""")
def pivot_sorted(spark, sf):
    """A grid in natural order of its row keys and listed order of its column keys."""
    grid = pv.pivot(table(spark, sf, "part"), ["p_brand"], ["p_type"], "Maximum", ["p_size"])
    return pv.sort_keys(grid, ["p_brand", "p_type"], {"p_type": ["STANDARD", "SMALL"]})


@query("SELECT l_orderkey, l_linenumber, l_extendedprice - l_extendedprice % 1000 AS bin FROM lineitem")
def derive_bin(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", bin_down(F.col("l_extendedprice"), 1000).alias("bin"))


@query("""
    SELECT event_id, strftime(ts, '%Y-%m-%d') || ' ' || strftime(ts, '%b') || ' ' || strftime(ts, '%a') || ' ' ||
           strftime(ts, '%w') || ' ' || strftime(ts, '%H:%M:%S') || ' %q' AS moment,
           '' AS bad FROM events
""")
def derive_date(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", date_text(F.col("ts"), "%y-%m-%d %n %w %x %H:%M:%S %q").alias("moment"),
        date_text(F.col("event_type"), "%y-%m-%d").alias("bad"))


@query("""
    SELECT p_brand, count(*) AS n,
           row_number() OVER (ORDER BY lower(regexp_extract(p_brand, '^\\D+')),
                                       CAST(regexp_extract(p_brand, '\\d+$') AS DOUBLE), p_brand) AS place
    FROM part GROUP BY p_brand
""")
def natural_sort(spark, sf):
    brands = table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return global_rank(brands, natural_order(F.col("p_brand")), "place")


@query("""
    SELECT o_orderpriority, count(*) AS n,
           row_number() OVER (ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, o_orderpriority) AS place
    FROM orders GROUP BY o_orderpriority
""")
def custom_sort(spark, sf):
    found = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return global_rank(found, listed_order(F.col("o_orderpriority"), ["5-LOW", "1-URGENT"]), "place")


@query(f"""
    WITH g AS ({_grid_sql("sum(l_quantity)")}),
         s AS (SELECT *, min(value) OVER (PARTITION BY level) AS lo, max(value) OVER (PARTITION BY level) AS hi FROM g WHERE level <> 'total')
    SELECT l_returnflag, l_linestatus, level, round(value, 2) AS value, round((value - lo) / (hi - lo), 6) AS heat,
           round(100 * value / (1.4::DOUBLE * hi), 6) AS bar
    FROM s
""")
def scale_cells(spark, sf):
    scaled = pv.scale_cells(_pivot(spark, sf, "Sum", ["l_quantity"]), ROWS, COLS)
    return scaled.withColumns({"value": F.round("value", 2), "heat": F.round("heat", 6), "bar": F.round("bar", 6)})


@query(f"""
    WITH g AS ({_grid_sql("sum(l_quantity)")}),
         s AS (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM g WHERE level <> 'total'
               WINDOW w AS (PARTITION BY level, CASE WHEN level = 'cell' THEN l_returnflag END))
    SELECT l_returnflag, l_linestatus, level, round(value, 2) AS value, round((value - lo) / nullif(hi - lo, 0), 6) AS heat,
           round(100 * value / (1.4::DOUBLE * hi), 6) AS bar
    FROM s
""")
def scale_rows(spark, sf):
    scaled = pv.scale_cells(_pivot(spark, sf, "Sum", ["l_quantity"]), ROWS, COLS, "row")
    return scaled.withColumns({"value": F.round("value", 2), "heat": F.round("heat", 6), "bar": F.round("bar", 6)})


@query("""
    SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS money, format('{:,.0f}', round(o_totalprice)) AS whole,
           CASE WHEN o_custkey = 0 THEN '' ELSE format('{:,.1f}', 100.0::DOUBLE * (o_custkey / 7.0::DOUBLE)) || '%' END AS percent
    FROM orders
""")
def number_formats(spark, sf):
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey", number_text(price).alias("money"), integer_text(price).alias("whole"),
        percent_text(F.col("o_custkey") / 7.0).alias("percent"))
