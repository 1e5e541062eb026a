"""u-joins, joins, column operators, filters, sorts, groups, SQL and the grid's recipe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftgrid.catalog import query, table
from weftgrid.functions.numbers import num
from weftgrid.operators import columns
from weftgrid.operators.features import label as label_column_op
from weftgrid.operators.profile import describe_all
from weftgrid.operators.ranking import global_rank
from weftgrid.operators.disjunction import full_disjunction, subset_sizes
from weftgrid.operators.ujoin import match_count, ujoin, ujoin_all
from weftgrid.plans.grid import Grid, sample, sample_exact, sample_strata


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").withColumnRenamed("o_orderkey", "orderkey")


def _lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "orderkey")


# --- u-join -------------------------------------------------------------------

@query("""
    SELECT o_orderstatus, count(*) AS n_rows, count(l_linenumber) AS n_items,
           round(coalesce(sum(l_quantity), 0), 2) AS quantity
    FROM orders FULL OUTER JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderstatus
""")
def ujoin_group_count(spark, sf):
    """Flagship: fuse orders and line items, then group the fused table."""
    fused = ujoin(_orders(spark, sf).select("orderkey", "o_orderstatus"),
                  _lineitem(spark, sf).select("orderkey", "l_linenumber", "l_quantity"))
    return fused.groupBy("o_orderstatus").agg(
        F.count("*").alias("n_rows"), F.count("l_linenumber").alias("n_items"),
        F.round(F.coalesce(F.sum("l_quantity"), F.lit(0.0)), 2).alias("quantity"))


@query("""
    SELECT coalesce(o_orderkey, l_orderkey) AS orderkey, o_orderstatus, o_totalprice, l_linenumber, l_quantity
    FROM (SELECT * FROM orders WHERE o_orderstatus = 'F')
    FULL OUTER JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) ON o_orderkey = l_orderkey
""")
def ujoin_shared(spark, sf):
    orders = _orders(spark, sf).where("o_orderstatus = 'F'").select("orderkey", "o_orderstatus", "o_totalprice")
    items = _lineitem(spark, sf).where("l_quantity > 45").select("orderkey", "l_linenumber", "l_quantity")
    return ujoin(orders, items)


@query("""
    SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, lang, n_chars, quality, toxic
    FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id
""")
def ujoin_natural(spark, sf):
    return ujoin(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf, "labels"))


@query("""
    WITH o AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS custkey, o_orderkey FROM orders),
         c AS (SELECT CASE WHEN c_acctbal >= 0 THEN c_custkey END AS custkey, c_name FROM customer)
    SELECT coalesce(o.custkey, c.custkey) AS custkey, o_orderkey, c_name
    FROM o FULL OUTER JOIN c ON o.custkey = c.custkey
""")
def ujoin_null_keys(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("custkey"), "o_orderkey")
    customers = table(spark, sf, "customer").select(
        F.when(F.col("c_acctbal") >= 0, F.col("c_custkey")).alias("custkey"), "c_name")
    return ujoin(orders, customers)


@query("""
    SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL::BIGINT AS p_partkey, NULL::VARCHAR AS p_name,
           NULL::INTEGER AS p_size FROM supplier
    UNION ALL
    SELECT NULL, NULL, NULL, NULL, p_partkey, p_name, p_size FROM part
""")
def ujoin_disjoint(spark, sf):
    return ujoin(table(spark, sf, "supplier"), table(spark, sf, "part").select("p_partkey", "p_name", "p_size"))


@query("""
    WITH f AS (SELECT o_custkey AS custkey, strftime(o_orderdate, '%Y-%m-%d') AS orderdate, count(*) AS filled
               FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
         o AS (SELECT o_custkey AS custkey, strftime(o_orderdate, '%Y-%m-%d') AS orderdate, count(*) AS open
               FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2)
    SELECT coalesce(f.custkey, o.custkey) AS custkey, coalesce(f.orderdate, o.orderdate) AS orderdate, filled, open
    FROM f FULL OUTER JOIN o ON f.custkey = o.custkey AND f.orderdate = o.orderdate
""")
def ujoin_two_keys(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("custkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("orderdate"), "o_orderstatus")
    sides = [
        orders.where(F.col("o_orderstatus") == status).groupBy("custkey", "orderdate").agg(F.count("*").alias(name))
        for status, name in (("F", "filled"), ("O", "open"))
    ]
    return ujoin(*sides)


@query("""
    SELECT CAST(coalesce(CAST(c_custkey AS VARCHAR), k) AS VARCHAR) AS custkey, c_name, total
    FROM customer FULL OUTER JOIN
         (SELECT CAST(o_custkey AS VARCHAR) AS k, count(*) AS total FROM orders GROUP BY 1)
    ON CAST(c_custkey AS VARCHAR) = k
""")
def ujoin_widened_type(spark, sf):
    """A shared column of text on one side and numbers on the other compares as text."""
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), "c_name")
    totals = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("custkey")).agg(
        F.count("*").alias("total"))
    return ujoin(customers, totals)


_NARY = """
    SELECT r_regionkey AS regionkey, r_name, nationkey, n_name, custkey, c_name, orderkey, o_orderstatus
    FROM (SELECT coalesce(n.nationkey, c.nationkey) AS nationkey, n_name, n.regionkey, custkey, c_name, orderkey, o_orderstatus
          FROM (SELECT n_nationkey AS nationkey, n_name, n_regionkey AS regionkey FROM nation) n
          FULL OUTER JOIN
               (SELECT coalesce(c_custkey, o_custkey) AS custkey, c_name, c_nationkey AS nationkey,
                       o_orderkey AS orderkey, o_orderstatus
                FROM customer FULL OUTER JOIN orders ON c_custkey = o_custkey) c
          ON n.nationkey = c.nationkey) x
    FULL OUTER JOIN region ON x.regionkey = r_regionkey
"""


def _nary_frames(spark, sf):
    return {
        "region": table(spark, sf, "region").withColumnRenamed("r_regionkey", "regionkey"),
        "nation": table(spark, sf, "nation").withColumnsRenamed({"n_nationkey": "nationkey", "n_regionkey": "regionkey"}),
        "customer": table(spark, sf, "customer").select(
            F.col("c_custkey").alias("custkey"), "c_name", F.col("c_nationkey").alias("nationkey")),
        "orders": table(spark, sf, "orders").select(
            F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"), "o_orderstatus"),
    }


@query(_NARY)
def ujoin_nary(spark, sf):
    return ujoin_all(_nary_frames(spark, sf))


@query(_NARY)
def ujoin_nary_reversed(spark, sf):
    """The same frames given in the opposite order."""
    return ujoin_all(dict(reversed(_nary_frames(spark, sf).items())))


#: A chain of frames, each with the column it shares with the next; some keys are missing.
_CHAIN = (
    ("o", "(SELECT o_orderkey AS orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS custkey FROM orders)", "custkey"),
    ("c", "(SELECT c_custkey AS custkey, c_name, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_nationkey END AS nationkey FROM customer)", "nationkey"),
    ("n", "(SELECT n_nationkey AS nationkey, n_name, CASE WHEN n_nationkey > 4 THEN n_regionkey END AS regionkey FROM nation)", "regionkey"),
    ("r", "(SELECT r_regionkey AS regionkey, r_name FROM region)", None),
)
_CHAIN_COLUMNS = {"orderkey": "o", "custkey": "oc", "c_name": "c", "nationkey": "cn", "n_name": "n", "regionkey": "nr", "r_name": "r"}


def _disjunction_sql() -> str:
    """Every stretch of the chain, without the rows that its neighbours on either side could join."""
    parts = []
    for i in range(len(_CHAIN)):
        for j in range(i, len(_CHAIN)):
            names = [name for name, _, _ in _CHAIN[i:j + 1]]
            joins = _CHAIN[i][1] + " " + names[0] + "".join(
                f" JOIN {_CHAIN[k][1]} {_CHAIN[k][0]} ON {_CHAIN[k - 1][0]}.{_CHAIN[k - 1][2]} = {_CHAIN[k][0]}.{_CHAIN[k - 1][2]}" for k in range(i + 1, j + 1))
            open_ends = []
            if i:
                key = _CHAIN[i - 1][2]
                open_ends.append(f"NOT EXISTS (SELECT 1 FROM {_CHAIN[i - 1][1]} z WHERE z.{key} = {names[0]}.{key})")
            if j + 1 < len(_CHAIN):
                key = _CHAIN[j][2]
                open_ends.append(f"NOT EXISTS (SELECT 1 FROM {_CHAIN[j + 1][1]} z WHERE z.{key} = {names[-1]}.{key})")
            columns = ", ".join(
                f"{next((f'{n}.{c}' for n in names if n in holders), 'NULL')} AS {c}" for c, holders in _CHAIN_COLUMNS.items())
            parts.append(f"SELECT {columns} FROM {joins}" + (" WHERE " + " AND ".join(open_ends) if open_ends else ""))
    return " UNION ALL ".join(parts)


def _chain_frames(spark, sf):
    when = lambda condition, key: F.when(F.expr(condition), F.col(key))
    return {
        "orders": table(spark, sf, "orders").select(F.col("o_orderkey").alias("orderkey"), when("o_orderstatus <> 'P'", "o_custkey").alias("custkey")),
        "customer": table(spark, sf, "customer").select(
            F.col("c_custkey").alias("custkey"), "c_name", when("c_mktsegment <> 'BUILDING'", "c_nationkey").alias("nationkey")),
        "nation": table(spark, sf, "nation").select(
            F.col("n_nationkey").alias("nationkey"), "n_name", when("n_nationkey > 4", "n_regionkey").alias("regionkey")),
        "region": table(spark, sf, "region").select(F.col("r_regionkey").alias("regionkey"), "r_name"),
    }


@query(_disjunction_sql())
def disjunction_chain(spark, sf):
    """What orders, customers, nations and regions say together, with keys missing in all of them."""
    return full_disjunction(_chain_frames(spark, sf))


@query(_disjunction_sql())
def disjunction_chain_other_order(spark, sf):
    """The same frames in an order in which neighbours share no column, under other names."""
    frames = _chain_frames(spark, sf)
    return full_disjunction({"1": frames["nation"], "2": frames["orders"], "3": frames["region"], "4": frames["customer"]})


@query("""
    WITH s AS (SELECT s_suppkey AS suppkey, CASE WHEN s_acctbal > 0 THEN s_nationkey END AS nationkey FROM supplier),
         g AS (SELECT CASE WHEN c_mktsegment <> 'BUILDING' THEN c_nationkey END AS nationkey, c_mktsegment AS segment, count(*) AS customers FROM customer GROUP BY 1, 2),
         x AS (SELECT coalesce(n_nationkey, s.nationkey) AS nationkey, n_name, suppkey FROM nation FULL JOIN s ON n_nationkey = s.nationkey),
         y AS (SELECT n_name, suppkey, segment FROM x FULL JOIN g ON x.nationkey = g.nationkey)
    SELECT concat_ws(',', CASE WHEN segment IS NOT NULL THEN 'customers' END, CASE WHEN n_name IS NOT NULL THEN 'nation' END,
                     CASE WHEN suppkey IS NOT NULL THEN 'supplier' END) AS sources, count(*) AS n
    FROM y GROUP BY 1
""")
def disjunction_sources(spark, sf):
    """Three frames on one key, and which of them each fused row comes from."""
    customers = table(spark, sf, "customer").groupBy(
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey")).alias("nationkey"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("customers"))
    frames = {
        "customers": customers,
        "nation": table(spark, sf, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name"),
        "supplier": table(spark, sf, "supplier").select(
            F.col("s_suppkey").alias("suppkey"), F.when(F.col("s_acctbal") > 0, F.col("s_nationkey")).alias("nationkey")),
    }
    return subset_sizes(frames, full_disjunction(frames))


@query("""
    WITH p AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18, 2)) AS price FROM orders),
         q AS (SELECT l_orderkey, l_linenumber, round(l_extendedprice / 100000000, 10) AS small FROM lineitem)
    SELECT (SELECT count(*) FROM p) AS prices, (SELECT count(*) FROM q) AS smalls, (SELECT count(*) FROM p) AS prices_met, (SELECT count(*) FROM q) AS smalls_met
""")
def ujoin_numbers_of_any_type(spark, sf):
    """Decimals meet the doubles that are the same number, however small or large: each finds itself."""
    prices = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    large = [prices.select("k", (F.col("price") * F.expr("cast(10000000000 AS decimal(11,0))")).alias("v"), F.lit(1).alias("a")),
             prices.select("k", F.concat("price", F.lit("E10")).cast("double").alias("v"), F.lit(1).alias("b"))]
    tiny = table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("units"))
    small = [tiny.select("k", (F.col("units").cast("decimal(18,0)") * F.expr("cast(0.0000000001 AS decimal(11,10))")).alias("v"), F.lit(1).alias("a")),
             tiny.select("k", F.concat("units", F.lit("E-10")).cast("double").alias("v"), F.lit(1).alias("b"))]
    sides = [ujoin(*pair).agg(F.count(F.lit(1)).alias("rows"), F.count(F.col("a") + F.col("b")).alias("met")) for pair in (large, small)]
    return sides[0].withColumn("side", F.lit(0)).unionByName(sides[1].withColumn("side", F.lit(1))).agg(*[
        F.sum(F.when(F.col("side") == i, F.col(c)).otherwise(0)).alias(f"{name}{end}")
        for i, name in enumerate(("prices", "smalls")) for c, end in (("rows", ""), ("met", "_met"))])


@query("""
    SELECT count(*) FILTER (o_orderkey IS NOT NULL AND l_orderkey IS NOT NULL)::BIGINT AS matched,
           count(*) FILTER (l_orderkey IS NULL)::BIGINT AS left_only,
           count(*) FILTER (o_orderkey IS NULL)::BIGINT AS right_only, count(*)::BIGINT AS total
    FROM orders FULL OUTER JOIN lineitem ON o_orderkey = l_orderkey
""")
def ujoin_match_count(spark, sf):
    return match_count(_orders(spark, sf).select("orderkey", "o_orderstatus"),
                       _lineitem(spark, sf).select("orderkey", "l_linenumber"))


@query("""
    SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE c_mktsegment = 'BUILDING'
""")
def inner_join_where(spark, sf):
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    return joined.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name", "n_name")


@query("""
    SELECT o_orderkey, c_name, o_orderpriority FROM customer, orders
    WHERE c_custkey = o_custkey AND o_orderpriority = '1-URGENT'
""")
def comma_join(spark, sf):
    return spark.sql(
        "SELECT o_orderkey, c_name, o_orderpriority FROM {c} c, {o} o "
        "WHERE c.c_custkey = o.o_custkey AND o_orderpriority = :priority",
        args={"priority": "1-URGENT"}, c=table(spark, sf, "customer"), o=table(spark, sf, "orders"))


# --- column operators -----------------------------------------------------------

@query("SELECT p_name, p_brand FROM part")
def project(spark, sf):
    return columns.project(table(spark, sf, "part"), "p_name", "p_brand")


@query("SELECT p_partkey, p_name, 'shop' AS origin, 7 AS lot FROM part")
def add_column(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    return part.transform(columns.add_column, "origin", "shop").transform(columns.add_column, "lot", 7)


@query("SELECT p_partkey, p_name AS title, p_brand, p_size FROM part")
def rename_drop(spark, sf):
    part = table(spark, sf, "part").transform(columns.rename, "p_name", "title").transform(columns.rename, "nothing", "x")
    return part.transform(columns.drop, "p_type", "p_retailprice", "nothing")


@query("SELECT doc_id, coalesce(CAST(quality AS VARCHAR), '') AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def to_text(spark, sf):
    labelled = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return labelled.select("doc_id", "quality").transform(columns.to_text, "quality")


@query("SELECT event_id, value * 2 AS value, upper(event_type) AS event_type FROM events")
def apply_function(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value", "event_type")
    return events.transform(columns.apply, "value", lambda c: c * 2).transform(columns.apply, "event_type", F.upper)


@query("SELECT count(*) AS n_rows, count(*) AS n_ids FROM events")
def row_id(spark, sf):
    """Every row gets an id of its own."""
    return table(spark, sf, "events").transform(columns.add_row_id).agg(
        F.count("*").alias("n_rows"), F.count_distinct("GridID").alias("n_ids"))


@query("SELECT count(*) AS n_rows, count(DISTINCT e) AS n_ids FROM (SELECT events AS e FROM events)")
def row_hash_id(spark, sf):
    """Equal rows, and only they, get the same hash."""
    return table(spark, sf, "events").transform(columns.add_row_hash).agg(
        F.count("*").alias("n_rows"), F.count_distinct("row_hash").alias("n_ids"))


_ALL_DIMS = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS dim{i}" for i in range(64))


@query(f"SELECT vec_id, label, {_ALL_DIMS} FROM embeddings")
def expand_vector(spark, sf):
    """All 64 dimensions; their number is looked up."""
    return columns.expand_vector(table(spark, sf, "embeddings"), "embedding")


@query("""
    SELECT p_partkey, string_split(p_name, ' ')[1] AS p_name1,
           CASE WHEN position(' ' IN p_name) > 0 THEN substr(p_name, position(' ' IN p_name) + 1) END AS p_name2
    FROM part
""")
def split_char_left(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name").transform(
        columns.split_column, "p_name", 2, "begin", "char", " ")


_PARTS = "string_split(url, '/')"


@query(f"""
    SELECT page_id,
           CASE WHEN len({_PARTS}) > 3 THEN array_to_string({_PARTS}[1:len({_PARTS}) - 2], '/') ELSE {_PARTS}[1] END AS url1,
           CASE WHEN len({_PARTS}) > 3 THEN {_PARTS}[len({_PARTS}) - 1] ELSE {_PARTS}[2] END AS url2,
           CASE WHEN len({_PARTS}) > 3 THEN {_PARTS}[len({_PARTS})] ELSE {_PARTS}[3] END AS url3
    FROM pages
""")
def split_char_right(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url").transform(
        columns.split_column, "url", 3, "end", "char", "/")


@query("""
    SELECT c_custkey, substr(c_name, 1, 8) AS c_name1,
           CASE WHEN length(c_name) > 8 THEN substr(c_name, 9, 8) END AS c_name2,
           CASE WHEN length(c_name) > 16 THEN substr(c_name, 17, 8) END AS c_name3
    FROM customer
""")
def split_len_left(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name").transform(
        columns.split_column, "c_name", 3, "begin", "length", 8)


@query("""
    WITH u AS (SELECT page_id, url, length(url) AS n FROM pages)
    SELECT page_id, substr(url, greatest(n - 20, 0) + 1, n - greatest(n - 20, 0)) AS url1,
           CASE WHEN n > 20 THEN substr(url, greatest(n - 40, 0) + 1, n - 20 - greatest(n - 40, 0)) END AS url2,
           CASE WHEN n > 40 THEN substr(url, greatest(n - 60, 0) + 1, n - 40 - greatest(n - 60, 0)) END AS url3
    FROM u
""")
def split_len_right(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url").transform(
        columns.split_column, "url", 3, "end", "length", 20)


@query("""
    SELECT 'c_acctbal' AS name, 'double' AS type, count(c_acctbal) AS count FROM customer
    UNION ALL SELECT 'c_custkey', 'bigint', count(c_custkey) FROM customer
    UNION ALL SELECT 'c_mktsegment', 'string', count(c_mktsegment) FROM customer
    UNION ALL SELECT 'c_name', 'string', count(c_name) FROM customer
    UNION ALL SELECT 'c_nationkey', 'int', count(c_nationkey) FROM customer
""")
def schema_listing(spark, sf):
    """Columns in name order with their types and how many values they hold."""
    customers = table(spark, sf, "customer")
    held = describe_all(customers).select(F.col("column").alias("name"), "count")
    return columns.schema_listing(customers).join(held, "name").orderBy(F.lower("name"))


# --- filters --------------------------------------------------------------------

@query("""
    SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem
    WHERE l_quantity >= 30 AND l_returnflag <> 'R' AND l_linenumber <= 3 AND l_discount < 0.08
""")
def filter_cmp(spark, sf):
    items = table(spark, sf, "lineitem")
    for column, op, value in (("l_quantity", ">=", "30"), ("l_returnflag", "!=", "R"), ("l_linenumber", "<=", 3),
                              ("l_discount", "<", "0.08")):
        items = columns.filter_rows(items, column, op, value)
    return items.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%re_ %'")
def filter_like(spark, sf):
    return columns.filter_rows(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "like", "re_ ")


@query("""
    SELECT 'missing' AS kind, doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL
    UNION ALL SELECT 'present', doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL
""")
def filter_null(spark, sf):
    fused = ujoin(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"))
    return columns.filter_rows(fused, "quality", "is null").select(F.lit("missing").alias("kind"), "doc_id").union(
        columns.filter_rows(fused, "quality", "is not null").select(F.lit("present"), "doc_id"))


@query("SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_extendedprice >= 20000 AND l_extendedprice < 50000")
def filter_interval(spark, sf):
    return columns.filter_interval(table(spark, sf, "lineitem"), "l_extendedprice", 20000, 50000).select(
        "l_orderkey", "l_extendedprice")


@query("""
    SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)
    WHERE coalesce(CAST(quality AS VARCHAR), 'null') NOT IN ('0', 'null')
""")
def filter_exclude(spark, sf):
    fused = ujoin(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"))
    return columns.exclude_values(fused, "quality", ["0", "null"]).select("doc_id", "quality")


@query("""
    SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN
        (SELECT c_custkey FROM customer WHERE c_acctbal < 2000)
""")
def filter_exclude_frame(spark, sf):
    """An exclusion list that is itself a table."""
    poor = table(spark, sf, "customer").where("c_acctbal < 2000").select(F.col("c_custkey").cast("string"))
    return columns.exclude_values(table(spark, sf, "orders"), "o_custkey", poor).select("o_orderkey", "o_custkey")


@query("""
    SELECT coalesce(CAST(quality AS VARCHAR), 'null') AS quality, doc_id FROM documents LEFT JOIN labels USING (doc_id)
    WHERE coalesce(CAST(quality AS VARCHAR), 'null') IN ('1', 'null')
""")
def filter_include(spark, sf):
    fused = ujoin(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"))
    return columns.keep_values(fused, "quality", ["1", "null"]).select(
        F.coalesce(F.col("quality").cast("string"), F.lit("null")).alias("quality"), "doc_id")


@query("SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 0")
def non_empty_lines(spark, sf):
    lines = columns.explode_lines(table(spark, sf, "documents"), "doc_id", "text").withColumnRenamed("text", "line")
    return columns.non_empty(lines, "line")


# --- sort, limit, group -----------------------------------------------------------

def _stretches(ordered, column):
    """Where each value of a sorted frame stands: its place among the values, its rows, and whether no other value is between them."""
    held = ordered.withColumn("_at", F.monotonically_increasing_id())
    runs = held.groupBy(column).agg(F.min("_at").alias("first"), F.max("_at").alias("last"), F.count("*").alias("n"))
    # One row per value of a column with few values.
    order = Window.orderBy("first")
    return runs.select(
        column, F.row_number().over(order).alias("place"), "n",
        F.coalesce(F.col("last") < F.lead("first").over(order), F.lit(True)).alias("apart"))


@query("SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) AS place, count(*) AS n, TRUE AS apart FROM orders GROUP BY o_orderpriority")
def sort_column(spark, sf):
    """The whole table in order of a column that has a few frequent values."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return _stretches(columns.sort(orders, "o_orderpriority"), "o_orderpriority")


@query("""
    SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag DESC) AS place, count(*) AS n, TRUE AS apart FROM lineitem GROUP BY l_returnflag
""")
def sort_copies(spark, sf):
    """The whole table in order, once its rows are reduced to a few that repeat."""
    flags = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    return _stretches(columns.sort_copies(flags, "l_returnflag", ascending=False), "l_returnflag")


@query("""
    SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place, o_orderkey, o_totalprice FROM orders
""")
def sort_places(spark, sf):
    """Position of every order by price: a total order over the whole table."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return global_rank(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], "place")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sort_desc_topk(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return columns.top_k(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 100)


@query("SELECT CAST(least(count(*), 1000) AS BIGINT) AS n FROM orders")
def take_n(spark, sf):
    return columns.take(table(spark, sf, "orders"), 1000).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS count FROM documents WHERE text LIKE '%tion%'")
def count_filtered(spark, sf):
    return Grid.load(table(spark, sf, "documents")).sql(
        "SELECT count(*) count FROM DataGrid WHERE text LIKE :pattern", pattern="%tion%")


@query("SELECT event_type, count(*) AS people FROM events GROUP BY event_type")
def group_count(spark, sf):
    return columns.group_count(table(spark, sf, "events"), "event_type", name="people")


@query("""
    SELECT o_custkey, count(*) AS count FROM orders WHERE o_orderpriority IS NOT NULL
    GROUP BY o_custkey HAVING count(*) > 12
""")
def group_having(spark, sf):
    orders = table(spark, sf, "orders").where("o_orderpriority is not null")
    return columns.group_count(orders, "o_custkey").where("count > 12")


@query("""
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity,
           round(avg(l_extendedprice), 4) AS price, min(l_discount) AS low, max(l_tax) AS high
    FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def group_simple_aggs(spark, sf):
    return columns.group_aggregate(
        table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"],
        n=F.count("*"), quantity=F.round(F.sum("l_quantity"), 2), price=F.round(F.avg("l_extendedprice"), 4),
        low=F.min("l_discount"), high=F.max("l_tax"))


@query("""
    SELECT o_orderkey, o_orderpriority,
           CAST(place - 1 AS DOUBLE) AS o_orderpriority_label
    FROM orders LEFT JOIN (SELECT o_orderpriority, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS place
                           FROM orders GROUP BY o_orderpriority) USING (o_orderpriority)
""")
def label_column(spark, sf):
    return label_column_op(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query("""
    SELECT l_orderkey, l_partkey, CAST(place - 1 AS DOUBLE) AS l_partkey_label
    FROM lineitem LEFT JOIN (SELECT l_partkey, row_number() OVER (ORDER BY count(*) DESC, l_partkey) AS place
                             FROM lineitem GROUP BY l_partkey) USING (l_partkey)
""")
def label_many_values(spark, sf):
    return label_column_op(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), "l_partkey")


# --- set operations -----------------------------------------------------------------

@query("""
    SELECT l_suppkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY l_suppkey
""")
def set_union_aggregate(spark, sf):
    """Set union per key; the sets hold at most the few return flags."""
    items = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return items.groupBy("l_suppkey").agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("flags"))


@query("""
    SELECT doc_id, list_sort(list_distinct(string_split(text, ' ')))[1] AS first_word,
           len(list_distinct(string_split(text, ' '))) AS n FROM documents
""")
def distinct_words(spark, sf):
    words = F.sort_array(F.array_distinct(F.split("text", " ")))
    return table(spark, sf, "documents").select(
        "doc_id", F.get(words, F.lit(0)).alias("first_word"), F.size(words).cast("bigint").alias("n"))


# --- sampling, history, SQL -----------------------------------------------------------

@query("""
    SELECT event_id, event_type FROM events ORDER BY md5('42' || '|' || event_id), event_id LIMIT 1000
""")
def sample_exact_rows(spark, sf):
    return sample_exact(table(spark, sf, "events").select("event_id", "event_type"), ["event_id"])


@query("SELECT TRUE AS again, TRUE AS inside, TRUE AS near")
def sample_fixed_seed(spark, sf):
    """The same seed draws the same rows of the table, about as many as asked for."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    first, second = sample(items), sample(items)
    n = first.count()
    strange = first.exceptAll(second).count() + second.exceptAll(first).count()
    outside = first.join(items, items.columns, "left_anti").count()
    return spark.range(1).select(F.lit(strange == 0).alias("again"), F.lit(outside == 0).alias("inside"), F.lit(800 <= n <= 1200).alias("near"))


@query("""
    SELECT l_orderkey, l_quantity * 2 AS quantity, 'A' AS mark FROM lineitem WHERE l_returnflag = 'A'
""")
def recipe_undo_redo(spark, sf):
    """A recipe with steps undone, redone and replaced."""
    grid = (
        Grid.load(table(spark, sf, "lineitem"))
        .filter("l_returnflag", "=", "A")
        .rename("l_quantity", "quantity")
        .apply("quantity", lambda c: c * 2)
        .drop("quantity")
        .undo().undo().redo()
        .add_column("mark", "A")
        .redo().redo()
    )
    return grid.df.select("l_orderkey", "quantity", "mark")


@query("""
    SELECT o_orderkey, string_split(o_orderpriority, '-')[1] AS p1, string_split(o_orderpriority, '-')[2] AS p2
    FROM orders WHERE o_totalprice > 1000
""")
def recipe_replay(spark, sf):
    """A recipe tried on a sample and replayed on the whole table."""
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "p")
    trial = (
        Grid.load(sample(orders)).filter("o_totalprice", ">", 1000).split("p", 2, "begin", "char", "-")
    )
    return trial.replay(orders).df.select("o_orderkey", "p1", "p2")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def grid_reset(spark, sf):
    """Steps forgotten by a reset leave the base as it was."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return Grid.load(orders).drop("o_totalprice").filter("o_orderstatus", "=", "F").reset().redo().df


@query("""
    SELECT coalesce(c_nationkey, s_nationkey) AS nationkey, customers, suppliers
    FROM (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1)
    FULL OUTER JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey
""")
def grid_load_join(spark, sf):
    """An empty grid adopts its first source; the next one is u-joined."""
    counts = [
        table(spark, sf, name).groupBy(F.col(f"{name[0]}_nationkey").alias("nationkey")).agg(F.count("*").alias(f"{name}s"))
        for name in ("customer", "supplier")
    ]
    return Grid.empty(spark).join(counts[0]).join(counts[1]).df


@query("""
    SELECT TRUE AS all_match, count(*) >= 100 AS enough FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'A' AND l_discount > 0.09
""")
def preview_resample(spark, sf):
    """A preview whose sampled rows became too few is taken from the result instead."""
    grid = Grid.load(table(spark, sf, "lineitem")).filter("l_quantity", ">", 45).filter("l_returnflag", "=", "A").filter(
        "l_discount", ">", 0.09)
    right = (F.col("l_quantity") > 45) & (F.col("l_returnflag") == "A") & (F.col("l_discount") > 0.09)
    return grid.sampled_preview().agg(F.coalesce(F.every(right), F.lit(True)).alias("all_match"), (F.count("*") >= 100).alias("enough"))


@query("""
    SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey), o_orderkey) <= 200
""")
def stratified_sample(spark, sf):
    """Two hundred orders of every status, the same for any partitioning."""
    return sample_strata(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderstatus"], ["o_orderkey"], 200)


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY o_orderstatus")
def sql_query(spark, sf):
    return Grid.load(table(spark, sf, "orders")).sql(
        "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM DataGrid GROUP BY o_orderstatus ORDER BY n DESC")


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY o_custkey")
def sql_many_rows(spark, sf):
    """An SQL result of any number of rows comes back whole."""
    return Grid.load(table(spark, sf, "orders")).sql(
        "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM DataGrid GROUP BY o_custkey")


@query("""
    SELECT event_id, CAST(nullif(regexp_extract(props, '\\d+'), '') AS DOUBLE) AS k FROM events
""")
def leading_number(spark, sf):
    """Numbers read from text that goes on after them."""
    events = table(spark, sf, "events").withColumn("text", F.regexp_replace("props", r"^\D+", " "))
    return events.select("event_id", num("text", events.schema["text"].dataType).alias("k"))
