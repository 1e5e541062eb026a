"""Sources, sinks and the source inventory.

Round trips write to a fresh sub-folder of the shared folder and read it back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgrid.catalog import query, table
from weftgrid.operators import columns, text
from weftgrid.operators.ranking import global_rank
from weftgrid.session import shared_folder
from weftgrid.sources.cellstore import read_cells, write_cells
from weftgrid.sources import inventory, readers, sinks
from weftgrid.sources.names import clean_columns

_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


# --- round trips --------------------------------------------------------------------

@query("SELECT o_orderkey::BIGINT AS o_orderkey, o_custkey::BIGINT AS o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def csv_roundtrip(spark, sf):
    """CSV with a header and declared types."""
    orders = _orders(spark, sf)
    path = sinks.save(orders, shared_folder(spark, "csv"), "csv", header="true")
    return readers.read_csv(spark, path, orders.schema)


@query("SELECT event_id, epoch_us(ts) AS us, event_type FROM events")
def csv_timestamps(spark, sf):
    """Time stamps through CSV, to the microsecond."""
    events = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    path = sinks.save(events, shared_folder(spark, "csv"), "csv", header="true", **exact)
    found = spark.read.options(header="true", **exact).schema(events.schema).csv(path)
    return found.select("event_id", F.unix_micros("ts").alias("us"), "event_type")


@query("SELECT event_id, epoch_us(ts) AS us, value FROM events")
def json_timestamps(spark, sf):
    """Time stamps through JSON, to the microsecond."""
    events = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    path = sinks.save(events, shared_folder(spark, "json"), "json", **exact)
    found = spark.read.options(**exact).schema(events.schema).json(path)
    return found.select("event_id", F.unix_micros("ts").alias("us"), "value")


@query("SELECT sum(o_orderkey)::BIGINT AS keys, round(sum(o_totalprice), 2) AS price, count(*) AS n, 'int,int,string,double,string' AS types FROM orders")
def csv_inferred(spark, sf):
    """CSV with inferred types, through a source descriptor."""
    path = sinks.save(_orders(spark, sf), shared_folder(spark, "csv"), "csv", header="true")
    orders = readers.load_source(spark, {"format": "csv", "source": path})
    return orders.agg(F.sum("o_orderkey").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("price"), F.count("*").alias("n"),
                      ).withColumn("types", F.lit(",".join(t for _, t in orders.dtypes)))


@query("SELECT doc_id, lang, source, n_chars, text FROM documents")
def json_roundtrip(spark, sf):
    docs = table(spark, sf, "documents")
    path = sinks.save(docs, shared_folder(spark, "json"), "json")
    return readers.load_source(spark, {"format": "json", "path": path}, docs.schema)


@query("SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def json_inferred(spark, sf):
    path = sinks.save(table(spark, sf, "customer"), shared_folder(spark, "json"), "json")
    return readers.load_source(spark, {"format": "json", "source": path})


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def xml_roundtrip(spark, sf):
    part = table(spark, sf, "part")
    path = shared_folder(spark, "xml")
    part.write.format("xml").option("rowTag", "doc").option("rootTag", "docs").save(path)
    return readers.load_source(spark, {"format": "xml", "source": path}, part.schema)


@query("SELECT * FROM lineitem")
def parquet_roundtrip(spark, sf):
    path = sinks.write_parquet(table(spark, sf, "lineitem"), shared_folder(spark, "parquet"))
    return readers.load_source(spark, {"format": "parquet", "source": path})


@query(_ORDERS)
def transfer_to_parquet(spark, sf):
    """A JSON source copied to Parquet and read through the new descriptor."""
    orders = _orders(spark, sf)
    origin = sinks.save(orders, shared_folder(spark, "json"), "json")
    moved = sinks.transfer(spark, {"format": "json", "source": origin, "name": "orders"}, shared_folder(spark, "moved"))
    return readers.load_source(spark, moved)


@query("SELECT md5(line) AS line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1")
def text_lines_roundtrip(spark, sf):
    """Line-text sink and scan."""
    lines = columns.explode_lines(table(spark, sf, "documents"), "doc_id", "text").select("text")
    path = sinks.save(lines, shared_folder(spark, "lines"), "text")
    read = readers.read_lines(spark, path)
    return read.groupBy(F.md5("value").alias("line")).agg(F.count("*").alias("n"))


@query("SELECT lang, md5(line) AS line, count(*) AS n FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1, 2")
def whole_text_roundtrip(spark, sf):
    """One folder per language; each file of it comes back as one row of file and text."""
    path = shared_folder(spark, "texts")
    table(spark, sf, "documents").select("lang", "text").write.partitionBy("lang").text(path)
    files = readers.read_texts(spark, f"{path}/*")
    lang = F.regexp_extract("file", "lang=([a-z]+)", 1)
    # Every file ends in a line feed.
    lines = files.select(lang.alias("lang"), F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("line"))
    return lines.groupBy("lang", F.md5("line").alias("line")).agg(F.count("*").alias("n"))


@query("""
    SELECT md5(regexp_replace(regexp_replace(html, '(<!--.*?-->|<[^>]*>)', '', 'g'), '&([^;]+);', '', 'g')) AS page, count(*) AS n
    FROM (SELECT replace(replace(html, chr(13), ''), chr(10), ' ') AS html FROM pages) GROUP BY 1
""")
def html_lines(spark, sf):
    """Pages written as lines of HTML and stripped after the scan."""
    pages = table(spark, sf, "pages").select(F.translate("html", "\n\r", " ").alias("html"))
    path = sinks.save(pages, shared_folder(spark, "html"), "text")
    stripped = text.html_to_text(readers.read_lines(spark, path), "value")
    return stripped.groupBy(F.md5("value").alias("page")).agg(F.count("*").alias("n"))


@query("""
    SELECT '(' || word || ', ' || count(*) || ')' AS value
    FROM (SELECT unnest(string_split(line, ' ')) AS word FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents))
    GROUP BY word
""")
def word_count_text(spark, sf):
    lines = columns.explode_lines(table(spark, sf, "documents"), "doc_id", "text")
    path = sinks.write_word_counts(text.word_count(lines, "text"), shared_folder(spark, "counts"))
    return readers.read_lines(spark, path)


@query("""
    SELECT event_type, user_id::VARCHAR AS user_id, count(*)::VARCHAR AS "Count" FROM events GROUP BY 1, 2
""")
def pivot_tsv_rows(spark, sf):
    """Exported grid without column attributes: the value column is named after the aggregator."""
    path = sinks.write_pivot_tsv(table(spark, sf, "events"), shared_folder(spark, "tsv"), ["event_type", "user_id"], [])
    return spark.read.csv(path, sep="\t", header=True)


@query("""
    SELECT user_id::VARCHAR AS user_id, nullif(count(*) FILTER (event_type = 'click'), 0)::VARCHAR AS click,
           nullif(count(*) FILTER (event_type = 'error'), 0)::VARCHAR AS error,
           nullif(count(*) FILTER (event_type = 'purchase'), 0)::VARCHAR AS purchase,
           nullif(count(*) FILTER (event_type = 'signup'), 0)::VARCHAR AS signup,
           nullif(count(*) FILTER (event_type = 'view'), 0)::VARCHAR AS view FROM events GROUP BY 1
""")
def pivot_tsv(spark, sf):
    path = sinks.write_pivot_tsv(table(spark, sf, "events"), shared_folder(spark, "tsv"), ["user_id"], ["event_type"])
    return spark.read.csv(path, sep="\t", header=True)


@query("""
    SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"c_acctbal":' || c_acctbal || ',"c_mktsegment":"' || c_mktsegment || '"}' AS value
    FROM customer
""")
def json_records(spark, sf):
    return sinks.json_records(table(spark, sf, "customer"), None)


@query("SELECT s_suppkey::VARCHAR AS \"row\", s_acctbal::VARCHAR AS s_acctbal, s_name, s_nationkey::VARCHAR AS s_nationkey FROM supplier")
def cells_roundtrip(spark, sf):
    cells = columns.to_cells(table(spark, sf, "supplier"), "s_suppkey")
    return columns.from_cells(cells, ["s_acctbal", "s_name", "s_nationkey"])


@query("""
    SELECT o_orderkey::VARCHAR AS "row", 'f1' AS family, qualifier, value FROM (
        SELECT o_orderkey, 'o_orderstatus' AS qualifier, o_orderstatus AS value FROM orders
        UNION ALL SELECT o_orderkey, 'o_custkey', o_custkey::VARCHAR FROM orders)
""")
def cells(spark, sf):
    return columns.to_cells(table(spark, sf, "orders"), "o_orderkey", columns=["o_orderstatus", "o_custkey"])


@query("SELECT conv_id, unnest(string_split(text, chr(10))) AS text FROM conversations")
def kv_explode_lines(spark, sf):
    return columns.explode_lines(table(spark, sf, "conversations"), "conv_id", "text")


@query("SELECT o_orderkey::BIGINT AS id, o_orderstatus AS name, TRY_CAST(split_part(o_orderpriority, '-', 1) AS INTEGER) AS code, NULL::INTEGER AS extra FROM orders")
def typed_fields(spark, sf):
    """Delimited lines parsed into typed columns; a missing field is NULL."""
    lines = table(spark, sf, "orders").select(
        F.concat_ws("|", "o_orderkey", "o_orderstatus", F.substring_index("o_orderpriority", "-", 1)).alias("value"))
    return readers.typed_fields(lines, {"id": "bigint", "name": "string", "code": "int", "extra": "int"}, sep="|")


@query('SELECT n_nationkey AS ab, n_name AS ab_2, n_regionkey AS col_2, c.c_custkey AS key FROM nation JOIN customer c ON c_nationkey = n_nationkey')
def clean_names(spark, sf):
    """Names without special characters; collisions are numbered."""
    nation = table(spark, sf, "nation").toDF("A b", "a-b", "!?")
    joined = nation.join(table(spark, sf, "customer"), F.col("`A b`") == F.col("c_nationkey"))
    return clean_columns(joined.select("`A b`", "`a-b`", "`!?`", F.col("c_custkey").alias("Key")))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def registered_view(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("weft_events")
    return readers.read_view(spark, "weft_events").groupBy("event_type").agg(F.count("*").alias("n"))


# --- inventory --------------------------------------------------------------------------

_EXTENSION = {"en": "txt", "de": "json", "fr": "HTML", "es": "zip"}
_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _EXTENSION.items())


def _files(spark, sf):
    """Documents seen as files: the language decides the extension, the text length the size."""
    kind = F.create_map(*[F.lit(x) for pair in _EXTENSION.items() for x in pair])
    path = F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/Doc"), F.col("doc_id"), F.lit("."), kind[F.col("lang")])
    return table(spark, sf, "documents").select(
        path.alias("path"), (F.col("n_chars") * F.col("n_chars")).alias("length"), F.current_timestamp().alias("modificationTime"))


@query(f"""
    WITH f AS (SELECT 'Doc' || doc_id || '.' || CASE lang {_CASE} END AS name, n_chars * n_chars AS bytes, lang FROM documents)
    SELECT name, CASE lang WHEN 'en' THEN 'text' ELSE 'json' END AS format, bytes,
           row_number() OVER (ORDER BY CASE lang WHEN 'en' THEN 'text' ELSE 'json' END, lower(name)) AS place
    FROM f WHERE lang IN ('en', 'de')
""")
def source_listing(spark, sf):
    """Accepted files in listing order (extensions are matched as written)."""
    listed = inventory.describe_files(_files(spark, sf)).select("name", "type", "format", "bytes")
    return global_rank(listed, inventory.source_order(), "place").drop("type")


_SIZE = "n_chars * n_chars * n_chars"


@query(f"""
    WITH s AS (SELECT doc_id, {_SIZE} AS b FROM documents),
         k AS (SELECT doc_id, b, CASE WHEN b >= 1099511627776 THEN 4 WHEN b >= 1073741824 THEN 3 WHEN b >= 1048576 THEN 2
                                      WHEN b >= 1024 THEN 1 ELSE 0 END AS k FROM s),
         m AS (SELECT doc_id, b // (1024 ** k)::BIGINT AS m, k FROM k)
    SELECT doc_id, CASE WHEN m > 1000 THEN 1 ELSE m END::BIGINT AS measure,
           (['B', 'KB', 'MB', 'GB', 'TB', 'PB'])[k + 1 + CASE WHEN m > 1000 THEN 1 ELSE 0 END] AS unit
    FROM m
""")
def readable_size(spark, sf):
    size = F.col("n_chars") * F.col("n_chars") * F.col("n_chars")
    measure, unit = inventory.readable_size(size)
    return table(spark, sf, "documents").select("doc_id", measure.alias("measure"), unit.alias("unit"))


@query(f"""
    SELECT doc_id, CASE lang WHEN 'en' THEN 'text' WHEN 'de' THEN 'json' WHEN 'fr' THEN 'html' ELSE 'binary' END AS format,
           lang IN ('en', 'de') AS accepted FROM documents
""")
def format_infer(spark, sf):
    kind = F.create_map(*[F.lit(x) for pair in _EXTENSION.items() for x in pair])
    name = F.concat(F.lit("x."), kind[F.col("lang")])
    return table(spark, sf, "documents").select(
        "doc_id", inventory.infer_format(name).alias("format"), inventory.allowed(name).alias("accepted"))


@query("SELECT 'json' AS format, 'File' AS type, TRUE AS some_files, count(*) AS n_rows FROM customer")
def source_inventory(spark, sf):
    """Files just written, found by their metadata."""
    customers = table(spark, sf, "customer")
    path = sinks.save(customers, shared_folder(spark, "inventory"), "json")
    found = inventory.source_inventory(spark, path)
    files = found.groupBy("format", "type").agg((F.count("*") > 0).alias("some_files"))
    return files.withColumn("n_rows", readers.read_json(spark, path, customers.schema).agg(F.count("*")).scalar())


@query("""
    SELECT o_orderkey::VARCHAR AS "row", 'f1' AS family, qualifier, value FROM (
        SELECT o_orderkey, 'o_orderstatus' AS qualifier, o_orderstatus AS value FROM orders
        UNION ALL SELECT o_orderkey, 'o_custkey', o_custkey::VARCHAR FROM orders
        UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders)
""")
def cell_store(spark, sf):
    """Orders written as cells through the data source, and read back in byte ranges."""
    cells = columns.to_cells(table(spark, sf, "orders"), "o_orderkey", columns=["o_orderstatus", "o_custkey", "o_orderpriority"])
    return read_cells(spark, write_cells(cells, shared_folder(spark, "cells")), 1 << 20)
