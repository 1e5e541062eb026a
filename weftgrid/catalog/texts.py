"""Tokens, stems, features, topics, indexes and similarity."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from weftgrid.catalog import query, table
from weftgrid.catalog.stems import stem_ctes
from weftgrid.functions.rows import explode_column
from weftgrid.functions.stemming import stem
from weftgrid.functions.stopwords import ENGLISH
from weftgrid.operators import columns, docindex, features, search, text
from weftgrid.session import materialize, packed, shared_folder, spread
from weftgrid.sources.readers import read_html
from weftgrid.sources.textfiles import write_text_files


def _docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def _lines(spark, sf):
    return columns.explode_lines(_docs(spark, sf), "doc_id", "text").select(F.col("text").alias("value"))


def filtered(spark, sf):
    """Documents as tokens: alphabetic, three letters or more, no stop words."""
    docs = text.tokenize(_docs(spark, sf), "text")
    for step in (text.keep_alphabetic, text.keep_long, text.remove_stop_words):
        docs = step(docs, "text")
    return docs


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH)
_TOKENS = """
    toks AS (SELECT doc_id, regexp_extract_all(lower(text), '\\w+') AS toks FROM documents),
    tok AS (SELECT doc_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS idx FROM toks)"""
KEPT = f"""{_TOKENS},
    kept AS (SELECT doc_id, token, idx FROM tok
             WHERE regexp_full_match(token, '\\p{{L}}+') AND length(token) >= 3 AND token NOT IN ({_STOP}))"""


# --- word counts ------------------------------------------------------------------

_LINES = "SELECT unnest(string_split(text, chr(10))) AS line FROM documents"


@query(f"SELECT word, count(*) AS count FROM (SELECT unnest(string_split(line, ' ')) AS word FROM ({_LINES})) GROUP BY word")
def word_count(spark, sf):
    return text.word_count(_lines(spark, sf))


@query(f"""
    SELECT word, count(*) AS count FROM (SELECT unnest(string_split(line, ' ')) AS word FROM ({_LINES}) WHERE length(line) > 0)
    GROUP BY word ORDER BY count DESC, word LIMIT 100
""")
def word_count_top100(spark, sf):
    return text.top_words(_lines(spark, sf))


# --- tokens -----------------------------------------------------------------------

@query(f"WITH {_TOKENS} SELECT doc_id, CAST(idx - 1 AS INTEGER) AS pos, token FROM tok")
def tokenize(spark, sf):
    return text.explode_tokens(text.tokenize(_docs(spark, sf), "text"), "doc_id", "text")


@query("""
    SELECT doc_id, CAST(generate_subscripts(toks, 1) - 1 AS INTEGER) AS pos, unnest(toks) AS token
    FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+') AS toks FROM documents)
""")
def tokenize_unicode(spark, sf):
    return text.explode_tokens(text.tokenize(_docs(spark, sf), "text", unicode=True), "doc_id", "text")


@query(f"""
    WITH {_TOKENS}
    SELECT doc_id, token, count(*) AS n FROM tok
    WHERE regexp_full_match(token, '\\p{{L}}+') AND length(token) >= 4 GROUP BY doc_id, token
""")
def tokens_filtered(spark, sf):
    docs = text.keep_long(text.keep_alphabetic(text.tokenize(_docs(spark, sf), "text"), "text"), "text", 4)
    return features.term_counts(docs, "doc_id", "text").select("doc_id", F.col("term").alias("token"), F.col("tf").alias("n"))


@query(f"""
    WITH {KEPT}
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS INTEGER) AS pos, token FROM kept
""")
def stopwords_removed(spark, sf):
    return text.explode_tokens(filtered(spark, sf), "doc_id", "text")


@query(f"WITH {_TOKENS}, {stem_ctes('tok')} SELECT token, stem FROM stems")
def stem_vocab(spark, sf):
    words = explode_column(text.tokenize(_docs(spark, sf), "text"), [], F.col("text"), "token").distinct()
    return words.select("token", stem(F.col("token")).alias("stem"))


@query(f"""
    WITH {KEPT}, {stem_ctes('kept')}
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS INTEGER) AS pos, stem AS token
    FROM kept JOIN stems USING (token)
""")
def preprocess(spark, sf):
    return text.explode_tokens(text.preprocess(_docs(spark, sf), "text"), "doc_id", "text")


# --- features ------------------------------------------------------------------------

_WEIGHTED = """
    c AS (SELECT doc_id, token AS term, count(*) AS tf FROM kept GROUP BY 1, 2),
    d AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
    w AS (SELECT doc_id, term, tf, df, tf * ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (df + 1)) AS weight
          FROM c JOIN d USING (term))"""


@query(f"WITH {KEPT} SELECT doc_id, token AS term, count(*) AS tf FROM kept GROUP BY 1, 2")
def tf(spark, sf):
    return features.term_counts(filtered(spark, sf), "doc_id", "text")


@query(f"WITH {KEPT}, {_WEIGHTED} SELECT doc_id, term, tf, df, round(weight, 9) AS weight FROM w")
def tfidf_long(spark, sf):
    return features.tfidf(filtered(spark, sf), "doc_id", "text").withColumn("weight", F.round("weight", 9))


@query(f"""
    WITH {_TOKENS},
         k AS (SELECT doc_id, token, idx FROM tok WHERE regexp_full_match(token, '\\p{{L}}+') AND length(token) >= 3 AND token NOT IN ({_STOP})),
         {stem_ctes('k')},
         kept AS (SELECT doc_id, stem AS token, idx FROM k JOIN stems USING (token)), {_WEIGHTED}
    SELECT doc_id, term, tf, df, round(weight, 9) AS weight FROM w
""")
def tfidf_stemmed(spark, sf):
    """TF-IDF of the fully preprocessed text."""
    docs = text.preprocess(_docs(spark, sf), "text")
    return features.tfidf(docs, "doc_id", "text").withColumn("weight", F.round("weight", 9))


@query(f"""
    WITH {KEPT}, {_WEIGHTED},
         top AS (SELECT term FROM c GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 20)
    SELECT documents.doc_id, 'term_' || top.term AS term, round(coalesce(weight, 0), 9) AS weight
    FROM documents CROSS JOIN top LEFT JOIN w ON w.doc_id = documents.doc_id AND w.term = top.term
""")
def tfidf_wide_topn(spark, sf):
    """One column per frequent term, listed as rows so that the schema does not depend on the data."""
    wide = features.tfidf_wide(filtered(spark, sf), "text", 20)
    terms = [c for c in wide.columns if c.startswith("term_")]
    return wide.unpivot("doc_id", terms, "term", "weight").withColumn("weight", F.round("weight", 9))


@query(f"""
    WITH {KEPT}, c AS (SELECT doc_id, count(*) AS n FROM kept GROUP BY 1)
    SELECT documents.doc_id, coalesce(c.n, 0)::DOUBLE AS tokens FROM documents LEFT JOIN c USING (doc_id)
""")
def hashing_tf(spark, sf):
    """Hashed counts; hashing may merge terms but keeps every document's total."""
    hashed = features.hashing_tf(filtered(spark, sf), "text", 4096)
    total = F.aggregate(features.vector_entries("text"), F.lit(0.0), lambda a, e: a + e["value"])
    return hashed.select("doc_id", total.alias("tokens"))


@query(f"WITH {KEPT} SELECT doc_id, token AS term, count(*)::DOUBLE AS tf FROM kept GROUP BY 1, 2")
def count_vectors(spark, sf):
    """Count vectors over the whole vocabulary, read back term by term."""
    counted, names = features.count_vector_tables(filtered(spark, sf), "text")
    entries = explode_column(counted, ["doc_id"], features.vector_entries("text"), "e").select("doc_id", "e.place", "e.value")
    return entries.join(names, "place").select("doc_id", "term", F.col("value").alias("tf"))


@query("SELECT doc_id, TRUE AS finite FROM documents")
def word2vec(spark, sf):
    """Every document gets a vector of two finite numbers."""
    made = columns.expand_vector(features.word2vec(filtered(spark, sf), "text"), "text")
    numbers = [c for c in made.columns if c.startswith("dim")]
    finite = F.lit(len(numbers) == 2)
    for c in numbers:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return made.select("doc_id", finite.alias("finite"))


@query(f"""
    WITH {KEPT}, k AS (SELECT DISTINCT doc_id FROM kept)
    SELECT documents.doc_id, 5 AS topics, TRUE AS valid, CASE WHEN k.doc_id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS total
    FROM documents LEFT JOIN k USING (doc_id)
""")
def lda_topics(spark, sf):
    """A distribution over five topics for every document that has a term left; zeros for the others."""
    modelled, _ = features.lda(_docs(spark, sf), "text")
    shares = vector_to_array(F.col("text"))
    return modelled.select(
        "doc_id", F.size(shares).alias("topics"), F.forall(shares, lambda x: x.between(0, 1)).alias("valid"),
        F.round(F.aggregate(shares, F.lit(0.0), lambda total, x: total + x), 6).alias("total"))


@query("SELECT unnest(range(5))::INTEGER AS topic, 3 AS terms, TRUE AS descending, TRUE AS known")
def lda_terms(spark, sf):
    """Three terms of the vocabulary per topic, the weightiest first."""
    docs = _docs(spark, sf)
    _, topics = features.lda(docs, "text")
    words = features.vocabulary_counts(text.preprocess(docs, "text"), "text").select(F.col("w").alias("term"), F.lit(True).alias("known"))
    ranked = topics.join(words, "term", "left").groupBy("topic").agg(
        F.sort_array(F.collect_list(F.struct("rank", "weight"))).alias("r"), F.every(F.coalesce("known", F.lit(False))).alias("known"))
    falling = F.forall(F.sequence(F.lit(1), F.size("r") - 1), lambda i: F.get("r", i)["weight"] <= F.get("r", i - 1)["weight"])
    return ranked.select("topic", F.size("r").alias("terms"), falling.alias("descending"), "known")


@query(f"""
    WITH {KEPT}, k AS (SELECT DISTINCT doc_id FROM kept)
    SELECT documents.doc_id, 5 AS topics, CASE WHEN k.doc_id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS total
    FROM documents LEFT JOIN k USING (doc_id)
""")
def lda_columns(spark, sf):
    """One column per topic; the shares of a text add up to one."""
    wide = features.topic_columns(_docs(spark, sf), "text")
    topics = [c for c in wide.columns if c.startswith("topic__")]
    shares = wide.unpivot("doc_id", topics, "topic", "share")
    return shares.groupBy("doc_id").agg(
        F.count_distinct("topic").cast("int").alias("topics"), F.round(F.sum("share"), 6).alias("total"))


# --- sentences and mentions -------------------------------------------------------------

_SENTENCES = """
    s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
                                     lambda x: length(x) > 0) AS ss FROM documents),
    sent AS (SELECT doc_id, unnest(ss) AS sentence, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS pos FROM s)"""


@query(f"WITH {_SENTENCES} SELECT doc_id, pos, sentence FROM sent")
def sentences(spark, sf):
    split = text.segment_sentences(_docs(spark, sf), "text")
    return explode_column(split, ["doc_id"], F.col("text"), "sentence", "pos")


_RUN = "\\p{Lu}[\\p{L}\\p{N}]*(?: \\p{Lu}[\\p{L}\\p{N}]*)*"


@query(f"""
    WITH {_SENTENCES},
         m AS (SELECT doc_id, pos, regexp_extract_all(sentence, '{_RUN}') AS runs FROM sent),
         x AS (SELECT doc_id, pos AS sentence, CAST(generate_subscripts(runs, 1) - 1 AS INTEGER) AS position, unnest(runs) AS mention FROM m),
         g AS (SELECT lower(name) AS name, min('benchmark') AS label FROM (
                   SELECT unnest(regexp_extract_all(text, '{_RUN}')) AS name FROM benchmark) GROUP BY 1)
    SELECT doc_id, sentence, position, mention, label FROM x LEFT JOIN g ON lower(mention) = g.name
""")
def entity_mentions(spark, sf):
    """Capitalised runs of the documents; the gazetteer is the runs that occur in the benchmark passages."""
    runs = F.regexp_extract_all("text", F.lit(text.MENTION_PATTERN), F.lit(1))
    gazetteer = explode_column(table(spark, sf, "benchmark"), [], runs, "name").withColumn("label", F.lit("benchmark"))
    return text.entity_mentions(_docs(spark, sf), "doc_id", "text", gazetteer)


# --- index and similarity ------------------------------------------------------------------

@query("""
    SELECT doc_id, array_to_string(list_sort(list_distinct(string_split(text, ' '))), '|') AS words FROM documents
""")
def forward_index(spark, sf):
    index = docindex.forward_index(_docs(spark, sf), "doc_id", "text")
    return index.select("doc_id", F.array_join("words", "|").alias("words"))


_POSTINGS = """
    SELECT DISTINCT lower(regexp_replace(word, '^\\s+|\\s+$', '', 'g')) AS word, doc_id
    FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents)"""


@query(_POSTINGS)
def inverted_index(spark, sf):
    return docindex.inverted_index(_docs(spark, sf), "doc_id", "text", unique_key=True)


@query(f"SELECT doc_id, word, 1 AS present FROM ({_POSTINGS})")
def binary_vectors(spark, sf):
    return docindex.binary_vectors(_docs(spark, sf), "doc_id", "text", unique_key=True)


@query(f"""
    SELECT word, doc_id // 100 AS block, count(*) AS size, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS docs
    FROM ({_POSTINGS}) GROUP BY 1, 2
""")
def inverted_index_blocks(spark, sf):
    index = docindex.inverted_index(_docs(spark, sf), "doc_id", "text", unique_key=True)
    blocks = docindex.posting_blocks(index, "doc_id", 100)
    return blocks.withColumn("docs", F.array_join("docs", ","))


@query(f"""
    WITH {_TOKENS},
         c AS (SELECT doc_id, token, count(*) AS tf FROM tok WHERE token IN ('tion', 'the', 'und', 'les') GROUP BY 1, 2),
         d AS (SELECT token, count(*) AS df FROM c GROUP BY 1)
    SELECT doc_id, count(*) AS hits,
           round(sum(tf * ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (df + 1))), 9) AS score
    FROM c JOIN d USING (token) GROUP BY doc_id
""")
def term_search(spark, sf):
    docs = text.tokenize(_docs(spark, sf), "text")
    found = docindex.term_search(docs, "doc_id", "text", ["the", "tion", "und", "les"])
    return found.withColumn("score", F.round("score", 9))


def _positions(spark, sf, block_size=search.BLOCK_DOCUMENTS):
    """Positional index of the documents, written once and read by the search."""
    docs = text.tokenize(_docs(spark, sf), "text")
    return materialize(search.position_index(docs, "doc_id", "text", block_size).sortWithinPartitions("term", "block"), "positions")


@query(f"""
    WITH {_TOKENS}
    SELECT doc_id AS doc, count(*) AS n
    FROM (SELECT doc_id, token, lead(token) OVER w AS second, lead(token, 2) OVER w AS third FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
    WHERE token = 'of' AND second = 'the' AND third = 'the' GROUP BY doc_id
""")
def phrase_search(spark, sf):
    """Documents with three words in a row, one of them twice, from delta-coded positions."""
    return search.phrase_search(_positions(spark, sf), ["of", "the", "the"])


@query(f"""
    WITH {_TOKENS},
         c AS (SELECT doc_id, token, count(*) AS tf FROM tok WHERE token IN ('tion', 'the', 'und', 'les') GROUP BY 1, 2),
         d AS (SELECT token, count(*) AS df FROM c GROUP BY 1),
         s AS (SELECT doc_id AS doc, sum(tf * ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (df + 1))) AS score FROM c JOIN d USING (token) GROUP BY doc_id),
         t AS (SELECT doc_id // 64 AS block, token, max(tf) AS top FROM c GROUP BY 1, 2),
         b AS (SELECT block, sum(top * ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (df + 1))) AS bound FROM t JOIN d USING (token) GROUP BY block),
         head AS (SELECT block FROM b ORDER BY bound DESC, block LIMIT 8),
         best AS (SELECT score FROM s WHERE doc // 64 IN (SELECT block FROM head) ORDER BY score DESC LIMIT 10)
    SELECT doc, round(score, 6) AS score, (SELECT count(*) FROM b) AS blocks, (SELECT count(*) FROM b WHERE bound >= (SELECT min(score) FROM best)) AS blocks_read
    FROM s ORDER BY s.score DESC, doc LIMIT 10
""")
def ranked_search(spark, sf):
    """The ten best documents; blocks whose bound is below the tenth best score found so far are not read."""
    documents = table(spark, sf, "documents").count()
    found = search.ranked_search(_positions(spark, sf, 64), ["the", "tion", "und", "les"], documents, 10, 64)
    return found.withColumn("score", F.round("score", 6))


_SETS = """
    ws AS (SELECT doc_id, list_sort(list_distinct(list_transform(string_split(text, ' '),
                  lambda w: lower(regexp_replace(w, '^\\s+|\\s+$', '', 'g'))))) AS words FROM documents)"""


@query(f"""
    WITH {_SETS},
         h AS (SELECT min(doc_id) AS doc, count(*) AS copies, len(words) AS n, words FROM ws GROUP BY words),
         w AS (SELECT doc, unnest(words) AS word FROM h),
         o AS (SELECT a.doc AS doc1, b.doc AS doc2, count(*) AS o FROM w a JOIN w b ON a.word = b.word AND a.doc < b.doc GROUP BY 1, 2)
    SELECT doc1, doc2, h1.copies AS copies1, h2.copies AS copies2,
           floor(o / sqrt((h1.n * h2.n)::DOUBLE) * 100) / 100 AS similarity
    FROM o JOIN h h1 ON h1.doc = doc1 JOIN h h2 ON h2.doc = doc2 WHERE o / sqrt((h1.n * h2.n)::DOUBLE) >= 0.8
""")
def doc_similarity(spark, sf):
    return docindex.similar_documents(_docs(spark, sf), "doc_id", "text", 0.8)


@query(f"""
    WITH {_SETS}, h AS (SELECT min(doc_id) AS doc, words FROM ws GROUP BY words)
    SELECT doc_id, doc FROM ws JOIN h USING (words)
""")
def doc_copies(spark, sf):
    return docindex.copy_groups(_docs(spark, sf), "doc_id", "text")


_LANGS = ("de", "en", "es", "fr")


@query(f"""
    WITH w AS (SELECT DISTINCT lang, lower(regexp_replace(word, '^\\s+|\\s+$', '', 'g')) AS word
               FROM (SELECT lang, unnest(string_split(text, ' ')) AS word FROM documents)),
         n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
         o AS (SELECT a.lang AS doc, b.lang AS doc2, floor(count(*) / sqrt((any_value(x.n) * any_value(y.n))::DOUBLE) * 100) / 100 AS s
               FROM w a JOIN w b USING (word) JOIN n x ON x.lang = a.lang JOIN n y ON y.lang = b.lang GROUP BY 1, 2)
    SELECT doc, {", ".join(f"coalesce(max(s) FILTER (doc2 = '{x}'), 0) AS {x}" for x in _LANGS)} FROM o GROUP BY doc
""")
def similarity_matrix(spark, sf):
    """Word overlap of the languages, each language's documents taken as one."""
    return docindex.similarity_matrix(table(spark, sf, "documents").select("lang", "text"), "lang", "text")


@query(f"""
    WITH {_SETS},
         h AS (SELECT doc_id::VARCHAR AS doc, (row_number() OVER (ORDER BY doc_id::VARCHAR) - 1) // 256 AS tile, len(words) AS n, words FROM ws),
         w AS (SELECT doc, tile, n, unnest(words) AS word FROM h),
         o AS (SELECT a.doc, a.tile AS t1, b.tile AS t2, b.doc AS doc2, floor(count(*) / sqrt((any_value(a.n) * any_value(b.n))::DOUBLE) * 100) / 100 AS s
               FROM w a JOIN w b USING (word) GROUP BY a.doc, a.tile, b.tile, b.doc)
    SELECT doc, t1::INTEGER AS tile1, t2::INTEGER AS tile2, count(*) AS filled, round(sum(s), 2) AS total FROM o WHERE s > 0 GROUP BY doc, t1, t2
""")
def similarity_tiles(spark, sf):
    """The matrix of all documents in tiles, summed by document and tile."""
    cells = docindex.tile_cells(docindex.similarity_tiles(_docs(spark, sf), "doc_id", "text"))
    return cells.groupBy(F.col("doc1").alias("doc"), "tile1", "tile2").agg(
        F.count("*").alias("filled"), F.round(F.sum("similarity"), 2).alias("total"))


def _cosine_sql(a: str, b: str) -> str:
    dot = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i]::DOUBLE * {1}[i]::DOUBLE))"
    return f"{dot.format(a, b)} / sqrt({dot.format(a, a)} * {dot.format(b, b)})"


@query(f"""
    WITH c AS (SELECT label, list(m ORDER BY i) AS centre FROM (
                   SELECT label, i, avg(x) AS m FROM (
                       SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)
    SELECT vec_id, label, round({_cosine_sql('embedding', 'centre')}, 6) AS cosine FROM embeddings JOIN c USING (label)
""")
def vector_cosine(spark, sf):
    """Cosine of each vector with the centre of its label."""
    vectors = table(spark, sf, "embeddings")
    means = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    # One value per dimension of the vectors.
    centres = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("c"))
    centres = centres.select("label", F.transform("c", lambda p: p["m"]).alias("centre"))
    cosine = docindex.vector_cosine(F.col("embedding"), F.col("centre"))
    return vectors.join(centres, "label").select("vec_id", "label", F.round(cosine, 6).alias("cosine"))


@query("SELECT page_id, string_split(url, '/')[-1] AS name FROM pages")
def base_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", docindex.base_name(F.col("url")).alias("name"))


# --- pages --------------------------------------------------------------------------------

@query("""
    SELECT page_id, regexp_replace(regexp_replace(html, '(<!--.*?-->|<[^>]*>)', '', 'g'), '&([^;]+);', '', 'g') AS html FROM pages
""")
def html_to_text(spark, sf):
    return text.html_to_text(table(spark, sf, "pages").select("page_id", "html"), "html")


@query("""
    SELECT page_id, regexp_replace(regexp_replace(html || chr(10), '(<!--.*?-->|<[^>]*>)', '', 'g'), '&([^;]+);', '', 'g') AS text FROM pages
""")
def html_files(spark, sf):
    """Whole HTML files, one per page, read as text."""
    path = shared_folder(spark, "pages")
    write_text_files(table(spark, sf, "pages"), F.concat(F.lit("page-"), "page_id"), F.col("html"), path, ".html")
    pages = packed(read_html(spark, f"{path}/*"))
    return pages.select(F.regexp_extract("file", r"/page-(\d+)\.html$", 1).cast("bigint").alias("page_id"), "text")
