"""Sentences and entities learned from the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgrid.catalog import query, table
from weftgrid.catalog.texts import KEPT, filtered
from weftgrid.functions.rows import explode_column
from weftgrid.operators import sentences as sent, tagger, text, topics, vectors
from weftgrid.session import materialize, spread


def _docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


# Pieces between gaps: chr(1) goes before the white space, chr(2) behind it.
_EVIDENCE = r"""
    t AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])(\s+)', '\1' || chr(1) || '\2' || chr(2), 'g'), chr(1)) AS ps FROM documents),
    p0 AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS place FROM t),
    p1 AS (SELECT doc_id, place, CASE WHEN place > 1 THEN string_split(p, chr(2))[1] ELSE '' END AS gap, string_split(p, chr(2))[-1] AS piece FROM p0),
    w0 AS (SELECT regexp_extract_all(piece, '\p{L}+(?:\.\p{L}+)*\.?') AS ws FROM p1),
    w1 AS (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w0),
    ev AS (SELECT lower(rtrim(w, '.')) AS word, count(*) FILTER (w LIKE '%.') AS stopped, count(*) FILTER (w NOT LIKE '%.') AS plain,
                  count(*) FILTER (regexp_matches(w, '^\p{Ll}')) AS lower, count(*) FILTER (i > 1 AND regexp_matches(w, '^\p{Lu}')) AS inside
           FROM w1 GROUP BY 1),
    q AS (SELECT sum(stopped) / sum(stopped + plain) AS q FROM ev),
    r AS (SELECT word, stopped, plain, length(replace(word, '.', '')) AS n,
                 2 * (stopped * ln(0.99) + plain * ln(1 - 0.99) - stopped * ln(q) - CASE WHEN plain > 0 THEN plain * ln(1 - q) ELSE 0 END) AS ratio
          FROM ev, q WHERE stopped > 0),
    sc AS (SELECT word, stopped, plain,
                  CASE WHEN ratio > 0 THEN ratio * exp(-n) * (length(word) - n + 1) * pow(n::DOUBLE, -plain::DOUBLE) ELSE 0.0 END AS score FROM r)"""


@query(f"WITH {_EVIDENCE} SELECT word, stopped, plain, round(score, 6) AS score FROM sc")
def abbreviation_scores(spark, sf):
    """Every word seen with a full stop, and how much it looks like an abbreviation."""
    evidence = materialize(sent.word_evidence(_docs(spark, sf), "text"), "words")
    return sent.abbreviation_scores(evidence).withColumn("score", F.round("score", 6))


@query(rf"""
    WITH {_EVIDENCE},
         f AS (SELECT *, lead(gap) OVER w AS gap_after,
                      lower(regexp_extract(piece, '(\p{{L}}+(?:\.\p{{L}}+)*)\.$', 1)) AS last,
                      regexp_extract(lead(piece) OVER w, '^\P{{L}}*(\p{{L}}+)', 1) AS first
               FROM p1 WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
         e AS (SELECT *, last IN (SELECT word FROM sc WHERE score >= 0.3)
                     AND NOT (regexp_matches(first, '^\p{{Lu}}') AND lower(first) IN (SELECT word FROM ev WHERE lower > 0 AND inside = 0)) AS goes_on
               FROM f WHERE length(piece) > 0),
         n AS (SELECT *, coalesce(sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (
                   PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS pos FROM e)
    SELECT doc_id, pos, string_agg(CASE WHEN place = first_place THEN piece ELSE gap || piece END, '' ORDER BY place) AS sentence
    FROM (SELECT *, min(place) OVER (PARTITION BY doc_id, pos) AS first_place FROM n) GROUP BY doc_id, pos
""")
def learned_sentences(spark, sf):
    """Sentences of the documents; full stops of the corpus's own abbreviations do not end one."""
    return sent.learned_sentences(_docs(spark, sf), "doc_id", "text")


def language_names(documents):
    """``(name, label, held_out)``: capitalised runs found in texts of one language only, that language, and whether
    the name is kept from the learner."""
    runs = F.regexp_extract_all("text", F.lit(text.MENTION_PATTERN), F.lit(1))
    mentions = explode_column(documents.where("lang IS NOT NULL"), ["lang"], runs, "mention")
    names = mentions.groupBy(F.lower("mention").alias("name")).agg(F.min("lang").alias("label"), F.max("lang").alias("other"))
    return names.where("label = other").select("name", "label", (F.crc32("name") % 3 == 1).alias("held_out"))


@query()
def entity_tags(spark, sf):
    """Mentions of the documents, labelled by a model learned from two thirds of the names that belong to one language."""
    documents = spread(table(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id")
    names = language_names(documents).where("NOT held_out").select("name", "label")
    model = tagger.train_tagger(documents, "doc_id", "text", names)
    return tagger.tag_entities(documents, "doc_id", "text", model)


def _tokens(spark, sf):
    return text.tokenize(_docs(spark, sf), "text")


@query("""
    WITH k AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '\\w+') AS t FROM documents)),
         h AS (SELECT a.w AS a, b.w AS b FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.i IN (a.i + 1, a.i + 2)),
         p AS (SELECT term, context, count(*) AS n FROM (SELECT a AS term, b AS context FROM h UNION ALL SELECT b, a FROM h) GROUP BY 1, 2),
         m AS (SELECT term FROM p GROUP BY 1 HAVING sum(n) >= 20),
         q AS (SELECT * FROM p WHERE term IN (FROM m) AND context IN (FROM m)),
         s AS (SELECT term, sum(n)::DOUBLE AS c FROM q GROUP BY 1),
         w AS (SELECT q.term, context, n, ln(n * (SELECT sum(c) FROM s) / (x.c * y.c)) AS weight FROM q JOIN s x ON x.term = q.term JOIN s y ON y.term = context)
    SELECT term, context, n, round(weight, 6) AS weight FROM w WHERE weight > 0
""")
def word_associations(spark, sf):
    """Words that stand within two words of each other more often than by chance."""
    return vectors.word_associations(_tokens(spark, sf), "text", 2, 20).withColumn("weight", F.round("weight", 6))


@query()
def word_vectors(spark, sf):
    """Vectors of sixteen numbers for all words with enough company."""
    return vectors.word_vectors(_tokens(spark, sf), "text")


def _topics(spark, sf, **options):
    return topics.fit_topics(filtered(spark, sf), "doc_id", "text", rounds=6, **options)


@query("SELECT (range + 1)::INTEGER AS round, TRUE AS rises FROM range(5)")
def topic_bounds(spark, sf):
    """Each round brings the topics closer to the documents: the bound of the log likelihood rises."""
    bounds = _topics(spark, sf).bounds
    return spark.createDataFrame([(i, bounds[i] > bounds[i - 1]) for i in range(1, len(bounds))], "round int, rises boolean")


@query(f"WITH {KEPT} SELECT token AS term, count(*)::DOUBLE AS n, TRUE AS valid FROM kept GROUP BY 1")
def topics_by_term(spark, sf):
    """Every occurrence of every word is dealt to the five topics, no part of it lost."""
    dealt = F.aggregate("counts", F.lit(0.0), lambda a, x: a + x)
    valid = F.forall("counts", lambda x: x >= 0) & F.forall("weights", lambda x: x.between(0, 1))
    return _topics(spark, sf).terms.select("term", F.round(dealt, 4).alias("n"), valid.alias("valid"))


@query(f"WITH {KEPT} SELECT doc_id, count(*)::DOUBLE AS n, 1.0::DOUBLE AS total FROM kept GROUP BY 1")
def topics_by_document(spark, sf):
    """The same by document, learned in four batches; the shares of a document add up to one."""
    def total(name):
        return F.aggregate(name, F.lit(0.0), lambda a, x: a + x)
    return _topics(spark, sf, batches=4).documents.select(
        "doc_id", F.round(total("counts"), 4).alias("n"), F.round(total("shares"), 6).alias("total"))
