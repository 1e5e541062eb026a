"""DuckDB statements that return the same rows as the queries of this subpackage."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NORMAL_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION_SQL = f"""
WITH item AS (
    SELECT CAST(item_id AS VARCHAR) AS item, {_NORMAL_WORDS.format("coalesce(text, '')")} AS w FROM benchmark
), sized AS (
    SELECT item, w, least(len(w), 13) AS k FROM item WHERE len(w) > 0
), win AS (
    SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g
    FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)
), doc AS (
    SELECT row_number() OVER () AS r, doc_id, {_NORMAL_WORDS.format("coalesce(text, '')")} AS w FROM documents
), gram AS (
    SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
    FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)
), hit AS (
    SELECT r, i, k, item FROM gram JOIN win USING (k, g)
), words AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM hit)) GROUP BY r
), named AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""

_PHRASES = (
    "all rights reserved|licensed under|released under|public license|terms of (use|service)|privacy policy|"
    "cookie|copyright|sign (in|up)|log ?in|subscribe|newsletter|javascript|click here|read more")

LINE_RULES_SQL = rf"""
WITH doc AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
           [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w,
           string_split(coalesce(text, ''), chr(10)) AS lines
    FROM documents
), gram AS (
    SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM doc)
), covered AS (
    SELECT r, count(DISTINCT p) AS n_repeat_words
    FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM gram) WHERE n > 1)
    GROUP BY r
), line AS (
    SELECT r, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n, len(regexp_extract_all(x, '[#*$%&|<>]')) AS symbols,
           len(regexp_extract_all(x, '[!?]{{2}}')) AS shouts, len(regexp_extract_all(x, '[|»›•·>]')) AS marks,
           length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS chars
    FROM (SELECT r, unnest(lines) AS x FROM doc)
), clean AS (
    SELECT r, coalesce(sum(chars) FILTER (WHERE NOT (n > 0 AND (
               (n >= 40 AND NOT regexp_matches(x, '[.!?…。]')) OR symbols >= n OR shouts * 3 >= n
               OR (marks >= 3 AND marks * 4 >= n) OR (n <= 25 AND regexp_matches(lower(x), '{_PHRASES}'))))), 0) AS clean_word_chars,
           count(*) FILTER (WHERE n > 0) - count(DISTINCT x) FILTER (WHERE n > 0) AS n_dup_lines
    FROM line GROUP BY r
), counted AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
           CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
           CAST(clean_word_chars AS BIGINT) AS clean_word_chars
    FROM doc LEFT JOIN covered USING (r) LEFT JOIN clean USING (r)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 2 * clean_word_chars >= word_chars AS kept
FROM counted
"""

LINE_SPREAD_SQL = r"""
WITH doc AS (
    SELECT row_number() OVER () AS r, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
    SELECT r, source, i, lines[i] AS x, length(regexp_replace(lines[i], '[\x20\x09-\x0D]+', '', 'g')) > 0 AS worded
    FROM (SELECT r, source, lines, unnest(range(1, len(lines) + 1)) AS i FROM doc)
), spread AS (
    SELECT x FROM line WHERE worded GROUP BY x
    HAVING count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) >= 10
), judged AS (
    SELECT r, i, x, worded, worded AND x IN (SELECT x FROM spread) AS gone FROM line
)
SELECT doc_id, count(*) FILTER (WHERE worded) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged JOIN doc USING (r) GROUP BY r, doc_id
"""

# Targets: sources in order of how soon their cap is reached; those before the first that is not are full.
# Each source's documents, in the order of a hash, are taken up to its target, and once more from the start where it is above the size.
MIXING_SQL = r"""
WITH doc AS (
    SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           md5('11|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS k
    FROM documents
), src AS (
    SELECT source, sum(size) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
    FROM doc GROUP BY source
), filling AS (
    SELECT *, 1.5::DOUBLE * sum(n) OVER () - coalesce(sum(2 * n) OVER before, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS weight
    FROM src WINDOW before AS (ORDER BY CAST(n AS DOUBLE) / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), open AS (
    SELECT *, w * rest / weight > 2 * n AS full_ FROM filling
), shared AS (
    SELECT 1.5::DOUBLE * (SELECT sum(n) FROM src) - coalesce(sum(2 * n) FILTER (WHERE full_), 0) AS rest, sum(w) FILTER (WHERE NOT full_) AS weight FROM open
), goal AS (
    SELECT source, no, CAST(n AS BIGINT) AS n, CASE WHEN full_ THEN CAST(2 * n AS DOUBLE) ELSE w * shared.rest / shared.weight END AS target
    FROM open, shared
), placed AS (
    SELECT doc_id, size, goal.n AS source_size, target, no,
           coalesce(sum(size) OVER (PARTITION BY no ORDER BY k, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
    FROM doc JOIN goal ON doc.source IS NOT DISTINCT FROM goal.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(least(size, greatest(0, ceil(target) - a)) + least(size, greatest(0, ceil(target) - source_size - a)) AS BIGINT) AS taken
FROM placed
"""

AUDIT_SQL = r"""
WITH doc AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
           [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w
    FROM documents
), failed AS (
    SELECT part, doc_id, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
           + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
           + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
           + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS f
    FROM doc
), label AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), mask AS (
    SELECT part, f, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
    FROM failed LEFT JOIN label USING (doc_id) GROUP BY part, f
), letter AS (
    SELECT chr(CAST(65 + i AS INTEGER)) AS c, CAST(1 << i AS BIGINT) AS bit FROM (SELECT unnest(range(5)) AS i)
), perm AS (
    SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letter a JOIN letter b ON b.c <> a.c JOIN letter c ON c.c NOT IN (a.c, b.c) JOIN letter d ON d.c NOT IN (a.c, b.c, c.c)
         JOIN letter e ON e.c NOT IN (a.c, b.c, c.c, d.c)
), step AS (
    SELECT filter_order, CAST(i AS INTEGER) AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0) AS before
    FROM (SELECT *, unnest(range(1, 6)) AS i FROM perm)
), counted AS (
    SELECT part, filter_order, step, bit,
           coalesce(sum(n) FILTER (WHERE f & CAST(before + bit AS BIGINT) = 0), 0) AS kept,
           coalesce(sum(n) FILTER (WHERE f & CAST(before AS BIGINT) = 0 AND f & bit <> 0), 0) AS removed,
           coalesce(sum(n) FILTER (WHERE f & CAST(before AS BIGINT) <> 0 AND f & bit <> 0), 0) AS redundant,
           coalesce(sum(n) FILTER (WHERE f = bit), 0) AS unique_fails,
           coalesce(sum(good) FILTER (WHERE f & CAST(before AS BIGINT) = 0 AND f & bit <> 0), 0) AS good_lost,
           coalesce(sum(toxic) FILTER (WHERE f & CAST(before AS BIGINT) = 0 AND f & bit <> 0), 0) AS toxic_lost
    FROM mask CROSS JOIN step GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""

COLLOCATIONS_SQL = r"""
WITH doc AS (
    SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
), piece AS (
    SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM doc)
), total AS (
    SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM piece GROUP BY lang
), gram AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM piece, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k)
), f AS (
    SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS a FROM gram GROUP BY lang, k, phrase HAVING count(*) >= 30
), cut AS (
    SELECT lang, k, phrase, a, c, array_to_string(w[1:c], ' ') AS first_part, array_to_string(w[c + 1:k], ' ') AS rest
    FROM (SELECT *, unnest(range(1, k)) AS c FROM f WHERE k > 1)
), scored AS (
    SELECT cut.lang, cut.k, cut.phrase, cut.a, x.a AS l, y.a AS r, CAST(CAST(2000000 AS HUGEINT) * cut.a // (x.a + y.a) AS BIGINT) AS score, c
    FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.first_part JOIN f y ON y.lang = cut.lang AND y.phrase = cut.rest
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), inside AS (
    SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longest
    FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM f WHERE k > 2)) GROUP BY ALL
), kept AS (
    SELECT lowest.* FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 80 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
