"""The English stemmer as SQL over a vocabulary: the independent check of the column expressions."""

from __future__ import annotations

from weftgrid.functions import stemming as fixed


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _case(subject: str, table: dict[str, str]) -> str:
    return f"CASE {subject} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _match(word: str, suffixes) -> str:
    return f"regexp_extract({word}, '({'|'.join(suffixes)})$')"


_V, _C = "[aeiouy]", "[^aeiouy]"
_SHORT = f"(?:{_C}{_V}[^aeiouywxY]|^{_V}{_C})$"


def stem_ctes(vocabulary: str) -> str:
    """CTEs ending in ``stems(token, stem)`` for a table expression with a column ``token``."""
    first = f"regexp_extract(w, '^(?:{'|'.join(fixed.R1_PREFIXES)}|.*?{_V}{_C})')"
    rest = f"regexp_extract(substr(w, p1 + 1), '^.*?{_V}{_C}')"
    two = "right(w, 2)"
    return f"""
    v0 AS (SELECT DISTINCT token, regexp_replace(regexp_replace(token, '^''', ''), '(^|{_V})y', '\\1Y', 'g') AS w FROM {vocabulary}),
    v1 AS (SELECT *, CASE WHEN {first} = '' THEN length(w) ELSE length({first}) END AS p1 FROM v0),
    v2 AS (SELECT *, CASE WHEN {rest} = '' THEN length(w) ELSE p1 + length({rest}) END AS p2 FROM v1),
    a0 AS (SELECT * REPLACE (regexp_replace(w, '(''s''|''s|'')$', '') AS w) FROM v2),
    a1 AS (SELECT * REPLACE (CASE
               WHEN w LIKE '%sses' THEN left(w, length(w) - 2)
               WHEN w LIKE '%ied' OR w LIKE '%ies' THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
               WHEN w LIKE '%us' OR w LIKE '%ss' THEN w
               WHEN regexp_matches(w, '{_V}.+s$') THEN left(w, length(w) - 1) ELSE w END AS w) FROM a0),
    b0 AS (SELECT *, w IN ({_listed(fixed.STOP_AFTER_1A)}) AS halt, {_match('w', ['eedly', 'ingly', 'edly', 'eed', 'ing', 'ed'])} AS suf FROM a1),
    b1 AS (SELECT *, left(w, length(w) - length(suf)) AS cut FROM b0),
    b2 AS (SELECT * REPLACE (CASE WHEN halt OR suf = '' THEN w
                 WHEN suf IN ('eed', 'eedly') THEN CASE WHEN length(cut) >= p1 THEN cut || 'ee' ELSE w END
                 WHEN regexp_matches(cut, '{_V}') THEN cut ELSE w END AS w),
                  NOT halt AND suf NOT IN ('', 'eed', 'eedly') AND regexp_matches(cut, '{_V}') AS mend FROM b1),
    b3 AS (SELECT * REPLACE (CASE WHEN NOT mend THEN w
                 WHEN {two} IN ('at', 'bl', 'iz') THEN w || 'e'
                 WHEN {two} IN ({_listed(fixed.DOUBLES)}) THEN left(w, length(w) - 1)
                 WHEN p1 >= length(w) AND regexp_matches(w, '{_SHORT}') THEN w || 'e' ELSE w END AS w) FROM b2),
    c1 AS (SELECT * REPLACE (CASE WHEN NOT halt AND regexp_matches(w, '.{_C}[yY]$') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w) FROM b3),
    d0 AS (SELECT * REPLACE ({_match('w', fixed.STEP2)} AS suf) FROM c1),
    d1 AS (SELECT * REPLACE (left(w, length(w) - length(suf)) AS cut) FROM d0),
    d2 AS (SELECT * REPLACE (CASE WHEN halt OR suf = '' OR length(cut) < p1 THEN w
                 WHEN suf = 'ogi' AND right(cut, 1) <> 'l' THEN w
                 WHEN suf = 'li' AND (cut = '' OR position(right(cut, 1) IN '{fixed.LI_ENDINGS}') = 0) THEN w
                 ELSE cut || {_case('suf', fixed.STEP2)} END AS w) FROM d1),
    e0 AS (SELECT * REPLACE ({_match('w', fixed.STEP3)} AS suf) FROM d2),
    e1 AS (SELECT * REPLACE (left(w, length(w) - length(suf)) AS cut) FROM e0),
    e2 AS (SELECT * REPLACE (CASE WHEN halt OR suf = '' OR length(cut) < p1 OR (suf = 'ative' AND length(cut) < p2) THEN w
                 ELSE cut || {_case('suf', fixed.STEP3)} END AS w) FROM e1),
    f0 AS (SELECT * REPLACE ({_match('w', fixed.STEP4)} AS suf) FROM e2),
    f1 AS (SELECT * REPLACE (left(w, length(w) - length(suf)) AS cut) FROM f0),
    f2 AS (SELECT * REPLACE (CASE WHEN halt OR suf = '' OR length(cut) < p2 THEN w
                 WHEN suf = 'ion' AND right(cut, 1) NOT IN ('s', 't') THEN w ELSE cut END AS w) FROM f1),
    g0 AS (SELECT * REPLACE (left(w, length(w) - 1) AS cut) FROM f2),
    g1 AS (SELECT * REPLACE (CASE WHEN halt THEN w
                 WHEN w LIKE '%e' AND (length(cut) >= p2 OR (length(cut) >= p1 AND NOT regexp_matches(cut, '{_SHORT}'))) THEN cut
                 WHEN w LIKE '%ll' AND length(cut) >= p2 THEN cut ELSE w END AS w) FROM g0),
    stems AS (SELECT token, CASE WHEN length(token) <= 2 THEN token
                  ELSE coalesce({_case('token', fixed.SPECIAL)}, lower(w)) END AS stem FROM g1)"""
