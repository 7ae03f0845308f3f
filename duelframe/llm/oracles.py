"""DuckDB SQL with the rows of those queries that SQL can express."""

from __future__ import annotations

from .quality import COMMON_WORDS, MAX_BOTH, MAX_CLASS_DISTANCE, MAX_COMMON_DISTANCE, MAX_REPEATED_PERCENT, MIN_CHARS_FOR_CLASSES, MIN_WORDS, MIN_WORDS_FOR_COMMON

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: Payload digests in base 32: 32 groups of five bits, each from two hexadecimal digits.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, h, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (((instr('0123456789abcdef', substr(x, CAST(i * 5 // 4 + 1 AS BIGINT), 1)) - 1) * 16 + greatest(instr('0123456789abcdef', substr(x, CAST(i * 5 // 4 + 2 AS BIGINT), 1)) - 1, 0)) // CAST(pow(2, 3 - i * 5 % 4) AS BIGINT)) % 32 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM s
"""

NEAR_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
c AS (SELECT list_sort(s) AS s, min(doc_id) AS a, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY 1, 3),
x AS (SELECT a, n, unnest(s) AS k FROM c),
l AS (SELECT p.a AS a, q.a AS b FROM x p JOIN x q ON p.k = q.k AND p.a < q.a GROUP BY p.a, q.a, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, a FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS component FROM r GROUP BY a)
SELECT doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM s LEFT JOIN c ON list_sort(s.s) = c.s LEFT JOIN m ON m.a = c.a
"""

_CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "space": r"[\x20\x09-\x0D]", "mark": r"[.,;:!?''\"()\-]", "symbol": "[#*$%&|<>]", "control": r"[\x00-\x08\x0E-\x1F+/=@\\^_`\[\]{}~\x7F]", "wide": r"[^\x00-\x7F]"}
_NAMES = ("lower", *_CLASSES)


def _lists() -> str:
    return " ".join(f"WHEN '{k}' THEN [{', '.join(chr(39) + w + chr(39) for w in v)}]" for k, v in COMMON_WORDS.items())


def _distance(p: str, q: str) -> str:
    return f"sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: CASE WHEN ({p})[i] > 0 THEN ({p})[i] * log2(({p})[i] / ((({p})[i] + ({q})[i]) / 2)) ELSE 0 END + CASE WHEN ({q})[i] > 0 THEN ({q})[i] * log2(({q})[i] / ((({p})[i] + ({q})[i]) / 2)) ELSE 0 END)) / 2))"


_TO_SHARES = "list_transform({0}, lambda v: v::DOUBLE / greatest({1}, 1))"
QUALITY_SQL = f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w, CASE lang {_lists()} ELSE [] END AS cw FROM documents),
k AS (SELECT doc_id, lang, len(w) AS n_words, length(t) AS chars, {', '.join(f"length(t) - length(regexp_replace(t, '{p}', '', 'g')) AS {c}" for c, p in _CLASSES.items())},
  list_transform(cw, lambda x: len(list_filter(w, lambda y: lower(y) = x))) AS common,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines, w FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM k WHERE len(w) >= 8)),
h AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM g) WHERE c > 1),
rp AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8))) AS r FROM h GROUP BY doc_id),
f AS (SELECT k.doc_id, lang, n_words, chars - space AS word_chars, symbol AS n_symbols, n_dup_lines, coalesce(r, 0) AS n_repeat_words, chars, [chars - upper - digit - space - mark - symbol - control - wide, upper, digit, space, mark, symbol, control, wide] AS cl, common FROM k LEFT JOIN rp ON k.doc_id = rp.doc_id),
rc AS (SELECT lang, list(v ORDER BY i) AS rc FROM (SELECT lang, i, sum(cl[i]) AS v FROM f, (SELECT unnest(range(1, 9)) AS i) GROUP BY lang, i) GROUP BY lang),
rw AS (SELECT lang, list(v ORDER BY i) AS rw, max(nw) AS nw FROM (SELECT lang, i, sum(common[i]) AS v, sum(n_words) AS nw FROM f, (SELECT unnest(range(1, 100)) AS i) WHERE i <= len(common) GROUP BY lang, i) GROUP BY lang),
j0 AS (SELECT f.*, {_TO_SHARES.format('cl', 'chars')} AS p1, {_TO_SHARES.format('rc', 'list_sum(rc)')} AS q1, {_TO_SHARES.format('list_append(common, n_words - list_sum(common))', 'n_words')} AS p2, {_TO_SHARES.format('list_append(rw, nw - list_sum(rw))', 'nw')} AS q2, rw IS NOT NULL AS listed FROM f LEFT JOIN rc ON f.lang IS NOT DISTINCT FROM rc.lang LEFT JOIN rw ON f.lang = rw.lang),
j AS (SELECT *, CASE WHEN chars >= {MIN_CHARS_FOR_CLASSES} THEN {_distance('p1', 'q1')} END AS a, CASE WHEN listed AND n_words >= {MIN_WORDS_FOR_COMMON} THEN {_distance('p2', 'q2')} END AS b FROM j0),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM j)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(a <= {MAX_CLASS_DISTANCE}, true) AND coalesce(b <= {MAX_COMMON_DISTANCE}, true) AND NOT coalesce(n_words >= {MAX_BOTH[0]} AND a > {MAX_BOTH[1]} AND b > {MAX_BOTH[2]}, false) AS kept FROM v
"""
