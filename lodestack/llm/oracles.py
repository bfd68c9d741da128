"""SQL for DuckDB that gives the rows of those operators' queries that SQL can express."""

from __future__ import annotations

from lodestack.llm import quality, substrings

_LISTS = ", ".join(f"('{lang}', '{w}', {k})" for lang, ws in quality.COMMON_WORDS.items() for k, w in enumerate(ws))
_KNOWN = ", ".join(f"'{lang}'" for lang in quality.COMMON_WORDS)


def _distance(bins: str, ref: str) -> str:
    """Jensen-Shannon distances by row: bins(r, ref, k, x) against ref(ref, k, y)."""
    return f"""SELECT r, sqrt(greatest(sum(0.5E0 * (CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)), 0)) AS jsd FROM (
 SELECT b.r, b.x / CAST(sum(b.x) OVER (PARTITION BY b.r) AS DOUBLE) AS p, f.y / CAST(sum(f.y) OVER (PARTITION BY b.r) AS DOUBLE) AS q FROM {bins} b JOIN {ref} f USING (ref, k)) GROUP BY r"""


OP3 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, CASE WHEN lang IN ({_KNOWN}) THEN lang ELSE '{quality.OTHER}' END AS ref, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT r, ref, unnest(words) AS w, unnest(range(len(words))) AS i FROM d),
win AS (SELECT r, i, w, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, unnest([i, i + 1, i + 2]) AS pos FROM (SELECT *, count(*) OVER (PARTITION BY r, w, w1, w2) AS c FROM win WHERE w2 IS NOT NULL) WHERE c > 1),
repeats AS (SELECT r, count(DISTINCT pos) AS n FROM rep GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
s AS (SELECT *, regexp_replace(text, '\p{{L}}+', '', 'g') AS signs, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS upper, length(text) AS n_chars FROM d),
f AS (SELECT s.r, doc_id, ref, n_chars, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(signs, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
 n_chars - length(signs) - upper AS lower, upper, length(regexp_replace(signs, '[^0-9]+', '', 'g')) AS digit, length(regexp_replace(signs, '[^\x20\x09-\x0D]+', '', 'g')) AS space, length(regexp_replace(signs, '[^.,;:!?''"()-]+', '', 'g')) AS punct FROM s LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
good AS (SELECT r FROM g WHERE NOT base_failed AND 10 * n_symbols < n_words),
cls AS (SELECT r, ref, unnest(range(7)) AS k, unnest([lower, upper, digit, space, punct, n_symbols, n_chars - lower - upper - digit - space - punct - n_symbols]) AS x FROM g),
lists AS (SELECT * FROM (VALUES {_LISTS}) t(lang, word, k)),
hits AS (SELECT p.r, l.k, count(*) AS x FROM p JOIN lists l ON l.lang = p.ref AND l.word = lower(p.w) GROUP BY p.r, l.k),
slots AS (SELECT g.r, g.ref, l.k FROM g JOIN lists l ON l.lang = g.ref),
named AS (SELECT slots.r, slots.ref, slots.k, coalesce(x, 0) AS x FROM slots LEFT JOIN hits USING (r, k)),
wrd AS (SELECT * FROM named UNION ALL SELECT g.r, g.ref, 99, g.n_words - coalesce((SELECT sum(x) FROM named WHERE named.r = g.r), 0) FROM g),
cref AS (SELECT ref, k, sum(x) AS y FROM cls SEMI JOIN good USING (r) GROUP BY ref, k),
wref AS (SELECT ref, k, sum(x) AS y FROM wrd SEMI JOIN good USING (r) GROUP BY ref, k),
cd AS ({_distance('cls', 'cref')}), wd AS ({_distance('wrd', 'wref')}),
j AS (SELECT g.*, CASE WHEN n_chars >= {quality.MIN_CHARS} THEN cd.jsd END AS class_jsd, CASE WHEN n_words >= {quality.MIN_WORDS} THEN wd.jsd END AS word_jsd FROM g LEFT JOIN cd USING (r) LEFT JOIN wd USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(class_jsd, 0) <= {quality.MAX_CLASS_JSD} AND coalesce(word_jsd, 0) <= {quality.MAX_WORD_JSD} AS kept, round(class_jsd, 6) AS class_jsd, round(word_jsd, 6) AS word_jsd FROM j"""

_L = substrings.LENGTH
OP10 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, p, substr(h, 2 * p + 1, {2 * _L}) AS s FROM (SELECT *, unnest(range(greatest(length(h) // 2 - {_L - 1}, 0))) AS p FROM d)),
m AS (SELECT s, min(doc_id) AS f FROM w GROUP BY s),
hit AS (SELECT w.r, w.p FROM w JOIN m USING (s) WHERE m.f < coalesce(w.doc_id, 9223372036854775807)),
g AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + {_L} THEN 0 ELSE 1 END AS new FROM hit),
i AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS island FROM g),
runs AS (SELECT r, island, min(p) AS a, max(p) + {_L} AS b FROM i GROUP BY r, island),
k AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM runs),
c AS (SELECT k.r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS tail FROM k JOIN d USING (r) GROUP BY k.r)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN c.r IS NULL THEN h ELSE head || substr(h, 2 * tail + 1) END)) AS kept_sha256 FROM d LEFT JOIN c USING (r)"""
