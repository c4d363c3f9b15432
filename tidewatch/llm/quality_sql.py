"""The quality rules as SQL that DuckDB runs (distinct doc_ids)."""

from __future__ import annotations

from .quality_rules import COMMON_WORDS, Rules

RULES = Rules()
LISTS = " UNION ALL ".join(f"SELECT '{lang}' AS lang, '{w}' AS w, {k} AS b" for lang, words in COMMON_WORDS.items() for k, w in enumerate(words))
BINS = len(next(iter(COMMON_WORDS.values())))
LANGS = ", ".join(f"'{x}'" for x in COMMON_WORDS)
#: Character classes by bin; what no class takes is the last bin.
CLASSES = ["a-z", r"\x{DF}-\x{F6}\x{F8}-\x{FF}", r"A-Z\x{C0}-\x{D6}\x{D8}-\x{DE}", "0-9", r"\x20\x09-\x0D", ".,;:?''\"()-"]
TAKEN = [f"length(regexp_replace(t, '[^{c}]', '', 'g'))" for c in CLASSES]
CHARS = " UNION ALL ".join([*(f"SELECT doc_id, lang, {k} AS b, {x} AS n FROM d" for k, x in enumerate(TAKEN)), f"SELECT doc_id, lang, {len(TAKEN)}, length(t) - ({' + '.join(TAKEN)}) FROM d"])


def _distance(name: str) -> str:
    return f"""{name}_p AS (SELECT doc_id, lang, b, n * 1.0 / nullif(sum(n) OVER (PARTITION BY doc_id), 0) AS p FROM {name}),
 {name}_q AS (SELECT {name}_p.lang AS lang, b, avg(p) AS q FROM {name}_p JOIN c USING (doc_id) WHERE NOT c.base_failed GROUP BY 1, 2),
 {name}_d AS (SELECT doc_id, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS dist
   FROM {name}_p JOIN {name}_q USING (lang, b) JOIN big USING (lang) WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY doc_id)"""


SQL = f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
 w0 AS (SELECT doc_id, lang, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
 w AS (SELECT doc_id, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w0),
 tri AS (SELECT doc_id, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS x FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
 rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM tri WHERE x IS NOT NULL) WHERE c > 1),
 cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(3)) AS k) GROUP BY doc_id),
 ln AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
 c0 AS (SELECT d.doc_id, d.lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
   CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
   FROM d JOIN w0 USING (doc_id) JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
 c AS (SELECT *, n_words < {RULES.min_words} OR 100 * n_repeat_words > {RULES.max_repeat_percent} * n_words AS base_failed FROM c0),
 big AS (SELECT lang FROM c WHERE NOT base_failed GROUP BY lang HAVING count(*) >= {RULES.min_reference_docs}),
 chars AS ({CHARS}),
 lists AS ({LISTS}),
 hits AS (SELECT w.doc_id, lists.b, count(*) AS n FROM w JOIN lists ON w.lang = lists.lang AND lower(w.w) = lists.w GROUP BY 1, 2),
 common AS (SELECT c.doc_id, c.lang, s.b, coalesce(hits.n, 0) AS n FROM c JOIN (SELECT unnest(range({BINS})) AS b) s ON true LEFT JOIN hits ON hits.doc_id = c.doc_id AND hits.b = s.b WHERE c.lang IN ({LANGS})
   UNION ALL SELECT c.doc_id, c.lang, {BINS}, c.n_words - coalesce((SELECT sum(n) FROM hits WHERE hits.doc_id = c.doc_id), 0) FROM c WHERE c.lang IN ({LANGS})),
 {_distance("chars")},
 {_distance("common")},
 reach AS (SELECT lang, {RULES.word_limit} * sqrt(sum(CASE WHEN b = {BINS} THEN log2(2 / (1 + q)) + q * log2(2 * q / (1 + q)) WHEN q > 0 THEN q ELSE 0 END) / 2) AS lim FROM common_q GROUP BY lang),
 v AS (SELECT c.*, coalesce(word_chars >= {RULES.min_chars} AND chars_d.dist > {RULES.char_limit}, false) OR coalesce(n_words >= {RULES.min_hist_words} AND common_d.dist > reach.lim, false) AS far
   FROM c LEFT JOIN chars_d ON chars_d.doc_id = c.doc_id LEFT JOIN common_d ON common_d.doc_id = c.doc_id LEFT JOIN reach ON reach.lang = c.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT far AS kept FROM v"""
