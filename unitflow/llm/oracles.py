"""SQL for DuckDB that gives the rows of queries which SQL can express."""

from __future__ import annotations

from unitflow.llm import quality_rules as rules
from unitflow.llm import secret_scan as secrets

_LISTS = "\n UNION ALL ".join(f"SELECT '{lang}' AS language, {k} AS k, '{w}' AS word" for lang, words in rules.COMMON_WORDS.items() for k, w in enumerate(words))
_LANGS = ", ".join(f"'{k}'" for k in rules.COMMON_WORDS)
_COUNT = lambda pattern: f"length(regexp_replace(text, '[^{pattern}]', '', 'g'))"

QUALITY_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, CASE WHEN lang IN ({_LANGS}) THEN lang ELSE 'other' END AS language FROM documents),
 w AS (SELECT rid, language, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
 tok AS (SELECT rid, language, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS i FROM w),
 win AS (SELECT rid, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS win FROM tok WINDOW o AS (PARTITION BY rid ORDER BY i)),
 twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM win WHERE win IS NOT NULL),
 repeats AS (SELECT rid, count(DISTINCT i + off) AS n_repeat_words FROM twice, (SELECT unnest(generate_series(0, 4)) AS off) WHERE n > 1 GROUP BY rid),
 lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
 dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
 base AS (SELECT d.rid, doc_id, d.language, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars, {_COUNT('#*$%&|<>')} AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN repeats USING (rid) LEFT JOIN dups USING (rid)),
 common AS ({_LISTS}),
 hits AS (SELECT rid, tok.language, k, count(*) AS c FROM tok JOIN common ON tok.language = common.language AND lower(tok.word) = common.word GROUP BY ALL),
 words AS (SELECT rid, language, k, c FROM hits UNION ALL SELECT rid, language, -1, n_words - coalesce((SELECT sum(c) FROM hits h WHERE h.rid = b.rid), 0) FROM base b),
 classes AS (SELECT rid, language, unnest([0, 1, 2, 3, 4, 5, 6]) AS k, unnest([{_COUNT('a-z')}, {_COUNT(chr(92) + 'x20' + chr(92) + 'x09-' + chr(92) + 'x0D')}, {_COUNT('A-Z')}, length(regexp_replace(regexp_replace(text, '[A-Za-z]', '', 'g'), '[^\pL]', '', 'g')),
   {_COUNT('0-9')}, length(regexp_replace(text, '[^.,;:''"?()-]', '', 'g')), length(regexp_replace(text, '[A-Za-z0-9\x20\x09-\x0D\pL.,;:''"?()-]', '', 'g'))]) AS c FROM d),
 both_kinds AS (SELECT 'class' AS kind, rid, language, k, c FROM classes UNION ALL SELECT 'word', rid, language, k, c FROM words),
 own AS (SELECT kind, rid, language, k, c / greatest(sum(c) OVER (PARTITION BY kind, rid), 1) AS p FROM both_kinds),
 refs AS (SELECT kind, language, k, sum(c) / greatest(sum(sum(c)) OVER (PARTITION BY kind, language), 1) AS q FROM both_kinds GROUP BY kind, language, k),
 pairs AS (SELECT r.kind, b.rid, coalesce(o.p, 0) AS p, r.q FROM base b JOIN refs r ON r.language = b.language LEFT JOIN own o ON o.kind = r.kind AND o.rid = b.rid AND o.k = r.k),
 dist AS (SELECT rid, kind, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS js FROM pairs GROUP BY rid, kind),
 js AS (SELECT rid, max(js) FILTER (kind = 'class') AS class_js, max(js) FILTER (kind = 'word') AS word_js FROM dist GROUP BY rid),
 sizes AS (SELECT language, sum(n_words) AS words FROM base GROUP BY language),
 judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base JOIN js USING (rid) JOIN sizes USING (language))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
 NOT base_failed AND (n_words < {rules.MIN_WORDS} OR words < {rules.MIN_REFERENCE_WORDS} OR class_js <= {rules.MAX_CLASS_DISTANCE}) AND (n_words < {rules.MIN_WORDS_FOR_WORDS} OR words < {rules.MIN_REFERENCE_WORDS} OR word_js <= {rules.MAX_WORD_DISTANCE}) AS kept
FROM judged
"""


def _spans(name: str, pattern: str, group: int, least: int, order: int) -> str:
    return rf"""SELECT rid, {order} AS ord, '{name}' AS kind, hit, start, start + length(hit) AS stop FROM (
   SELECT rid, unnest(hits) AS hit, unnest(parts) AS part, unnest(list_transform(generate_series(1, len(hits)), lambda i: (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0))::BIGINT)) AS start
   FROM (SELECT rid, regexp_extract_all(text, '{pattern}') AS hits, regexp_extract_all(text, '{pattern}', {group}) AS parts, string_split_regex(text, '{pattern}') AS gaps FROM d) WHERE len(hits) > 0) WHERE length(part) >= {least}"""


_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
SECRET_SCAN = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
 base AS ({_spans('assign', _ASSIGN, 1, 6, 0)} UNION ALL {_spans('access', 'AKIA[A-Z0-9]+', 0, 20, 1)} UNION ALL {_spans('hex', '[0-9a-f]+', 0, 24, 2)}),
 cand AS (SELECT row_number() OVER () AS cid, c.* FROM ({_spans('entropy', '[A-Za-z0-9+/_=-]+', 0, secrets.WINDOW, 3)}) c
  WHERE NOT regexp_matches(hit, '{secrets.ALLOWED.replace('++', '+').replace('*+', '*')}') AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = c.rid AND b.start <= c.start AND b.stop >= c.stop)),
 chars AS (SELECT cid, hit, i, substr(hit, i + j, 1) AS ch FROM (SELECT cid, hit, unnest(generate_series(1, length(hit) - {secrets.WINDOW - 1})) AS i FROM cand), (SELECT unnest(generate_series(0, {secrets.WINDOW - 1})) AS j)),
 counts AS (SELECT cid, hit, i, ch, count(*) AS n FROM chars GROUP BY ALL),
 bits AS (SELECT cid, hit, i, log2({secrets.WINDOW}) - sum(n * log2(n)) / {secrets.WINDOW} AS h FROM counts GROUP BY ALL),
 random AS (SELECT cid FROM bits GROUP BY cid, hit HAVING max(h) >= CASE WHEN regexp_matches(hit, '^[0-9a-fA-F]+$') THEN {secrets.HEX_BITS} ELSE {secrets.MIXED_BITS} END),
 spans AS (SELECT * FROM base UNION ALL SELECT rid, ord, kind, hit, start, stop FROM cand WHERE cid IN (SELECT cid FROM random)),
 joined AS (SELECT rid, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (kind <> 'entropy') AS base_spans,
   count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN joined USING (rid)
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LEXICAL_SEARCH = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS ts FROM documents WHERE text IS NOT NULL),
 q AS (SELECT row_number() OVER () AS qid, item_id, list_distinct(regexp_extract_all({_LOWER}, '{_TERM}')) AS ts FROM benchmark WHERE text IS NOT NULL),
 s AS (SELECT count(*) AS n, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0),
 tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ts) AS term FROM d) GROUP BY rid, term),
 w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, n),
 m AS (SELECT rid, doc_id, 10 + (90 * len(ts) * n) // l AS m FROM d, s WHERE len(ts) > 0),
 scores AS (SELECT qid, item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM (SELECT qid, item_id, unnest(ts) AS term FROM q) JOIN w USING (term) JOIN tf USING (term) JOIN m USING (rid) GROUP BY ALL)
SELECT item_id, (row_number() OVER o)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0 WINDOW o AS (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER o <= 10
"""

FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
 t AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS ts, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
 c AS (SELECT *, len(ts) AS n, least(h1 % (len(ts) + 1), h2 % (len(ts) + 1)) AS a, greatest(h1 % (len(ts) + 1), h2 % (len(ts) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
 p AS (SELECT *, array_to_string(ts[1:a], '') AS prefix, array_to_string(ts[a + 1:b], '') AS middle, array_to_string(ts[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN coalesce(length(prefix), 0) END AS prefix_chars, CASE WHEN form <> 'plain' THEN coalesce(length(middle), 0) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": QUALITY_RULES, "op10_secret_scan": SECRET_SCAN, "op11_lexical_search": LEXICAL_SEARCH, "op12_fill_in_middle": FILL_IN_MIDDLE}
