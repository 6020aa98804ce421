"""DuckDB SQL for the queries that SQL can express, written from the definitions."""

from __future__ import annotations

from haulmark.llm import licenses
from haulmark.llm.queries import URL_RULES

_WORD = r"[^\x20\x09-\x0D]+"

SOURCE_MIX = rf"""
WITH RECURSIVE items AS (
  SELECT doc_id, source, text,
    coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size,
    coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0) AS symbols
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM items GROUP BY source),
weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
    [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM sizes),
levels AS (  -- each source's level if it were the first uncapped one; the largest holds
  SELECT a.source, (1.5::DOUBLE * (SELECT sum(source_size) FROM weighed)
     - coalesce(sum(b.cap) FILTER (b.cap / b.w < a.cap / a.w), 0))
    / sum(b.w) FILTER (b.cap / b.w >= a.cap / a.w) AS level
  FROM weighed a, weighed b GROUP BY a.source, a.cap, a.w),
targets AS (
  SELECT source, source_size, least(cap, w * (SELECT max(level) FROM levels)) AS target
  FROM weighed),
keyed AS (
  SELECT i.*, t.source_size, t.target, round(t.target)::BIGINT AS goal,
    -ln((('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5)
        / (1::BIGINT << 52)) / greatest((size + 1.0) / (size + 1.0 + symbols), 0.001) AS key
  FROM items i JOIN targets t ON i.source IS NOT DISTINCT FROM t.source),
placed AS (
  SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM keyed)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (epochs * size + least(greatest(goal - epochs * source_size - before, 0), size))::BIGINT AS taken
FROM placed
"""

QUALITY_RULES = rf"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    coalesce(regexp_extract_all(text, '{_WORD}'), []) AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS five
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
often AS (SELECT doc_id, five FROM windows GROUP BY ALL HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM windows JOIN often USING (doc_id, five), (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
measured AS (
  SELECT d.doc_id, d.source, len(w)::BIGINT AS n_words,
    length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(d.text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM words d LEFT JOIN lines l USING (doc_id) LEFT JOIN covered c USING (doc_id)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured),
hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k FROM judged GROUP BY source),
moments AS (
  SELECT coalesce(avg(k / n), 0) AS mean, coalesce(var_samp(k / n), 0) AS spread
  FROM hosts WHERE k / n <= 0.5),
prior AS (
  SELECT mean, CASE WHEN spread > 0 AND spread < mean * (1 - mean)
    THEN least(greatest(mean * (1 - mean) / spread - 1, 1.0), 100.0) ELSE 1.0 END AS strength
  FROM moments),
rates AS (SELECT source, n + strength AS weight, (k + mean * strength) / (n + strength) AS rate
  FROM hosts, prior),
bad AS (
  SELECT source FROM rates WHERE rate - 3.0 * sqrt(rate * (1 - rate) / (weight + 1)) > 0.5)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (
    SELECT 1 FROM bad b WHERE b.source IS NOT DISTINCT FROM j.source) AS kept
FROM judged j
"""


def _values(rows: list[tuple]) -> str:
    quoted = [", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) for row in rows]
    return "VALUES " + ", ".join(f"({row})" for row in quoted)


_PHRASES = _values([(label, phrase, len(phrase.split())) for label, phrase in licenses.PHRASES])
_POSTINGS = _values([(p.template, p.word, p.position, p.weight) for p in licenses.postings()])
_TEMPLATES = _values([(i, t[0], t[2], len(t[2].split()), licenses.key_offset(t))
                      for i, t in enumerate(licenses.TEMPLATES)])

LICENSE_SCAN = rf"""
WITH phrases(label, phrase, n) AS ({_PHRASES}),
postings(template, word, position, weight) AS ({_POSTINGS}),
templates(template, label, phrase, n, place) AS ({_TEMPLATES}),
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (
  SELECT doc_id, i, w[i + 1] AS word, w
  FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM words)),
base AS (
  SELECT doc_id, label, i FROM places JOIN phrases ON array_to_string(w[i + 1:i + n], ' ') = phrase
  WHERE word IN ('under', 'apache', 'cc')),
based AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
    list_sort(list_distinct(list(label))) AS labels FROM base GROUP BY doc_id),
placed AS (
  SELECT doc_id, any_value(w) AS w, template, i - position AS origin, sum(weight) AS weight
  FROM places JOIN postings USING (word) GROUP BY doc_id, template, i - position),
verified AS (
  SELECT doc_id, list(label) AS labels, max(least(weight, 1.0)) AS score
  FROM placed JOIN templates USING (template)
  WHERE weight >= {licenses.SHARE} - 1e-6 AND origin + place >= 0
    AND array_to_string(w[origin + place + 1:origin + place + n], ' ') = phrase GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
  first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(b.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(
    coalesce(b.labels, []), coalesce(v.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE round(coalesce(score, 0.0), 6) END::DOUBLE AS score
FROM words w LEFT JOIN based b USING (doc_id) LEFT JOIN verified v USING (doc_id)
"""

URL_SCAN = rf"""
WITH rules(verdict, host, path) AS ({_values(URL_RULES)}),
cut AS (
  SELECT page_id, CASE WHEN contains(url, '://')
    THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut),
fits AS (
  SELECT page_id, arg_max(struct_pack(rule := r.host || r.path, verdict := r.verdict),
    length(r.host || r.path)) AS best
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host))
    AND starts_with(p.path, r.path) GROUP BY page_id)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits USING (page_id)
"""

FILTER_AUDIT = rf"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    coalesce(regexp_extract_all(text, '{_WORD}'), []) AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id FROM words GROUP BY text),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
failed AS (
  SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x
      WHEN 'A' THEN len(w) < 200
      WHEN 'B' THEN 100 * len(list_distinct(w)) < 50 * len(w)
      WHEN 'C' THEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text)
      WHEN 'D' THEN regexp_matches(text, '[#$%&*|]')
      ELSE coalesce(doc_id > first_id, false) END) AS fails,
    (doc_id IN (SELECT doc_id FROM good))::INT AS good,
    (doc_id IN (SELECT doc_id FROM toxic))::INT AS toxic
  FROM words JOIN firsts USING (text)),
counted AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[:step - 1] AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
judged AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails, list_contains(fails, f) AS fails_here,
    len(list_filter(fails, lambda x: contains(before, x))) > 0 AS gone
  FROM counted, steps),
counts AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN NOT gone AND NOT fails_here THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN NOT gone AND fails_here THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN gone AND fails_here THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = [f] THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN NOT gone AND fails_here THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN NOT gone AND fails_here THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost,
  toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counts
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS t, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS w
  FROM documents),
places AS (
  SELECT t, pos, w[pos + 1] AS term FROM (SELECT t, w, unnest(range(len(w))) AS pos FROM texts)),
counts AS (SELECT term, count(*) AS n FROM places GROUP BY term),
items AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all({_LOWER}, '{_TERM}') AS w
  FROM benchmark),
windows AS (
  SELECT item, w[s:s + 9] AS words
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM items WHERE len(w) > 0)),
terms AS (
  SELECT words, len(words) AS n, place, words[place + 1] AS term
  FROM (SELECT words, unnest(range(len(words))) AS place FROM (SELECT DISTINCT words FROM windows))),
ranked AS (
  SELECT words, t.n, place, term, count(*) OVER (PARTITION BY words) AS held,
    row_number() OVER (PARTITION BY words ORDER BY c.n, place) AS k
  FROM terms t JOIN counts c USING (term)),
anchors AS (SELECT * FROM ranked WHERE k <= 2 AND held >= ceil(0.8::DOUBLE * n)),
seeds AS (
  SELECT words, n, t, pos - place AS start FROM anchors JOIN places USING (term) WHERE k = 1),
beside AS (  -- the least distance of each other anchor
  SELECT s.words, s.t, s.start, a.k, min(abs(p.pos - a.place - s.start)) AS off
  FROM seeds s JOIN anchors a ON a.words = s.words AND a.k > 1
    JOIN places p ON p.t = s.t AND p.term = a.term AND abs(p.pos - a.place - s.start) <= 3
  GROUP BY ALL),
candidates AS (
  SELECT s.words, s.n, s.t, s.start FROM seeds s LEFT JOIN beside b USING (words, t, start)
  GROUP BY s.words, s.n, s.t, s.start
  HAVING count(b.k) = (SELECT count(*) FROM anchors a WHERE a.words = s.words) - 1),
placed AS (
  SELECT c.words, c.n, c.t, c.start, count(DISTINCT x.place) AS near,
    count(DISTINCT x.place) FILTER (p.pos = c.start + x.place) AS same
  FROM candidates c JOIN terms x ON x.words = c.words
    JOIN places p ON p.t = c.t AND p.term = x.term AND abs(p.pos - x.place - c.start) <= 3
  GROUP BY ALL),
matched AS (
  SELECT words, n, t, start, same = n AS exact FROM placed
  WHERE same = n OR near >= ceil(0.8::DOUBLE * n)),
hits AS (
  SELECT t, count(DISTINCT pos) AS n_hit
  FROM (SELECT t, unnest(range(start, start + n)) AS pos FROM matched WHERE exact) GROUP BY t),
named AS (
  SELECT t, item, bool_or(exact) AS exact FROM matched JOIN windows USING (words) GROUP BY t, item),
lists AS (
  SELECT t, count(*) FILTER (exact) AS n_items, count(*) FILTER (NOT exact) AS n_near_items,
    coalesce(string_agg(item, ',' ORDER BY item) FILTER (exact), '') AS items
  FROM named GROUP BY t)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0)::BIGINT AS n_near_items
FROM texts LEFT JOIN hits USING (t) LEFT JOIN lists USING (t)
"""

ORACLES: dict[str, str] = {
    "op13_decontamination": DECONTAMINATION,
    "op11_filter_audit": FILTER_AUDIT,
    "op1_source_mix": SOURCE_MIX, "op4_quality_rules": QUALITY_RULES,
    "op8_license_scan": LICENSE_SCAN, "op9_url_rules": URL_SCAN,
}
