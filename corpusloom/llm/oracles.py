"""DuckDB twins of those queries that SQL can express on whole tables."""

from __future__ import annotations

from .url_filter import JUNK_WORDS, SITE_RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_EXACT = f"""
WITH n AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""


def _url_sql() -> str:
    rules = ", ".join(
        "('{}', '{}', '{}', '{}')".format(v, t, *(t.partition("/")[0], t[t.index("/"):])) for v, t in (line.split() for line in SITE_RULES)
    )
    junk = "|".join("[-._/]".join(w.split()) for w in JUNK_WORDS)
    return f"""
WITH rules(verdict, rule, rule_host, rule_path) AS (VALUES {rules}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
f AS (SELECT s.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rule) DESC) AS k
      FROM s JOIN rules r ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path))
SELECT s.page_id, s.host, s.path, f.rule,
  coalesce(f.verdict, CASE WHEN regexp_matches({_LOWER.format("s.host || s.path")}, '(^|[^a-z0-9])({junk})($|[^a-z0-9])') THEN 'block' ELSE 'allow' END) AS verdict
FROM s LEFT JOIN f ON f.page_id = s.page_id AND f.k = 1
"""


_WORDS = r"[^\x20\x09-\x0D]+"
_QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORDS}') AS words FROM d),
x AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT doc_id, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS gram FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g WHERE gram IS NOT NULL) WHERE n > 1),
covered AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, i + k.k AS at FROM twice, (VALUES (0), (1), (2)) k(k)) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) AS n_lines
          FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORDS}') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters,
        length(regexp_replace(t, '[^!]', '', 'g')) AS n_marks
      FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 100 * n_dup_lines > 40 * n_lines
       OR (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words))
       OR (n_letters > 0 AND 100 * n_upper > 60 * n_letters) OR 10 * n_marks > 3 * n_words) AS kept, 'clean-1' AS policy, 1 AS rules_version
FROM b
"""

_RESAMPLE = rf"""
WITH tables AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
sides AS (SELECT true AS own, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT false, NULL, coalesce(text, '') FROM benchmark),
texts AS (SELECT own, doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM sides),
words AS (SELECT own, doc_id, unnest(words) AS w FROM texts),
named AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words)),
hashed AS (
  SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h), 2), lambda i: ('0x' || substr(h, i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS b FROM named, tables),
counts AS (SELECT b, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM words JOIN hashed USING (w) GROUP BY b),
sums AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM counts),
gains AS (SELECT b, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS g FROM counts, sums),
weights AS (SELECT doc_id, sum(g)::BIGINT AS total, count(*) AS n FROM words JOIN hashed USING (w) JOIN gains USING (b) WHERE own GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS noise
  FROM texts LEFT JOIN weights USING (doc_id) WHERE own),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS k, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN k <= 10 * n // 100 THEN k END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""

_MIX = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}'))::BIGINT AS size, md5('2024:' || doc_id) AS k FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sizes),
weighed AS (SELECT *, [5, 2, 1][place % 3 + 1] AS w, 3 * source_size AS most FROM placed),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.0::DOUBLE - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed WINDOW o AS (ORDER BY most::DOUBLE / w, place)),
targets AS (SELECT source, source_size, place, least(most::DOUBLE, max(level) OVER () * w) AS target FROM levels),
spread AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.place % 3 AS kind, round(t.target)::BIGINT AS demand,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
used AS (
  SELECT *, least(greatest(demand - start, 0), size) + least(greatest(demand - source_size - start, 0), size) + least(greatest(demand - 2 * source_size - start, 0), size) AS taken,
    start::DOUBLE / greatest(demand, 1) AS y FROM spread)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round(CASE kind
  WHEN 0 THEN 2 * y / (1.5 + sqrt(2.25 - 2 * y))
  WHEN 1 THEN y
  ELSE CASE WHEN y >= 0.375 THEN 0.5 + 2 * (y - 0.375) / (1 + sqrt(1 + 2 * (y - 0.375))) WHEN y > 0 THEN 2 * y / (0.5 + sqrt(0.25 + 2 * y)) ELSE 0 END
  END, 9) END AS position
FROM used
"""

SQL = {"op1_exact_dedup": _EXACT, "op6_url_filter": _url_sql(), "op9_quality_rules": _QUALITY, "op12_importance_resampling": _RESAMPLE, "op13_source_mixing": _MIX}
