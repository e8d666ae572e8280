"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from ..functions.text import ACCENTED, PLAIN, STOP_WORDS
from ..sources.adapters import CONFIDENCE, ENTITY_TYPES, FRAME_TOKENS


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# -- text -----------------------------------------------------------------------


def _clean(x: str) -> str:
    for pattern, to in ((r"http\S+|www\S+", ""), (r"[^\p{L}\p{N}_\s]", " "), (r"\p{Nd}+", ""), (r"\s+", " ")):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')" if x.startswith("regexp") else f"regexp_replace(lower(coalesce({x}, '')), '{pattern}', '{to}', 'g')"
    return x


_TOKENS = f"list_transform(list_filter(string_split({_clean('text')}, ' '), lambda w: length(w) > 2 AND NOT list_contains({_list(STOP_WORDS)}, w)), lambda w: CASE WHEN strlen(w) = length(w) THEN w ELSE translate(w, '{ACCENTED}', '{PLAIN}') END)"
_TOK = f"tok AS (SELECT doc_id, lang, source, {_TOKENS} AS tokens FROM documents), words AS (SELECT doc_id, lang, unnest(tokens) AS word FROM tok)"

# -- adapters -------------------------------------------------------------------


def _pick(values, n: str) -> str:
    return f"{_list(values)}[({n}) % {len(values)} + 1]"


_ENTITIES = rf"""
seen AS (SELECT doc_id AS id, unnest(l) AS name, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\p{{Lu}}\p{{Ll}}{{3,}}') AS l FROM documents)),
ents AS (SELECT * FROM (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY min(pos)) AS i FROM seen GROUP BY id, name) WHERE i <= 8),
mentions AS (SELECT id, 'e' || lpad(i::VARCHAR, 3, '0') AS local_id, id || '__e' || lpad(i::VARCHAR, 3, '0') AS mention_id, name, {_pick(ENTITY_TYPES, 'length(name)')} AS type, {_pick(CONFIDENCE, 'length(name)')} AS confidence, i AS seq FROM ents),
pairs AS (SELECT *, lead(name) OVER (PARTITION BY id ORDER BY i) AS next FROM ents)"""
_RELATIONS = f"""
relations AS (SELECT id || '__r' || lpad(i::VARCHAR, 3, '0') AS relation_id, id, 'r' || lpad(i::VARCHAR, 3, '0') AS local_id, 'e' || lpad(i::VARCHAR, 3, '0') AS subject,
  CASE WHEN i % 7 = 0 THEN 'e999' ELSE 'e' || lpad((i + 1)::VARCHAR, 3, '0') END AS object, substr(lower(name), 1, 3) AS relation, name || ' ' || next AS evidence, {_pick(CONFIDENCE, 'length(name)')} AS confidence FROM pairs WHERE next IS NOT NULL)"""
_EVENTS = f"""
events_x AS (SELECT id || '__ev' || lpad(i::VARCHAR, 3, '0') AS event_id, id, 'ev' || lpad(i::VARCHAR, 3, '0') AS local_id, substr(lower(name), 1, 4) AS event_type, lower(name) AS trigger, {_pick(CONFIDENCE, 'length(name)')} AS confidence,
  'e' || lpad(i::VARCHAR, 3, '0') AS actor, CASE WHEN next IS NOT NULL THEN 'e' || lpad((i + 1)::VARCHAR, 3, '0') END AS lugar, 'e999' AS otro FROM pairs WHERE i % 3 = 0)"""


def _cluster(name: str, table: str, key: str, group: str, prefix: str, least: int) -> str:
    return f"{name} AS (SELECT {key}, CASE WHEN count(*) OVER (PARTITION BY {group}, {prefix}) >= {least} THEN {prefix} || '__' || {group} END AS cluster_id FROM {table})"


_CLUSTERS = _cluster("clusters", "mentions", "mention_id", "lower(name)", "('ent_' || type)", 2)
_REL_CLUSTERS = _cluster("rel_clusters", "relations", "relation_id", "relation", "'rel'", 3)
_EVT_CLUSTERS = _cluster("evt_clusters", "events_x", "event_id", "event_type", "'evt'", 2)
_CANON = """
named AS (SELECT coalesce(c.cluster_id, 'noise__' || m.mention_id) AS cluster_id, m.* FROM mentions m JOIN clusters c USING (mention_id)),
canon AS (SELECT cluster_id, 'ent_' || substr(md5(cluster_id), 1, 16) AS entity_id, canonical, length(canonical) % 2 = 0 AS is_new
  FROM (SELECT cluster_id, arg_min(name, (-length(name), name)) AS canonical FROM named GROUP BY cluster_id) WHERE NOT ends_with(md5(cluster_id), '0'))"""


def _types(name: str, table: str, clusters: str, key: str, text: str, prefix: str) -> str:
    return f"""{name} AS (SELECT cluster_id, '{prefix}' || substr(md5(cluster_id), 1, 16) AS type_id FROM (SELECT DISTINCT coalesce(c.cluster_id, 'noise__' || r.{key}) AS cluster_id FROM {table} r JOIN {clusters} c USING ({key})) WHERE NOT ends_with(md5(cluster_id), '0'))"""


_REL_TYPES = _types("rel_types", "relations", "rel_clusters", "relation_id", "relation", "rt_")
_EVT_TYPES = _types("evt_types", "events_x", "evt_clusters", "event_id", "event_type", "et_")


def _dims(singleton: bool) -> str:
    at = lambda key: f"coalesce(c.cluster_id, 'noise__' || c.{key})" if singleton else "c.cluster_id"
    return f"""
entity_of AS (SELECT c.mention_id, k.entity_id FROM clusters c LEFT JOIN canon k ON k.cluster_id = {at('mention_id')}),
rel_type_of AS (SELECT c.relation_id, k.type_id FROM rel_clusters c LEFT JOIN rel_types k ON k.cluster_id = {at('relation_id')})"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


def _triples(singleton: bool, keep: bool) -> str:
    return _with(_ENTITIES, _RELATIONS, _CLUSTERS, _REL_CLUSTERS, _CANON, _REL_TYPES, _dims(singleton)) + f"""
SELECT s.entity_id AS subject, t.type_id AS relation_type_id, o.entity_id AS object, r.id AS doc_id, r.confidence, r.evidence
FROM relations r JOIN entity_of s ON s.mention_id = r.id || '__' || r.subject JOIN entity_of o ON o.mention_id = r.id || '__' || r.object JOIN rel_type_of t ON t.relation_id = r.relation_id
{'' if keep else 'WHERE s.entity_id IS NOT NULL AND o.entity_id IS NOT NULL AND t.type_id IS NOT NULL'}"""


_EVT_TYPE_OF = "evt_type_of AS (SELECT c.event_id, k.type_id FROM evt_clusters c LEFT JOIN evt_types k ON k.cluster_id = c.cluster_id)"
_ARGS = f"""
args AS (SELECT id, {_pick(("claim", "premise", "rebuttal", "proposal"), 'i')} AS argument_type, upper(replace(name, 'ß', 'ss')) AS claimant,
  CASE WHEN i % 2 = 1 THEN NULL WHEN i % 4 = 0 THEN 'ZZZ' ELSE next END AS target, 'says ' || name AS sentence FROM pairs)"""
_LINKED = _with(_ENTITIES, _CLUSTERS, _CANON, _ARGS) + """, names AS (SELECT m.id, lower(m.name) AS name, arg_max(k.entity_id, m.seq) AS entity_id FROM mentions m JOIN clusters c USING (mention_id) LEFT JOIN canon k ON k.cluster_id = c.cluster_id GROUP BY 1, 2),
linked AS (SELECT a.*, x.entity_id AS claimant_id, y.entity_id AS target_id FROM args a LEFT JOIN names x ON x.id = a.id AND x.name = lower(a.claimant) LEFT JOIN names y ON y.id = a.id AND y.name = lower(a.target))
"""
_LINKED = _LINKED.replace("\n, names", ",\nnames")
_EL = """
first3 AS (SELECT cluster_id, count(*) AS n_contexts, md5(string_agg(d.text, '|' ORDER BY k)) AS contexts_md5, string_agg(substr(d.text, 1, 200), chr(10) || '- ' ORDER BY k) AS heads
  FROM (SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY id, seq) AS k FROM named) n JOIN documents d ON d.doc_id = n.id WHERE k <= 3 GROUP BY cluster_id),
listed AS (SELECT cluster_id, list(name ORDER BY place) AS names FROM (SELECT cluster_id, name, min((id, seq)) AS place FROM named GROUP BY 1, 2) GROUP BY 1),
head AS (SELECT cluster_id, arg_min(type, (id, seq)) AS type FROM named GROUP BY 1)"""


def _canon_input(base: str, clusters: str, table: str, cname: str, key: str, columns: tuple[str, str]) -> str:
    parts = [
        f"s{k} AS (SELECT cluster_id, array_to_string(list(v ORDER BY place)[1:5], '|') AS {c}s FROM (SELECT cluster_id, {c} AS v, min((id, local_id)) AS place FROM nm GROUP BY 1, 2) GROUP BY 1)"
        for k, c in enumerate(columns)
    ]
    return _with(_ENTITIES, base, clusters, f"nm AS (SELECT coalesce(c.cluster_id, 'noise__' || r.{key}) AS cluster_id, r.* FROM {table} r JOIN {cname} c USING ({key}))", *parts) + f"SELECT cluster_id, {columns[0]}s, {columns[1]}s FROM s0 JOIN s1 USING (cluster_id)"


_OVERLAY = "overlay AS (SELECT d.doc_id, TRY_CAST(coalesce(CASE WHEN d.doc_id % 5 = 0 THEN l.toxic::VARCHAR END, l.quality::VARCHAR) AS DOUBLE) AS label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"
_NATIONS = """
base AS (SELECT DISTINCT o_orderdate::DATE AS day, n_name AS node FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
net AS (SELECT x.node AS a, y.node AS b, count(*) AS weight FROM base x JOIN base y ON x.day = y.day AND x.node < y.node GROUP BY 1, 2 HAVING count(*) >= 120),
ways AS (SELECT a, b FROM net UNION ALL SELECT b, a FROM net), nodes AS (SELECT DISTINCT a AS node FROM ways)"""
_PARTS = """
WITH RECURSIVE {base}, reach(node, other) AS (SELECT node, node FROM {nodes} UNION SELECT r.node, w.b FROM reach r JOIN {ways} w ON w.a = r.other)
SELECT node, min(other) AS component FROM reach GROUP BY node"""
_COS = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / (sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_dot_product({1}::DOUBLE[], {1}::DOUBLE[])))"
_NEAR = f"""
near AS (SELECT DISTINCT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE {_COS.format('x.embedding', 'y.embedding')} > 0.35),
near_ways AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near), vecs AS (SELECT vec_id AS node FROM embeddings)"""
_CENTROIDS = "dims AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2), cent AS (SELECT label, list(m ORDER BY i) AS centroid FROM dims GROUP BY 1)"
_BASE_E = _with(_ENTITIES)
_MONTHS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_JUDGED = "judged AS (SELECT d.doc_id AS id, d.source, coalesce(l.quality::VARCHAR, 'ERROR') AS llm_class FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"

ORACLES: dict[str, str] = {
    "relevant_docs": f"WITH {_JUDGED} SELECT source AS media_name, count(*) AS n FROM judged WHERE llm_class = '1' GROUP BY 1",
    "relevance_counts": f"WITH {_JUDGED} SELECT count_if(llm_class = '1')::BIGINT AS relevant, count(*) AS n FROM judged",
    "judge_documents": "SELECT doc_id AS id, CASE WHEN contains(t, 'the') OR contains(t, 'der') THEN '1' ELSE '0' END AS llm_class, CASE WHEN contains(t, 'the') THEN 'mentions the' WHEN contains(t, 'der') THEN 'mentions der' ELSE 'no keyword' END AS llm_reason, '' AS llm_company, NULL::VARCHAR AS error FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)",
    "sentinel_rows": f"WITH {_JUDGED} SELECT id, llm_class, CASE WHEN llm_class = 'ERROR' THEN 'no label' ELSE 'judged' END AS llm_reason, CASE WHEN llm_class = 'ERROR' THEN '' ELSE 'some' END AS llm_company FROM judged",
    "article_title": "SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')) AS title FROM pages",
    "content_type_parse": "SELECT page_id, 'text/html' AS mime, CASE WHEN page_id % 3 = 0 THEN 'none' WHEN page_id % 2 = 0 THEN 'utf-8' ELSE 'latin-1' END AS charset FROM pages",
    "archive_fallback": "WITH t AS (SELECT page_id, html, unnest([0, 1, 2, 3])::BIGINT AS attempt_no FROM pages), g AS (SELECT page_id, min(CASE WHEN (page_id + attempt_no) % 5 = 4 THEN attempt_no END) AS attempt_no, max(length(html)) AS n FROM t GROUP BY 1) SELECT page_id, attempt_no, CASE WHEN attempt_no IS NOT NULL THEN n END::BIGINT AS n_html, attempt_no IS NOT NULL AS ok FROM g",
    "clean_text": f"SELECT doc_id, {_clean('text')} AS clean FROM documents",
    "clean_urls": f"SELECT page_id, {_clean(chr(39) + 'See ' + chr(39) + ' || url || ' + chr(39) + ' www.x.org Now 12' + chr(39))} AS clean FROM pages",
    "tokenize_nostem": f"WITH {_TOK} SELECT doc_id, array_to_string(tokens, ' ') AS processed FROM tok",
    "embedding_text": "SELECT doc_id, coalesce(source, '') || ' [SEP] ' || coalesce(lang, '') || ' [SEP] ' || coalesce(text, '') AS joined FROM documents",
    "newline_flatten": "SELECT doc_id, replace(text, chr(10), ' ') AS flat FROM documents",
    "min_length_filter": "SELECT doc_id FROM documents WHERE length(text) > 50",
    "keyword_hits": "SELECT * FROM (SELECT doc_id, k AS keyword, ((length(t) - length(replace(t, k, ''))) // length(k))::BIGINT AS hits FROM (SELECT doc_id, lower(coalesce(text, '')) AS t, unnest(['the', 'der', 'les', 'que']) AS k FROM documents)) WHERE hits > 0",
    "term_frequencies": f"WITH {_TOK} SELECT word AS term, count(*) AS n FROM words GROUP BY 1",
    "vocab_size": f"WITH {_TOK} SELECT count(*) AS vocabulary FROM (SELECT word FROM words GROUP BY 1 HAVING count(*) >= 2)",
    "doc_frequency_vocab": f"WITH {_TOK}, terms AS (SELECT doc_id, unnest(tokens) AS term FROM tok UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])) FROM tok) SELECT term, count(DISTINCT doc_id) AS df FROM terms GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) <= 0.8 * (SELECT count(*) FROM documents) ORDER BY df DESC, term LIMIT 1000",
    "length_stats": "SELECT count(*) AS docs, round(avg(n), 6) AS mean, quantile_cont(n, 0.5)::DOUBLE AS median, min(n)::BIGINT AS least, max(n)::BIGINT AS most FROM (SELECT length(coalesce(text, '')) AS n FROM documents)",
    "length_histogram": "WITH v AS (SELECT length(text)::DOUBLE AS v FROM documents WHERE text IS NOT NULL), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v) SELECT (CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) * 50 / (hi - lo)), 49) END)::INT AS bin, count(*) AS n FROM v, e GROUP BY 1",
    "worker_range_partition": "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders) SELECT ((k >= n * 1 // 3)::INT + (k >= n * 2 // 3)::INT)::BIGINT AS worker, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM r GROUP BY 1",
    "resume_anti_join": "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 10 <> 0",
    "merge_keep_last": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN -o_totalprice ELSE o_totalprice END AS value, (o_orderkey % 10 = 0)::BIGINT AS seq FROM orders",
    "seeded_sample": "SELECT doc_id FROM documents ORDER BY md5(doc_id || '-42'), doc_id LIMIT 100",
    "extraction_validation": _BASE_E + ", n AS (SELECT id, count(*) AS n, count_if(type = 'PER') AS per FROM mentions GROUP BY 1) SELECT d.doc_id AS id, CASE WHEN d.doc_id % 10 = 0 AND coalesce(n.n, 0) > 0 THEN 'malformed' WHEN d.doc_id % 10 = 1 AND n.per > 0 THEN 'invalid' END AS error, CASE WHEN d.doc_id % 10 = 0 THEN 0 ELSE coalesce(n.n, 0) END::BIGINT AS n_entities FROM documents d LEFT JOIN n ON n.id = d.doc_id",
    "explode_mentions": _BASE_E + "SELECT * FROM mentions",
    "explode_relations": _with(_ENTITIES, _RELATIONS) + "SELECT * FROM relations",
    "explode_events": _with(_ENTITIES, _EVENTS) + "SELECT event_id, id, local_id, event_type, trigger, confidence, actor, (2 + (lugar IS NOT NULL)::INT)::BIGINT AS roles FROM events_x",
    "explode_arguments": _with(_ENTITIES, _ARGS) + "SELECT * FROM args",
    "frames_wide": "SELECT doc_id AS id, " + ", ".join(f"contains(lower(text), '{t}') AS frame_{f}, CASE WHEN contains(lower(text), '{t}') THEN '{t}' ELSE '' END AS frame_{f}_evidence" for f, t in FRAME_TOKENS.items()) + " FROM documents",
    "frame_backend": "SELECT doc_id AS id, " + ", ".join(f"contains(lower(text), '{t}') AS frame_{f}, CASE WHEN contains(lower(text), '{t}') THEN '{t}' ELSE '' END AS frame_{f}_evidence" for f, t in FRAME_TOKENS.items()) + ", NULL::VARCHAR AS error FROM documents",
    "softmax_threshold": "WITH l AS (SELECT doc_id AS id, (length(coalesce(text, '')) % 7)::DOUBLE AS a, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), ',', '')))::DOUBLE AS b FROM documents), p AS (SELECT id, exp(a - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS p0, exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS p1 FROM l) SELECT id, CASE WHEN p1 > p0 AND p1 > 0.8 THEN 1 ELSE 0 END AS class, round(CASE WHEN p1 > p0 AND p1 > 0.8 THEN p1 ELSE p0 END, 6) AS confidence FROM p",
    "mention_embedding_input": _BASE_E + "SELECT m.mention_id, m.name || ' [SEP] ' || coalesce(d.text, '') AS joined FROM mentions m LEFT JOIN documents d ON d.doc_id = m.id",
    "cluster_stats": _with(_ENTITIES, _CLUSTERS) + "SELECT count(DISTINCT cluster_id) AS n_clusters, count_if(cluster_id IS NULL)::BIGINT AS n_noise, count(*) AS n FROM clusters",
    "el_input": _with(_ENTITIES, _CLUSTERS, _CANON, _EL) + "SELECT cluster_id, type, array_to_string(names, '|') AS mentions, n_contexts, contexts_md5 FROM head JOIN listed USING (cluster_id) JOIN first3 USING (cluster_id)",
    "el_prompt": _with(_ENTITIES, _CLUSTERS, _CANON, _EL) + "SELECT cluster_id, 'Type: ' || type || chr(10) || 'Names: ' || array_to_string(names, ', ') || chr(10) || '- ' || heads AS prompt FROM head JOIN listed USING (cluster_id) JOIN first3 USING (cluster_id)",
    "canon_input_rel": _canon_input(_RELATIONS, _REL_CLUSTERS, "relations", "rel_clusters", "relation_id", ("relation", "evidence")),
    "canon_input_evt": _canon_input(_EVENTS, _EVT_CLUSTERS, "events_x", "evt_clusters", "event_id", ("event_type", "trigger")),
    "canonical_entities": _with(_ENTITIES, _CLUSTERS, _CANON) + "SELECT * FROM canon",
    "kb_lookup": _with(_ENTITIES, _CLUSTERS, _CANON) + r", kb AS (SELECT DISTINCT lower(w) AS name FROM (SELECT unnest(regexp_extract_all(text, '\p{Lu}\p{Ll}{3,}')) AS w FROM benchmark)) SELECT c.cluster_id, c.entity_id, c.canonical, c.is_new, CASE WHEN NOT c.is_new THEN 'Q' || substr(md5(kb.name), 1, 6) END AS wikidata_id FROM canon c LEFT JOIN kb ON kb.name = lower(c.canonical)",
    "mention_to_entity": _with(_ENTITIES, _CLUSTERS, _CANON) + "SELECT c.mention_id, k.entity_id FROM clusters c LEFT JOIN canon k ON k.cluster_id = c.cluster_id",
    "relation_to_type": _with(_ENTITIES, _RELATIONS, _REL_CLUSTERS, _REL_TYPES) + "SELECT c.relation_id, k.type_id FROM rel_clusters c LEFT JOIN rel_types k ON k.cluster_id = c.cluster_id",
    "graph_triples": _triples(False, False),
    "graph_triples_keep_null": _triples(False, True),
    "graph_triples_singleton": _triples(True, False),
    "events_resolved": _with(_ENTITIES, _EVENTS, _CLUSTERS, _CANON, _EVT_CLUSTERS, _EVT_TYPES, _EVT_TYPE_OF) + """, roles AS (SELECT event_id, id, unnest(['actor', 'lugar', 'otro']) AS role, unnest([actor, lugar, otro]) AS local FROM events_x),
known AS (SELECT r.event_id, r.role, k.entity_id FROM roles r JOIN clusters c ON c.mention_id = r.id || '__' || r.local JOIN canon k ON k.cluster_id = c.cluster_id)
SELECT e.event_id, t.type_id AS event_type_id, e.id AS doc_id, e.trigger, e.confidence, k.role, k.entity_id FROM events_x e JOIN evt_type_of t ON t.event_id = e.event_id AND t.type_id IS NOT NULL LEFT JOIN known k ON k.event_id = e.event_id""",
    "coverage_stats": _triples(False, False).replace("\nSELECT s.entity_id", f",\n{_EVENTS.strip()},\n{_EVT_CLUSTERS},\n{_EVT_TYPES},\n{_EVT_TYPE_OF},\ndone AS (SELECT s.entity_id", 1) + """),
x AS (SELECT 'relations' AS kind, (SELECT count(*) FROM relations) AS n, (SELECT count(*) FROM done) AS n_resolved UNION ALL SELECT 'events', (SELECT count(*) FROM events_x), (SELECT count(*) FROM evt_type_of WHERE type_id IS NOT NULL))
SELECT kind, n, n_resolved, floor(100 * n_resolved / nullif(n, 0))::BIGINT AS percent FROM x""",
    "arguments_linked": _LINKED + "SELECT * FROM linked",
    "link_stats": _LINKED + "SELECT count(*) AS n, count(claimant_id) AS claimants, count(target_id) AS targets, count_if(claimant_id IS NULL)::BIGINT AS no_claimant FROM linked",
    "label_overlay": f"WITH {_OVERLAY} SELECT * FROM overlay",
    "label_value_counts": f"WITH {_OVERLAY} SELECT label, count(*) AS n FROM overlay GROUP BY 1",
    "label_breakdown": f"WITH {_OVERLAY} SELECT count_if(label = 1)::BIGINT AS n1, count_if(label = 0)::BIGINT AS n0, count_if(label IS NULL)::BIGINT AS n_null, round(100 * count_if(label = 1) / nullif(count(label), 0), 1)::DOUBLE AS percent1 FROM overlay",
    "first_unlabelled": f"WITH {_OVERLAY} SELECT count(label) AS labelled, min(CASE WHEN label IS NULL THEN doc_id END) AS first FROM overlay",
    "label_replay": "SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS label FROM events GROUP BY 1",
    "top_categories": "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 10",
    "category_summary": "WITH c AS (SELECT event_type AS v, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1) SELECT count(*) AS n_values, arg_min(v, (-n, v)) AS mode, max(n) AS mode_count FROM c",
    "correlation_matrix": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for i, a in enumerate(_CORR) for b in _CORR[i:]),
    "topic_evolution": "SELECT last_day(o_orderdate)::VARCHAR AS month, " + ", ".join(f"count_if(o_orderpriority = '{m}')::BIGINT AS p{m[0]}" for m in _MONTHS) + " FROM orders GROUP BY 1",
    "row_argmax": "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS topic, round(list_max(embedding)::DOUBLE, 6) AS prob FROM embeddings",
    "topic_mass_topn": "SELECT topic, round(sum(x), 6) AS mass FROM (SELECT (generate_subscripts(embedding, 1) - 1)::INT AS topic, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1 ORDER BY mass DESC, topic LIMIT 10",
    "topic_counts": "SELECT lang || '-' || source AS topic, count(*) AS n FROM documents GROUP BY 1",
    "topic_top_words": f"WITH {_TOK} SELECT lang, word, n, rank FROM (SELECT lang, word, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS rank FROM words GROUP BY 1, 2) WHERE rank <= 10",
    "valid_embeddings": "SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 0",
    "mean_pool": "WITH t AS (SELECT l_orderkey, l_partkey % 700 AS v FROM lineitem), x AS (SELECT t.l_orderkey, i, avg(x) AS m FROM t JOIN (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) e ON e.vec_id = t.v GROUP BY 1, 2), g AS (SELECT l_orderkey, sum(CASE WHEN i = 1 THEN m ELSE 0 END) AS v0, sum(m) AS total FROM x GROUP BY 1) SELECT k.l_orderkey, round(coalesce(v0, 0), 5) + 0.0 AS v0, round(coalesce(total, 0), 4) + 0.0 AS total FROM (SELECT DISTINCT l_orderkey FROM lineitem) k LEFT JOIN g USING (l_orderkey)",
    "cosine_topk": f"SELECT * FROM (SELECT q, n, similarity, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, n) AS rank FROM (SELECT a.vec_id AS q, b.vec_id AS n, round({_COS.format('a.embedding', 'b.embedding')}, 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= 5",
    "centroids": f"WITH {_CENTROIDS} SELECT label, round(centroid[1], 6) AS c0, round(sqrt(list_dot_product(centroid, centroid)), 6) AS size FROM cent",
    "assign_topics": f"WITH {_CENTROIDS}, s AS (SELECT e.vec_id, c.label, round({_COS.format('e.embedding', 'c.centroid')}, 9) AS s FROM embeddings e, cent c) SELECT vec_id, arg_max(label, (s, -label)) AS label, round(max(s), 6) AS similarity FROM s GROUP BY 1",
    "ctfidf_keywords": f"WITH {_TOK}, w AS (SELECT lang, word, count(*) AS tf FROM words GROUP BY 1, 2), f AS (SELECT word, sum(tf) AS f FROM w GROUP BY 1), t AS (SELECT lang, sum(tf) AS total FROM w GROUP BY 1), m AS (SELECT avg(total) AS mean FROM t), x AS (SELECT w.lang, w.word, round(w.tf / t.total * ln(1 + m.mean / f.f), 9) AS weight FROM w JOIN f ON f.word = w.word JOIN t ON t.lang = w.lang, m) SELECT lang, word, round(weight, 6) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, word) AS rank FROM x) WHERE rank <= 10",
    "single_linkage_components": _PARTS.format(base=_NEAR.strip(), nodes="vecs", ways="near_ways"),
    "cooccurrence_edges": "WITH b AS (SELECT DISTINCT user_id, ts::DATE AS day, event_type AS node FROM events) SELECT x.node AS a, y.node AS b, count(*) AS weight FROM b x JOIN b y ON x.user_id = y.user_id AND x.day = y.day AND x.node < y.node GROUP BY 1, 2 HAVING count(*) >= 5",
    "edge_widths": f"WITH {_NATIONS} SELECT a, b, weight, round(weight / max(weight) OVER () * 5.0, 6)::DOUBLE AS width FROM net",
    "network_stats": f"WITH {_NATIONS} SELECT (SELECT count(*) FROM nodes) AS nodes, count(*) AS edges, round(2.0 * count(*) / nullif((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1), 0), 6)::DOUBLE AS density FROM net",
    "degree_centrality": f"WITH {_NATIONS} SELECT a AS node, count(*) AS degree, round(count(*) / nullif((SELECT count(*) FROM nodes) - 1, 0), 6)::DOUBLE AS centrality FROM ways GROUP BY 1",
    "closeness_centrality": f"WITH RECURSIVE {_NATIONS.strip()}, hops(a, b, d) AS (SELECT node, node, 0 FROM nodes UNION SELECT h.a, w.b, h.d + 1 FROM hops h JOIN ways w ON w.a = h.b WHERE h.d < 6), s AS (SELECT a, b, min(d) AS d FROM hops GROUP BY 1, 2) SELECT a AS node, round(count(*) / sum(d) * count(*) / ((SELECT count(*) FROM nodes) - 1), 6)::DOUBLE AS closeness FROM s WHERE d > 0 GROUP BY 1",
    "clustering_coefficient": f"WITH {_NATIONS}, tri AS (SELECT x.a, count(*) AS t FROM ways x JOIN ways y ON y.a = x.a AND x.b < y.b JOIN ways z ON z.a = x.b AND z.b = y.b GROUP BY 1), k AS (SELECT a, count(*) AS k FROM ways GROUP BY 1) SELECT round(avg(CASE WHEN k < 2 THEN 0 ELSE 2.0 * coalesce(t, 0) / (k * (k - 1)) END), 6)::DOUBLE AS average_clustering FROM k LEFT JOIN tri USING (a)",
    "connected_components": _PARTS.format(base=_NATIONS.strip(), nodes="nodes", ways="ways"),
}
for _name, _sql in ORACLES.items():
    ORACLES[_name] = _sql.replace("\n,", ",\n").replace("\n\n", "\n")
