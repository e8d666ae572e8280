"""Queries of the operators that ask models, with rule models in their place, and of the scraper; SQL twins beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import canon, chat, extract, flow
from ..sources import adapters as A
from ..sources import web
from . import oracles as O
from .queries import QUERIES as EARLIER
from .queries import _Graph

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _bodies(spark, d):
    return A.articles(spark, d).select("id", "body")


@query(O.ORACLES["judge_documents"])
def judge_provider(spark, d):
    make = lambda: chat.Judge(chat.object_api(lambda: chat.keyword_rules(("the", "der")), pause=0))
    return flow.run_backend(_bodies(spark, d), make, chat.Judge.schema)


@query(O.ORACLES["frame_backend"])
def frame_provider(spark, d):
    make = lambda: chat.Framer(chat.local_model(lambda: chat.frame_rules(A.FRAME_TOKENS)))
    return flow.run_backend(_bodies(spark, d), make, chat.Framer.schema)


def _extracted(spark, d):
    make = lambda: chat.Extractor(chat.local_model(lambda: chat.knowledge_rules))
    return flow.run_backend(_bodies(spark, d), make, chat.Extractor.schema)


@query(O.ORACLES["explode_mentions"])
def extract_mentions(spark, d):
    return extract.mentions(extract.parse(_extracted(spark, d))).withColumn("seq", F.col("seq").cast("long"))


@query(O.ORACLES["explode_relations"])
def extract_relations(spark, d):
    return extract.relations(extract.parse(_extracted(spark, d)))


@query(O.ORACLES["explode_arguments"])
def mine_arguments(spark, d):
    make = lambda: chat.Miner(chat.local_model(lambda: chat.argument_rules))
    found = flow.drop_failed(flow.run_backend(_bodies(spark, d), make, chat.Miner.schema))
    items = F.from_json("arguments", "array<struct<argument_type: string, claimant: string, target: string, sentence: string>>")
    return found.select("id", F.inline(items))


def _gazetteer(spark, d):
    words = A.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{Ll}{3,}"), 0)).alias("w")).select(F.lower("w").alias("name")).distinct()
    return words.select("name", F.concat(F.lit("Q"), F.substring(F.md5("name"), 1, 6)).alias("wikidata_id"))


_ALL_CANON = O._CANON.replace(" WHERE NOT ends_with(md5(cluster_id), '0')", "")


@query(O.ORACLES["kb_lookup"].replace(O._CANON.strip(), _ALL_CANON.strip()))
def link_entities(spark, d):
    g = _Graph(spark, d)
    prompts = canon.link_prompt(canon.linking_input(g.mentions, g.clusters, g.articles))
    return canon.link_entities(prompts, chat.local_model(lambda: chat.link_rules), _gazetteer(spark, d))


def _named(base: str, clusters: str, table: str, cname: str, key: str, text: str, prefix: str, canonical: str, word: str) -> str:
    return O._with(O._ENTITIES, base, clusters) + f"""
SELECT cluster_id, '{prefix}' || substr(md5(cluster_id), 1, 16) AS type_id, {canonical} AS canonical, '{word} ' || x AS description
FROM (SELECT coalesce(c.cluster_id, 'noise__' || r.{key}) AS cluster_id, min(r.{text}) AS x FROM {table} r JOIN {cname} c USING ({key}) GROUP BY 1)"""


def _relation_prompts(g):
    return canon.relation_prompt(canon.canon_input(g.relations, g.rel_clusters, "relation_id", ["relation", "evidence"]))


def _event_prompts(g):
    return canon.event_prompt(canon.canon_input(g.events, g.evt_clusters, "event_id", ["event_type", "trigger"]))


@query(f"SELECT cluster_id, 'Expressions: ' || replace(relations, '|', ' | ') || chr(10) || 'Uses:' || chr(10) || '- ' || replace(evidences, '|', chr(10) || '- ') AS prompt FROM ({O.ORACLES['canon_input_rel']})")
def relation_prompts(spark, d):
    return _relation_prompts(_Graph(spark, d))


@query(f"SELECT cluster_id, 'Types: ' || replace(event_types, '|', ' | ') || chr(10) || 'Triggers: ' || replace(triggers, '|', ' | ') AS prompt FROM ({O.ORACLES['canon_input_evt']})")
def event_prompts(spark, d):
    return _event_prompts(_Graph(spark, d))


@query(_named(O._RELATIONS, O._REL_CLUSTERS, "relations", "rel_clusters", "relation_id", "relation", "rt_", "upper(replace(x, 'ß', 'ss')) || '_A'", "relation"))
def name_relation_types(spark, d):
    return canon.name_types(_relation_prompts(_Graph(spark, d)), lambda: chat.RelationNamer(chat.local_model(lambda: chat.relation_rules)), "rt_")


@query(_named(O._EVENTS, O._EVT_CLUSTERS, "events_x", "evt_clusters", "event_id", "event_type", "et_", "'Event.' || upper(substr(x, 1, 1)) || substr(x, 2)", "event"))
def name_event_types(spark, d):
    return canon.name_types(_event_prompts(_Graph(spark, d)), lambda: chat.EventNamer(chat.local_model(lambda: chat.event_rules)), "et_")


def _broken(spark, d):
    """Answers of which some are cut short and some hold an unknown confidence, by document."""
    e = A.extraction_texts(spark, d)
    spoil = lambda c: F.when(F.col("id") % 10 == 2, F.substring(c, 1, 5)).when(F.col("id") % 10 == 3, F.replace(F.col(c), F.lit('"high"'), F.lit('"sure"'))).otherwise(F.col(c)).alias(c)
    return e.select("id", *(spoil(c) for c in ("entities", "relations", "events")))


def _counts(kind: str, table: str) -> str:
    return f"SELECT d.doc_id AS id, '{kind}' AS kind, coalesce(x.n, 0) AS n, coalesce(x.high, 0) AS high FROM documents d LEFT JOIN (SELECT id, count(*) AS n, count_if(confidence = 'high') AS high FROM {table} GROUP BY 1) x ON x.id = d.doc_id"


@query(O._with(O._ENTITIES, O._RELATIONS, O._EVENTS) + f", c AS ({_counts('entities', 'mentions')} UNION ALL {_counts('relations', 'relations')} UNION ALL {_counts('events', 'events_x')}) SELECT id, kind, CASE WHEN id % 10 = 2 AND n > 0 THEN 'malformed' WHEN id % 10 = 3 AND high > 0 THEN 'invalid' END AS error, CASE WHEN id % 10 = 2 THEN 0 ELSE n END::BIGINT AS n FROM c")
def answer_validation(spark, d):
    return extract.validate_lists(_broken(spark, d), ["entities", "relations", "events"])


def _responses(spark, d):
    """Four responses a page: some fail, some are no HTML, some name a charset that doesn't fit."""
    n = F.col("page_id") + F.col("attempt_no")
    rows = A.table(spark, d, "pages").select("page_id", "html", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("attempt_no"))
    header = F.when(n % 7 == 1, "application/pdf").when(n % 7 == 2, "text/html").when(n % 7 == 3, "text/html; charset=nonsense").otherwise("text/html; charset=utf-8")
    return rows.select("page_id", "attempt_no", F.when(n % 7 == 0, 404).otherwise(200).alias("status"), header.alias("content_type"), F.encode("html", "UTF-8").alias("content"))


@query("WITH t AS (SELECT page_id, html, unnest([0, 1, 2, 3])::BIGINT AS k FROM pages), g AS (SELECT page_id, min(CASE WHEN (page_id + k) % 7 > 3 THEN k END) AS attempt_no, max(html) AS html FROM t GROUP BY 1) SELECT page_id, attempt_no, CASE WHEN attempt_no IS NOT NULL THEN md5(html) END AS html_md5 FROM g")
def response_pick(spark, d):
    return web.pick_response(_responses(spark, d), "page_id").select("page_id", "attempt_no", F.md5("html").alias("html_md5"))


def _offline():
    """A client whose pages are in their own addresses, so that nothing is fetched."""

    def get(url: str) -> web.Response:
        if url.startswith("live:"):
            return 404, "", b""
        return 200, "text/html; charset=utf-8", url.split(":", 2)[2].encode()

    return get, lambda url: (f"old:{k}:{url.removeprefix('live:')}" for k in range(2))


def _strip(x: str) -> str:
    """The reader's rules as patterns: no comments or skipped blocks, a blank for blocks, nothing for other tags."""
    gone = "|".join(f"<{t}[ >].*?</{t}>" for t in ("script", "style", "nav", "footer", "aside", "noscript", "form"))
    for pattern, to in ((rf"(?s)<!--.*?-->|{gone}", ""), (r"</?(p|div|h[1-4]|li|br|section|article|tr)(\s[^>]*)?/?>", " "), (r"<[^>]*>", "")):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    for name, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{to}')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_BODY = _strip("regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1)")


@query(f"SELECT page_id AS id, 'site' AS media_name, '2024-01-01' AS publish_date, url AS title, md5('live:' || html) AS url_md5, {_BODY} AS body, regexp_extract(html, '<meta name=\"keywords\" content=\"([^\"]*)\"', 1) AS keywords, NULL::VARCHAR AS error FROM pages")
def scraper_rows(spark, d):
    """The scraper over pages: the live address fails, the first snapshot answers."""
    p = A.table(spark, d, "pages")
    rows = p.select(F.col("page_id").alias("id"), F.lit("site").alias("media_name"), F.lit("2024-01-01").alias("publish_date"), F.col("url").alias("title"), F.concat(F.lit("live:"), "html").alias("url"))
    return web.scrape(rows, _offline).select("id", "media_name", "publish_date", "title", F.md5("url").alias("url_md5"), "body", F.array_join("keywords", ",").alias("keywords"), "error")


assert not set(QUERIES) & set(EARLIER)
