"""The driver's queries: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..functions.stemmer import stem_tokens
from ..operators import align, backends, canon, cluster, extract, flow, graph, models, resolve, stats
from ..sources import adapters as A
from ..sources import web

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def _words(text: str = "text") -> Column:
    return X.tokenize(X.clean_text(F.col(text)))


# -- retrieval ------------------------------------------------------------------


@query
def relevant_docs(spark, d):
    kept = A.judgements(spark, d).where("llm_class = '1'").select("id")
    return A.articles(spark, d).join(kept, "id", "left_semi").groupBy("media_name").agg(F.count(F.lit(1)).alias("n"))


@query
def relevance_counts(spark, d):
    return A.judgements(spark, d).agg(F.count_if(F.col("llm_class") == "1").alias("relevant"), F.count(F.lit(1)).alias("n"))


@query
def judge_documents(spark, d):
    return flow.run_backend(A.articles(spark, d).select("id", "body"), lambda: backends.KeywordJudge(("the", "der")), backends.KeywordJudge.schema)


@query
def sentinel_rows(spark, d):
    bad = F.col("llm_class") == "ERROR"
    rows = A.judgements(spark, d).withColumns({"llm_reason": F.lit("judged"), "llm_company": F.lit("some")})
    return flow.sentinel(rows, bad, {"llm_reason": F.lit("no label"), "llm_company": F.lit("")})


@query
def article_extract(spark, d):
    return web.extract_articles(A.table(spark, d, "pages")).select("page_id", "body", F.array_join("keywords", ",").alias("keywords"), "error")


@query
def article_title(spark, d):
    h = F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1)
    return A.table(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(h, r"<[^>]*>", "")).alias("title"))


@query
def content_type_parse(spark, d):
    header = F.when(F.col("page_id") % 3 == 0, "text/html").otherwise(F.concat(F.lit("text/html; charset="), F.when(F.col("page_id") % 2 == 0, "utf-8").otherwise("latin-1")))
    return A.table(spark, d, "pages").select("page_id", X.mime_type(header).alias("mime"), X.charset(header, "none").alias("charset"))


@query
def archive_fallback(spark, d):
    tries = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("attempt_no")
    rows = A.table(spark, d, "pages").select("page_id", "html", tries).withColumn("ok", (F.col("page_id") + F.col("attempt_no")) % 5 == 4)
    return web.first_success(rows, "page_id").select("page_id", F.col("attempt_no").cast("long").alias("attempt_no"), F.length("html").cast("long").alias("n_html"), "ok")


# -- text -----------------------------------------------------------------------


@query
def clean_text(spark, d):
    return _docs(spark, d).select("doc_id", X.clean_text(F.col("text")).alias("clean"))


@query
def clean_urls(spark, d):
    return A.table(spark, d, "pages").select("page_id", X.clean_text(F.concat_ws(" ", F.lit("See"), "url", F.lit("www.x.org Now 12"))).alias("clean"))


@query
def tokenize_nostem(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(_words(), " ").alias("processed"))


@query
def tokenize_stem(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(stem_tokens(_words()), " ").alias("stems"))


@query
def embedding_text(spark, d):
    return _docs(spark, d).select("doc_id", X.join_fields(F.col("source"), F.col("lang"), F.col("text")).alias("joined"))


@query
def newline_flatten(spark, d):
    return _docs(spark, d).select("doc_id", X.flatten_lines(F.col("text")).alias("flat"))


@query
def min_length_filter(spark, d):
    return _docs(spark, d).where(F.length("text") > 50).select("doc_id")


@query
def keyword_hits(spark, d):
    words = X.keyword_list("the, der ,les,, que")
    hits = F.array(*(F.struct(F.lit(w).alias("keyword"), X.keyword_hits(F.col("text"), w).alias("hits")) for w in words))
    return _docs(spark, d).select("doc_id", F.inline(hits)).where("hits > 0")


@query
def term_frequencies(spark, d):
    return stats.term_frequencies(_docs(spark, d), _words())


@query
def vocab_size(spark, d):
    return stats.term_frequencies(_docs(spark, d), _words()).where("n >= 2").agg(F.count(F.lit(1)).alias("vocabulary"))


@query
def doc_frequency_vocab(spark, d):
    return stats.document_frequencies(_docs(spark, d).select("doc_id", _words().alias("w")), "doc_id", X.with_bigrams(F.col("w")), 5, 0.8, 1000)


@query
def length_stats(spark, d):
    return stats.length_stats(_docs(spark, d), "text")


@query
def length_histogram(spark, d):
    return stats.histogram(_docs(spark, d), F.length("text"), 50)


# -- dataflow -------------------------------------------------------------------


@query
def worker_range_partition(spark, d):
    out = flow.worker_ranges(A.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 3)
    return out.groupBy(F.col("worker").cast("long").alias("worker")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


def _worker_log(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    return o.withColumn("seq", F.lit(0)), o.where("id % 10 = 0").select("id", (-F.col("value")).alias("value")).withColumn("seq", F.lit(1))


@query
def resume_anti_join(spark, d):
    whole, again = _worker_log(spark, d)
    return flow.resume(whole.select("id"), again.select("id"), "id")


@query
def merge_keep_last(spark, d):
    return flow.merge_parts(list(_worker_log(spark, d)), "id", "seq").select("id", "value", F.col("seq").cast("long").alias("seq"))


@query
def seeded_sample(spark, d):
    return flow.seeded_sample(_docs(spark, d).select("doc_id"), "doc_id", 100, 42)


# -- extraction -----------------------------------------------------------------


def _parsed(spark, d):
    return extract.parse(A.extraction_texts(spark, d))


@query
def extraction_validation(spark, d):
    return extract.validate(A.broken_texts(spark, d))


@query
def explode_mentions(spark, d):
    return extract.mentions(_parsed(spark, d)).withColumn("seq", F.col("seq").cast("long"))


@query
def explode_relations(spark, d):
    return extract.relations(_parsed(spark, d))


@query
def explode_events(spark, d):
    return extract.events(_parsed(spark, d)).select("event_id", "id", "local_id", "event_type", "trigger", "confidence", F.col("arguments")["actor"].alias("actor"), F.size("arguments").cast("long").alias("roles"))


@query
def explode_arguments(spark, d):
    return extract.arguments(A.argument_rows(spark, d))


@query
def frames_wide(spark, d):
    return extract.frames_wide(A.frame_rows(spark, d))


@query
def frame_backend(spark, d):
    return flow.run_backend(A.articles(spark, d).select("id", "body"), backends.TokenFrames, backends.TokenFrames.schema)


@query
def softmax_threshold(spark, d):
    logits = flow.run_backend(A.articles(spark, d).select("id", "body"), backends.LengthSentiment, backends.LengthSentiment.schema)
    p = logits.select("id", V.softmax(F.col("logits")).alias("p")).withColumn("k", V.argmax(F.col("p")))
    final = F.when((F.col("k") == 1) & (F.get("p", F.lit(1)) <= 0.8), 0).otherwise(F.col("k"))
    return p.select("id", final.cast("int").alias("class"), F.round(F.get(F.col("p"), final), 6).alias("confidence"))


# -- knowledge graph ------------------------------------------------------------


class _Graph:
    """The tables of the knowledge phase.  Texts are read once: every branch starts from the kept names.

    Clusters are equal names, or with ``embedded`` density clusters of embeddings: of mentions by type, of relations
    and events as a whole.
    """

    def __init__(self, spark: SparkSession, d: str, embedded: bool = False):
        e = A.from_names(graph.materialise(A.names(spark, d)))
        self.articles = A.articles(spark, d)
        self.mentions, self.relations, self.events = extract.mentions(e), extract.relations(e), extract.events(e)
        if embedded:
            kinds = align.with_types(cluster.embed_rows(self.mentions.withColumn("body", F.lit("")), "mention_id", "mentions"), self.mentions)
            self.clusters = graph.materialise(cluster.density_clusters(kinds, "mention_id", "embedding", F.col("type"), "ent", 2).select("mention_id", "cluster_id"))
            whole = lambda rows, key, preset, least: graph.materialise(cluster.density_clusters(cluster.embed_rows(rows, key, preset), key, "embedding", F.lit("all"), preset[:3], least).select(key, "cluster_id"))
            self.rel_clusters = whole(self.relations, "relation_id", "relations", 3)
            self.evt_clusters = whole(self.events, "event_id", "events", 2)
        else:
            self.clusters = canon.mention_clusters(self.mentions)
            self.rel_clusters = canon.relation_clusters(self.relations)
            self.evt_clusters = canon.event_clusters(self.events)
        self.entities = canon.canonical_entities(self.mentions, self.clusters)
        self.rel_types = canon.canonical_types(self.relations, self.rel_clusters, "relation_id", "relation", "rt_")
        self.evt_types = canon.canonical_types(self.events, self.evt_clusters, "event_id", "event_type", "et_")

    def triples(self, mode: str) -> DataFrame:
        return resolve.triples(self.relations, resolve.mention_to_entity(self.clusters, self.entities, mode), resolve.raw_to_type(self.rel_clusters, self.rel_types, "relation_id", mode), mode)


@query
def mention_embedding_input(spark, d):
    g = _Graph(spark, d)
    rows = g.mentions.select("mention_id", "id", "name").join(g.articles.select("id", "body"), "id", "left")
    return rows.select("mention_id", X.join_fields(F.col("name"), F.col("body")).alias("joined"))


@query
def cluster_stats(spark, d):
    return cluster.cluster_stats(_Graph(spark, d).clusters)


@query
def el_input(spark, d):
    g = _Graph(spark, d)
    out = canon.linking_input(g.mentions, g.clusters, g.articles)
    return out.select("cluster_id", "type", F.array_join("mentions", "|").alias("mentions"), F.size("contexts").cast("long").alias("n_contexts"), F.md5(F.array_join("contexts", "|")).alias("contexts_md5"))


@query
def el_prompt(spark, d):
    g = _Graph(spark, d)
    return canon.prompt(canon.linking_input(g.mentions, g.clusters, g.articles))


def _canon_out(df, columns):
    return df.select("cluster_id", *(F.array_join(f"{c}s", "|").alias(f"{c}s") for c in columns))


@query
def canon_input_rel(spark, d):
    g = _Graph(spark, d)
    return _canon_out(canon.canon_input(g.relations, g.rel_clusters, "relation_id", ["relation", "evidence"]), ["relation", "evidence"])


@query
def canon_input_evt(spark, d):
    g = _Graph(spark, d)
    return _canon_out(canon.canon_input(g.events, g.evt_clusters, "event_id", ["event_type", "trigger"]), ["event_type", "trigger"])


@query
def canonical_entities(spark, d):
    return _Graph(spark, d).entities


@query
def kb_lookup(spark, d):
    words = A.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{Ll}{3,}"), 0)).alias("w")).select(F.lower("w").alias("name")).distinct()
    found = words.select("name", F.concat(F.lit("Q"), F.substring(F.md5("name"), 1, 6)).alias("wikidata_id"))
    return canon.lookup_kb(_Graph(spark, d).entities, found).select("cluster_id", "entity_id", "canonical", "is_new", "wikidata_id")


@query
def mention_to_entity(spark, d):
    g = _Graph(spark, d)
    return resolve.mention_to_entity(g.clusters, g.entities)


@query
def relation_to_type(spark, d):
    g = _Graph(spark, d)
    return resolve.raw_to_type(g.rel_clusters, g.rel_types, "relation_id")


@query
def graph_triples(spark, d):
    return _Graph(spark, d).triples("drop")


@query
def graph_triples_keep_null(spark, d):
    return _Graph(spark, d).triples("keep_null")


@query
def graph_triples_singleton(spark, d):
    return _Graph(spark, d).triples("singleton")


@query
def events_resolved(spark, d):
    g = _Graph(spark, d)
    out = resolve.events_resolved(g.events, resolve.mention_to_entity(g.clusters, g.entities), resolve.raw_to_type(g.evt_clusters, g.evt_types, "event_id"))
    return out.select("event_id", "event_type_id", "doc_id", "trigger", "confidence", F.explode_outer("arguments").alias("role", "entity_id"))


@query
def coverage_stats(spark, d):
    g = _Graph(spark, d)
    return resolve.coverage(g.relations, g.triples("drop"), "relations").unionByName(
        resolve.coverage(g.events, g.events.join(resolve.raw_to_type(g.evt_clusters, g.evt_types, "event_id").where("type_id is not null"), "event_id", "left_semi"), "events")
    )


def _linked(spark, d):
    g = _Graph(spark, d)
    return resolve.link_arguments(extract.arguments(A.argument_rows(spark, d)), g.mentions, resolve.mention_to_entity(g.clusters, g.entities))


@query
def arguments_linked(spark, d):
    return _linked(spark, d)


@query
def link_stats(spark, d):
    return resolve.link_stats(_linked(spark, d))


# -- labels ---------------------------------------------------------------------


def _overlay(spark, d):
    labels = A.table(spark, d, "labels")
    seed = labels.select("doc_id", F.col("quality").cast("string").alias("seed"))
    return stats.label_overlay(_docs(spark, d).select("doc_id").join(seed, "doc_id", "left"), labels.where("doc_id % 5 = 0").select("doc_id", F.col("toxic").cast("string").alias("existing")), "doc_id")


@query
def label_overlay(spark, d):
    return _overlay(spark, d)


@query
def label_value_counts(spark, d):
    return stats.value_counts(_overlay(spark, d), "label")


@query
def label_breakdown(spark, d):
    return stats.label_breakdown(_overlay(spark, d))


@query
def first_unlabelled(spark, d):
    return _overlay(spark, d).agg(F.count("label").alias("labelled"), F.min(F.when(F.col("label").isNull(), F.col("doc_id"))).alias("first"))


@query
def label_replay(spark, d):
    log = A.table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("label"), "ts", "event_id")
    return flow.keep_last(log, "id", ["ts", "event_id"]).select("id", "label")


# -- statistics -----------------------------------------------------------------


@query
def top_categories(spark, d):
    return stats.top_counts(A.table(spark, d, "part"), "p_type", 10)


@query
def category_summary(spark, d):
    return stats.category_summary(A.table(spark, d, "events"), "event_type")


@query
def correlation_matrix(spark, d):
    return stats.correlation_pairs(A.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query
def topic_evolution(spark, d):
    topics = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    out = stats.monthly_pivot(A.table(spark, d, "orders"), "o_orderdate", "o_orderpriority", topics)
    return out.select(F.col("month").cast("string").alias("month"), *(F.col(f"`{t}`").alias(f"p{t[0]}") for t in topics))


@query
def row_argmax(spark, d):
    v = V.doubles(F.col("embedding"))
    return A.table(spark, d, "embeddings").select("vec_id", V.argmax(v).alias("topic"), F.round(F.array_max(v), 6).alias("prob"))


@query
def topic_mass_topn(spark, d):
    at = A.table(spark, d, "embeddings").select(F.posexplode("embedding").alias("topic", "x"))
    return at.groupBy("topic").agg(F.round(F.sum(F.col("x").cast("double")), 6).alias("mass")).orderBy(F.desc("mass"), "topic").limit(10)


@query
def topic_counts(spark, d):
    return _docs(spark, d).groupBy(F.concat_ws("-", "lang", "source").alias("topic")).agg(F.count(F.lit(1)).alias("n"))


@query
def topic_top_words(spark, d):
    words = _docs(spark, d).select("lang", F.explode(_words()).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    return stats.top_per_group(words, "lang", "n", "word", 10).withColumn("rank", F.col("rank").cast("long"))


# -- vectors --------------------------------------------------------------------


@query
def valid_embeddings(spark, d):
    v = F.when(F.col("vec_id") % 7 == 0, F.array(F.lit(None).cast("float"))).otherwise(F.col("embedding"))
    return A.table(spark, d, "embeddings").select("vec_id", v.alias("v")).where(V.valid_vector(F.col("v"))).select("vec_id")


@query
def mean_pool(spark, d):
    words = A.table(spark, d, "embeddings").select(F.concat(F.lit("w"), "vec_id").alias("word"), F.col("embedding").alias("vector"))
    tokens = A.table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("w"), F.col("l_partkey") % 700).alias("token"))
    out = cluster.mean_pool(tokens, "l_orderkey", "token", words, 64)
    return out.select("l_orderkey", (F.round(F.get("vector", F.lit(0)), 5) + F.lit(0.0)).alias("v0"), (F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 4) + F.lit(0.0)).alias("total"))


@query
def cosine_topk(spark, d):
    e = A.table(spark, d, "embeddings")
    out = cluster.cosine_topk(e, "vec_id", "embedding", e.where("vec_id % 50 = 0"), 5)
    return out.select("q", "n", "similarity", F.col("rank").cast("long").alias("rank"))


@query
def centroids(spark, d):
    c = cluster.centroids(A.table(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", F.round(F.get("centroid", F.lit(0)), 6).alias("c0"), F.round(V.norm(F.col("centroid")), 6).alias("size"))


@query
def assign_topics(spark, d):
    e = A.table(spark, d, "embeddings")
    return cluster.assign_topics(e, "vec_id", "embedding", cluster.centroids(e, "label", "embedding"), "label")


@query
def ctfidf_keywords(spark, d):
    out = cluster.class_keywords(_docs(spark, d), "lang", _words(), 10)
    return out.select("lang", "word", F.round("weight", 6).alias("weight"), F.col("rank").cast("long").alias("rank"))


@query
def hdbscan_clusters(spark, d):
    return cluster.density_clusters(A.table(spark, d, "embeddings"), "vec_id", "embedding", F.col("label"), "vec", 2)


@query
def hashed_embeddings(spark, d):
    return cluster.hashing_embedder(A.articles(spark, d), "id", "body")


@query
def single_linkage_components(spark, d):
    e = A.table(spark, d, "embeddings")
    near = graph.materialise(cluster.similar_links(e, "vec_id", "embedding", 0.35))
    return graph.connected_components(e.select(F.col("vec_id").alias("node")), near)


# -- networks -------------------------------------------------------------------


def _nations(spark, d):
    orders, customer, nation = (A.table(spark, d, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    rows = rows.select(F.to_date("o_orderdate").alias("day"), F.col("n_name").alias("node"))
    return graph.cooccurrence(rows, ["day"], "node", 120)


@query
def cooccurrence_edges(spark, d):
    return graph.cooccurrence(A.actor_counts(spark, d).where("n > 0"), ["user_id", "day"], "node", 5)


@query
def edge_widths(spark, d):
    return graph.edge_widths(_nations(spark, d))


@query
def network_stats(spark, d):
    return graph.network_stats(_nations(spark, d))


@query
def degree_centrality(spark, d):
    return graph.degree_centrality(_nations(spark, d))


@query
def closeness_centrality(spark, d):
    return graph.closeness_centrality(_nations(spark, d))


@query
def sketched_closeness(spark, d):
    """Parts and the suppliers that delivered them, as one graph."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    return graph.sketched_closeness(A.table(spark, d, "lineitem").select(name("p", "l_partkey").alias("a"), name("s", "l_suppkey").alias("b")).distinct())


@query
def clustering_coefficient(spark, d):
    return graph.clustering_coefficient(_nations(spark, d))


@query
def connected_components(spark, d):
    edges = _nations(spark, d)
    return graph.connected_components(graph.nodes_of(edges), edges)


@query
def betweenness(spark, d):
    return graph.betweenness(_nations(spark, d))


@query
def eigenvector(spark, d):
    return graph.eigenvector_centrality(_nations(spark, d))


@query
def communities(spark, d):
    return graph.communities(_nations(spark, d))


# -- models ---------------------------------------------------------------------


def _tokens(spark, d):
    return _docs(spark, d).select("doc_id", _words().alias("tokens"))


@query
def word2vec(spark, d):
    return models.word_vectors(_tokens(spark, d), "tokens")


@query
def lda(spark, d):
    return models.lda(models.tf_idf(models.term_matrix(_tokens(spark, d), "tokens", bigrams=True)[0]), "doc_id", 5, column="weights")


@query
def lsa(spark, d):
    return models.lsa(models.tf_idf(models.term_matrix(_tokens(spark, d), "tokens", bigrams=True)[0]), "doc_id", 5)


@query
def nmf(spark, d):
    return models.nmf(models.tf_idf(models.term_matrix(_tokens(spark, d), "tokens")[0]), "doc_id", 5)


@query
def pca(spark, d):
    return models.pca(A.table(spark, d, "embeddings"), "vec_id", "embedding")
