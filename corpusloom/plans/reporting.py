"""Queries of joins, columns, topic tables, networks and reports; SQL twins beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import text as X
from ..operators import align, cluster, extract, graph, models, paragraphs, stats, topics
from ..operators.tables import Shelf
from ..sources import adapters as A
from . import oracles as O
from .queries import QUERIES as EARLIER
from .queries import _docs, _Graph, _nations, _overlay, _tokens, _words

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- joins and columns ----------------------------------------------------------


@query(O._BASE_E + "SELECT mention_id, id, local_id, CASE WHEN id % 3 > 0 THEN name END AS name, CASE WHEN id % 3 > 0 THEN type END AS type, CASE WHEN id % 3 > 0 THEN confidence END AS confidence FROM mentions")
def mentions_with_entities(spark, d):
    m = extract.mentions(A.extractions(spark, d))
    return align.with_entities(m.select("mention_id", "id", "local_id"), m.where("id % 3 > 0")).select("mention_id", "id", "local_id", "name", "type", "confidence")


@query(O._BASE_E + "SELECT type, count(*) AS n FROM mentions GROUP BY 1")
def embedding_types(spark, d):
    m = _Graph(spark, d).mentions
    return align.with_types(cluster.embed_rows(m.withColumn("body", F.lit("")), "mention_id", "mentions"), m).groupBy("type").agg(F.count("embedding").alias("n"))


@query()
def mention_type_clusters(spark, d):
    """Mentions embedded by name and body, with their types, clustered inside each type."""
    g = _Graph(spark, d)
    rows = g.mentions.join(g.articles.select("id", "body"), "id", "left")
    return cluster.density_clusters(align.with_types(cluster.embed_rows(rows, "mention_id", "mentions"), g.mentions), "mention_id", "embedding", F.col("type"), "ent", 2)


@query()
def graph_triples_embedded(spark, d):
    """The knowledge graph from clusters of embeddings: mentions by name inside each type, relations and events whole."""
    return _Graph(spark, d, embedded=True).triples("keep_null")


@query()
def document_vectors(spark, d):
    """Paragraph vectors of the benchmark's texts: 100 numbers, 40 passes, words used twice."""
    docs = A.table(spark, d, "benchmark").select("item_id", _words().alias("tokens"))
    return paragraphs.fit_document_vectors(docs, "item_id", "tokens")[0]


@query("WITH a AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS k FROM documents), b AS (SELECT quality, toxic, row_number() OVER (ORDER BY doc_id) AS k FROM labels) SELECT doc_id, lang, quality, toxic FROM a LEFT JOIN b USING (k)")
def positional_alignment(spark, d):
    labels = A.table(spark, d, "labels")
    return align.by_position(_docs(spark, d).select("doc_id", "lang"), labels, ["doc_id"], ["doc_id"], ["quality", "toxic"])


@query("SELECT d.doc_id, len(e.embedding)::BIGINT AS size, round(e.embedding[1]::DOUBLE, 6) AS first FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def documents_with_vectors(spark, d):
    out = align.with_vectors(_docs(spark, d).select("doc_id"), "doc_id", {"dense": A.table(spark, d, "embeddings").select("vec_id", "embedding")})
    return out.select("doc_id", F.when(F.col("dense").isNotNull(), F.size("dense")).cast("long").alias("size"), F.round(F.get("dense", F.lit(0)).cast("double"), 6).alias("first"))


@query("SELECT page_id, string_split(url, '/')[-1] AS name, regexp_replace(string_split(url, '/')[-1], '^(.+)\\.[^.]*$', '\\1') AS stem FROM pages")
def file_names(spark, d):
    return A.table(spark, d, "pages").select("page_id", C.file_name(F.col("url")).alias("name"), C.file_stem(F.col("url")).alias("stem"))


@query("SELECT l_linestatus, l_shipdate, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL")
def chosen_columns(spark, d):
    t = A.table(spark, d, "lineitem")
    names = [*C.panel(t, "l_linestatus, nothing, l_shipdate, l_tax"), *C.existing(t, ["l_returnflag", "l_none"])]
    return C.select_quoted(t, names).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {O._OVERLAY} SELECT doc_id, CASE WHEN label IS NULL THEN 'unlabelled' WHEN label = 0 THEN 'no' WHEN label = 1 THEN 'yes' ELSE 'other' END AS badge FROM overlay")
def label_badges(spark, d):
    return _overlay(spark, d).select("doc_id", C.badge(F.col("label"), {0.0: "no", 1.0: "yes"}, "other", "unlabelled").alias("badge"))


@query(f"WITH {O._TOK} SELECT t.doc_id, {O._clean('d.text')} AS clean_text, len(t.tokens)::BIGINT AS n_tokens, array_to_string(t.tokens, ' ') AS processed_text FROM tok t JOIN documents d ON d.doc_id = t.doc_id")
def process_documents(spark, d):
    return X.process(_docs(spark, d), "text", stemmed=False).select("doc_id", "clean_text", F.size("tokens").cast("long").alias("n_tokens"), "processed_text")


# -- topics ---------------------------------------------------------------------


@query("SELECT count(DISTINCT CASE WHEN label > 0 THEN label END) AS n_topics, count_if(label = 0)::BIGINT AS n_outliers, count(*) AS n, round(count_if(label = 0)::DOUBLE / nullif(count(*), 0), 6) AS share FROM embeddings")
def topic_outliers(spark, d):
    return topics.outliers(A.table(spark, d, "embeddings").select(F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("topic_id")))


_LANG_TOPICS = "CASE lang WHEN 'de' THEN 0 WHEN 'fr' THEN 1 WHEN 'es' THEN 2 ELSE -1 END"


@query(
    f"WITH {O._TOK.replace('FROM documents)', f'FROM documents WHERE {_LANG_TOPICS} >= 0)', 1)}, w AS (SELECT {_LANG_TOPICS} AS topic_id, word, count(*) AS tf FROM words GROUP BY 1, 2), f AS (SELECT word, sum(tf) AS f FROM w GROUP BY 1), t AS (SELECT topic_id, sum(tf) AS total FROM w GROUP BY 1), "
    f"m AS (SELECT avg(total) AS mean FROM t), x AS (SELECT w.topic_id, w.word, round(w.tf / t.total * ln(1 + m.mean / f.f), 9) AS weight FROM w JOIN f ON f.word = w.word JOIN t ON t.topic_id = w.topic_id, m), "
    f"k AS (SELECT topic_id, string_agg(word, ',' ORDER BY rank) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, word) AS rank FROM x) WHERE rank <= 10 GROUP BY 1), "
    f"n AS (SELECT {_LANG_TOPICS} AS topic_id, count(*) AS n FROM documents GROUP BY 1) SELECT n.topic_id, n.n AS count, k.keywords, NULL::VARCHAR AS label FROM n JOIN k USING (topic_id)"
)
def topic_keyword_table(spark, d):
    docs = _docs(spark, d)
    given = docs.select("doc_id", F.when(F.col("lang") == "de", 0).when(F.col("lang") == "fr", 1).when(F.col("lang") == "es", 2).otherwise(-1).alias("topic_id"))
    return topics.topic_keywords(docs, "doc_id", given, _words()).withColumn("keywords", F.array_join("keywords", ","))


@query()
def fit_topics(spark, d):
    """Topics of all documents from hashed vectors."""
    docs = A.articles(spark, d)
    return topics.fit_topics(docs, "id", cluster.hashing_embedder(docs, "id", "body"))


_INTO = "CASE WHEN topic_id < 10 THEN topic_id % 2 ELSE topic_id END"


@query(
    f"WITH {O._TOK}, w AS (SELECT source AS topic_id, word, count(*) AS tf FROM (SELECT substr(source, 4)::INT AS source, unnest(tokens) AS word FROM tok) GROUP BY 1, 2), "
    f"g AS (SELECT {_INTO} AS topic_id, word, sum(tf) AS tf FROM w GROUP BY 1, 2), f AS (SELECT word, sum(tf) AS f FROM g GROUP BY 1), t AS (SELECT topic_id, sum(tf) AS total FROM g GROUP BY 1), m AS (SELECT avg(total) AS mean FROM t), "
    "x AS (SELECT g.topic_id, g.word, g.tf, round(g.tf / t.total * ln(1 + m.mean / f.f), 9) AS weight FROM g JOIN f ON f.word = g.word JOIN t ON t.topic_id = g.topic_id, m) "
    "SELECT topic_id, word, tf::BIGINT AS tf, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, word) AS rank FROM x) WHERE rank <= 10"
)
def merged_topic_words(spark, d):
    """Counts and keywords of merged topics (sources, some of which are put together), from their parts' word table."""
    docs = _docs(spark, d).withColumn("topic_id", F.substring("source", 4, 9).cast("int"))
    words = Shelf(spark, "words").keep(cluster.class_words(docs, "topic_id", _words()))
    into = words.select("topic_id").distinct().withColumn("into", F.expr(_INTO))
    merged = topics.merged_words(words, into, "topic_id")
    best = stats.top_per_group(cluster.class_weights(merged, "topic_id"), "topic_id", "weight", "word", 10)
    return best.join(merged, ["topic_id", "word"]).select("topic_id", "word", "tf", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {O._TOK} SELECT 1 AS least, count(DISTINCT word) AS vocabulary FROM words")
def hyper_search(spark, d):
    best, size = models.search_word_vectors(_tokens(spark, d), "tokens")
    return spark.createDataFrame([(best["least"], int(size))], "least int, vocabulary long")


@query("SELECT label::VARCHAR AS cluster, count(*) AS n FROM (SELECT CASE WHEN label < 3 THEN -1 ELSE label END AS label FROM embeddings) GROUP BY 1")
def cluster_sizes(spark, d):
    return topics.cluster_sizes(A.table(spark, d, "embeddings").select(F.when(F.col("label") >= 3, F.col("label")).alias("cluster_id")))


# -- networks and reports ---------------------------------------------------------


@query(f"WITH {O._NATIONS} SELECT a AS node, (count(*) * 100)::BIGINT AS size FROM ways GROUP BY 1")
def node_sizes(spark, d):
    return graph.node_sizes(_nations(spark, d)).withColumn("size", F.col("size").cast("long"))


@query(
    "WITH m AS (SELECT DISTINCT user_id, ts::DATE AS day, event_type AS node FROM events), e AS (SELECT x.node AS a, y.node AS b, count(*) AS weight FROM m x JOIN m y ON x.user_id = y.user_id AND x.day = y.day AND x.node < y.node GROUP BY 1, 2 HAVING count(*) >= 5), "
    "w AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), s AS (SELECT count(DISTINCT a) AS nodes FROM w) SELECT 'actor_' || a AS node, count(*) AS degree, round(count(*) / nullif((SELECT nodes FROM s) - 1, 0), 6)::DOUBLE AS centrality FROM w GROUP BY 1"
)
def actor_network(spark, d):
    """The network of actor columns: a wide table, one column an actor."""
    kinds = [r[0] for r in A.table(spark, d, "events").select("event_type").distinct().orderBy("event_type").collect()]  # a handful of types
    wide = A.actor_counts(spark, d).groupBy("user_id", "day").pivot("node", kinds).agg(F.sum("n"))
    wide = wide.select("user_id", "day", *(F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(f"actor_{k}") for k in kinds))
    return graph.degree_centrality(graph.actor_network(wide, ["user_id", "day"], 5))


@query(
    f"WITH {O._TOK}, v AS (SELECT length(array_to_string(tokens, ' '))::DOUBLE AS v FROM tok), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v) "
    "SELECT 'length' AS panel, (CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) * 50 / (hi - lo)), 49) END)::INT::VARCHAR AS key, count(*)::DOUBLE AS value FROM v, e GROUP BY 2 "
    "UNION ALL SELECT * FROM (SELECT 'topic', lang, count(*)::DOUBLE FROM documents GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10) UNION ALL SELECT 'cluster', source, count(*)::DOUBLE FROM documents GROUP BY 2 "
    "UNION ALL SELECT 'summary', 'documents', count(*)::DOUBLE FROM v UNION ALL SELECT 'summary', 'mean_length', round(avg(v), 6) FROM v UNION ALL SELECT 'summary', 'median_length', median(v) FROM v"
)
def dashboard(spark, d):
    docs = X.process(_docs(spark, d), "text", stemmed=False)
    return stats.dashboard(docs, "processed_text", "lang", "source")


assert not set(QUERIES) & set(EARLIER)
